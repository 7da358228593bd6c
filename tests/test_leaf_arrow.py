"""Spans that Python's re finds, as Arrow lists."""

import re

import pyarrow as pa
import pytest

from veilspark.functions import spans as S


def rows(pattern, texts):
    compiled = re.compile(pattern)
    group = "v" if "v" in compiled.groupindex else 0
    return [
        [
            {"start": m.start(group), "end": m.end(group), "raw": m[group]}
            for m in (compiled.finditer(t) if t else ())
            if m[group] is not None
        ]
        for t in texts
    ]


@pytest.mark.parametrize("pattern", [r"(?:a|b)+c", r"x(?P<v>\d+)?", "日"])
def test_spans_are_those_of_re(monkeypatch, pattern):
    monkeypatch.setattr(S, "TEXTS_AT_ONCE", 3)
    texts = ["abc x1 日", None, "", "x", "x22 x aac", "日日", "none", "bbc x9"]
    got = S._spans_of(re.compile(pattern), pa.array(texts, pa.string()))
    assert got.to_pylist() == rows(pattern, texts)
    assert S._spans_of(re.compile(pattern), pa.array([], pa.string())).to_pylist() == []
