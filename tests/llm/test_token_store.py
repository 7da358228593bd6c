import glob
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from veilspark.llm import token_store as T

from .data import awkward, prose, table, with_clashes

ODD = [
    "A'RE it's. x.", "a...b , . ,\n\n x<|endoftext|>. é. É É́ é ́x 1.2, 'S", "Ünï.   x y.\x85z",
    "İ K ſ ς Σ. ", "Straße ÀÉÎÕÜ ĳ Ĳ ŉ ŀ ǅ ÷ × a×b Ąćż ŸÝ ſſ İı Ğğ é ß.\n\nß­x  y",
    "日本 語。 कि नमस्ते 😀😀 x😀", "don't we're I'm’s ẞ Ω Å <|startoftext|>", "x.\ny,z ,q .w", "<|ENDOFTEXT|>",
]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(T.default_tokenizer())
    return lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, T.END_ID]


def rows():
    return awkward() + [(50 + i, t, "xx", "a", 1) for i, t in enumerate(ODD)] + [
        (70 + i, prose(i, 50), "en", "a", 1) for i in range(40)
    ]


def test_files_hold_the_tokens(spark, plain):
    got = T.token_report(spark, with_clashes(table(spark, rows()))).collect()
    assert len(got) == len(rows())
    got.sort(key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0))
    at, want = 0, {}
    for r in rows():
        crc = zlib.crc32(np.array(plain(r[1]), "<u4").tobytes())
        want.setdefault(r[0], []).append((len(plain(r[1])), crc))
    for r in got:
        assert r.start == at
        at += r.n_tokens
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
    assert not any(want.values())
    assert T.token_report(spark, table(spark, [])).count() == 0


def test_small_caches_give_the_same(plain, monkeypatch):
    monkeypatch.setattr(T, "CACHED_CHUNKS", 3)
    monkeypatch.setattr(T, "TOGETHER", 2)
    encoder = T.ChunkEncoder(T.default_tokenizer())
    for text in [r[1] or "" for r in rows()] * 2:
        data = np.frombuffer(text.encode(), np.uint8)
        ids, borders = encoder.encode(data, np.array([0, len(data)]))
        assert ids.tolist() == plain(text) and borders.tolist() == [0, len(ids)]


def test_selective_reads(spark, tmp_path, plain):
    folder = str(tmp_path / "tokens")
    docs = [(i, prose(i, 30), "en", "a", 1) for i in range(300)]
    T.write_tokens(table(spark, docs), folder, T.default_tokenizer())
    some = {r.doc_id: r.ids for r in T.read_tokens(spark, folder, 20, 29).collect()}
    assert some == {i: plain(docs[i][1]) for i in range(20, 30)}
    plan = T.read_tokens(spark, folder, 20, 29)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,20)" in plan
    meta = T.read_metadata(spark, folder)
    assert "ids" not in meta._jdf.queryExecution().executedPlan().toString()
    assert meta.agg({"n_tokens": "sum"}).first()[0] == sum(len(plain(d[1])) for d in docs)
    file = pq.ParquetFile(sorted(glob.glob(f"{folder}/*.parquet"))[0])
    column = file.metadata.row_group(0).column(4)
    assert "ids" in column.path_in_schema and column.has_offset_index
    assert any("DICTIONARY" in e for e in column.encodings)


def _one_slice(encoder, texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    ids, borders = encoder.encode(data, offsets)
    return [ids[a:b].tolist() for a, b in zip(borders[:-1], borders[1:])]


def test_a_slice_gives_each_text_its_own_ids(plain):
    import random

    encoder = T.ChunkEncoder(T.default_tokenizer())
    fixed = ["Hello World again", "x <| y", "word\x1c next", "a\x1f b", "café\x1d", "über\x1e",
             "\x1chello", "Tab\there", "CAPS and\r\nLines", ""]
    assert _one_slice(encoder, fixed) == [plain(t) for t in fixed]
    chance = random.Random(3)
    alphabet = [chr(c) for c in range(0x20, 0x3000) if chr(c).isprintable()]
    alphabet += ["\x1c", "\x1d", "\x1e", "\x1f", " ", " ", "\n", "\t", "<|", "A", "z"]
    for _ in range(20):
        texts = ["".join(chance.choice(alphabet) for _ in range(chance.randrange(0, 40))) for _ in range(30)]
        texts += [chance.choice(fixed) + " " + t for t in texts[:5]]
        assert _one_slice(encoder, texts) == [plain(t) for t in texts]
