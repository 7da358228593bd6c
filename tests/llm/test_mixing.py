import math

import pytest
from pyspark.sql import functions as F

from veilspark.llm import mixing
from veilspark.llm.mixing import mix_documents, mix_report

from .data import DOCS, prose, table, with_clashes


def sizes_and_targets(rows):
    by = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r)
    return by


def test_targets_and_takes(spark):
    rows = [(i, prose(i, 20 + i % 7), "en", f"s{i % 5}" if i % 3 else "hot", 1) for i in range(400)]
    docs = table(spark, rows)
    got = mix_report(docs).collect()
    assert len(got) == 400
    total = sum(r.size for r in got)
    sources = {(r.source_size, r.target) for r in got}
    assert math.isclose(sum(t for _, t in sources), total)
    assert all(t <= 3 * s for s, t in sources)
    for (_, target), own in sizes_and_targets(got).items():
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own)
        assert all(r.taken % r.size == 0 and r.taken <= 3 * r.size for r in own)
        counts = {r.taken // r.size for r in own}
        assert max(counts) - min(counts) <= 1  # whole epochs first
    again = mix_report(docs.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_buckets_do_not_change_the_result(spark, monkeypatch):
    rows = [(i, prose(i, 10 + i % 9), "en", f"s{i % 3}", 1) for i in range(300)]
    want = sorted(map(tuple, mix_report(table(spark, rows)).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    assert sorted(map(tuple, mix_report(table(spark, rows)).collect())) == want


def test_awkward_rows(spark):
    got = mix_report(with_clashes(table(spark))).collect()
    assert len(got) == 14
    assert all(r.taken == 0 for r in got if r.size == 0)
    assert mix_report(table(spark, [])).collect() == []
    mixed = mix_documents(with_clashes(table(spark)))
    assert mixed.columns == with_clashes(table(spark)).columns
    taken = sum(r.taken for r in got)
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    assert mixed.agg(F.sum(words)).first()[0] == taken


def test_only_sql(spark):
    plan = mix_report(table(spark))._jdf.queryExecution().toString()
    assert not any(name in plan for name in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("weights", [(1,), (5, 1)])
def test_other_weights(spark, weights):
    rows = [(i, "w " * 10, "en", f"s{i % 2}", 1) for i in range(40)]
    targets = {r.target for r in mix_report(table(spark, rows, DOCS), weights).collect()}
    want = [200.0] if weights == (1,) else [400 / 6, 2000 / 6]
    assert sorted(targets) == pytest.approx(want)
