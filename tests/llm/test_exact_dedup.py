import hashlib

import numpy as np

from veilspark.llm import exact_dedup as E

from .data import awkward, table, with_clashes


def brute(rows):
    """Expected (doc_id, keep_id, group_size, kept, sha) of each row, kept by one per group."""
    sha = [hashlib.sha256((r[1] or "").encode()).hexdigest() for r in rows]
    out, seen = [], set()
    for r, h in zip(rows, sha, strict=True):
        ids = [q[0] for q, g in zip(rows, sha, strict=True) if g == h]
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        kept = r[0] == keep and h not in seen
        seen |= {h} if kept else set()
        out.append((r[0], keep, len(ids), kept, h))
    return sorted(out, key=str)


def test_filter_has_no_false_negatives_and_few_positives():
    chance = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 10, 1000, 100_000):
        keys = chance.integers(0, 2**63, n, dtype=np.uint64)
        f = E.build_filter(keys)
        assert E.may_contain(keys, *f).all()
        if n:
            assert len(f[3]) <= 1.5 * n + 64
        other = chance.integers(0, 2**63, 200_000, dtype=np.uint64)
        assert E.may_contain(other, *f).mean() < (0.01 if n else 1e-9)
    keys = np.array([5, 5, 5, 7], np.uint64)
    assert E.may_contain(keys, *E.build_filter(keys)).all()


def test_awkward_rows_against_brute_force(spark):
    rows = awkward()
    got = E.exact_duplicates(spark, with_clashes(table(spark)))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_any_split_gives_the_same_rows(spark):
    texts = ["a", "b", "a", "c", "a", "b", None, "", "d" * 100_000]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, "c", "en", "s", 1)]
    want = brute(rows)
    for split in (-1, 0, 3, 5, 100):
        got = E.exact_duplicates(spark, table(spark, rows), split=split)
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_a_large_group_of_copies(spark):
    rows = [(i, "same text" if i % 3 else f"t{i % 7}", "en", "s", 1) for i in range(3000)]
    got = E.exact_duplicates(spark, table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_empty_table(spark):
    assert E.exact_duplicates(spark, table(spark, [])).count() == 0
