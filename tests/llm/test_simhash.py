import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from veilspark.llm import near
from veilspark.llm import simhash as S
from veilspark.llm.components import components

from .data import awkward, prose, table, with_clashes

MASK = (1 << 64) - 1


def fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints):
    """Smallest number reachable, for each of a list of fingerprints, by all pairs."""
    n = len(prints)
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 2 and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return root


def test_fingerprints_and_components(spark):
    base = prose(9, 400).split()
    near = []
    for i in range(40):
        changed = list(base)
        changed[i * 7] = f"new{i}"
        near.append((100 + i, " ".join(changed), "en", "hot", 1))
    rows = awkward() + near
    got = {}
    for r in S.near_duplicates(with_clashes(table(spark, rows))).collect():
        got.setdefault((r.doc_id, r.fingerprint), set()).add(r.component_id)
    prints = [fingerprint(r[1]) for r in rows]
    root = classes(prints)
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i]]
        least = min((x for x in ids if x is not None), default=None)
        assert got[(r[0], f"{prints[i]:016x}")] == {least}
    assert len({root[i] for i in range(14, len(rows))}) < 30  # some are linked


def test_links_of_close_fingerprints(spark):
    chance = random.Random(3)
    seeds = [chance.getrandbits(64) for _ in range(60)]
    values = set(seeds)
    for s in seeds:
        chain = s
        for _ in range(chance.randrange(6)):  # chains of one to three changed bits
            for _ in range(chance.choice([1, 2, 2, 3])):
                chain ^= 1 << chance.randrange(64)
            values.add(chain)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "_fingerprint long")
    found = {r.node: r.root for r in components(S.fingerprint_links(df)).collect()}
    want = classes(values)
    groups, same = {}, {}
    for v, s, w in zip(values, signed, want, strict=True):
        groups.setdefault(w, []).append(s)
        same.setdefault(found.get(s, s), []).append(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, same.values()))


def test_anchors_cover():
    chance = random.Random(4)
    for _ in range(300):
        x = chance.getrandbits(64)
        y = x ^ 1 << chance.randrange(64) ^ 0
        y ^= 1 << chance.randrange(64)
        pair = np.array([x, y], np.uint64)
        rows, keys = S.anchors(pair)
        assert set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist())
        assert (rows == 0).sum() <= 34


def test_large_buckets_both_ways(monkeypatch):
    chance = np.random.default_rng(5)
    center = np.uint64(chance.integers(1 << 62))
    bits = np.uint64(1) << chance.integers(0, 64, (600, 4)).astype(np.uint64)
    values = np.unique(np.bitwise_xor.reduce(bits, axis=1) ^ center)
    compared = S._close_to_any(values)
    monkeypatch.setattr(S, "PROBE", 0)
    assert (S._close_to_any(values) == compared).all()
    monkeypatch.setattr(S, "BUCKET", 10)
    keys = np.zeros(len(values), np.uint64)
    a, b = S.bucket_links(keys, values)
    monkeypatch.setattr(S, "BUCKET", 10_000)
    c, d = S.bucket_links(keys, values)
    assert sorted(zip(a, b, strict=True)) == sorted(zip(c, d, strict=True)) and len(a)


def test_buckets_cut_by_batches():
    keys = np.sort(np.random.default_rng(6).integers(0, 30_000, 300_000)).astype(np.int64)
    values = np.random.default_rng(7).integers(0, 4, 300_000).astype(np.int64) << 20
    whole = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values)], names=["a", "f"])
    parts = [whole.slice(i, 10_000) for i in range(0, 300_000, 10_000)]
    links = lambda batches: {
        (a, b)
        for x in S._compare(iter(batches))
        for a, b in zip(x["a"].to_pylist(), x["b"].to_pylist(), strict=True)
    }
    assert links(parts) == links([whole])


def test_representatives(spark):
    docs = with_clashes(table(spark))
    kept = S.keep_representatives(docs)
    assert kept.columns == docs.columns
    rows = awkward()
    root = classes([fingerprint(r[1]) for r in rows])
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    wanted = [rows[min((i for i in range(len(rows)) if root[i] == c), key=order)][0] for c in set(root)]
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=str) == sorted(wanted, key=str)
    assert S.keep_representatives(table(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    df = spark.createDataFrame([*chain, *star, (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}
    assert components(df.filter("false")).count() == 0


def edited(seed, n, changes):
    words = prose(seed, n).split()
    for i in range(changes):
        words[(2 * i + 1) * n // (2 * changes)] = f"edit{i}"
    return " ".join(words)


def test_representatives_of_near_copies(spark):
    near_copies = [(i, edited(21, 300, i), "en", "a", 1) for i in range(7)]
    far = [(20, edited(21, 300, 40), "en", "a", 1), (21, prose(22, 300), "en", "a", 1)]
    chain = [(30 + i, " ".join(prose(23, 400).split()[15 * i :][:300]), "en", "a", 1) for i in range(7)]
    rows = [*near_copies, *far, *chain]
    root = classes([fingerprint(r[1]) for r in rows])
    wanted = {min(r[0] for r, k in zip(rows, root) if k == c) for c in set(root)}
    kept = S.keep_representatives(table(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(wanted)


def test_recall_at_the_threshold():
    chance, met = np.random.default_rng(8), 0
    for _ in range(1000):
        words = chance.integers(0, 2**63, 360, dtype=np.uint64)
        _, a = near.sketch(words[:324])
        _, b = near.sketch(words[36:])  # 288 of 360: 0.8
        met += bool({*a} & {*b})
    assert met >= 990


def test_representatives_share_ids_or_have_none(spark):
    ids = [None, None, None, 5, 5, None]
    texts = [prose(31 + i, 100) for i in range(5)] + [prose(31, 100)]
    rows = [(i, t, "en", "a", 1) for i, t in zip(ids, texts, strict=True)]
    kept = S.keep_representatives(table(spark, rows)).collect()
    assert sorted(r.text for r in kept) == sorted(set(texts))
