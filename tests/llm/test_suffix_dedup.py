import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from veilspark.llm import suffix_dedup as S

from .data import awkward, prose, table, with_clashes

LAST = float("inf")


def brute(rows):
    first = {}
    texts = [(LAST if r[0] is None else r[0], (r[1] or "").encode()) for r in rows]
    for doc, t in texts:
        for i in range(len(t) - 49):
            key = t[i : i + 50]
            first[key] = min(first.get(key, LAST), doc)
    out = []
    for (doc, t), r in zip(texts, rows, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < doc:
                gone[i : i + 50] = b"\x01" * 50
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((r[0], len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def report(docs):
    return sorted((tuple(r) for r in S.repeats_report(docs).collect()), key=repr)


def many():
    chance = random.Random(8)
    parts = [prose(100 + i, 12) for i in range(12)]
    rows = awkward()
    for i in range(60):
        own = [prose(200 + i + 60 * j, chance.randrange(12)) for j in range(4)]
        mixed = [x for o in own for x in (o, chance.choice(parts)[chance.randrange(30) :])]
        rows.append((20 + i, " ".join(mixed), "en", "a", 1))
    rows += [(200 + i, "ab" * (40 + i) + "x" * 90, "en", "a", 1) for i in range(4)]
    rows += [(210, "é" * 60, "en", "a", 1), (211, "x" + "é" * 60, "en", "a", 1)]
    return rows


def test_against_brute_force(spark):
    rows = many()
    want = brute(rows)
    assert report(with_clashes(table(spark, rows))) == want
    assert sum(w[2] > 0 for w in want) > 30


def in_one_process(rows, partitions=3):
    """The steps of the job without Spark: (doc, start) of every repeated string."""
    docs = pa.record_batch(
        {
            "_id": pa.array([S.LAST if r[0] is None else r[0] for r in rows]),
            "_salt": pa.array(range(len(rows)), pa.int64()),
            "text": pa.array([r[1] for r in rows], pa.string()),
        }
    )
    cut = pa.Table.from_batches(list(S._cut(partitions)(iter([docs]))))
    found = pa.concat_tables(
        [S._match(cut.filter(pc.equal(cut["p"], p))) for p in set(cut["p"].to_pylist())]
    ).to_pylist()
    kind = pa.struct([(c, pa.int32()) for c in ("start", "n", "p", "anchor", "kind")])
    asked = [[f for f in found if f["kind"] and f["salt"] == k] for k in range(len(rows))]
    asked = [[{c: f[c] for c in ("start", "n", "p", "anchor", "kind")} for f in a] for a in asked]
    with_asked = pa.record_batch(
        [*docs.columns, pa.array(asked, pa.list_(kind))], names=["_id", "_salt", "text", "asked"]
    )
    pieces = pa.Table.from_batches(list(S._bytes_asked(partitions)(iter([with_asked]))))
    more = [
        r
        for p in range(partitions)
        for r in S._compare(pieces.filter(pc.equal(pieces["p"], p))).to_pylist()
    ]
    repeats = [f for f in found if f["kind"] == S.REPEAT] + more
    return {(r["salt"], r["start"] + i) for r in repeats for i in range(r["n"])}


@pytest.mark.parametrize("name, value", [("CROWDED", 0), ("BLOCK", 200), ("SLICE", 1000)])
def test_other_ways_give_the_same(monkeypatch, name, value):
    want = in_one_process(many())
    monkeypatch.setattr(S, name, value)
    assert in_one_process(many()) == want and len(want) > 1000


def test_empty_table(spark):
    assert report(table(spark, [])) == []


def test_suffix_arrays():
    chance = random.Random(9)
    for _ in range(400):
        n, top = chance.randrange(60), chance.choice([1, 2, 3, 30])
        x = np.array([chance.randint(1, top) for _ in range(n)], np.int64)
        assert S.suffix_array(x).tolist() == sorted(range(n), key=lambda i: x[i:].tolist())


def test_pieces_hold_every_string_once():
    texts = [t for t in (prose(i, i * 5).encode() for i in range(30))] + [b"a" * 300, b""]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    doc, start, n, anchor = S.pieces_of(data, offsets)
    strings = {}
    for d, s, k, a in zip(doc.tolist(), start.tolist(), n.tolist(), anchor.tolist(), strict=True):
        for i in range(s, s + k):
            strings.setdefault(texts[d][i : i + 50], set()).add(a)
            assert len(texts[d][i : i + 50]) == 50
    assert all(len(a) == 1 for a in strings.values())  # equal strings share an anchor
    assert n.sum() == sum(max(0, len(t) - 49) for t in texts)


def test_hashes_that_occur_once_are_not_sorted():
    from veilspark.llm.suffix_dedup import _maybe_twice

    chance = np.random.default_rng(5)
    hashes = chance.integers(0, 2**63, 50_000, dtype=np.uint64)
    hashes[100:200] = hashes[40_000:40_100]
    hashes[7] = hashes[8] = hashes[9]
    values, times = np.unique(hashes, return_counts=True)
    twice = np.flatnonzero(np.isin(hashes, values[times > 1]))
    found = _maybe_twice(hashes)
    assert np.isin(twice, found).all() and len(found) < len(hashes) // 2
    assert len(_maybe_twice(hashes[:0])) == 0 and len(_maybe_twice(hashes[:1])) == 0


def peak_mb(run):
    """The most that numpy and Python hold at a time, beyond what they hold before."""
    tracemalloc.start()
    run()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / 1e6


def asked_pieces(anchors, each, piece=100, seed=3):
    """Rows of step 3 in order of their anchors; each anchor has a string in two documents."""
    chance = np.random.default_rng(seed)
    rows = anchors * each
    texts = chance.integers(32, 127, (rows, piece), dtype=np.uint8)
    if each > 1:
        texts[1::each, :60] = texts[::each, :60]
        texts[1::each, 60] = texts[::each, 60] ^ 1
    return pa.record_batch(
        {
            "p": pa.array(np.zeros(rows, np.int32)),
            "anchor": pa.array(np.repeat(np.arange(anchors, dtype=np.int32), each)),
            "doc": pa.array(np.arange(rows)),
            "salt": pa.array(np.zeros(rows, np.int64)),
            "start": pa.array(np.zeros(rows, np.int32)),
            "piece": pa.array([t.tobytes() for t in texts], pa.binary()),
        }
    )


def in_batches(rows, n):
    return iter([rows.slice(i, n) for i in range(0, rows.num_rows, n)])


def test_pieces_are_compared_some_anchors_at_a_time():
    pieces = asked_pieces(20_000, 4)  # 8 MB
    found = []
    most = peak_mb(lambda: found.extend(r for b in S._compared(in_batches(pieces, 10_000)) for r in b.to_pylist()))
    assert most < 100
    assert sorted((f["doc"], f["start"], f["n"]) for f in found) == [
        (4 * i + 1, 0, 11) for i in range(20_000)
    ]


@pytest.mark.parametrize("block", [1, 300, 5_000, 1 << 20])
@pytest.mark.parametrize("batch", [1, 3, 7, 1000])
def test_anchors_stay_whole(monkeypatch, block, batch):
    monkeypatch.setattr(S, "BLOCK", block)
    pieces = pa.concat_batches([asked_pieces(9, 4), asked_pieces(1, 40), asked_pieces(9, 1)])
    pieces = pieces.take(pc.sort_indices(pieces, [("anchor", "ascending")]))
    tables = list(S._whole_anchors(in_batches(pieces, batch)))
    assert pa.concat_tables(tables).equals(pa.Table.from_batches([pieces]))
    seen = [set(t["anchor"].to_pylist()) for t in tables]
    assert sum(map(len, seen)) == len(set.union(*seen)) and len(seen) == (1 if block > 9000 else len(seen))
    if block == 1:
        assert all(len(a) == 1 for a in seen)


def cut_and_matched(rows, partitions=1):
    docs = pa.record_batch(
        {
            "_id": pa.array([r[0] for r in rows]),
            "_salt": pa.array([0] * len(rows)),
            "text": pa.array([r[1] for r in rows], pa.string()),
        }
    )
    return list(S._cut(partitions)(iter([docs])))


def test_pieces_are_matched_some_anchors_at_a_time(monkeypatch):
    rows = [(i, prose(i, 150)) for i in range(1500)]
    rows += [(2000 + i, prose(i, 150) + prose(9000 + i, 20)) for i in range(300)]
    monkeypatch.setattr(S, "SLICE", 100_000)
    cut = cut_and_matched(rows)
    key = ("doc", "start", "n", "anchor", "kind")

    def found():
        return sorted(tuple(r[k] for k in key) for b in S._matched(iter(cut)) for r in b.to_pylist())

    want = found()
    monkeypatch.setattr(S, "TOGETHER", 1000)
    assert found() == want and {w[-1] for w in want} == {S.REPEAT, S.ASK}


def test_long_texts_are_hashed_in_steps(monkeypatch):
    rows = [(i, prose(i, 900)) for i in range(3)] + [(3, ""), (4, prose(1, 900)), (5, "x" * 49)]
    want = in_one_process(rows)
    monkeypatch.setattr(S, "STEP", 100)
    assert in_one_process(rows) == want and len(want) > 3000
    text = np.frombuffer(prose(1, 500_000).encode(), np.uint8)
    monkeypatch.undo()
    assert peak_mb(lambda: S._hashed_pieces(text, np.array([0, len(text)]))) < 40 * len(text) / 1e6


def test_known_repeats_are_dealt_evenly():
    line = "the very same line stands in each of the documents of this slice, and in full"
    cut = pa.Table.from_batches(cut_and_matched([(i, line) for i in range(2000)], 16)).to_pylist()
    known = {r["p"]: sum(r["known"]) for r in cut}
    assert len(known) == 16 and max(known.values()) < 2 * min(known.values())


def test_shuffle_of_the_stored_table_goes_at_once(spark, monkeypatch):
    seen, stored = [], S.stored

    def watched(*given):
        seen.append(spark.conf.get(S.FILE_CLEANUP))
        return stored(*given)

    monkeypatch.setattr(S, "stored", watched)
    before = spark.conf.get(S.FILE_CLEANUP)
    S.repeats_report(table(spark, awkward()))
    assert seen == ["true"] and spark.conf.get(S.FILE_CLEANUP) == before
