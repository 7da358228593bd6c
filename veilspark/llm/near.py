"""Near copies: rows whose sets of five-word shingles have a Jaccard share of 0.8 or more.

Candidates meet in ``BANDS`` bands of ``ROWS`` least hashes: a pair at 0.8 meets with
probability 0.998, a closer one more surely. Every candidate is confirmed by the whole
sets of both. First each set is compared with the least of its buckets, which joins
large groups by few pairs; then all that meet and are not yet joined are compared,
but for pairs whose sketches agree in under ``AGREE`` places (a pair at 0.8 does so
in about one case of 100,000).

Sets are told apart by a 64-bit hash; equal ones are one row before anything is paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .tables import stored
from .textbytes import LOWER, NOT_SPACE, mix, slices, span_hashes, texts_of, words_of

SHINGLE = 5
BANDS, ROWS = 16, 5
AGREE = 48
FACTORS = np.random.default_rng(11).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * 2 + 1
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _joined(hashes: list[np.ndarray]) -> np.ndarray:
    out = np.full_like(hashes[0], len(hashes))
    for h in hashes:
        out = mix(out * _STEP + h)
    return out


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's shingles: letters A-Z are lowered, words are
    separated by ASCII white spaces, fewer than five are one shingle."""
    data, offsets = texts_of(column)
    data = LOWER[data]
    starts, ends, borders = words_of(data, offsets, NOT_SPACE)
    words = span_hashes(data, starts, ends)
    n = max(0, len(words) - SHINGLE + 1)
    shingles = _joined([words[i : i + n] for i in range(SHINGLE)])
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            yield np.unique(shingles[a : b - SHINGLE + 1])
        else:
            yield _joined([words[i : i + 1] for i in range(a, b)]) if b > a else words[:0]


def set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def sketch(hashes: np.ndarray) -> tuple[bytes, list[int]]:
    """A byte of each least hash, and the keys of the bands; an empty set has none."""
    if not len(hashes):
        return b"", []
    least = np.full(len(FACTORS), 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 1 << 12):
        part = hashes[i : i + (1 << 12), None] * FACTORS
        np.minimum(least, part.min(0), out=least)
    least = mix(least)
    bands = least.reshape(BANDS, ROWS)
    keys = _joined([np.arange(BANDS, dtype=np.uint64), *bands.T])
    return (least & np.uint64(255)).astype(np.uint8).tobytes(), keys.view(np.int64).tolist()


def sketches(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Columns ``keep``, ``_set``, ``_sketch`` and ``_keys`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, text):
            sets = [*shingle_sets(batch.column(text))]
            both = [sketch(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep]
                + [
                    pa.array([set_id(s) for s in sets], pa.int64()),
                    pa.array([x for x, _ in both], pa.binary()),
                    pa.array([k for _, k in both], pa.list_(pa.int64())),
                ],
                names=[*keep, "_set", "_sketch", "_keys"],
            )

    blank = F.expr("cast(null AS struct<_set:bigint,_sketch:binary,_keys:array<bigint>>)")
    schema = docs.select(*keep, blank.alias("b")).select(*keep, "b.*").schema
    return docs.select(*keep, text).mapInArrow(run, schema)


def _whole_sets(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for part in slices([batch], "text"):
            sets = [*shingle_sets(part.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("_set"),
                    pa.array([set_id(s) for s in sets], pa.int64()),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                names=["_set", "own", "shingles"],
            )


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that share 0.8 of their shingles."""
    a = sets.select(F.col("_set").alias("a"), F.col("shingles").alias("of_a"))
    b = sets.select(F.col("_set").alias("b"), F.col("shingles").alias("of_b"))
    same = "9 * size(array_intersect(of_a, of_b)) >= 4 * (size(of_a) + size(of_b))"
    return pairs.join(b, "b").join(a, "a").filter(same).select("a", "b")


def _meet(batches: Iterator[pa.RecordBatch]):
    """Pairs of one bucket with different roots and like sketches; rows come by key."""

    def pairs(rows: list[tuple]):
        ids, roots = (np.array([r[i] for r in rows], np.int64) for i in (1, 2))
        own = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)
        for i in range(len(rows) - 1):
            like = (own[i + 1 :] == own[i]).sum(1) >= AGREE
            for j in np.flatnonzero(like & (roots[i + 1 :] != roots[i])) + i + 1:
                yield max(ids[i], ids[j]), min(ids[i], ids[j])

    def batch(found):
        a, b = zip(*found, strict=True) if found else ((), ())
        arrays = [pa.array(x, pa.int64()) for x in (a, b)]
        return pa.RecordBatch.from_arrays(arrays, names=["a", "b"])

    held, found = [], set()
    for given in batches:
        for row in zip(*(c.to_pylist() for c in given.columns), strict=True):
            if held and row[0] != held[0][0]:
                found.update(pairs(held))
                held = []
            held.append(row)
        if len(found) > 100_000:
            yield batch(found)
            found = set()
    if held:
        found.update(pairs(held))
    yield batch(found)


def with_roots(rows: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Adds ``_root`` to the rows of ``sketches``: the least set of those reachable by
    near copies. Both tables have ``_row``, by which texts of candidates are found."""
    copies = rows.select("_set", F.explode("_keys").alias("key")).distinct()
    bucket = Window.partitionBy("key")
    copies = copies.withColumn("least", F.min("_set").over(bucket))
    copies = copies.withColumn("most", F.max("_set").over(bucket)).filter("least < most")
    copies = stored(copies.drop("most"), "buckets")
    needed = copies.select("_set").distinct()
    one = rows.join(needed, "_set").groupBy("_set").agg(F.min("_row").alias("_row"))
    texts = docs.select("_row", F.col(text).alias("text")).join(one, "_row")
    sets = texts.select("_set", "text").mapInArrow(
        _whole_sets, "_set long, own long, shingles array<long>"
    )
    sets = sets.filter("_set = own").groupBy("_set").agg(F.first("shingles").alias("shingles"))
    sets = stored(sets, "sets")

    stars = copies.filter("_set > least").select(
        F.col("_set").alias("a"), F.col("least").alias("b")
    )
    stars = stored(stars.distinct(), "pairs")
    links = stored(_confirmed(stars, sets), "links")
    roots = stored(components(links), "roots").withColumnRenamed("node", "_set")
    root = F.coalesce("root", "_set").alias("root")
    known = copies.join(roots, "_set", "left").select("key", "_set", root)
    known = known.withColumn("least", F.min("root").over(bucket))
    known = known.withColumn("most", F.max("root").over(bucket)).filter("least < most")
    known = stored(known.drop("least", "most"), "open")
    own = rows.join(known.select("_set").distinct(), "_set")
    own = own.groupBy("_set").agg(F.min("_sketch").alias("_sketch"))
    more = known.join(own, "_set").select("key", "_set", "root", "_sketch")
    more = more.repartition("key").sortWithinPartitions("key")
    more = more.mapInArrow(_meet, "a long, b long").distinct().join(stars, ["a", "b"], "left_anti")
    more = stored(_confirmed(stored(more, "pairs"), sets), "links")
    if not more.isEmpty():
        roots = components(links.union(more)).withColumnRenamed("node", "_set")
    return rows.join(roots, "_set", "left").withColumn("_root", root)
