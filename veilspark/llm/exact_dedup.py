"""Exact duplicates against immutable snapshots, screened by binary fuse filters.

A snapshot is what was ingested before: one row per distinct text (its SHA-256, its
bytes, the largest doc_id and the number of rows that carried it), written once and
never changed, and one static binary fuse filter per bucket of its digests. A new
batch is first grouped on its own digests, so that copies inside the batch are one
row however many there are. Only those distinct digests are screened against the
filters of their bucket; a digest that passes joins the snapshot's exact bucket,
where the bytes of both texts are compared. What fails the filter, or passes it
only by chance, is a new group.

The filter (Graf and Lemire, "Binary Fuse Filters", 2022) keeps 8 bits per slot in
some 1.13 slots per key. A key has three slots in three consecutive segments; the
XOR of their bytes equals the key's own fingerprint. It is built by peeling: slots
that hold one key give it up, round by round, and bytes are assigned in the reverse
order. It has no false negatives; about one digest in 256 passes by chance.

Texts are equal when their bytes are: no normalisation, a null text is the empty
text. Of equal texts the row with the largest doc_id stays.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import set_aside, stored

KEYS_PER_FILTER = 200_000
"""Distinct digests of one filter at most: the snapshot has as many buckets as that needs."""
SEEDS = 64
"""Seeds tried before a filter is given up; peeling fails with odds far below 1 in 10^6."""
M64 = (1 << 64) - 1


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser of MurmurHash3 over ``keys ^ seed``."""
    with np.errstate(over="ignore"):
        h = keys ^ np.uint64(seed * 0x9E3779B97F4A7C15 & M64)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
    return h


def _shape(n: int) -> tuple[int, int]:
    """Segment length (a power of two) and number of segments for ``n`` keys."""
    n = max(n, 2)
    length = 1 << min(18, int(math.floor(math.log(n) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
    count = max(1, -(-round(n * factor) // length) - 2)
    return length, count


def _slots(h: np.ndarray, length: int, count: int) -> np.ndarray:
    """The three slots of each hash, shape (3, n)."""
    first = ((h >> np.uint64(32)) * np.uint64(length * count)) >> np.uint64(32)
    mask = np.uint64(length - 1)
    second = (first + np.uint64(length)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * length)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _print(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segments, bytes) of a filter of these 64-bit keys.

    Repeated keys count once; no keys give an empty filter that holds nothing.
    """
    keys = np.unique(np.asarray(keys, dtype=np.uint64))
    n = len(keys)
    if n == 0:
        return 0, 1, 0, b""
    length, count = _shape(n)
    size = (count + 2) * length
    for seed in range(SEEDS):
        h = _mix(keys, seed)
        slots = _slots(h, length, count)
        held = np.bincount(slots.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        for row in slots:
            np.bitwise_xor.at(owner, row, np.arange(n))
        rounds, peeled = [], 0
        while True:
            single = np.flatnonzero(held == 1)
            if not single.size:
                break
            key, first = np.unique(owner[single], return_index=True)
            rounds.append((key, single[first]))
            peeled += len(key)
            for row in slots:
                np.subtract.at(held, row[key], 1)
                np.bitwise_xor.at(owner, row[key], key)
        if peeled < n:
            continue
        table = np.zeros(size, np.uint8)
        for key, slot in reversed(rounds):
            value = _print(h[key])
            for row in slots:
                value ^= table[row[key]]
            table[slot] = value
        return seed, length, count, table.tobytes()
    raise RuntimeError(f"no binary fuse filter for {n} keys in {SEEDS} seeds")


def may_contain(keys: np.ndarray, seed: int, length: int, count: int, table: bytes) -> np.ndarray:
    """False where a key is surely not in the filter; true for all keys that are."""
    keys = np.asarray(keys, dtype=np.uint64)
    if not table:
        return np.zeros(len(keys), bool)
    h = _mix(keys, seed)
    slots = _slots(h, length, count)
    t = np.frombuffer(table, np.uint8)
    return (t[slots[0]] ^ t[slots[1]] ^ t[slots[2]]) == _print(h)


FILTER = "_bucket long, seed long, seg_length long, segments long, table binary"


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    seed, length, count, table = build_filter(rows["_key"].to_numpy().astype(np.uint64))
    return pd.DataFrame(
        {"_bucket": [int(rows["_bucket"].iloc[0])], "seed": [seed], "seg_length": [length],
         "segments": [count], "table": [table]}
    )


def _probe(digests: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if digests.empty:
        return digests[["_sha"]].assign(_maybe=pd.Series(dtype=bool))
    keys = digests["_key"].to_numpy().astype(np.uint64)
    if filters.empty:
        maybe = np.zeros(len(keys), bool)
    else:
        f = filters.iloc[0]
        maybe = may_contain(keys, int(f.seed), int(f.seg_length), int(f.segments), f.table)
    return pd.DataFrame({"_sha": digests["_sha"], "_maybe": maybe})


def with_digests(docs: DataFrame) -> DataFrame:
    """Adds ``_text`` (null as empty), ``_sha`` (hex SHA-256 of its UTF-8) and ``_key``
    (its 64-bit filter key)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        docs.withColumn("_text", text)
        .withColumn("_sha", F.sha2(F.col("_text"), 256))
        .withColumn("_key", F.xxhash64("_sha"))
    )


class Snapshot:
    """Immutable distinct texts (``exact``: _sha, _bucket, _text, keep_id, size) and
    one filter per bucket (``filters``), both stored in the shared folder."""

    def __init__(self, exact: DataFrame, filters: DataFrame, buckets: int):
        self.exact, self.filters, self.buckets = exact, filters, buckets

    @classmethod
    def of(cls, spark: SparkSession, groups: DataFrame) -> Snapshot:
        """A snapshot of distinct texts: ``groups`` has _sha, _key, _text, keep_id, size,
        one row per distinct text."""
        exact = stored(groups, "snapshot")
        buckets = max(1, -(-exact.count() // KEYS_PER_FILTER))
        exact = exact.withColumn("_bucket", F.pmod("_key", F.lit(buckets)))
        filters = exact.select("_bucket", "_key").groupBy("_bucket").applyInPandas(_build, FILTER)
        return cls(exact, stored(filters, "filters"), buckets)

    def screen(self, digests: DataFrame) -> DataFrame:
        """(_sha, _maybe) of distinct digests (_sha, _key): false surely not held."""
        keyed = digests.withColumn("_bucket", F.pmod("_key", F.lit(self.buckets)))
        return (
            keyed.groupBy("_bucket")
            .cogroup(self.filters.groupBy("_bucket"))
            .applyInPandas(_probe, "_sha string, _maybe boolean")
        )


def batch_groups(rows: DataFrame) -> DataFrame:
    """One row per distinct text of a batch (with _sha, _key, _text, doc_id): its count
    and largest doc_id. Partial counts are taken in each task before the shuffle, so
    a group of copies, however large, is one row per task."""
    groups = rows.groupBy("_sha").agg(
        F.first("_key").alias("_key"),
        F.min("_text").alias("_text"),
        F.max("_text").alias("_other"),
        F.max("doc_id").alias("keep_id"),
        F.count("*").alias("size"),
    )
    return groups.withColumn(
        "_text",
        F.when(F.col("_text") == F.col("_other"), F.col("_text")).otherwise(
            F.raise_error(F.concat(F.lit("different texts share SHA-256 "), "_sha"))
        ),
    ).drop("_other")


def ingest(snapshot: Snapshot, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of a new batch (with _sha, _key, _text, doc_id) against a snapshot.

    Returns the groups as they stand after the batch (_sha, keep_id, size: snapshot
    and batch together, for every text of either) and the batch's new texts (_sha,
    _key, _text, keep_id, size), of which ``Snapshot.of`` makes the next snapshot
    segment. Positives of the filter are confirmed by comparing the bytes of both texts;
    equal digests of unequal bytes raise an error.
    """
    groups = stored(batch_groups(batch), "batch")
    maybe = snapshot.screen(groups.select("_sha", "_key")).filter("_maybe")
    held = snapshot.exact.select(
        "_sha", F.col("_text").alias("_held"), F.col("keep_id").alias("_old_keep"),
        F.col("size").alias("_old_size"),
    )
    confirmed = (
        groups.join(maybe.select("_sha"), "_sha")
        .join(held, "_sha")
        .withColumn(
            "_same",
            F.when(F.col("_text") == F.col("_held"), F.lit(True)).otherwise(
                F.raise_error(F.concat(F.lit("different texts share SHA-256 "), "_sha"))
            ),
        )
    )
    grown = confirmed.select(
        "_sha",
        F.greatest("keep_id", "_old_keep").alias("keep_id"),
        (F.col("size") + F.col("_old_size")).alias("size"),
    )
    grown = stored(grown, "grown")
    new = groups.join(grown.select("_sha"), "_sha", "left_anti")
    untouched = snapshot.exact.join(grown.select("_sha"), "_sha", "left_anti")
    after = untouched.select("_sha", "keep_id", "size").unionByName(grown).unionByName(
        new.select("_sha", "keep_id", "size")
    )
    return after, new.select("_sha", "_key", "_text", "keep_id", "size")


def exact_duplicates(spark: SparkSession, docs: DataFrame, split: int | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    Rows with doc_id below ``split`` form the snapshot; the others, null doc_ids
    among them, are the new batch screened against it. By default the split is the
    median doc_id, so both paths carry half the rows. The result does not depend on
    the split.

    A null text is the empty text. ``keep_id`` is the largest doc_id of the group,
    null only where all its rows have none. ``kept`` is true for exactly one row of
    each group, one that carries keep_id; repeated rows are rows like any other. An
    empty table gives no rows; columns other than doc_id and text are not read.
    """
    rows, _ = set_aside(docs.select("doc_id", "text"), "_text", "_sha", "_key")
    rows = with_digests(rows)
    if split is None:
        quantile = rows.approxQuantile("doc_id", [0.5], 0.01)
        split = int(quantile[0]) if quantile else 0
    old = F.col("doc_id") < F.lit(split)
    snapshot = Snapshot.of(spark, batch_groups(rows.filter(old)))
    after, _ = ingest(snapshot, rows.filter(~old | F.col("doc_id").isNull()))
    after = stored(after, "groups")
    counted = rows.groupBy("_sha", "doc_id").agg(F.count("*").alias("_n"))
    out = counted.join(after, "_sha").select(
        "doc_id", "keep_id", F.col("size").alias("group_size"), "_sha",
        F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_i"),
    )
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_i") == 1)
    return out.select(
        "doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("_sha").alias("text_sha256")
    )


ORACLE = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size,
       (d.doc_id IS NOT DISTINCT FROM g.keep_id
        AND row_number() OVER (PARTITION BY d.h, d.doc_id) = 1) AS kept,
       d.h AS text_sha256
FROM d JOIN g USING (h)
"""
