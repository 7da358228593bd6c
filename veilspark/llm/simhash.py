"""SimHash near-duplicates, found by anchor points of a covering code.

A fingerprint has 64 bits and links to others at ``THRESHOLD`` = 2 or fewer differing
bits. Of two bits at most one lies in one of the two halves, so each half is searched
with threshold 1. Anchors of a half are the words of the perfect [31, 26] Hamming
code, with the 32nd bit free: covering radius 1. Every fingerprint goes to all
anchors within radius + threshold = 2 of its half, 17 at most. The anchor nearest to
one end of a link is within 2 of the other end, so the two meet there.

The same code over all 64 bits would need some 650 copies of each fingerprint; the
halves need 34, for the same links.

Documents are reduced to distinct fingerprints before anything is replicated, so a
group of copies, however large, is one row. Of a bucket only enough links to connect
it leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import set_aside, stored
from .textbytes import slices, texts_of

SHINGLE = 3
SEED = 42
THRESHOLD = 2
BUCKET = 2048
"""Rows of a bucket that are compared by shifting; larger ones are compared in blocks."""
PROBE = 60_000
"""Rows of a bucket from which looking up all close values is less work than comparing."""


def fingerprint(text: bytes) -> int:
    """The 64 bits of a text, as a signed number; 0 if it has no words.

    Letters A-Z are lowered, words are separated by the six ASCII white spaces, and a
    bit is set if over half of the hashes of the three-word shingles have it.
    """
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
        starts = [0, *(spaces[: len(words) - SHINGLE] + 1).tolist()]
        ends = [*spaces[SHINGLE - 1 :].tolist(), len(line)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends, strict=True)]
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], ">u8").view(np.uint8)
        votes += np.unpackbits(part.reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
    bits = np.packbits(votes * 2 > len(hashes))
    return int(bits.view(">i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None):
    """Columns ``keep`` (all) of ``docs`` and ``_fingerprint``; null counts as empty."""
    names = [c for c in (docs.columns if keep is None else keep) if c != "_fingerprint"]
    docs = docs.drop("_fingerprint")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, text):
            data, offsets = texts_of(batch.column(text))
            whole = data.tobytes()
            values = [
                fingerprint(whole[a:b])
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(values, pa.int64())],
                names=[*names, "_fingerprint"],
            )

    schema = docs.select(*names, F.lit(0).cast("long").alias("_fingerprint")).schema
    return docs.mapInArrow(run, schema)


def _flip_masks() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: what to flip to reach each anchor within 2, and how many there are.

    Bit i of the 31 has syndrome i + 1; the first entry is the nearest anchor.
    """
    masks, counts = np.zeros((32, 17), np.uint64), np.zeros(32, np.int64)
    free = 1 << 31
    for s in range(32):
        near = 1 << (s - 1) if s else 0
        pairs = [
            1 << (i - 1) | 1 << ((i ^ s) - 1)
            for i in range(1, 32)
            if s and i < i ^ s and i ^ s
        ]
        row = [near, near | free, *pairs]
        masks[s, : len(row)], counts[s] = row, len(row)
    return masks, counts


MASKS, N_MASKS = _flip_masks()
SYNDROMES = np.zeros((4, 256), np.uint64)
for _byte in range(4):
    for _value in range(256):
        for _bit in range(8):
            if _value >> _bit & 1 and 8 * _byte + _bit < 31:
                SYNDROMES[_byte, _value] ^= np.uint64(8 * _byte + _bit + 1)


def anchors(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (row, anchor) of 64-bit fingerprints; the top bit pair tells the half.

    Anchors of the upper half are even, those of the lower half odd.
    """
    rows, out = [], []
    for half in (0, 1):
        word = values >> np.uint64(32) if half == 0 else values & np.uint64(0xFFFFFFFF)
        syndrome = np.zeros(len(values), np.uint64)
        for b in range(4):
            syndrome ^= SYNDROMES[b, (word >> np.uint64(8 * b)) & np.uint64(255)]
        s = syndrome.astype(np.int64)
        for k in range(MASKS.shape[1]):
            has = np.flatnonzero(N_MASKS[s] > k)
            rows.append(has)
            flipped = word[has] ^ MASKS[s[has], k]
            out.append(flipped << np.uint64(1) | np.uint64(half))
    return np.concatenate(rows), np.concatenate(out)


def _replicate(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(0, len(values), 1 << 14):
            part = values[i : i + (1 << 14)]
            rows, keys = anchors(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(part[rows].view(np.int64))],
                names=["anchor", "fingerprint"],
            )


def _distance_ok(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= THRESHOLD


def _labels(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None):
    """Smallest reachable row of each of n rows over the links a-b."""
    labels = np.arange(n) if labels is None else labels
    while len(a):
        # every label is a root; a root hooks to the least it is linked to, and links
        # to others stay open until both ends have one root
        first, second = labels[a], labels[b]
        np.minimum.at(labels, np.maximum(first, second), np.minimum(first, second))
        while (labels[labels] != labels).any():
            labels = labels[labels]
        open_ = labels[a] != labels[b]
        a, b = a[open_], b[open_]
    return labels


def _close_to_any(values: np.ndarray) -> np.ndarray:
    """Labels within one large bucket of sorted distinct fingerprints."""
    n = len(values)
    labels = np.arange(n)
    if n < PROBE:
        for i in range(0, n, 256):
            near = _distance_ok(values[i : i + 256, None], values[None, i:])
            a, b = np.nonzero(near)
            pairs = np.unique(labels[a + i] * n + labels[b + i])
            labels = _labels(n, pairs // n, pairs % n, labels)
        return labels
    bits = [np.uint64(1 << i) for i in range(64)]
    changes = bits + [a | b for i, a in enumerate(bits) for b in bits[:i]]
    for change in changes:
        other = values ^ change
        at = np.minimum(np.searchsorted(values, other), n - 1)
        a = np.flatnonzero((values[at] == other) & (other > values))
        labels = _labels(n, a, at[a], labels)
    return labels


def bucket_links(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever is close inside the buckets of sorted keys."""
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.concatenate([new, [len(keys)]]))
    out_a, out_b = [], []
    small = np.repeat(sizes <= BUCKET, sizes)
    a_rows, b_rows = [], []
    alive = np.flatnonzero(small[:-1] & (keys[1:] == keys[:-1]))
    step = 1
    while len(alive):
        close = alive[_distance_ok(values[alive], values[alive + step])]
        a_rows.append(close)
        b_rows.append(close + step)
        step += 1
        alive = alive[alive + step < len(keys)]
        alive = alive[keys[alive + step] == keys[alive]]
    if a_rows:
        labels = _labels(len(keys), np.concatenate(a_rows), np.concatenate(b_rows))
        moved = np.flatnonzero(labels != np.arange(len(keys)))
        out_a.append(values[moved])
        out_b.append(values[labels[moved]])
    for first, size in zip(new[sizes > BUCKET], sizes[sizes > BUCKET], strict=True):
        own = np.unique(values[first : first + size])
        labels = _close_to_any(own)
        moved = np.flatnonzero(labels != np.arange(len(own)))
        out_a.append(own[moved])
        out_b.append(own[labels[moved]])
    if not out_a:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(out_a), np.concatenate(out_b)


def _compare(batches: Iterator[pa.RecordBatch]):
    """Buckets in order of anchor; a bucket cut by a batch border is carried on."""
    seen: set[tuple[int, int]] = set()

    def links(keys, values):
        a, b = bucket_links(keys, values)
        fresh = {*zip(a.view(np.int64).tolist(), b.view(np.int64).tolist(), strict=True)}
        fresh -= seen
        if len(seen) > 500_000:
            seen.clear()
        seen.update(fresh)
        a, b = zip(*fresh, strict=True) if fresh else ((), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]
        )

    held_k, held_v = [], []
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        values = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        held_k.append(keys.copy())
        held_v.append(values.copy())
        if len(keys) and keys[-1] != held_k[0][0] and sum(map(len, held_k)) >= 1 << 17:
            keys, values = np.concatenate(held_k), np.concatenate(held_v)
            cut = np.flatnonzero(keys != keys[-1])[-1] + 1
            yield links(keys[:cut], values[:cut])
            held_k, held_v = [keys[cut:]], [values[cut:]]
    if held_k and sum(map(len, held_k)):
        yield links(np.concatenate(held_k), np.concatenate(held_v))


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """(a, b): links that connect all fingerprints at 2 or fewer differing bits."""
    copies = distinct.mapInArrow(_replicate, "anchor long, fingerprint long")
    return (
        copies.repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(_compare, "a long, b long")
    )


def with_roots(prints: DataFrame) -> DataFrame:
    """Adds ``_root``: the smallest fingerprint of the component of the row's own.

    ``prints`` has ``_fingerprint`` and is read several times: give a stored table.
    """
    distinct = stored(prints.select("_fingerprint").distinct(), "fingerprints")
    roots = components(fingerprint_links(distinct))
    linked = distinct.join(
        roots.withColumnRenamed("node", "_fingerprint"), "_fingerprint", "left"
    ).select("_fingerprint", F.coalesce("root", "_fingerprint").alias("_root"))
    return prints.join(stored(linked, "components"), "_fingerprint")


def with_components(prints: DataFrame, order: str = "doc_id") -> DataFrame:
    """Adds ``_component``: the smallest ``order`` value of all rows reachable by links.

    ``prints`` has ``_fingerprint`` and is read several times: give a stored table.
    Null values of ``order`` never are the smallest; a group of only such has null.
    """
    rooted = with_roots(prints)
    smallest = rooted.groupBy("_root").agg(F.min(order).alias("_component"))
    return rooted.join(smallest, "_root").drop("_root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``.

    A null or empty text has fingerprint zero and links like any other; repeated rows
    and ties share a component; an empty table gives no rows.
    """
    prints = stored(
        fingerprints(docs.select("doc_id", "text"), keep=["doc_id"]), "documents"
    )
    return with_components(prints).select(
        "doc_id",
        F.lower(F.lpad(F.hex("_fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("_component").alias("component_id"),
    )


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One document of each component of near copies: fingerprints of three-word
    shingles linked at ``THRESHOLD`` = 2 or fewer differing bits, as ``near_duplicates``
    finds them. The document of the smallest doc_id stays, all columns kept.

    Of rows that share the smallest doc_id, the one with the smallest hash of its
    columns stays; of rows equal in all columns one stays. Texts without words have
    fingerprint zero and link like any other. A null doc_id is never the smallest
    unless the whole component has none. An empty table gives no rows.
    """
    names = "_row _id _r n _fingerprint _root".split()
    docs, restored = set_aside(docs, *names)
    columns = docs.columns
    row = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in columns])
    keyed = docs.withColumn("_row", row)
    prints = stored(fingerprints(keyed, keep=["doc_id", "_row"]), "documents")
    prints = with_roots(prints).groupBy("_root", "doc_id", "_row")
    prints = prints.agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    kept = (
        prints.groupBy("_root")
        .agg(F.min_by(F.struct("doc_id", "_row", "n"), order).alias("k"))
        .select(F.col("k.doc_id").alias("_id"), F.col("k._row").alias("_r"), "k.n")
    )
    kept = stored(kept, "kept")

    def rows(kept: DataFrame) -> DataFrame:
        same = keyed["doc_id"].eqNullSafe(kept["_id"]) & (keyed["_row"] == kept["_r"])
        return keyed.join(kept, same)

    repeated = kept.filter("n > 1")
    if repeated.isEmpty():
        return restored(rows(kept))
    first = F.first(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("d")
    one = rows(repeated).groupBy("_id", "_r").agg(first).select("d.*")
    return restored(rows(kept.filter("n = 1")).select(*columns).union(one))
