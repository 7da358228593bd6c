"""Removal of repeated strings, by difference-cover suffix sorting in parallel.

A string of ``LENGTH`` = 50 bytes that also starts in a document with a smaller id is
removed. Equal strings must meet to be found; suffixes of the whole corpus are not
shuffled for that. Each string is dealt by its anchor, the smallest of the hashes of
its 16-byte parts, which equal strings share, and strings of one document that follow
each other with the same anchor travel as one piece:

1. Every task cuts its texts into pieces. A piece whose very bytes are in a smaller
   document of the same slice is a repeat at once; of the rest only hashes travel.
2. Per anchor, a piece equal to one of a smaller document is a repeat; an anchor of one
   document is done; where different pieces share an anchor their bytes are asked for.
3. Those pieces are sorted by suffix: the difference-cover algorithm sorts sampled
   triples, recurs on their names and merges the other suffixes; adjacent suffixes are
   compared over 50 bytes, and each run of equal strings knows its smallest document.
4. Repeats are joined to their documents and cut out.

Anchors with very many different pieces are asked for string by string instead, and
those are dealt by their own hash, so no anchor lands in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored
from .textbytes import mix, slices, span_hashes, texts_of

LENGTH = 50
GRAM = 16
SPAN = LENGTH - GRAM + 1
"""Parts of a string; the smallest hash among them is the anchor."""
SLICE = 2 << 20
STEP = 1 << 19
"""Bytes of a slice that are hashed at a time."""
TOGETHER = 1 << 16
"""Pieces that are matched at a time, about."""
BLOCK = 1 << 19
"""Bytes of pieces that are compared together, and the rest of their last anchor."""
CROWDED = 20_000
"""Different pieces of an anchor from which its strings are dealt one by one."""
PARTITION_BYTES = 16 << 20
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
LAST = (1 << 63) - 1
"""Stands for a null doc_id: larger than all others."""


def pieces_of(data: np.ndarray, offsets: np.ndarray):
    """(document, start, count, anchor) of all pieces of a slice.

    A piece is ``count`` strings that start one after the other and share an anchor.
    """
    n = len(data)
    if n < LENGTH:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, np.uint64)
    eight = _eights(data)
    hashes = eight[: n - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15)
    hashes ^= hashes >> np.uint64(32)
    hashes += eight[8 : n - GRAM + 9]
    hashes = mix(hashes)
    least, width = hashes, 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
    # strings that would run into the next text
    over = np.zeros(n + 1, np.int8)
    sizes = np.diff(offsets)
    np.add.at(over, np.maximum(offsets[1:] - LENGTH + 1, offsets[:-1])[sizes > 0], 1)
    np.add.at(over, offsets[1:][sizes > 0], -1)
    whole = np.cumsum(over[: len(least)], dtype=np.int8) == 0
    begins = np.ones(len(least), bool)
    np.not_equal(least[1:], least[:-1], out=begins[1:])
    begins[offsets[:-1][offsets[:-1] < len(least)]] = True
    ends = np.append(begins[1:], True) | ~np.append(whole[1:], True)
    first = np.flatnonzero(begins & whole)
    last = np.flatnonzero(ends & whole)
    doc = np.searchsorted(offsets, first, "right") - 1
    return doc, first - offsets[doc], last - first + 1, least[first]


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number; zeros after the end."""
    padded = np.append(data, np.zeros(8, np.uint8))
    return np.ndarray((len(data),), np.uint64, padded, strides=(1,)).copy()


def _first_rows(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows by the keys, and where in it the first key's groups begin."""
    order = np.lexsort(keys[::-1])
    top = keys[0][order]
    return order, np.flatnonzero(np.append(True, top[1:] != top[:-1])[: len(top)])


_BLOCKS = (
    "p int, anchor array<int>, piece array<bigint>, doc array<bigint>, salt array<bigint>, "
    "start_low array<smallint>, start_high array<smallint>, n_low array<smallint>, "
    "n_high array<smallint>, known array<boolean>"
)


def _halves(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low and high 16 bits; apart, the high ones, mostly zero, compress to nothing."""
    both = values.astype("<i4").view("<i2").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _whole(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.column_stack([low, high]).astype("<i2").view("<i4").ravel()


def _hashed_pieces(data: np.ndarray, offsets: np.ndarray):
    """(document, start, count, anchor, hash) of all pieces of a slice, ``STEP`` bytes at a
    time; a piece ends where a step does."""
    steps = []
    for first in range(0, max(len(data), 1), STEP):
        part = data[first : first + STEP + LENGTH - 1]
        inside = np.clip(offsets - first, 0, len(part))
        doc, start, n, anchor = pieces_of(part, inside)
        at = inside[doc] + start
        piece = span_hashes(part, at, at + n - 1 + LENGTH) if len(at) else anchor
        steps.append((doc, at + first - offsets[doc], n, anchor, piece))
    return [np.concatenate(x) for x in zip(*steps, strict=True)]


def _cut(partitions: int):
    """Step 1: rows of arrays, one for each slice and partition. Known repeats need no
    partner and are dealt by their documents."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "text", SLICE):
            data, offsets = texts_of(batch.column("text"))
            doc, start, n, anchor, piece = _hashed_pieces(data, offsets)
            ids = batch.column("_id").to_numpy()[doc]
            salts = batch.column("_salt").to_numpy()[doc]
            order, begin = _first_rows(piece, anchor, ids)
            group = np.cumsum(np.bincount(begin, minlength=len(order))) - 1
            least = ids[order][begin][group] if len(order) else ids
            same = anchor[order] == anchor[order][begin][group] if len(order) else anchor
            known = np.zeros(len(order), bool)
            known[order] = (ids[order] > least) & same
            p = ((anchor >> np.uint64(33)) % np.uint64(partitions)).astype(np.int64)
            even = mix(ids.astype(np.uint64) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            p = np.where(known, (even % np.uint64(partitions)).astype(np.int64), p)
            low = (anchor & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
            low, piece = np.where(known, 0, low), np.where(known, 0, piece.view(np.int64))
            order = np.argsort(p, kind="stable")
            p = p[order].astype(np.int32)
            borders = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else p
            cuts = pa.array(np.append(borders, len(p)).astype(np.int32))

            def column(values, cuts=cuts, order=order):
                return pa.ListArray.from_arrays(cuts, pa.array(values[order]))

            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(p[borders]),
                    column(low.astype(np.int32)),
                    column(piece),
                    column(ids),
                    column(salts),
                    *map(column, (*_halves(start), *_halves(n))),
                    column(known),
                ],
                names=[f.split()[0] for f in _BLOCKS.split(", ")],
            )

    return run


_FOUND = "doc bigint, salt bigint, start int, n int, p int, anchor int, kind tinyint"
REPEAT, ASK, ASK_EACH = 0, 1, 2


def _match(table: pa.Table) -> pa.Table:
    """Step 2, for one partition: repeats, and pieces whose bytes must be compared.

    Some anchors at a time, so that sorting copies a part of the pieces only.
    """
    flat = {
        c: np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in table[c].chunks])
        for c in table.column_names
        if c != "p"
    }
    flat["start"] = _whole(flat.pop("start_low"), flat.pop("start_high"))
    flat["n"] = _whole(flat.pop("n_low"), flat.pop("n_high"))
    known = flat.pop("known").astype(bool)
    out = [{c: flat[c][known] for c in ("doc", "salt", "start", "n", "anchor")}]
    kinds = [np.full(int(known.sum()), REPEAT, np.int8)]
    parts = max(1, len(known) // TOGETHER)
    part = flat["anchor"].astype(np.uint32) % np.uint32(parts)
    for k in range(parts):
        rest = np.flatnonzero((part == k) & ~known)
        if not len(rest):
            continue
        keys = [flat[c][rest] for c in ("doc", "piece", "anchor")]
        order = np.lexsort(keys)
        rest = rest[order]
        doc, piece, anchor = (c[order] for c in keys)
        new_anchor = np.append(True, anchor[1:] != anchor[:-1])
        new_piece = new_anchor | np.append(True, piece[1:] != piece[:-1])
        a_group, p_group = np.cumsum(new_anchor) - 1, np.cumsum(new_piece) - 1
        a_first, p_first = np.flatnonzero(new_anchor), np.flatnonzero(new_piece)
        p_least = doc[p_first][p_group]  # sorted by doc within a piece
        a_least = np.minimum.reduceat(doc, a_first)[a_group]
        a_most = np.maximum.reduceat(doc, a_first)[a_group]
        variants = np.bincount(a_group[p_first])[a_group]
        repeat = doc > p_least
        ask = ~repeat & (variants > 1) & (a_least < a_most)
        chosen = repeat | ask
        out.append({c: flat[c][rest[chosen]] for c in ("doc", "salt", "start", "n", "anchor")})
        kind = np.where(repeat, REPEAT, np.where(variants > CROWDED, ASK_EACH, ASK))
        kinds.append(kind[chosen].astype(np.int8))
    columns = {c: np.concatenate([o[c] for o in out]) for c in out[0]}
    n = len(columns["doc"])
    return pa.table(
        {
            "doc": columns["doc"],
            "salt": columns["salt"],
            "start": columns["start"],
            "n": columns["n"],
            "p": pa.array(np.full(n, table["p"][0].as_py(), np.int32)),
            "anchor": columns["anchor"],
            "kind": np.concatenate(kinds),
        }
    )


def _matched(batches: Iterator[pa.RecordBatch]):
    """Step 2 of all rows of a task; rows of one ``p`` are in one task."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    del held
    values = pc.unique(table["p"]).to_pylist()
    for p in values:
        own = table.filter(pc.equal(table["p"], p)) if len(values) > 1 else table
        yield from _match(own).to_batches(max_chunksize=TOGETHER)


def _bytes_asked(partitions: int):
    """The bytes of the pieces a document is asked for; crowded ones string by string."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "text", SLICE):
            data, offsets = texts_of(batch.column("text"))
            whole = data.tobytes()
            rows: dict[str, list] = {c: [] for c in ("p", "anchor", "doc", "salt", "start", "piece")}
            single: dict[tuple, int] = {}
            ids, salts = (batch.column(c).to_pylist() for c in ("_id", "_salt"))
            repeats = []
            for k in np.argsort(ids, kind="stable").tolist():
                base = int(offsets[k])
                for asked in batch.column("asked")[k].as_py() or ():
                    a, n = base + asked["start"], asked["n"]
                    if asked["kind"] == ASK:
                        found = [(asked["p"], asked["anchor"], a, n)]
                    else:
                        found = []
                        for i in range(a, a + n):
                            text = whole[i : i + LENGTH]
                            h = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest())
                            p, anchor = h % partitions, (h >> 33) - (1 << 30)
                            least = single.setdefault((anchor, p, text), ids[k])
                            if least < ids[k]:
                                repeats.append((ids[k], salts[k], i - base))
                            else:
                                found.append((p, anchor, i, 1))
                    for p, anchor, i, n in found:
                        rows["p"].append(p)
                        rows["anchor"].append(anchor)
                        rows["doc"].append(ids[k])
                        rows["salt"].append(salts[k])
                        rows["start"].append(i - base)
                        rows["piece"].append(whole[i : i + n - 1 + LENGTH])
            for i, (doc, salt, start) in enumerate(repeats):  # known already: dealt evenly
                rows["p"].append(i % partitions)
                rows["anchor"].append(i)
                rows["doc"].append(doc)
                rows["salt"].append(salt)
                rows["start"].append(start)
                rows["piece"].append(b"")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows["p"], pa.int32()),
                    pa.array(rows["anchor"], pa.int32()),
                    pa.array(rows["doc"], pa.int64()),
                    pa.array(rows["salt"], pa.int64()),
                    pa.array(rows["start"], pa.int32()),
                    pa.array(rows["piece"], pa.binary()),
                ],
                names=list(rows),
            )

    return run


_PIECES = "p int, anchor int, doc bigint, salt bigint, start int, piece binary"


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of a sequence of numbers from 1 on, in order (difference cover mod 3)."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    s = np.zeros(n + 3, np.int64)
    s[:n] = text
    sampled = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    base = int(s.max()) + 1
    triple = (s[sampled] * base + s[sampled + 1]) * base + s[sampled + 2]
    names, name = np.unique(triple, return_inverse=True)
    if len(names) < len(sampled):
        order = suffix_array(name + 1)
    else:
        order = np.argsort(name)
    rank = np.zeros(n + 3, np.int64)
    rank[sampled[order]] = np.arange(1, len(sampled) + 1)
    a = sampled[order]
    a = a[a < n]
    b = np.arange(0, n, 3)
    b = b[np.lexsort((rank[b + 1], s[b]))]
    # place of each other suffix among the sampled ones, all by bisection at once
    low, high = np.zeros(len(b), np.int64), np.full(len(b), len(a))
    while (open_ := low < high).any():
        i = np.flatnonzero(open_)
        middle = (low[i] + high[i]) // 2
        x, y = b[i], a[middle]
        one = y % 3 == 1
        second_x, second_y = np.where(one, rank[x + 1], s[x + 1]), np.where(one, rank[y + 1], s[y + 1])
        third_x, third_y = np.where(one, 0, rank[x + 2]), np.where(one, 0, rank[y + 2])
        smaller = (s[y] < s[x]) | (
            (s[y] == s[x])
            & ((second_y < second_x) | ((second_y == second_x) & (third_y < third_x)))
        )
        low[i] = np.where(smaller, middle + 1, low[i])
        high[i] = np.where(smaller, high[i], middle)
    out = np.empty(n, np.int64)
    place_b = low + np.arange(len(b))
    out[place_b] = b
    free = np.ones(n, bool)
    free[place_b] = False
    out[free] = a
    return out


def repeated_starts(pieces: list[bytes], docs: np.ndarray) -> list[tuple[int, int, int]]:
    """(piece, first, count): strings that also start in a piece of a smaller document."""
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes + 1)
    begin = ends - sizes - 1
    text = np.frombuffer(b"\x00".join(pieces) + b"\x00", np.uint8).astype(np.int64) + 2
    text[ends - 1] = 1
    owner = np.repeat(np.arange(len(pieces)), sizes + 1)
    order = suffix_array(text)
    starts_string = np.arange(len(text)) + LENGTH <= begin[owner] + sizes[owner]
    order = order[starts_string[order]]
    if not len(order):
        return []
    eight = _eights((text - 2).astype(np.uint8))
    equal = np.ones(len(order) - 1, bool)
    for k in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
        equal &= eight[order[1:] + k] == eight[order[:-1] + k]
    run = np.append(0, np.cumsum(~equal))
    doc = docs[owner[order]]
    least = np.minimum.reduceat(doc, np.flatnonzero(np.append(True, ~equal)))
    hit = np.sort(order[doc > least[run]])
    if not len(hit):
        return []
    cut = np.flatnonzero(np.append(True, (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])))
    count = np.diff(np.append(cut, len(hit)))
    first = hit[cut]
    piece = owner[first]
    return list(zip(piece.tolist(), (first - begin[piece]).tolist(), count.tolist(), strict=True))


def _maybe_twice(hashes: np.ndarray) -> np.ndarray:
    """Rows whose hash may be there more than once: all that are, and few others."""
    size = 1 << max(10, (2 * len(hashes)).bit_length())
    key = (hashes & np.uint64(size - 1)).astype(np.int32)
    own = np.arange(len(hashes), dtype=np.int32)
    last = np.empty(size, np.int32)
    last[key] = own
    other = last[key]
    twice = other != own
    twice[other[twice]] = True
    return np.flatnonzero(twice)


def _shared_runs(pieces: list[bytes], docs: np.ndarray) -> list[tuple[int, int, int]]:
    """(piece, first, count): strings whose hash another document's piece has as well.

    Words that many texts share give pieces an anchor in common but seldom 50 bytes; the
    rest need not be sorted.
    """
    if not pieces:
        return []
    sizes = np.array([len(p) for p in pieces])
    count = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(pieces)), count)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = inside + (np.cumsum(sizes) - sizes)[owner]
    hashes = span_hashes(np.frombuffer(b"".join(pieces), np.uint8), at, at + LENGTH)
    shared = np.zeros(len(hashes), bool)
    some = _maybe_twice(hashes)  # most are there once and need no sorting
    if len(some):
        order, begin = _first_rows(hashes[some])
        order = some[order]
        doc = docs[owner[order]]
        differ = np.minimum.reduceat(doc, begin) < np.maximum.reduceat(doc, begin)
        shared[order] = np.repeat(differ, np.diff(np.append(begin, len(order))))
    before = np.append(False, shared[:-1]) & (inside > 0)
    after = np.append(shared[1:], False) & np.append(inside[1:] > 0, False)
    first, last = np.flatnonzero(shared & ~before), np.flatnonzero(shared & ~after)
    runs = zip(owner[first].tolist(), inside[first].tolist(), (last - first + 1).tolist(), strict=True)
    return list(runs)


def _whole_anchors(batches: Iterator[pa.RecordBatch]):
    """Rows in order of their anchors, in tables of whole anchors of about ``BLOCK`` bytes."""
    held: list[pa.RecordBatch] = []
    size, before = 0, None
    for rows in batches:
        anchors = rows["anchor"].to_numpy()
        new = np.append(before is not None and anchors[0] != before, anchors[1:] != anchors[:-1])
        borders = np.flatnonzero(new)
        sizes = np.append(0, np.cumsum(pc.binary_length(rows["piece"]).to_numpy() + LENGTH))
        first = 0
        while (k := np.searchsorted(sizes[borders], sizes[first] + BLOCK - size)) < len(borders):
            end = int(borders[k])
            yield pa.Table.from_batches([*held, rows.slice(first, end - first)])
            held, size, first = [], 0, end
        held.append(rows.slice(first))
        size, before = size + int(sizes[-1] - sizes[first]), anchors[-1]
    if held:
        yield pa.Table.from_batches(held)


def _compared(batches: Iterator[pa.RecordBatch]):
    """Step 3 of all rows of a task, which come in order of their anchors."""
    for table in _whole_anchors(b for b in batches if b.num_rows):
        yield from _compare(table).to_batches()


def _compare(table: pa.Table) -> pa.Table:
    """Step 3, for whole anchors, the suffixes in blocks.

    Equal runs of strings are sorted once, for the smallest document that has them;
    larger documents repeat it.
    """
    doc, salt, start, n = [], [], [], []

    def repeat(i: int, first: int, count: int) -> None:
        doc.append(docs[i])
        salt.append(salts[i])
        start.append(starts[i] + first)
        n.append(count)

    pieces = table["piece"].to_pylist()
    docs, salts, starts, anchors = (table[c].to_pylist() for c in ("doc", "salt", "start", "anchor"))
    filled = []
    for i, piece in enumerate(pieces):
        if piece:
            filled.append(i)
        else:
            repeat(i, 0, 1)  # known to be one
    own = np.array(docs, np.int64)[filled]
    holders: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
    for k, first, count in _shared_runs([pieces[i] for i in filled], own):
        i = filled[k]
        run = pieces[i][first : first + count - 1 + LENGTH]
        holders.setdefault((anchors[i], run), []).append((i, first))
    del pieces
    block: list[tuple[bytes, int, list[tuple[int, int]]]] = []
    size, last = 0, None

    def sort_block() -> None:
        found = repeated_starts([b[0] for b in block], np.array([b[1] for b in block]))
        for k, first, count in found:
            for i, at in block[k][2]:
                repeat(i, at + first, count)

    for anchor, run in sorted(holders, key=lambda h: h[0]):
        if size >= BLOCK and anchor != last:
            sort_block()
            block, size = [], 0
        places = holders[anchor, run]
        least = min(docs[i] for i, _ in places)
        for i, first in places:
            if docs[i] > least:
                repeat(i, first, len(run) - LENGTH + 1)
        block.append((run, least, [(i, f) for i, f in places if docs[i] == least]))
        size, last = size + len(run), anchor
    if block:
        sort_block()
    return pa.table(
        {
            "doc": pa.array(doc, pa.int64()),
            "salt": pa.array(salt, pa.int64()),
            "start": pa.array(start, pa.int32()),
            "n": pa.array(n, pa.int32()),
        }
    )


def _cut_out(batches: Iterator[pa.RecordBatch]):
    """Step 4: the removed runs of each document, and what is left of it."""
    for batch in slices(batches, "text", SLICE):
        data, offsets = texts_of(batch.column("text"))
        rows = []
        repeats = batch.column("repeats")
        lists = repeats.offsets.to_numpy()
        start = repeats.values.field("start").to_numpy()
        count = repeats.values.field("n").to_numpy().astype(np.int64)
        for k in range(batch.num_rows):
            text = data[offsets[k] : offsets[k + 1]]
            a, b = (lists[k], lists[k + 1]) if repeats[k].is_valid else (0, 0)
            if a == b:
                rows.append({"n_bytes": len(text), "spans": [], "kept": text.tobytes()})
                continue
            change = np.bincount(start[a:b], minlength=len(text) + 1)
            change -= np.bincount(
                start[a:b] + count[a:b] - 1 + LENGTH, minlength=len(text) + 1
            )
            gone = np.cumsum(change[:-1]) > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
            rows.append(
                {
                    "n_bytes": len(text),
                    "spans": edges.reshape(-1, 2).tolist(),
                    "kept": text[~gone].tobytes(),
                }
            )
        yield batch, rows


def _prepared(docs: DataFrame) -> DataFrame:
    """text, ``_id`` (null as the largest) and ``_salt``, which parts rows that share a
    doc_id by their texts; 0 where all ids are different."""
    rows = docs.select("text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_id"))
    again = rows.groupBy("_id").count().filter("count > 1").select("_id")
    if again.isEmpty():
        return rows.withColumn("_salt", F.lit(0).cast("long"))
    again = again.withColumn("_again", F.lit(True))
    salt: Column = F.when(F.col("_again"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    return rows.join(again, "_id", "left").withColumn("_salt", salt).drop("_again")


def find_repeats(docs: DataFrame) -> DataFrame:
    """(doc, salt, start, n): n strings from ``start`` on that also start in a document
    with a smaller id. ``docs`` is as ``_prepared`` gives it."""
    session = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(
        int(session.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES)
    )
    cut = docs.select("_id", "_salt", "text").mapInArrow(_cut(partitions), _BLOCKS)
    # p is the number of a partition: hashed anew, some would get the pieces of four
    found = cut.repartitionById(partitions, "p").mapInArrow(_matched, _FOUND)
    # the table is all that is needed later: its shuffle goes now, not with the driver's garbage
    before = session.conf.get(FILE_CLEANUP)
    session.conf.set(FILE_CLEANUP, "true")
    try:
        found = stored(found, "repeats")
    finally:
        session.conf.set(FILE_CLEANUP, before)
    asked = (
        found.filter(F.col("kind") != REPEAT)
        .groupBy("doc", "salt")
        .agg(F.collect_list(F.struct("start", "n", "p", "anchor", "kind")).alias("asked"))
    )
    same = (F.col("_id") == F.col("doc")) & (F.col("_salt") == F.col("salt"))
    # rows equal in id and text are asked once
    once = docs.select("_id", "_salt", "text")
    pieces = (
        once.join(asked, same)
        .select("_id", "_salt", "text", "asked")
        .mapInArrow(_bytes_asked(partitions), _PIECES)
        .repartitionById(partitions, "p")
        .sortWithinPartitions("anchor")
        .mapInArrow(_compared, "doc bigint, salt bigint, start int, n int")
    )
    known = found.filter(F.col("kind") == REPEAT)
    return known.select("doc", "salt", "start", "n").union(pieces)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept: documents without repeats.

    Ids are whole numbers; the largest of 64 bits stands for null. ``kept`` are the remaining bytes, which may end inside a character. A null or empty
    text has no bytes. A null doc_id is larger than all others; rows that share a doc_id
    remove nothing from each other; copies of a text lose all of it but in the document
    with the smallest id. An empty table gives no rows.
    """
    rows = _prepared(docs)
    repeats = (
        find_repeats(rows)
        .groupBy("doc", "salt")
        .agg(F.collect_list(F.struct("start", "n")).alias("repeats"))
    )
    same = (F.col("_id") == F.col("doc")) & (F.col("_salt") == F.col("salt"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch, found in _cut_out(batches):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None if i == LAST else i for i in batch["_id"].to_pylist()], pa.int64()),
                    pa.array([r["n_bytes"] for r in found], pa.int64()),
                    pa.array([r["n_bytes"] - len(r["kept"]) for r in found], pa.int64()),
                    pa.array([len(r["spans"]) for r in found], pa.int64()),
                    pa.array([hashlib.sha256(r["kept"]).hexdigest() for r in found], pa.string()),
                    pa.array([r["kept"] for r in found], pa.binary()),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    # the same columns as the other join takes: texts are shuffled once for both
    kind = docs.schema["doc_id"].dataType
    found = (
        rows.select("_id", "_salt", "text")
        .join(repeats, same, "left")
        .select("_id", "text", "repeats")
        .mapInArrow(
            run,
            "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, "
            "kept_sha256 string, kept binary",
        )
    )
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def repeats_report(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).drop("kept")


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (
  SELECT doc_id, i, x[2 * i + 1 : 2 * i + 100] AS s
  FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 49)) AS i FROM d WHERE len(x) >= 100)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM w),
r AS (SELECT doc_id, i FROM m WHERE least < doc_id),
o AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS opens FROM r),
g AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM o),
s AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, k),
e AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
t AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
    string_agg(d.x[2 * before + 1 : 2 * a], '' ORDER BY a) AS kept
  FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes,
  CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || x[2 * coalesce(last, 0) + 1 :])) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
