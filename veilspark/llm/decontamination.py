"""Benchmark decontamination: Wu-Manber search of benchmark windows in documents.

The alphabet is words. A window of ten words is a pattern; blocks of two words feed
the shift table, and a block that ends some pattern (shift 0) leads to the bucket of
patterns with that suffix, whose words are then compared directly.

Searching runs inside the tasks that read the documents: no shuffle. The benchmark
is the query set. It is broadcast in blocks of at most ``BLOCK_WORDS`` words; a
larger one is searched block after block, each over all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import set_aside, stored
from .textbytes import (
    LOWER,
    WORD,
    mix,
    slices,
    span_hashes,
    sums_per_text,
    texts_of,
    words_of,
)

WINDOW = 10
BLOCK_WORDS = 2_000_000
LANE = 256
"""Window ends that one lane of the search walks over."""

_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _ODD + right)


class Patterns:
    """Shift table, suffix buckets and words of the windows of one length."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[int]]):
        self.windows = windows
        self.length = m = len(next(iter(windows)))
        self.block = min(2, m)
        words = sorted({w for window in windows for w in window})
        ends = np.cumsum([len(w) for w in words])
        starts = np.concatenate([[0], ends[:-1]])
        data = np.frombuffer(b"".join(words), np.uint8)
        hash_of = dict(zip(words, span_hashes(data, starts, ends), strict=True))
        hashes = np.array([[hash_of[w] for w in window] for window in windows], np.uint64)
        ends_of_blocks = (
            pair_hash(hashes[:, :-1], hashes[:, 1:]) if self.block == 2 else hashes
        )
        bits = max(16, int(ends_of_blocks.size * 8).bit_length())
        self.mask = np.uint64((1 << min(bits, 26)) - 1)
        farthest = m - self.block + 1
        self.shift = np.full(int(self.mask) + 1, farthest, np.uint8)
        for j in range(ends_of_blocks.shape[1]):
            slots = (ends_of_blocks[:, j] & self.mask).astype(np.int64)
            self.shift[slots] = np.minimum(
                self.shift[slots], ends_of_blocks.shape[1] - 1 - j
            )
        self.suffixes = np.unique(ends_of_blocks[:, -1])

    def candidates(self, words: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """Last words of the places whose final block ends a pattern.

        All texts are walked at the same time, long ones in several lanes; each
        lane moves on by the shift of the block it stands at.
        """
        first = borders[:-1] + self.length - 1
        count = np.maximum(0, -(-(borders[1:] - first) // LANE))
        lane = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(first, count) + lane * LANE
        stop = np.minimum(at + LANE, np.repeat(borders[1:], count))
        found = []
        while len(at):
            block = words[at]
            if self.block == 2:
                block = pair_hash(words[at - 1], block)
            shift = self.shift[(block & self.mask).astype(np.int64)]
            hit = shift == 0
            if hit.any():
                where = np.minimum(
                    np.searchsorted(self.suffixes, block[hit]), len(self.suffixes) - 1
                )
                found.append(at[hit][self.suffixes[where] == block[hit]])
            at = at + np.maximum(shift, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        return np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)


def build_patterns(items: list[tuple[int, str]]) -> list[Patterns]:
    """Windows of all items by length; items without words have none."""
    by_length: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
    lower = bytes(LOWER)
    for item, text in items:
        words = _WORDS.findall((text or "").encode().translate(lower))
        size = min(WINDOW, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            holders = by_length.setdefault(size, {}).setdefault(
                tuple(words[i : i + size]), []
            )
            if item is not None and item not in holders:
                holders.append(item)
    return [Patterns(windows) for windows in by_length.values()]


def _search(batches: Iterator[pa.RecordBatch], patterns: list[Patterns], text: str):
    for batch in slices(batches, text):
        data, offsets = texts_of(batch.column(text))
        data = LOWER[data]
        starts, ends, borders = words_of(data, offsets, WORD)
        hashes = span_hashes(data, starts, ends)
        runs: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        items: list[set] = [set() for _ in range(batch.num_rows)]
        for table in patterns:
            last = table.candidates(hashes, borders)
            texts = np.searchsorted(borders, last, "right") - 1
            for end, k in zip(last.tolist(), texts.tolist(), strict=True):
                begin = end - table.length + 1
                window = tuple(
                    data[a:b].tobytes()
                    for a, b in zip(
                        starts[begin : end + 1], ends[begin : end + 1], strict=True
                    )
                )
                holders = table.windows.get(window)
                if holders is None:
                    continue
                items[k].update(holders)
                begin, end = begin - int(borders[k]), end + 1 - int(borders[k])
                if runs[k] and begin <= runs[k][-1]["end"]:
                    runs[k][-1]["end"] = max(end, runs[k][-1]["end"])
                    runs[k][-1]["start"] = min(begin, runs[k][-1]["start"])
                else:
                    runs[k].append({"start": begin, "end": end})
        yield batch, np.diff(borders), runs, items


_ADDED = ["_n_words", "_runs", "_items"]
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _merged(runs: list[dict]) -> list[dict]:
    out: list[dict] = []
    for run in sorted(runs, key=lambda r: r["start"]):
        if out and run["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], run["end"])
        else:
            out.append(dict(run))
    return out


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Columns ``keep`` (all) of ``docs`` and ``_n_words``, ``_runs``, ``_items``.

    ``_runs`` are the maximal runs of words (numbered from 0, end exclusive) that
    lie in an occurrence of a benchmark window, ``_items`` the sorted ids of the
    items with an occurring window. A null or empty text has no words; an item
    without words, or with a null text, matches nothing; an item without an id
    marks words but is not listed. Repeated documents are judged one by one.
    Columns of ``docs`` that have these three names are replaced.
    """
    session = docs.sparkSession
    items = benchmark.select(
        F.col(item).cast("long").alias("item"), F.col(item_text).alias("text")
    )
    words = F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    total = items.agg(F.sum(words)).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS))
    out = docs.drop(*_ADDED).withColumns(
        {
            "_n_words": F.lit(0).cast("long"),
            "_runs": F.expr("cast(array() AS array<struct<start:bigint,end:bigint>>)"),
            "_items": F.expr("cast(array() AS array<bigint>)"),
        }
    )
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        patterns = session.sparkContext.broadcast([(r.item, r.text) for r in part.collect()])
        last = block + 1 == blocks
        names = keep if last and keep is not None else out.columns
        names = [c for c in names if c not in _ADDED] + _ADDED

        def search(batches, patterns=patterns, names=names):
            tables = build_patterns(patterns.value)
            for batch, n_words, runs, found in _search(batches, tables, text):
                had = batch.column("_runs").to_pylist(), batch.column("_items").to_pylist()
                if any(had[0]):
                    runs = [_merged(a + b) for a, b in zip(had[0], runs, strict=True)]
                ids = [sorted(a | {*b}) for a, b in zip(found, had[1], strict=True)]
                columns = [batch.column(c) for c in names[:-3]] + [
                    pa.array(n_words, pa.int64()),
                    pa.array([_merged(r) for r in runs], _RUNS),
                    pa.array(ids, pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        out = out.mapInArrow(search, out.select(*names).schema)
        if not last:
            out = stored(out, "decontamination")
    return out


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: words, hit words, items and whether it is contaminated."""
    docs = docs.select("doc_id", "text")
    found = find_contamination(docs, benchmark, keep=["doc_id"])
    n_hit = F.expr("aggregate(_runs, 0L, (n, r) -> n + r.end - r.start)")
    ids = F.array_join(F.sort_array(F.col("_items").cast("array<string>")), ",")
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (F.size("_runs") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark window occurs, columns unchanged."""
    docs, restored = set_aside(docs, *_ADDED)
    return restored(find_contamination(docs, benchmark).filter(F.size("_runs") == 0))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, string_split_regex(
    trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')), ' ') AS w
  FROM documents),
docs AS (SELECT doc_id, CASE WHEN w = [''] THEN [] ELSE w END AS w FROM d),
b AS (
  SELECT item_id, string_split_regex(
    trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')), ' ') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m,
    array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
        FROM b WHERE w <> [''])),
places AS (
  SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM docs, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m)),
hits AS (SELECT p.doc_id, p.i, p.m, w.item_id FROM places p JOIN windows w USING (m, s)),
marked AS (
  SELECT doc_id, count(*) AS n_hit FROM (
    SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS k FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items,
    string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)
"""
