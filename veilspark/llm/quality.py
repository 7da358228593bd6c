"""Quality rules: an isolation forest over statistics of the rules.

Two fixed rules fail a document outright. For the others the statistics become
features of a forest of random splits; documents that few splits set apart are
anomalous. Nothing is learned from a sample: what is usual and the threshold come from
all labelled rows, and every tree is grown from all documents. Level by level, tasks
count the rows of each node and find the range of each feature in it; a split needs no
more than these. The driver gets histograms and a row per node of a level, which are
bounded whatever the data. Every document is judged whole where it is read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored
from .textbytes import (
    NOT_SPACE,
    mix,
    slices,
    span_hashes,
    sums_per_text,
    texts_of,
    words_of,
)

TREES = 100
HEIGHT = 8
NODES = 2 ** (HEIGHT + 1) - 1
SCORES = 1 << 16
"""Scores are whole parts of this many, which bounds the values of their histogram."""
FEATURES = 4
UNUSUAL = 0.005
STEP = 0.01
"""Least difference of a share that counts; it grows by a quarter of what is usual."""
MIN_WORDS = 50
MOST_REPEATED = 50
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*b"#*$%&|<>"]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _n_repeated_lines(data, offsets, starts) -> np.ndarray:
    """Lines that hold a word and equal an earlier line of their text."""
    n = len(offsets) - 1
    newline = np.flatnonzero(data == 0x0A)
    after = newline[~np.isin(newline + 1, offsets)] + 1  # lines that follow another one
    first = np.sort(np.concatenate([offsets[:-1][np.diff(offsets) > 0], after]))
    doc = np.searchsorted(offsets, first, "right") - 1
    ends = np.append(newline, len(data))
    last = np.minimum(ends[np.searchsorted(newline, first)], offsets[1:][doc])
    worded = np.searchsorted(starts, last) > np.searchsorted(starts, first)
    first, last, doc = first[worded], last[worded], doc[worded]
    key = mix(span_hashes(data, first, last) + doc.astype(np.uint64) * _ODD)
    _, at = np.unique(key, return_index=True)
    return np.bincount(doc, minlength=n) - np.bincount(doc[at], minlength=n)


def _n_repeated_words(data, starts, ends, borders) -> np.ndarray:
    """Words in a three-word window that its text holds twice or more."""
    n, hashes = len(borders) - 1, span_hashes(data, starts, ends)
    marked = np.zeros(len(starts), bool)
    if len(starts) >= 3:
        doc = np.repeat(np.arange(n), np.diff(borders))
        inside = doc[2:] == doc[:-2]
        window = mix(mix(hashes[:-2] * _ODD + hashes[1:-1]) * _ODD + hashes[2:])
        window = mix(window + doc[:-2].astype(np.uint64) * _ODD)[inside]
        at = np.flatnonzero(inside)
        order = np.argsort(window)
        same = window[order][1:] == window[order][:-1]
        twice = at[order[np.append(same, False) | np.append(False, same)]]
        for k in range(3):
            marked[twice + k] = True
    return sums_per_text(marked, borders)


def statistics_of(column: pa.Array) -> np.ndarray:
    """A row of ``STATISTICS`` for each text; null counts as empty."""
    data, offsets = texts_of(column)
    starts, ends, borders = words_of(data, offsets, NOT_SPACE)
    leading = (data & 0xC0) != 0x80  # first byte of a code point
    return np.column_stack(
        [
            np.diff(borders),
            sums_per_text(leading & NOT_SPACE[data], offsets),
            sums_per_text(_SYMBOL[data], offsets),
            _n_repeated_lines(data, offsets, starts),
            _n_repeated_words(data, starts, ends, borders),
        ]
    ).astype(np.int64)


def base_failed(statistics: np.ndarray) -> np.ndarray:
    words, repeated = statistics[:, 0], statistics[:, 4]
    return (words < MIN_WORDS) | (100 * repeated > MOST_REPEATED * words)


def shares_of(statistics: np.ndarray) -> np.ndarray:
    """Symbols by character, repeated lines and repeated words by word, and the distance
    of the mean word length from five: shares, so that length alone is no anomaly."""
    words, chars, symbols, lines, repeated = statistics.T.astype(float)
    size = np.maximum(words, 1)
    return np.column_stack(
        [
            symbols / np.maximum(chars, 1),
            lines / size,
            repeated / size,
            np.abs(np.log(np.maximum(chars, 1) / size / 5.0)),
        ]
    )


def features_of(statistics: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """What the forest splits on: how far each share is above what is usual.

    In steps, for the forest would part any differences that are left, however small.
    """
    above = np.maximum(shares_of(statistics) - usual, 0.0)
    return np.floor(above / (usual / 4 + STEP))


@dataclass
class Forest:
    """Trees as arrays: the feature (-1: a leaf) and value of each split, path lengths.

    Node 0 is the root; the children of node i are 2 i + 1 and 2 i + 2.
    """

    feature: np.ndarray
    value: np.ndarray
    length: np.ndarray
    rows: int

    def nodes(self, x: np.ndarray, tree: int) -> np.ndarray:
        """How far down the tree each row comes."""
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(HEIGHT):
            feature = self.feature[tree, node]
            right = x[rows, np.maximum(feature, 0)] >= self.value[tree, node]
            node = np.where(feature >= 0, 2 * node + 1 + right, node)
        return node

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1; the shorter the mean path, the higher."""
        total = np.zeros(len(x))
        for t in range(TREES):
            total += self.length[t, self.nodes(x, t)]
        usual = _path(self.rows)
        return np.round(SCORES * 2.0 ** (-total / TREES / usual)) / SCORES if usual else total


@dataclass
class Model:
    """What is usual among rows labelled good, the forest, and where anomalies begin."""

    usual: np.ndarray
    forest: Forest
    threshold: float

    def anomaly(self, statistics: np.ndarray) -> np.ndarray:
        return self.forest.score(features_of(statistics, self.usual))


def _path(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def node_ranges(forest: Forest, level: int, x: np.ndarray, n: np.ndarray) -> dict:
    """Of each node of a level that rows reach: ``place`` (tree * NODES + node), how many
    they are, and the range of each feature. Row i of ``x`` stands for ``n[i]`` rows."""
    parts = []
    for t in range(TREES if len(x) else 0):
        node = forest.nodes(x, t)
        own = np.flatnonzero(node >= 2**level - 1)
        if len(own):
            own = own[np.argsort(node[own], kind="stable")]
            first = np.flatnonzero(np.diff(node[own], prepend=-1))
            ranges = [f.reduceat(x[own], first) for f in (np.minimum, np.maximum)]
            place = t * NODES + node[own][first]
            parts.append([place, np.add.reduceat(n[own], first), *ranges[0].T, *ranges[1].T])
    columns = zip(*parts, strict=True) if parts else [[np.empty(0)]] * len(_ranges_of(x.shape[1]))
    return dict(zip(_ranges_of(x.shape[1]), map(np.concatenate, columns), strict=True))


def _ranges_of(features: int) -> list[str]:
    return ["place", "n", *(f"{end}{k}" for end in ("low", "high") for k in range(features))]


def grown(ranges: Callable[[Forest, int], dict], features: int, seed: int = 11) -> Forest:
    """An isolation forest over rows of which ``ranges`` tells the ``node_ranges``."""
    chance = np.random.default_rng(seed)
    shape = (TREES, NODES)
    forest = Forest(np.full(shape, -1), np.zeros(shape), np.zeros(shape), 0)
    for level in range(HEIGHT + 1):
        found = ranges(forest, level)
        if not len(found["place"]):
            break
        order = np.argsort(found["place"])
        tree, node = np.divmod(found["place"][order].astype(np.int64), NODES)
        rows = found["n"][order]
        low, high = (
            np.column_stack([found[f"{end}{k}"][order] for k in range(features)])
            for end in ("low", "high")
        )
        forest.rows = max(forest.rows, int(rows.max()))
        for i, at in enumerate(zip(tree.tolist(), node.tolist(), strict=True)):
            varied = np.flatnonzero(high[i] > low[i])
            if level == HEIGHT or not len(varied):
                forest.length[at] = level + _path(float(rows[i]))
                continue
            f = int(chance.choice(varied))
            cut = chance.uniform(low[i, f], high[i, f])
            forest.feature[at], forest.value[at] = f, high[i, f] if cut <= low[i, f] else cut
    return forest


def grow(x: np.ndarray, seed: int = 11) -> Forest:
    """The forest of the rows of ``x``."""
    n = np.ones(len(x), np.int64)
    return grown(lambda forest, level: node_ranges(forest, level, x, n), x.shape[1], seed)


def best_threshold(
    scores: np.ndarray, good: np.ndarray, n: np.ndarray | None = None
) -> float:
    """The score from which documents go: highest mean of the two kinds' shares told right.

    An entry stands for ``n`` rows, or for one.
    """
    if not len(scores) or good.all() or not good.any():
        return 1.0
    order = np.argsort(scores)
    s, n = scores[order], np.ones(len(scores), np.int64) if n is None else n[order]
    g, b = n * good[order], n * ~good[order]
    right_good = np.concatenate([[0], np.cumsum(g)]) / g.sum()
    right_bad = 1 - np.concatenate([[0], np.cumsum(b)]) / b.sum()
    between = np.concatenate([[True], s[1:] > s[:-1], [True]])
    value = np.where(between, right_good + right_bad, -1)
    k = len(s) - int(np.argmax(value[::-1]))
    return float(1.0 if k == len(s) else s[k] if k == 0 else (s[k - 1] + s[k]) / 2)


def with_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None):
    """Columns ``keep`` (all) of ``docs`` and those of ``STATISTICS``."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in STATISTICS]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, text):
            columns = [pa.array(c) for c in statistics_of(batch.column(text)).T]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + columns, names=[*names, *STATISTICS]
            )

    added = [F.lit(0).cast("long").alias(c) for c in STATISTICS]
    return docs.mapInArrow(run, docs.select(*names, *added).schema)


def _mapped(df: DataFrame, columns: str, run: Callable[[np.ndarray], list]) -> DataFrame:
    """``columns`` that ``run`` makes of all the columns of ``df`` (a matrix, a row each)."""
    names = [c.split()[0] for c in columns.split(", ")]

    def batches(given: Iterator[pa.RecordBatch]):
        for batch in given:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            made = run(np.column_stack(rows)) if batch.num_rows else None
            if made is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], names=names)

    return df.mapInArrow(batches, columns)


def _collected(df: DataFrame) -> dict[str, np.ndarray]:
    table = df.toArrow()
    return {c: table[c].to_numpy() for c in table.column_names}


def usual_shares(good: DataFrame) -> np.ndarray:
    """Of each share the quantile that all but ``UNUSUAL`` of the rows keep to.

    ``good`` has ``STATISTICS`` and is read several times: give a stored table. The
    rows on both sides of the quantile are found 16 bits at a time: shares are no less
    than zero, so their bits are in their order.
    """
    n = good.count()
    if not n:
        return np.zeros(FEATURES)
    middle = (n - 1) * (1 - UNUSUAL)
    ranks = np.array([int(middle), min(int(middle) + 1, n - 1)] * FEATURES)
    known = np.zeros(2 * FEATURES, np.int64)  # the leading bits of each
    for shift in (48, 32, 16, 0):

        def counts(rows, shift=shift, known=known):
            bits = (shares_of(rows) + 0.0).view(np.int64).T
            found = []
            for k in range(2 * FEATURES):
                # two shifts, for one by 64 bits would be none
                own = bits[k // 2][(bits[k // 2] >> shift >> 16) == known[k]] >> shift
                value, times = np.unique(own, return_counts=True)
                found.append([np.full(len(value), k), value, times])
            return [np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True)]

        seen = _mapped(good.select(*STATISTICS), "k long, value long, n long", counts)
        seen = _collected(seen.groupBy("k", "value").agg(F.sum("n").alias("n")))
        below, known = ranks, known.copy()
        ranks = ranks.copy()
        for k in range(2 * FEATURES):
            own = np.flatnonzero(seen["k"] == k)
            own = own[np.argsort(seen["value"][own])]
            upto = np.cumsum(seen["n"][own])
            at = int(np.searchsorted(upto, below[k], "right"))
            known[k] = seen["value"][own[at]]
            ranks[k] = below[k] - (upto[at] - seen["n"][own[at]])
    a, b = known.view(np.float64).reshape(-1, 2).T
    part = middle - int(middle)
    return a + (b - a) * part if part < 0.5 else b - (b - a) * (1 - part)


_VECTOR = [f"f{k}" for k in range(FEATURES)]


def _vectors(rows: DataFrame, usual: np.ndarray) -> DataFrame:
    """The features of rows of ``STATISTICS`` and whatever number follows."""
    n = len(STATISTICS)
    more = [c for c in rows.columns if c not in STATISTICS]
    columns = ", ".join([f"{c} double" for c in _VECTOR] + [f"{c} long" for c in more])

    def run(given):
        return [*features_of(given[:, :n], usual).T, *given[:, n:].T]

    return _mapped(rows.select(*STATISTICS, *more), columns, run)


def forest_of(rows: DataFrame, usual: np.ndarray) -> Forest:
    """The forest of all rows of ``STATISTICS``; rows of the same features are one row
    that counts as many."""
    vectors = _vectors(rows, usual).groupBy(*_VECTOR).agg(F.count("*").alias("n"))
    vectors = stored(vectors, "features")
    names = _ranges_of(FEATURES)
    columns = ", ".join(f"{c} {'long' if c in ('place', 'n') else 'double'}" for c in names)

    def ranges(forest: Forest, level: int) -> dict:
        so_far = rows.sparkSession.sparkContext.broadcast(forest)

        def run(given):
            x, n = given[:, :FEATURES], given[:, FEATURES].astype(np.int64)
            found = node_ranges(so_far.value, level, x, n)
            return [found[c].astype(np.int64 if c in ("place", "n") else float) for c in names]

        how = {"n": F.sum, "low": F.min, "high": F.max}
        found = _mapped(vectors, columns, run).groupBy("place")
        return _collected(found.agg(*(how[c.rstrip("0123456789")](c).alias(c) for c in names[1:])))

    return grown(ranges, FEATURES)


def calibrate(stats: DataFrame, labels: DataFrame) -> Model:
    """The forest of all documents, and thresholds from all labelled ones.

    ``stats`` has doc_id and ``STATISTICS`` of each document and is read several times:
    give a stored table. Of the rows labelled good all but ``UNUSUAL`` are usual in each
    share; the forest sees what is above. Labels that are null teach nothing; an id
    labelled twice is good if both say so. Without labels of both kinds nothing is an
    anomaly.
    """
    passing = stats.filter(
        (F.col("n_words") >= MIN_WORDS)
        & (100 * F.col("n_repeat_words") <= MOST_REPEATED * F.col("n_words"))
    )
    known = (
        labels.filter("quality IS NOT NULL")
        .groupBy("doc_id")
        .agg((F.min("quality") > 0).cast("long").alias("good"))
    )
    told = stored(passing.join(known, "doc_id").select(*STATISTICS, "good"), "labelled")
    usual = usual_shares(told.filter("good = 1").drop("good"))
    model = Model(usual, forest_of(passing.select(*STATISTICS), usual), 1.0)
    forest = stats.sparkSession.sparkContext.broadcast(model.forest)

    def scored(given):
        x, numbers = given[:, :FEATURES], given[:, FEATURES:].astype(np.int64)
        return [forest.value.score(x), *numbers.T]

    counts = _vectors(told, usual).groupBy(*_VECTOR, "good").agg(F.count("*").alias("n"))
    seen = _mapped(counts, "score double, good long, n long", scored).groupBy("score", "good")
    seen = _collected(seen.agg(F.sum("n").alias("n")))
    model.threshold = best_threshold(seen["score"], seen["good"] == 1, seen["n"])
    return model


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed, anomaly and kept of every document.

    A null or empty text has no words and fails the base rule. Repeated rows are judged
    one by one and alike.
    """
    stats = stored(with_statistics(docs.select("doc_id", "text"), keep=["doc_id"]), "statistics")
    model = docs.sparkSession.sparkContext.broadcast(calibrate(stats, labels))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = np.column_stack([batch.column(c).to_numpy() for c in STATISTICS])
            failed, anomaly = base_failed(rows), model.value.anomaly(rows)
            kept = ~failed & (anomaly < model.value.threshold)
            added = [pa.array(failed), pa.array(anomaly), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(
                batch.columns + added,
                names=[*batch.schema.names, "base_failed", "anomaly", "kept"],
            )

    added = (F.lit(True).alias("base_failed"), F.lit(0.0).alias("anomaly"), F.lit(True).alias("kept"))
    return stats.mapInArrow(run, stats.select("*", *added).schema)
