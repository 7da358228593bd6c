import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from veilspark.llm import quality as Q

from .data import awkward, prose, table, with_clashes

LABELS = "doc_id long, quality int, toxic int"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    marked = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            marked |= {i, i + 1, i + 2}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), again, len(marked)


def texts():
    chance = random.Random(2)
    out = [r[1] for r in awkward()] + ["a\nb\na\n\n\n \na", "\n", "a\n", "x y x y x y x", "é# é# é#"]
    for _ in range(300):
        n = chance.randrange(40)
        out.append("".join(chance.choice(["a", "b", " ", "\n", "é", "#", "\r", "\x0b", "\x1c"]) for _ in range(n)))
    return out


def test_statistics():
    got = Q.statistics_of(pa.array(texts())).tolist()
    assert [tuple(g) for g in got] == [brute(t) for t in texts()]
    assert Q.statistics_of(pa.array([], pa.string())).shape == (0, 5)


def corpus(n=600):
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        words = prose(i, 70 + i % 90).split()
        text = " ".join(w + "%%%" for w in words) if bad else " ".join(words)
        rows.append((i, text + ("\nx y z\nx y z" if i % 9 == 1 else ""), "en", "a", 1))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_junk_goes_and_clean_documents_stay(spark):
    rows, labels = corpus()
    docs, known = table(spark, rows), spark.createDataFrame(labels[::2], LABELS)
    got = {r.doc_id: r for r in Q.quality_report(docs, known).collect()}
    assert all(tuple(got[r[0]][c] for c in Q.STATISTICS) == brute(r[1]) for r in rows)
    told = [got[i].kept == bool(good) for i, good, _ in labels[1::2]]
    assert sum(told) / len(told) > 0.97


def test_awkward_rows(spark):
    _, labels = corpus(10)
    labels += [(1, None, None), (2, 1, 1), (2, 0, 0), (None, 1, 1)]
    known = spark.createDataFrame(labels, LABELS)
    got = Q.quality_report(with_clashes(table(spark)), known).collect()
    assert len(got) == 14
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert Q.quality_report(table(spark, []), known).count() == 0
    nothing = spark.createDataFrame([], LABELS)
    assert Q.quality_report(table(spark), nothing).filter("kept <> (NOT base_failed)").count() == 0


def test_forest_isolates_what_is_apart():
    chance = np.random.default_rng(1)
    x = np.concatenate([chance.normal(0, 1, (2000, 3)), [[9, 9, 9], [-8, -8, 8]]])
    scores = Q.grow(x).score(x)
    assert scores[-2:].min() > np.quantile(scores[:-2], 0.99)
    assert 0 < scores.min() and scores.max() < 1
    alike = Q.grow(np.zeros((100, 3)))
    assert np.isfinite(alike.score(np.zeros((2, 3)))).all()
    assert np.isfinite(Q.grow(np.zeros((0, 3))).score(np.zeros((2, 3)))).all()


def test_threshold():
    scores, good = np.array([0.1, 0.2, 0.3, 0.8, 0.9]), np.array([1, 1, 1, 0, 0], bool)
    assert 0.3 < Q.best_threshold(scores, good) < 0.8
    assert Q.best_threshold(scores, ~good | good) == 1.0


def test_calibration_reads_every_row(spark, monkeypatch):
    """Nothing is learned from a sample, however large the table is."""
    monkeypatch.setattr(Q, "SAMPLE_ROWS", 20, raising=False)
    rows, labels = corpus()
    docs, known = table(spark, rows), spark.createDataFrame(labels, LABELS)
    stats = Q.stored(Q.with_statistics(docs, keep=["doc_id"]), "statistics")
    model = Q.calibrate(stats, known)
    every = np.array([brute(r[1]) for r in rows])
    good = np.array([bool(g) for _, g, _ in labels])
    passed = ~Q.base_failed(every)
    shares = Q.shares_of(every[passed & good])
    usual = np.quantile(shares, 1 - Q.UNUSUAL, axis=0)
    assert model.usual.tolist() == usual.tolist()
    assert model.forest.rows == passed.sum()
    alone = Q.grow(Q.features_of(every[passed], usual))
    assert np.array_equal(model.forest.feature, alone.feature)
    assert np.array_equal(model.forest.value, alone.value)
    assert np.array_equal(model.forest.length, alone.length)
    scores = alone.score(Q.features_of(every[passed], usual))
    assert model.threshold == Q.best_threshold(scores, good[passed])
    kept = {r.doc_id: r.kept for r in Q.quality_report(docs, known).collect()}
    assert all(kept[i] == bool(g) for (i, g, _), ok in zip(labels, passed) if ok)


def test_threshold_of_counted_scores():
    scores, good, n = np.array([0.2, 0.2, 0.6, 0.6]), np.array([1, 0, 1, 0], bool), np.array([90, 1, 2, 30])
    every = Q.best_threshold(np.repeat(scores, n), np.repeat(good, n))
    assert Q.best_threshold(scores, good, n) == every
