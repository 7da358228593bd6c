"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding.

Folding undoes disguise: look-alike letters become Latin ones, and digits or signs
that stand for letters become those inside a word. The lexicon is learned from
labelled rows: whole words and word beginnings that toxic documents hold far oftener
than others, weighted by log-odds. Pairs of words around an entry that only clean
documents hold become exception phrases, whose entry does not count.

The score puts two features into a logistic model: the summed weight, and the same
normalised by length.

Labelled rows are reduced to a sample of at most about ``TRAIN_ROWS`` for learning;
every document is scored whole, in the task that reads it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import set_aside, stored
from .textbytes import slices

TRAIN_ROWS = 12_000
"""Expected bound of the labelled rows that a lexicon is learned from."""
LEXICON = 5_000
"""Entries kept, the strongest first."""
SURE = 13.0
"""Evidence an entry needs, about e to the minus 13 of one found by chance."""
CUT = 0.3
STEMS = (4, 5, 6, 7)

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "a": "аα",
    "b": "Ьв",
    "c": "сϲ",
    "d": "ԁ",
    "e": "еε",
    "g": "ɡ",
    "h": "һн",
    "i": "іıι",
    "j": "ј",
    "k": "кκ",
    "l": "ӏ",
    "m": "м",
    "n": "ո",
    "o": "оοо",
    "p": "рρ",
    "q": "ԛ",
    "s": "ѕ",
    "t": "тτ",
    "u": "υս",
    "v": "ѵν",
    "w": "ԝω",
    "x": "хχ",
    "y": "уγ",
}
# Digits and signs that stand for letters.
SUBSTITUTES = {
    "0": "o",
    "1": "i",
    "3": "e",
    "4": "a",
    "5": "s",
    "7": "t",
    "8": "b",
    "@": "a",
    "$": "s",
    "!": "i",
}

# Insults known beforehand, for tables with few labels.
SEEDS = (
    "idiot idiots moron morons stupid scum pathetic worthless disgusting loser losers "
    "trash garbage filthy bastard bitch dumbass asshole retard imbecile clown vermin "
    "arschloch idioten dummkopf abschaum wertlos hurensohn connard salaud ordure "
    "imbécile crétin abruti idiota idiotas imbécil estúpido basura escoria cabrón"
).split()
SEED_WEIGHT = 3.0

_LATIN = {ord(x): latin for latin, like in HOMOGLYPHS.items() for x in like}
_LATIN |= {0xFF41 + i: chr(0x61 + i) for i in range(26)}  # full width
_SIGNS = re.escape("".join(SUBSTITUTES))
_DISGUISED = re.compile(
    rf"[{_SIGNS}]*[^\W\d_]+(?:[{_SIGNS}]+[^\W\d_]+)+|[{_SIGNS}]+[^\W\d_]{{2,}}"
)
_SIGN_TO_LETTER = str.maketrans(SUBSTITUTES)
_HAS_SIGN = re.compile(rf"[{_SIGNS}]")
WORDS = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower case, look-alikes as Latin letters, signs in a word as letters."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_LATIN)
    if _HAS_SIGN.search(text):
        text = _DISGUISED.sub(lambda m: m[0].translate(_SIGN_TO_LETTER), text)
    return text


@dataclass
class Model:
    """What is learned: entries (a trailing * marks a word beginning), exceptions, scale."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    scale: tuple[float, float, float] = (0.0, 0.0, -3.0)

    def automaton(self):
        """Entries and exception phrases, each with its weight (0 for a phrase)."""
        search = ahocorasick.Automaton()
        entries = [(e.rstrip("*"), e[-1] == "*", w) for e, w in self.weights.items()]
        entries += [(phrase, False, None) for phrase in self.exceptions]
        found: dict[str, list] = {}
        for word, open_, weight in entries:
            found.setdefault(word, []).append((len(word), open_, weight))
        for word, payload in found.items():
            search.add_word(word, payload)
        if found:
            search.make_automaton()
        return search if found else None


def matches(text: str, search) -> list[float]:
    """Weights of the entries in a folded text, those inside exceptions left out.

    An entry begins at a word's first letter and, unless it is a beginning, ends at its
    last. Of entries that begin at one place the heaviest counts.
    """
    if search is None:
        return []
    n, at, spared = len(text), {}, []
    for end, payload in search.iter(text):
        for size, open_, weight in payload:
            start = end + 1 - size
            if start and text[start - 1].isalpha():
                continue
            if not open_ and end + 1 < n and text[end + 1].isalpha():
                continue
            if weight is None:
                spared.append((start, end))
            else:
                at[start] = max(weight, at.get(start, 0.0))
    if spared:
        at = {s: w for s, w in at.items() if not any(a <= s <= b for a, b in spared)}
    return list(at.values())


def features(text: str | None, search) -> tuple[float, float]:
    """Summed weight (damped) and weight per word; both 0 for an empty text."""
    folded = fold(text or "")
    weights = matches(folded, search)
    if not weights:
        return 0.0, 0.0
    words = folded.count(" ") + folded.count("\n") + 1
    total = sum(weights)
    return math.log1p(total), math.log1p(100 * total / words)


def _entries(text: str) -> set[str]:
    words = {*WORDS.findall(fold(text))}
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) >= k}


def _count_entries(batches: Iterator[pa.RecordBatch]):
    """(entry, n toxic, n clean) over the documents of a task."""
    counts: tuple[Counter, Counter] = Counter(), Counter()
    for batch in slices(batches, "text"):
        for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts[not toxic].update(_entries(text or ""))
    names = [*counts[0], *(counts[1].keys() - counts[0].keys())]
    for i in range(0, len(names), 100_000):
        part = names[i : i + 100_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part)] + [pa.array([c[e] for e in part], pa.int64()) for c in counts],
            names=["entry", "toxic", "clean"],
        )


def _evidence(toxic: int, clean: int, share: float) -> float:
    """How surely an entry is toxic: its documents' divergence from the usual share.

    e to the minus this bounds the chance that an entry of no meaning does as well.
    """
    n, p = toxic + clean, toxic / (toxic + clean)
    if p <= share:
        return 0.0
    rest = (1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0.0
    return n * (p * math.log(p / share) + rest)


def _choose(
    counted: list, n_toxic: int, n_clean: int
) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of the surest entries and how often their documents are toxic.

    The surest comes first; entries that begin one another are alternatives, of which
    it is the only one taken. A word wins a tie against a beginning.
    """
    share = n_toxic / (n_toxic + n_clean)
    sure = {r.entry: _evidence(r.toxic, r.clean, share) for r in counted}
    support = {r.entry: (r.toxic, r.clean) for r in counted}
    weights: dict[str, float] = {}
    rates: dict[str, float] = {}
    blocked: set[str] = set()
    for entry in sorted(sure, key=lambda e: (-sure[e], e[-1] == "*", len(e), e)):
        word = entry.rstrip("*")
        above = {word[:k] + "*" for k in STEMS if k <= len(word)}
        if sure[entry] < SURE or entry in blocked or not above.isdisjoint(weights):
            continue
        toxic, clean = support[entry]
        weights[entry] = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log(
            (clean + 0.5) / (n_clean + 1)
        )
        rates[entry] = toxic / (toxic + clean)
        blocked |= above
        if len(weights) == LEXICON:
            break
    return weights, rates


def _owners(word: str, weights: dict[str, float]) -> list[str]:
    """The entries that match a word."""
    own = [word, *(word[:k] + "*" for k in STEMS if k <= len(word))]
    return [e for e in own if e in weights]


def _phrases(text: str, weights: dict[str, float]) -> set[str]:
    """Pairs of neighbouring words of which one is an entry."""
    words = WORDS.findall(fold(text))
    hit = [bool(_owners(w, weights)) for w in words]
    pairs = zip(words, words[1:], hit, hit[1:], strict=False)
    return {f"{a} {b}" for a, b, x, y in pairs if x or y}


def _fit(rows: np.ndarray, toxic: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a little shrinkage, by Newton steps that never overshoot."""
    x = np.column_stack([rows, np.ones(len(rows))])
    shrink = np.array([1e-2, 1e-2, 1e-4])

    def loss(w):
        z = np.where(toxic > 0, x @ w, -(x @ w))
        return np.logaddexp(0, -z).sum() + (shrink * w * w).sum() / 2

    w = np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - toxic) + shrink * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink)
        step, size = np.linalg.solve(curve, slope), 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return tuple(map(float, w))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document's labels are kept from training; null ids are not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled documents that are not held out.

    Documents without a label, or with a null one, teach nothing. Rows of ``labels``
    that repeat an id count once, toxic if any says so. Without both kinds of rows the
    lexicon is the seeds.
    """
    session = docs.sparkSession
    known = (
        labels.filter("toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).alias("toxic"))
        .filter(~held_out())
    )
    n = known.count()
    share = min(1.0, TRAIN_ROWS / n) if n else 1.0
    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select("doc_id", "text").join(sample, "doc_id").select("text", "toxic")
    # a text counts once; what is kept for the three passes is the sample alone
    rows = rows.groupBy("text").agg(F.max("toxic").alias("toxic"))
    rows = stored(rows, "labelled").repartition(session.sparkContext.defaultParallelism)
    kinds = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = kinds.get(True, 0), kinds.get(False, 0)
    if not n_toxic or not n_clean:
        return Model(dict.fromkeys(SEEDS, SEED_WEIGHT), scale=(1.0, 1.0, -3.0))
    least = max(3, n_toxic // 100)
    counted = (
        rows.mapInArrow(_count_entries, "entry string, toxic long, clean long")
        .groupBy("entry")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter(f"toxic >= {least} AND toxic / {n_toxic} > 4 * clean / {n_clean}")
        .orderBy(F.desc("toxic"), "entry")
        .limit(20 * LEXICON)
    )
    chosen, rates = _choose(counted.collect(), n_toxic, n_clean)
    model = Model({e: SEED_WEIGHT for e in SEEDS} | chosen)
    weights = session.sparkContext.broadcast(model.weights)

    def count_phrases(batches):
        counts: tuple[Counter, Counter] = Counter(), Counter()
        for batch in slices(batches, "text"):
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts[not toxic].update(_phrases(text or "", weights.value))
        names = [*(counts[0].keys() | counts[1].keys())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string())]
            + [pa.array([c[e] for e in names], pa.int64()) for c in counts],
            names=["entry", "toxic", "clean"],
        )

    spared = (
        rows.mapInArrow(count_phrases, "entry string, toxic long, clean long")
        .groupBy("entry")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter("toxic = 0 AND clean >= 3")
        .select("entry", "clean")
        .orderBy(F.desc("clean"), "entry")
        .limit(LEXICON)
    )
    for phrase, clean in spared.collect():
        owners = [e for word in phrase.split() for e in _owners(word, rates)]
        if owners and clean * -math.log(1 - max(min(rates[e], 0.98) for e in owners)) > SURE:
            model.exceptions.add(phrase)
    measured = session.sparkContext.broadcast(model)

    def measure(batches):
        search = measured.value.automaton()
        for batch in slices(batches, "text"):
            found = [features(t, search) for t in batch.column(0).to_pylist()]
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.float64()), pa.array(b, pa.float64()), batch.column(1)],
                names=["a", "b", "toxic"],
            )

    # three numbers for each row of the sample
    seen = rows.mapInArrow(measure, "a double, b double, toxic boolean").collect()
    known_rows = np.array(sorted((r.a, r.b, float(r.toxic)) for r in seen))
    model.scale = _fit(known_rows[:, :2], known_rows[:, 2])
    return model


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None):
    """Columns ``keep`` (all) of ``docs`` and ``_toxicity`` from 0 to 1.

    Null counts as empty; empty texts have the score of a text without matches.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c != "_toxicity"]
    docs = docs.drop("_toxicity")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        search = shared.value.automaton()
        a, b, c = shared.value.scale
        for batch in slices(batches, text):
            found = np.array(
                [features(t, search) for t in batch.column(text).to_pylist()]
            )
            value = 1 / (1 + np.exp(-np.clip(found @ np.array([a, b]) + c, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(x) for x in names] + [pa.array(value)],
                names=[*names, "_toxicity"],
            )

    schema = docs.select(*names, F.lit(0.0).alias("_toxicity")).schema
    return docs.mapInArrow(run, schema)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = learn(docs, labels)
    scored = score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("_toxicity").alias("score"),
        (F.col("_toxicity") >= CUT).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below the cut, columns unchanged."""
    docs, restored = set_aside(docs, "_toxicity")
    return restored(score(docs, learn(docs, labels)).filter(F.col("_toxicity") < CUT))
