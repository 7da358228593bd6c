"""License scans by a positional index of rare words.

The templates' words are counted over all documents. A file looks up all its rare
licence words, however many they are; each posting (template, place) votes, with the
word's inverse document frequency, for the shift between file and template, so
words that stand to each other as in the template meet at one shift. A template whose
shift gathers enough of its weight is confirmed by its key phrases there. The ``OWN``
rarest words of a template are looked up for it however common they are, so a licence
that much of the corpus has is found like any other.

Words are found and hashed for a slice of texts at once, in the task that reads them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import LOWER, WORD, slices, span_hashes, texts_of, words_of

COMMON = 0.1
"""Licence words that more than this share of all documents hold are looked up only
for templates that have them among their ``OWN`` rarest."""
OWN = 4
LEAST = 0.05
"""Weight of a word that all documents hold."""
ENOUGH = 0.35
SLACK = 12
"""Words around a template's place in which its key phrases may stand."""

# Phrases of the base labels.
BASE = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}

# Notices of public licences, and the phrases each must hold.
TEMPLATES: list[tuple[str, str, list[str]]] = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "without restriction"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license", "version 2"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu general public license", "version 3"]),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["gnu general public license", "version 2"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ["gnu affero general public license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["released into the public domain"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights", ["waived all copyright"]),
    ("all-rights-reserved", "copyright all rights reserved", ["all rights reserved"]),
]

LONGEST = max(len(text.split()) for _, text, _ in TEMPLATES)
VOCABULARY = sorted({w for _, text, _ in TEMPLATES for w in text.split()})


def _hash_words(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    return span_hashes(np.frombuffer(b"".join(raw), np.uint8), np.append(0, ends[:-1]), ends)


class _Lookup:
    """Vocabulary words of a slice: the number of each word, or -1."""

    def __init__(self, words: list[str]):
        hashes = _hash_words(words)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of vocabulary words and their numbers."""
        at = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        found = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        good = self.hashes[found] == hashes[at]
        return at[good], self.order[found[good]]


def _sliced(batches: Iterator[pa.RecordBatch], text: str):
    for batch in slices(batches, text):
        data, offsets = texts_of(batch.column(text))
        data = LOWER[data]
        starts, ends, borders = words_of(data, offsets, WORD)
        yield batch, data, starts, ends, borders, span_hashes(data, starts, ends)


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, list[int]]:
    """The number of documents, and how many hold each word of ``VOCABULARY``."""

    def run(batches: Iterator[pa.RecordBatch]):
        lookup, n, counts = _Lookup(VOCABULARY), 0, np.zeros(len(VOCABULARY), np.int64)
        for batch, _, _, _, borders, hashes in _sliced(batches, text):
            at, number = lookup(hashes)
            doc = np.searchsorted(borders, at, "right") - 1
            once = np.unique(doc * len(VOCABULARY) + number) % len(VOCABULARY)
            counts += np.bincount(once, minlength=len(VOCABULARY))
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *range(len(VOCABULARY))]), pa.array([n, *counts.tolist()])],
            names=["word", "n"],
        )

    sums = docs.select(text).mapInArrow(run, "word long, n long").groupBy("word").sum("n")
    found = dict(map(tuple, sums.collect()))  # one row per word of the vocabulary
    return found.get(-1, 0), [found.get(i, 0) for i in range(len(VOCABULARY))]


class _Index:
    """Postings of the rare words and of each template's own, and the phrases as hashes."""

    def __init__(self, n_docs: int, frequencies: list[int]):
        rare = [2 * f <= max(2 * COMMON * n_docs, 4) for f in frequencies]
        weight = [math.log((n_docs + 1) / (f + 0.5)) for f in frequencies]
        self.weight = np.maximum(weight, LEAST)
        self.idf = self.weight * rare
        number = {w: i for i, w in enumerate(VOCABULARY)}
        posts = [[] for _ in VOCABULARY]
        self.total = np.zeros(len(TEMPLATES))
        for t, (_, text, _) in enumerate(TEMPLATES):
            words = [number[w] for w in text.split()]
            own = sorted(set(words), key=lambda w: (-self.weight[w], w))[:OWN]
            for place, word in enumerate(words):
                if rare[word] or word in own:
                    posts[word].append((t, place))
                    self.total[t] += self.weight[word]
        self.first = np.cumsum([0, *map(len, posts)])
        self.posts = np.array([p for own in posts for p in own], np.int64)
        self.base = [(label, p.split(), _hash_words(p.split())) for label, p in BASE.items()]

    def candidates(self, doc: np.ndarray, place: np.ndarray, word: np.ndarray):
        """(document, template, shift, share of weight) with enough weight."""
        posted = self.first[word + 1] > self.first[word]
        doc, place, word = doc[posted], place[posted], word[posted]
        if not len(doc):
            return []
        n = self.first[word + 1] - self.first[word]
        which = np.repeat(np.arange(len(word)), n)
        post = self.posts[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.first[word][which]]
        # a shift is above minus the longest template, a text has under 2**32 words
        key = doc[which] * len(TEMPLATES) + post[:, 0]
        key = (key << 32) + (place[which] - post[:, 1] + LONGEST)
        votes, inverse = np.unique(key, return_inverse=True)
        weight = np.bincount(inverse, self.weight[word][which], len(votes))
        both, shift = votes >> 32, (votes & 0xFFFFFFFF) - LONGEST
        share = weight / self.total[both % len(TEMPLATES)]
        good = share >= ENOUGH
        found = (both // len(TEMPLATES), both % len(TEMPLATES), shift, share)
        return [*zip(*(x[good].tolist() for x in found), strict=True)]


def find_licenses(
    docs: DataFrame,
    frequencies: tuple[int, list[int]] | None = None,
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Columns ``keep`` (all) of ``docs`` and ``_license``: a struct of n_words, the
    places of base phrases, base labels, all labels, and the score.

    The score is 1 with a base label, else the weight share of the best confirmed
    template, else 0. A null or empty text has no words and no labels. A column
    ``_license`` of ``docs`` is replaced.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c != "_license"]
    docs = docs.drop("_license")
    frequencies = frequencies or document_frequencies(docs, text)

    def run(batches: Iterator[pa.RecordBatch]):
        lookup, index = _Lookup(VOCABULARY), _Index(*frequencies)
        for batch, data, starts, ends, borders, hashes in _sliced(batches, text):
            n = batch.num_rows
            places: list[list[int]] = [[] for _ in range(n)]
            base: list[set] = [set() for _ in range(n)]
            labels: list[set] = [set() for _ in range(n)]
            score = np.zeros(n)

            def words(a: int, b: int, data=data, starts=starts, ends=ends) -> list[str]:
                spans = zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)
                return [data[x:y].tobytes().decode() for x, y in spans]

            for label, phrase, wanted in index.base:
                size = len(phrase)
                fit = np.ones(max(0, len(hashes) - size + 1), bool)
                for i, h in enumerate(wanted):
                    fit &= hashes[i : i + len(fit)] == h
                for at in np.flatnonzero(fit).tolist():
                    k = int(np.searchsorted(borders, at, "right")) - 1
                    if at + size <= borders[k + 1] and words(at, at + size) == phrase:
                        places[k].append(at - int(borders[k]))
                        base[k].add(label)
            at, number = lookup(hashes)
            doc = np.searchsorted(borders, at, "right") - 1
            for k, t, shift, share in index.candidates(doc, at - borders[doc], number):
                label, template, phrases = TEMPLATES[t]
                first = int(borders[k]) + max(0, shift - SLACK)
                last = int(borders[k]) + shift + len(template.split()) + SLACK
                around = f" {' '.join(words(first, min(last, int(borders[k + 1]))))} "
                if all(f" {p} " in around for p in phrases):
                    labels[k].add(label)
                    score[k] = max(score[k], min(1.0, share))
            rows = [
                {
                    "n_words": int(borders[k + 1] - borders[k]),
                    "places": sorted(places[k]),
                    "base": sorted(base[k]),
                    "labels": sorted(base[k] | labels[k]),
                    "score": 1.0 if base[k] else float(score[k]),
                }
                for k in range(n)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(rows, _ARROW)],
                names=[*names, "_license"],
            )

    blank = F.expr(f"cast(null AS {_LICENSE})").alias("_license")
    return docs.mapInArrow(run, docs.select(*names, blank).schema)


_LICENSE = (
    "struct<n_words:bigint,places:array<bigint>,base:array<string>,"
    "labels:array<string>,score:double>"
)
_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("places", pa.list_(pa.int64())),
        ("base", pa.list_(pa.string())),
        ("labels", pa.list_(pa.string())),
        ("score", pa.float64()),
    ]
)


def license_report(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    return find_licenses(docs, keep=["doc_id"]).select(
        "doc_id",
        "_license.n_words",
        F.size("_license.places").cast("long").alias("n_base"),
        F.array_min("_license.places").alias("first_word"),
        F.array_max("_license.places").alias("last_word"),
        F.array_join("_license.base", ",").alias("base_labels"),
        F.array_join("_license.labels", ",").alias("labels"),
        "_license.score",
    )
