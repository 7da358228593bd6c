import re

import numpy as np

from veilspark.llm import licenses as L

from .data import awkward, prose, table, with_clashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    ("Released under the MIT License.", "mit", "mit"),
    ("Licensed under CC BY-NC 4.0. Licensed under the CC by NC", "cc-by-nc", "cc-by-nc"),
    ("Licensed under the Apache License, Version 2.0.", "apache-2", "apache-2"),
    ("under the MIT license under the mit LICENSE and apache license version 2", "apache-2,mit", "apache-2,mit"),
    ("This work is licensed under the GNU General Public License, version 3.", "", "gpl-3"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "", "bsd"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "", ""),
    ("license of the general public, under version", "", ""),
    ("under the mit", "", ""),
]


def base(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    places, labels = [], set()
    for label, phrase in L.BASE.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    first, last = (min(places), max(places)) if places else (None, None)
    return len(words), len(places), first, last, ",".join(sorted(labels))


def test_base_places_and_labels(spark):
    wrapped = [(100 + i, f"{prose(i, 40)} {t} {prose(i + 50, 30)}", "en", "a", 1) for i, (t, *_) in enumerate(TEXTS)]
    rows = awkward() + [(50 + i, t, "en", "a", 1) for i, (t, *_) in enumerate(TEXTS)] + wrapped
    got = L.license_report(with_clashes(table(spark, rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        want = [base(x[1]) for x in rows if x[0] == r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) in want
        assert 0 <= r.score <= 1
    by_id = {r.doc_id: r for r in got}
    for i, (_, own, labels) in enumerate(TEXTS):
        for k in (50 + i, 100 + i):
            assert (by_id[k].base_labels, by_id[k].labels) == (own, labels), TEXTS[i]
    assert L.license_report(table(spark, [])).count() == 0


def test_common_words_are_not_looked_up(spark):
    rows = [(i, "the license and version of this", "en", "a", 1) for i in range(40)]
    n, counts = L.document_frequencies(table(spark, rows))
    assert n == 40 and counts[L.VOCABULARY.index("license")] == 40
    index = L._Index(n, counts)
    assert index.idf[L.VOCABULARY.index("license")] == 0
    assert index.idf[L.VOCABULARY.index("apache")] > 0


def test_files_of_many_licenses(spark):
    labels = ["apache-2", "bsd", "cc0", "gpl-3", "isc", "mit", "mpl-2", "unlicense"]
    longest = {x: max((t for own, t, _ in L.TEMPLATES if own == x), key=len) for x in labels}
    notices = " ".join(f"{prose(i, 30)} {longest[x]}." for i, x in enumerate(labels))
    rows = [(0, notices, "en", "a", 1)] + [(i, prose(i, 40), "en", "a", 1) for i in range(1, 60)]
    got = {r.doc_id: r.labels for r in L.license_report(table(spark, rows)).collect()}
    assert got[0].split(",") == labels and not any(got[i] for i in range(1, 60))


def test_licenses_of_much_of_the_corpus(spark):
    for t, (label, notice, _) in enumerate(L.TEMPLATES):
        index = L._Index(30, [30] * len(L.VOCABULARY))
        words = np.array([L.VOCABULARY.index(w) for w in notice.split()])
        found = index.candidates(np.zeros(len(words), int), np.arange(len(words)), words)
        assert (0, t, 0) in [f[:3] for f in found], label
    header = next(t for own, t, _ in L.TEMPLATES if own == "gpl-3" and "redistribute" in t)
    texts = [f"{prose(i, 20)} {header if i % 3 == 0 else ''} {prose(i + 50, 20)}" for i in range(30)]
    got = L.license_report(table(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)]))
    assert {r.doc_id: r.labels for r in got.collect()} == {i: "" if i % 3 else "gpl-3" for i in range(30)}
