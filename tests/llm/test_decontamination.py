import hashlib
import re

from veilspark.llm import decontamination as D

from .data import prose, table, with_clashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BENCH = "item_id long, text string"


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def brute(text, items):
    own = words(text)
    hit, found = set(), set()
    for item, other in items:
        w = words(other)
        m = min(10, len(w))
        windows = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
        for i in range(len(own) - m + 1):
            if m and tuple(own[i : i + m]) in windows:
                hit |= set(range(i, i + m))
                found.add(item)
    ids = ",".join(sorted(str(i) for i in found if i is not None))
    n = len([i for i in found if i is not None])
    return len(own), len(hit), n, hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


ITEMS = [
    (1, prose(1, 15)),
    (2, prose(1, 15)),  # the same item twice
    (3, "one"),
    (4, None),
    (5, "  "),
    (10, "THE SAME id, Another text"),
    (11, prose(6, 12)),
    (12, "x x x x x x x x x x x x"),
    (13, "日本語 😀"),
]


def report(spark, docs, items=ITEMS):
    bench = spark.createDataFrame(items, BENCH)
    rows = D.contamination_report(docs, bench).collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_against_brute_force(spark):
    extra = [
        (20 + i, f"{prose(i, i)}, {prose(6, 12).upper()}! {prose(i, 40)} x" + " x" * i, "en", "a", 1)
        for i in range(30)
    ]
    from .data import awkward

    rows = awkward() + extra
    want = sorted(((r[0], *brute(r[1], ITEMS)) for r in rows), key=repr)
    assert report(spark, with_clashes(table(spark, rows))) == want
    assert any(w[-1] for w in want) and not all(w[-1] for w in want)


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    want = report(spark, table(spark))
    monkeypatch.setattr(D, "BLOCK_WORDS", 20)
    assert report(spark, table(spark)) == want


def test_empty_tables(spark):
    assert report(spark, table(spark, [])) == []
    assert not any(r[-1] for r in report(spark, table(spark), [(None, None)]))
    nothing = spark.createDataFrame([], BENCH)
    assert D.contamination_report(table(spark), nothing).count() == 14


def test_clean_documents_stay_as_they_are(spark):
    docs = with_clashes(table(spark))
    bench = spark.createDataFrame(ITEMS, BENCH)
    kept = D.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    clean = {r[0] for r in report(spark, docs) if not r[-1]}
    assert {r.doc_id for r in kept.collect()} == clean
