"""Small made-up tables with the awkward cases that every operator must take."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "the of and lorem ipsum dolor sit amet consec tetur elit sed tempor".split()


def prose(seed: int, n: int) -> str:
    chance = random.Random(seed)
    return " ".join(chance.choice(WORDS) + str(chance.randrange(90)) for _ in range(n))


def awkward() -> list[tuple]:
    """Nulls, empty and long texts, ties, repeated rows, odd characters."""
    rows = [
        (1, prose(1, 120), "en", "a", 5),
        (2, prose(1, 120), "en", "a", 5),  # a copy
        (2, prose(1, 120), "en", "a", 5),  # a repeated row
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, " \n\t ", "de", "b", 4),
        (6, prose(2, 30_000), "en", None, None),
        (7, prose(1, 119) + " changed", "en", "c", 1),
        (7, "another text of the same id", "en", "c", 1),
        (8, "Ünïcödé 日本語 😀 x́ end", "xx", "c", 2),
        (None, prose(3, 80), "en", "a", 3),
        (None, None, None, "a", None),
        (9, "one", "en", "d", 1),
        (10, prose(4, 60) + "\n" + prose(5, 60), "fr", "é", 1),
    ]
    return rows


def table(spark, rows=None, schema=DOCS):
    return spark.createDataFrame(awkward() if rows is None else rows, schema)


def with_clashes(df):
    """Extra columns named as the operators name theirs."""
    from pyspark.sql import functions as F

    names = (
        "_size _key _draw _source _toxicity _fingerprint _row _n_words _runs _items "
        "_license _secrets n_words word_chars anchor p kept text_ salt doc"
    ).split()
    return df.withColumns({n: F.lit("x") for n in names})
