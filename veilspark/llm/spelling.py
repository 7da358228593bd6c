"""Spelling variants grouped by reduced-alphabet neighbourhoods.

Every letter is hashed to one of ``SYMBOLS`` symbols. Two words one edit apart
(one code point inserted, deleted or replaced) have reduced forms at most one edit
apart too: a replaced letter may even keep its symbol. So each word generates the
full one-edit neighbourhood of its reduced form, itself included, and joins the
vocabulary on the reduced form; the few candidates that meet are verified on the
original strings. The neighbourhood has ``1 + L + L * k + (L + 1) * k`` keys for a
word of L letters and k symbols, which grows with the word only, never with the
corpus; a key matches the words whose reduced form it is, about ``V_L / k^L`` of
the V_L words of that length. Each near pair needs to meet only once, so each word
generates only the part of its neighbourhood that ``one_sided`` names.

Words, counts and forms are built by Spark's own functions (regular expressions,
CRC-32, higher-order functions on arrays, joins and aggregates); nothing goes
through Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored

# Fixed values of the contract: runs, the letters lowered, the rule that deletes one
# code point, the least length and count of a word, and the dominance factor.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
DELETE_MODULUS = 97
MIN_LENGTH = 5
MIN_COUNT = 3
DOMINANCE = 2

SYMBOLS = 8
"""Symbols of the reduced alphabet."""
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
"""All letters a run can hold after A-Z are lowered; the rest stay as they are."""


def _symbol(letter: str) -> str:
    return str((ord(letter) * 2654435761 >> 11) % SYMBOLS)


REDUCED = "".join(map(_symbol, LETTERS))


def words(docs: DataFrame) -> DataFrame:
    """(word, n): the distinct words of at least ``MIN_LENGTH`` code points that occur
    ``MIN_COUNT`` times or more over all texts.

    A run is lowered in A-Z only. With h the unsigned CRC-32 of the UTF-8 of
    ``<doc_id>:<run>``, a run whose h is divisible by 97 loses its code point
    ``h % length``. A null text has no runs; a null doc_id is written as nothing.
    Counts are partial in each task before the shuffle, so a very common word is one
    row per task.
    """
    lowered = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(lowered, F.lit(RUN), 0)).alias("run"))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run")
    h = F.crc32(F.encode(key, "UTF-8"))
    at = (h % F.length("run")).cast("int")
    cut = F.expr("concat(substr(run, 1, _at), substr(run, _at + 2))")
    word = F.when(h % DELETE_MODULUS == 0, cut).otherwise(F.col("run"))
    counted = (
        runs.withColumn("_at", at).select(word.alias("word")).groupBy("word").count()
    )
    return counted.filter(
        (F.length("word") >= MIN_LENGTH) & (F.col("count") >= MIN_COUNT)
    ).select("word", F.col("count").alias("n"))


def reduced(word: str = "word") -> F.Column:
    return F.translate(F.col(word), LETTERS, REDUCED)


def neighbourhood(r: F.Column) -> F.Column:
    """All strings over the symbols at most one edit from ``r``, ``r`` itself too."""
    symbols = F.array(*[F.lit(str(s)) for s in range(SYMBOLS)])
    n = F.length(r)

    def part(i, tail):
        return lambda s: F.concat(F.substring(r, 1, i), s, F.substring(r, i + tail, 1 << 30))

    deleted = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.concat(F.substring(r, 1, i), F.substring(r, i + 2, 1 << 30)),
    )
    replaced = F.flatten(
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(symbols, part(i, 2)))
    )
    inserted = F.flatten(
        F.transform(F.sequence(F.lit(0), n), lambda i: F.transform(symbols, part(i, 1)))
    )
    return F.array_distinct(F.concat(F.array(r), deleted, replaced, inserted))


def one_sided(r: F.Column) -> F.Column:
    """The part of ``neighbourhood(r)`` that one word of each near pair generates.

    An insertion into the shorter word of a pair is a deletion from the longer one,
    so each word generates only its deletions; of two words of equal length whose
    reduced forms differ in one place, the one with the smaller symbol there
    generates the replacement. With ``r`` itself, every near pair meets at least once,
    as the whole neighbourhood would let it, from some four times fewer keys.
    """
    symbols = F.array(*[F.lit(str(s)) for s in range(SYMBOLS)])
    n = F.length(r)
    deleted = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.concat(F.substring(r, 1, i), F.substring(r, i + 2, 1 << 30)),
    )
    replaced = F.flatten(
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.transform(
                F.filter(symbols, lambda s: s > F.substring(r, i + 1, 1)),
                lambda s: F.concat(F.substring(r, 1, i), s, F.substring(r, i + 2, 1 << 30)),
            ),
        )
    )
    return F.concat(F.array(r), deleted, replaced)


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, other, other_n): every ordered pair of words exactly one edit apart.

    ``vocabulary`` (word, n, _id) is stored. Keys travel as 64-bit hashes of the
    reduced strings, with word ids: a clash of hashes only adds a candidate, which the
    check on the original strings throws out.
    """
    keys = F.array_distinct(F.transform(one_sided(reduced()), lambda k: F.xxhash64(k)))
    keyed = vocabulary.select(F.col("_id").alias("_a"), F.explode(keys).alias("_key"))
    index = vocabulary.select(F.col("_id").alias("_b"), F.xxhash64(reduced()).alias("_key"))
    met = keyed.join(index, "_key").filter(F.col("_a") != F.col("_b"))
    met = met.select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).distinct()
    a = vocabulary.select(F.col("_id").alias("_a"), F.col("word").alias("wa"), F.col("n").alias("na"))
    b = vocabulary.select(F.col("_id").alias("_b"), F.col("word").alias("wb"), F.col("n").alias("nb"))
    near = met.join(a, "_a").join(b, "_b").filter(F.levenshtein("wa", "wb", 1) == 1)
    near = stored(near.select("wa", "na", "wb", "nb"), "near")
    return near.select(F.col("wa").alias("word"), F.col("wb").alias("other"), F.col("nb").alias("other_n")).union(
        near.select(F.col("wb").alias("word"), F.col("wa").alias("other"), F.col("na").alias("other_n"))
    )


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to their end by pointer jumping. A form has at
    least twice the count of its word, so chains are short and never close."""
    step = forms.select("word", F.coalesce("form", "word").alias("_to"))
    while True:
        step = stored(step, "roots")
        ahead = step.select(F.col("word").alias("_to"), F.col("_to").alias("_next"))
        jumped = step.join(ahead, "_to", "left").select(
            "word", F.coalesce("_next", "_to").alias("_next"), "_to"
        )
        jumped = stored(jumped, "roots")
        if jumped.filter(F.col("_next") != F.col("_to")).isEmpty():
            return jumped.select("word", F.col("_next").alias("root"))
        step = jumped.select("word", F.col("_next").alias("_to"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word of ``words(docs)``.

    ``form`` is the near word of largest count, ties to the smallest in code-point
    order, where its count is at least twice the word's; else null (so is form_n).
    ``n_near`` counts all near words, 0 if none. ``root`` follows forms to the last,
    the word itself if it has none. Texts of any length are read whole; an empty table
    or one without words gives no rows; columns other than doc_id and text are not read.
    """
    vocabulary = stored(
        words(docs.select("doc_id", "text")).withColumn("_id", F.monotonically_increasing_id()),
        "words",
    )
    pairs = near_pairs(vocabulary)
    best = pairs.groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.min_by(F.struct("other", "other_n"), F.struct(-F.col("other_n"), "other")).alias("b"),
    )
    forms = vocabulary.drop("_id").join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("b.other_n") >= DOMINANCE * F.col("n"), F.col("b.other")).alias("form"),
        F.when(F.col("b.other_n") >= DOMINANCE * F.col("n"), F.col("b.other_n")).alias("form_n"),
    )
    forms = stored(forms, "forms")
    return forms.join(_roots(forms), "word").select(
        "word", "form", "root", "n", F.col("n_near").cast("long"), F.col("form_n").cast("long")
    )
