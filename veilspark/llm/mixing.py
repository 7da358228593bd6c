"""Mixing sources to target weights by Efraimidis-Spirakis sampling, all in SQL.

Every document draws an exponential key, divided by its quality weight; within a
source the smallest keys come first. A source whose target is e + f times its size
gives e whole epochs and then documents in order of key until f of its words are
taken.

A source may hold a third of all rows, so no window runs over a source: keys are
dealt into buckets of about ``BUCKET_ROWS`` rows by their expected distribution
(weights have four classes, so it is known), sums per bucket give the bucket where
the budget ends, and only that bucket is sorted. A document then compares its key to
its source's last one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import set_aside, stored

BUCKET_ROWS = 5000
SALTS = 64
MOST_EPOCHS = 3
SYMBOLS = "#*$%&|<>"
CLASSES = (0.25, 0.5, 0.75, 1.0)
"""Quality weights, by how many of 100 characters are symbols: over 10, over 5, over 1."""


DRAWN = ["_source", "_size", "_weight", "_draw", "_key"]
ADDED = [*DRAWN, "_salt", "_repeats", "_time", "source_size", "target", "epochs", "rest"]
ADDED += ["cut", "start"]


def n_words(text: str) -> Column:
    return F.coalesce(
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long")
    )


def quality_weight(text: str) -> Column:
    """The weight class of a text; null and empty texts have the middle class 0.5."""
    length = F.length(text)
    symbols = 100 * (length - F.length(F.translate(text, SYMBOLS, "")))
    weight = F.when(F.coalesce(length, F.lit(0)) == 0, CLASSES[1])
    for most, value in ((10, CLASSES[0]), (5, CLASSES[1]), (1, CLASSES[2])):
        weight = weight.when(symbols > most * length, value)
    return weight.otherwise(CLASSES[3])


def keyed(docs: DataFrame, seed: int) -> DataFrame:
    """Adds the columns of the draw; rows equal in doc_id and text draw the same."""
    draw = F.md5(
        F.concat(
            F.lit(f"{seed}:"),
            F.coalesce(F.col("doc_id").cast("string"), F.lit("-")),
            F.lit(":"),
            F.coalesce("text", F.lit("")),
        )
    )
    bits = F.conv(F.substring("_draw", 1, 13), 16, 10).cast("long")
    return (
        docs.withColumns(
            {
                "_source": F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")),
                "_size": n_words("text"),
                "_weight": quality_weight("text"),
                "_draw": draw,
            }
        )
        .withColumn("_key", -F.log((bits + 1) / F.lit(2.0**52)) / F.col("_weight"))
    )


def _with_weights(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Weights in turn by rank: nulls last, else by code point. Ranks are counted in
    ranges of names, so no task sorts them all."""
    ranges = sources.repartitionByRange(F.col("source").isNull(), "source")
    ranges = stored(ranges.withColumn("part", F.spark_partition_id()), "sources")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = ranges.groupBy("part").count()
    parts = parts.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    own = F.row_number().over(W.partitionBy("part").orderBy(F.asc_nulls_last("source")))
    rank = F.col("before") + own - 1
    listed = F.array(*map(F.lit, weights))
    weight = F.element_at(listed, (rank % len(weights) + 1).cast("int"))
    return ranges.join(parts, "part").withColumn("weight", weight).drop("part", "count", "before")


def _with_targets(sources: DataFrame) -> DataFrame:
    """Targets in proportion to weight, at most ``MOST_EPOCHS`` times the size; what
    a full source can't take is shared among the others, until none is above."""
    cap = F.col("source_size") * MOST_EPOCHS
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = F.col("weight") * F.lit(level) > cap
        n, capped, weight = sources.agg(
            F.sum(full.cast("long")),
            F.sum(F.when(full, cap).otherwise(0)),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))),
        ).first()
        higher = (total - (capped or 0)) / weight if weight else level
        if higher <= level:
            break
        level = higher
    target = F.when(full, cap).otherwise(F.col("weight") * F.lit(level)).cast("double")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    return (
        sources.withColumn("target", target)
        .withColumn("epochs", F.coalesce(epochs, F.lit(0)))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    )


def _joined(drawn: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with their source's figures. Each source comes ``SALTS`` times, so that the
    rows of a large one are dealt to as many tasks."""
    salt = F.pmod(F.xxhash64("_draw"), F.lit(SALTS))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    left = drawn.withColumn("_salt", salt)
    return left.join(sources.withColumn("_salt", salts), ["_source", "_salt"])


def mixture_plan(drawn: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """A row per source: size, target, epochs and the last key of its part epoch.

    ``drawn`` has the columns of ``keyed`` and is read several times.
    """
    shares = [
        F.avg((F.col("_weight") == w).cast("double")).alias(f"share{i}")
        for i, w in enumerate(CLASSES)
    ]
    sources = drawn.groupBy("_source").agg(
        F.first("source").alias("source"),
        F.sum("_size").alias("source_size"),
        F.ceil(F.count("*") / BUCKET_ROWS).alias("buckets"),
        *shares,
    )
    sources = stored(_with_weights(sources, weights), "sources")
    sources = stored(_with_targets(sources), "sources")
    part = sources.filter("rest > 0").drop("source")
    expected = sum(
        F.col(f"share{i}") * (1 - F.exp(-w * F.col("_key"))) for i, w in enumerate(CLASSES)
    )
    bucket = F.least(F.floor(expected * F.col("buckets")), F.col("buckets") - 1)
    rows = _joined(drawn, part).withColumn("bucket", bucket)
    sums = rows.groupBy("_source", "bucket").agg(
        F.sum("_size").alias("n"), F.first("rest").alias("rest")
    )
    running = W.partitionBy("_source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0)))
    last = sums.filter("before < rest AND before + n >= rest").groupBy("_source").agg(
        F.min("bucket").alias("bucket"), F.min("before").alias("before")
    )
    # rows of the bucket in which the budget ends; equal rows count together
    ends = rows.join(last, ["_source", "bucket"]).groupBy("_source", "_key", "_draw").agg(
        F.sum("_size").alias("n"), F.first("before").alias("before"), F.first("rest").alias("rest")
    )
    order = W.partitionBy("_source").orderBy("_key", "_draw")
    upto = order.rowsBetween(W.unboundedPreceding, -1)
    taken = ends.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(upto), F.lit(0)))
    position = F.struct("_key", "_draw")
    fits = (F.col("before") + F.col("n") / 2 <= F.col("rest"))
    cut = taken.groupBy("_source").agg(
        F.max(F.when(fits, position)).alias("cut"),
        F.min(position).alias("start"),
    )
    columns = ["_source", "source_size", "target", "epochs", "rest"]
    return sources.select(*columns).join(cut, "_source", "left")


def with_repeats(drawn: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds to each row how often the mix takes it, and its source's figures."""
    position = F.struct("_key", "_draw")
    chosen = F.when(
        F.col("cut").isNotNull(), position <= F.col("cut")
    ).otherwise((F.col("rest") > 0) & F.coalesce(position < F.col("start"), F.lit(False)))
    repeats = (F.col("epochs") + chosen.cast("long")).alias("_repeats")
    return _joined(drawn, plan).select(
        *drawn.columns, "source_size", "target", repeats
    )


def mix_report(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 1) -> DataFrame:
    """A row per document: its words, its source's words and target, and words taken.

    Null and empty texts have size 0. A null source is a source, last in order.
    Documents equal in doc_id and text are taken or left together, apart from other
    ties, which the draw orders. The budget of a source ends at the document that
    brings it nearest. An empty table gives no rows.
    """
    drawn = keyed(docs.select("doc_id", "text", "source"), seed)
    drawn = stored(drawn.drop("text"), "drawn")
    return with_repeats(drawn, mixture_plan(drawn, weights)).select(
        "doc_id",
        F.col("_size").alias("size"),
        "source_size",
        "target",
        (F.col("_size") * F.col("_repeats")).alias("taken"),
    )


def mix_documents(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 1
) -> DataFrame:
    """The mixed documents: each row as often as the mix takes it, columns unchanged.

    The plan is made from a table without texts; texts are read once more to be
    given out, and drawn again with the same result.
    """
    docs, restored = set_aside(docs, *ADDED)
    drawn = keyed(docs, seed)
    plan = mixture_plan(stored(drawn.select("doc_id", "source", *DRAWN), "drawn"), weights)
    times = F.explode(F.expr("sequence(1, _repeats)")).alias("_time")
    return restored(with_repeats(drawn, plan).filter("_repeats > 0").select("*", times))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    length(text) AS chars,
    100 * (length(text) - length(translate(text, '#*$%&|<>', ''))) AS symbols,
    md5('1:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(text, '')) AS draw
  FROM documents),
k AS (
  SELECT *, -ln((CAST('0x' || draw[1:13] AS BIGINT) + 1) / 4503599627370496.0::DOUBLE) /
    CASE WHEN coalesce(chars, 0) = 0 THEN 0.5 WHEN symbols > 10 * chars THEN 0.25
      WHEN symbols > 5 * chars THEN 0.5 WHEN symbols > chars THEN 0.75
      ELSE 1.0 END::DOUBLE AS key
  FROM d),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS ss,
    1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, CAST(sum(ss) OVER () AS BIGINT) AS t, CAST(sum(w) OVER () AS BIGINT) AS tw,
    coalesce(CAST(sum(3 * ss) OVER o AS BIGINT), 0) AS caps, coalesce(CAST(sum(w) OVER o AS BIGINT), 0) AS ws
  FROM s WINDOW o AS (ORDER BY 3 * ss / w::DOUBLE, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, w * ((t - caps) / (tw - ws)::DOUBLE) > 3 * ss AS capped FROM r),
l AS (
  SELECT (any_value(t) - coalesce(sum(3 * ss) FILTER (capped), 0))::DOUBLE /
    (any_value(tw) - coalesce(sum(w) FILTER (capped), 0))::DOUBLE AS level FROM c),
g AS (
  SELECT source, ss, CASE WHEN capped THEN 3.0::DOUBLE * ss ELSE w * level END AS target FROM c, l),
e AS (SELECT *, CASE WHEN ss > 0 THEN floor(target / ss) ELSE 0 END AS epochs FROM g),
p AS (
  SELECT k.*, ss, target, epochs, target - epochs * ss AS rest,
    sum(size) OVER (PARTITION BY k.source ORDER BY key, draw) -
    sum(size) OVER (PARTITION BY k.source, key, draw) AS before,
    sum(size) OVER (PARTITION BY k.source, key, draw) AS n
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, ss AS source_size, target,
  CAST(size * (epochs + CASE WHEN rest > 0 AND before + n / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END)
    AS BIGINT) AS taken
FROM p
"""
