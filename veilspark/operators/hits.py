"""The hit table: one row per detected value, and what is asked of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import (
    HIT_FIELDS,
    detections,
    positioned,
    with_python_spans,
)
from ..functions.masking import dedupe_spans
from ..functions.sqltext import name
from ..rules import Rules

KEYS = ("doc_id", "source")


def scan(
    df: DataFrame,
    rules: Rules,
    text: str = "text",
    keys: Sequence[str] = KEYS,
    positions: bool = True,
    dedupe: bool = False,
) -> DataFrame:
    """Every hit of every row, with 1-based line and column unless switched off.

    Narrow: each row is detected and exploded in place. ``hit_no`` numbers the hits of a row in
    (start, end, recognizer) order, so no global sort is needed to restore it. With
    ``dedupe``, one hit per identical span of a row (the most confident, the first on a
    tie), chosen inside the row: what :func:`dedupe_hits` does to a table by a shuffle.
    """
    column = name(text)
    df, python_spans = with_python_spans(df, column, rules)
    hits = detections(column, rules, python_spans)
    if dedupe:
        hits = dedupe_spans(hits)
    if positions:
        hits = positioned(column, hits)
    # the outer form: an inner explode makes Catalyst evaluate the array twice,
    # once more for a "not empty" filter
    exploded = df.select(*keys, F.posexplode_outer(F.expr(hits)).alias("at", "found"))
    exploded = exploded.filter(F.col("at").isNotNull())
    fields = HIT_FIELDS if positions else HIT_FIELDS[:-2]
    return exploded.select(
        *keys, (F.col("at") + 1).alias("hit_no"), *[f"found.{f}" for f in fields]
    )


def hit_counts(
    df: DataFrame, rules: Rules, text: str = "text", into: str = "n_hits"
) -> DataFrame:
    """Each row with its number of hits, rows without any included."""
    column = name(text)
    df, python_spans = with_python_spans(df, column, rules)
    counted = df.withColumn(
        into, F.expr(f"size({detections(column, rules, python_spans)})")
    )
    return counted.drop(*python_spans.values())


# -- filters of a hit table ---------------------------------------------------


def filter_enabled(hits: DataFrame, rules: Rules) -> DataFrame:
    return hits.filter(rules.is_enabled("type"))


def filter_confidence(hits: DataFrame, rules: Rules) -> DataFrame:
    """Keep hits at or above the threshold of their type, else the global one."""
    return hits.filter(f"confidence >= {rules.threshold_of('type')}")


def filter_allowlist(hits: DataFrame, rules: Rules) -> DataFrame:
    """Drop hits whose value contains an allowlist entry."""
    return hits.filter(f"NOT {rules.is_allowed('raw')}")


def sort_hits(hits: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows of one text side by side and in document order.

    Sorted inside partitions of whole texts: a global order over all texts would
    cost a range shuffle and mean nothing. To keep this layout for later readers,
    write it with :func:`write_sorted_hits`.
    """
    return hits.repartition(*keys).sortWithinPartitions(*keys, "start", "end", "ord")


def place_in_text(hits: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``hit_no``: the place of each row among the rows of its text, from 1, in the
    order the rows stand in their partition. After :func:`sort_hits` no rows move:
    the window asks for the partitioning that is already there."""
    placed = hits.withColumn("_place", F.monotonically_increasing_id())
    order = Window.partitionBy(*keys).orderBy("_place")
    return placed.withColumn("hit_no", F.row_number().over(order)).drop("_place")


def write_sorted_hits(hits: DataFrame, table: str, buckets: int, keys: Sequence[str] = KEYS) -> None:
    """Hits as a table bucketed by text and sorted in document order inside each bucket,
    so that readers who group, join or rank by text plan no exchange. ``buckets`` is a
    parameter of the table: at a few hundred MB a bucket file, it grows with the data."""
    (
        hits.write.mode("overwrite")
        .bucketBy(buckets, *keys)
        .sortBy(*keys, "start", "end", "ord")
        .format("parquet")
        .saveAsTable(table)
    )


def dedupe_hits(hits: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One hit per identical span: the most confident, the first on a tie."""
    span = Window.partitionBy(*keys, "start", "end").orderBy(
        F.desc("confidence"), "ord"
    )
    return (
        hits.withColumn("_rank", F.row_number().over(span))
        .filter("_rank = 1")
        .drop("_rank")
    )


def resolve_policy(hits: DataFrame, rules: Rules) -> DataFrame:
    return hits.withColumn("policy", F.expr(rules.policy_of("type")))


# -- signals of a scan --------------------------------------------------------


def scan_gate(
    df: DataFrame, rules: Rules, text: str = "text", source: str = "source"
) -> DataFrame:
    """Per source its number of hits and whether it is clean.

    Counted row by row before grouping, so a source holding much of the data
    reaches the shuffle as one partial sum per task.
    """
    counted = hit_counts(df.select(source, text), rules, text)
    return (
        counted.groupBy(source)
        .agg(F.sum("n_hits").alias("n_hits"))
        .withColumn("clean", F.col("n_hits") == 0)
    )


def scan_failed(gate: DataFrame) -> DataFrame:
    """The signal of the whole scan: one row, true if any source has a hit."""
    return gate.agg(
        F.coalesce(F.bool_or(~F.col("clean")), F.lit(False)).alias("failed"),
        F.count("*").alias("n_sources"),
        F.count_if("clean").alias("n_clean"),
    )


def scan_totals(hits: DataFrame, source: str = "source") -> DataFrame:
    """Hits per source and, in the row without a source, in total."""
    return hits.rollup(source).agg(F.count("*").alias("n_hits"))
