"""Reading texts, payloads and audit logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import AUDIT_SCHEMA_VERSION
from ..operators.audit import AUDIT_SCHEMA


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a table that is read in fewer parts than cores.

    Such a table is small, at most one split per core, and a file of one row group
    is a single task however it is split. Larger tables are not moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_table(
    spark: SparkSession, path: str, columns: Sequence[str], small: bool = False
) -> DataFrame:
    """Columns of a parquet table as a source of texts.

    ``small``: the table may be of one file, and its rows are spread over the cores.
    """
    table = spark.read.parquet(path).select(*columns)
    return spread(table) if small else table


def read_text_files(spark: SparkSession, *paths: str, glob: str = "*") -> DataFrame:
    """Whole files, one row each: ``source`` (the path) and ``text``.

    UTF-8, with bytes that are not valid replaced. Several paths make one table.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(list(paths))
    )
    return files.select(
        F.col("path").alias("source"), F.make_valid_utf8("content").alias("text")
    )


def read_text_lines(spark: SparkSession, *paths: str, glob: str = "*") -> DataFrame:
    """Lines of text files: ``source`` (the path), ``line_no`` (from 1 in its file) and
    ``text`` (UTF-8, bytes that are not valid replaced; lines end at ``\n`` only).

    Files are split into byte ranges as Spark's text reader splits any file
    (``spark.sql.files.maxPartitionBytes``), so one file of any size is many tasks and
    no file is ever one value. A line belongs to the range in which it starts; its
    number is the count of lines of the ranges before it in its file, a prefix sum
    over one row per range, plus its place in its own range. Nothing is collected.
    """
    raw = (
        spark.read.option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .option("lineSep", "\n")
        .text(list(paths))
    )
    rows = raw.select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("_range"),
        F.monotonically_increasing_id().alias("_at"),
        F.make_valid_utf8(F.col("value").cast("binary")).alias("text"),
    )
    ranges = rows.groupBy("source", "_range").agg(
        F.count("*").alias("_n"), F.min("_at").alias("_first")
    )
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    placed = rows.join(ranges, ["source", "_range"])
    line = F.col("_before") + F.col("_at") - F.col("_first") + 1
    return placed.select("source", line.alias("line_no"), "text")


def union_sources(*tables: DataFrame) -> DataFrame:
    """Several tables of texts as one, each row keeping its source."""
    first, *rest = tables
    for table in rest:
        first = first.unionByName(table)
    return first


def read_audit_log(spark: SparkSession, *paths: str) -> DataFrame:
    """Audit records from JSON lines; blank and malformed lines are skipped."""
    return parse_audit_lines(spark.read.text(list(paths)))


def parse_audit_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Records of a column of lines: unknown keys ignored, missing ones defaulted.

    A line that is JSON but not an object counts as malformed.
    """
    line = F.trim(F.translate(value, "\t\r\n\f\x0b", " " * 5))
    parsed = lines.select(line.alias("line")).filter(
        "startswith(line, '{') AND endswith(line, '}') "
        "AND try_parse_json(concat('[', line, ']')) IS NOT NULL"
    )
    record = parsed.select(F.from_json("line", _LENIENT_SCHEMA).alias("r")).select("r.*")
    as_int = {c: F.expr(f"try_cast({c} AS int)") for c in ("line", "col")}
    return record.select(
        F.coalesce(F.expr("try_cast(schema AS int)"), F.lit(AUDIT_SCHEMA_VERSION)).alias(
            "schema"
        ),
        F.coalesce("ts", F.lit("")).alias("ts"),
        F.coalesce("type", F.lit("")).alias("type"),
        F.coalesce("action", F.lit("mask")).alias("action"),
        F.coalesce("checksum_valid", F.lit(False)).alias("checksum_valid"),
        F.coalesce("file", F.lit("")).alias("file"),
        as_int["line"].alias("line"),
        as_int["col"].alias("col"),
        F.coalesce("rule_id", "type", F.lit("")).alias("rule_id"),
        F.coalesce("masked_preview", F.lit("")).alias("masked_preview"),
    )


_LENIENT_SCHEMA = AUDIT_SCHEMA.replace(" int", " string")
