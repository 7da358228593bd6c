"""The audit table: one record per redaction, never holding the raw value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import AUDIT_SCHEMA_VERSION
from ..functions.masking import masked_preview
from .redaction import explode_redactions, type_label

FIELDS = (
    "schema ts type action checksum_valid file line col rule_id masked_preview".split()
)
AUDIT_SCHEMA = (
    "schema int, ts string, type string, action string, checksum_valid boolean,"
    " file string, line int, col int, rule_id string, masked_preview string"
)


def utc_now() -> Column:
    """The time of the run to the second, e.g. 2026-01-01T00:00:00+00:00."""
    return F.concat(
        F.date_format(
            F.convert_timezone(
                F.current_timezone(), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz")
            ),
            "yyyy-MM-dd'T'HH:mm:ss",
        ),
        F.lit("+00:00"),
    )


def audit_entries(
    redacted: DataFrame,
    file: str = "source",
    ts: str | None = None,
    keys: Sequence[str] = (),
    keep_raw: bool = False,
) -> DataFrame:
    """Audit records of redacted rows, in the fixed key order.

    ``line`` and ``col`` are null unless the redactions carry positions.
    ``keep_raw`` is for :func:`leaks` only.
    """
    rows = explode_redactions(
        redacted.withColumn("file", F.col(file)), [*keys, "file"]
    )
    if keep_raw:
        keys = [*keys, "redaction_no", "raw"]
    return rows.select(
        *keys,
        F.lit(AUDIT_SCHEMA_VERSION).alias("schema"),
        (utc_now() if ts is None else F.lit(ts)).alias("ts"),
        "type",
        F.col("policy").alias("action"),
        "checksum_valid",
        "file",
        "line",
        "col",
        F.col("type").alias("rule_id"),
        F.expr(masked_preview("masked")).alias("masked_preview"),
    )


def audit_json() -> Column:
    """One record as a JSON line: fixed key order, nulls kept, no spaces."""
    return F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"})


ANCHOR = 8  # a raw value is looked for by one of its substrings of this length
_CUT = ',"masked_preview":'


def record_parts() -> tuple[Column, Column]:
    """``audit_json`` in two: up to the preview, which few records differ in, and the rest."""
    others = F.to_json(F.struct(*FIELDS[:-1]), {"ignoreNullFields": "false"})
    head = F.concat(F.substring(others, F.lit(1), F.length(others) - 1), F.lit(_CUT))
    return head, F.substring(audit_json(), F.length(head) + 1, F.length(audit_json()))


def _grams(text: str, sizes: Column) -> Column:
    """64-bit ids of the distinct substrings of the given lengths."""
    return F.array_distinct(
        F.flatten(
            F.transform(
                F.filter(sizes, lambda a: a <= F.length(text)),
                lambda a: F.transform(
                    F.sequence(F.lit(1), F.length(text) - a + 1),
                    lambda i: F.xxhash64(F.col(text).substr(i, a)),
                ),
            )
        )
    )


def _holding(texts: DataFrame, values: DataFrame, anchor: int) -> DataFrame:
    """``text`` of the distinct ``texts`` that contain any of the distinct ``value``s.

    A containment join by anchors: every value is filed under the one of its substrings
    of length ``min(len, anchor)`` that the fewest texts hold; a value of which some
    substring is in no text is in none itself. A text gives each substring of those
    lengths once, is paired only with the values filed under them, and a pair counts if
    the text contains the value. A text holding a value holds its anchor, so nothing is
    missed. Texts and substrings travel as 64-bit ids until the check, which reads the
    text itself: ids that clash only add pairs that the check throws out.
    """
    values = values.withColumn("_a", F.least(F.length("value"), F.lit(anchor)))
    # at most ``anchor`` lengths, whatever the data; without values none
    sizes = values.agg(F.collect_set("_a")).scalar()
    texts = texts.withColumn("_id", F.xxhash64("text"))
    held = texts.withColumn("_sizes", sizes).select(
        "_id", F.explode(_grams("text", F.col("_sizes"))).alias("gram")
    )
    often = held.groupBy("gram").agg(F.count("*").alias("_f"))
    filed = values.withColumn("_grams", _grams("value", F.array("_a"))).select(
        "value", F.size("_grams").alias("_n"), F.explode("_grams").alias("gram")
    )
    anchors = (
        filed.join(often, "gram")
        .groupBy("value", "_n")
        .agg(F.min_by("gram", F.struct("_f", "gram")).alias("gram"), F.count("*").alias("_found"))
        .filter("_found = _n")
        .select("value", "gram")
    )
    pairs = held.join(anchors, "gram").select("_id", "value")
    return pairs.join(texts, "_id").filter(F.contains("text", "value")).select("text").distinct()


def leaks(entries: DataFrame, anchor: int = ANCHOR) -> DataFrame:
    """Per type: records, those holding their own raw value, and those holding any
    raw value of the run.

    ``entries`` come from ``audit_entries(keep_raw=True)``. Few records differ up to the
    preview, so both parts of the records are looked at apart, each distinct one once
    (``_holding``). A value that reaches from one into the other holds the signs on both
    sides of the cut; such values, if there are any, are looked for in whole records.
    Equal records are checked once and counted as often as they occur. Null and empty
    raw values are no values; no entries give no rows.
    """
    head, tail = record_parts()
    lines = entries.select("type", "raw", head.alias("head"), tail.alias("tail"))
    # every branch below starts with the same shuffle (n included), which is run once
    lines = lines.groupBy("type", "raw", "head", "tail").agg(F.count("*").alias("n")).filter("n > 0")
    values = lines.select(F.col("raw").alias("value")).filter("value <> ''").distinct()
    across = values.filter(F.contains("value", F.lit(':"')) | F.contains("value", F.lit(":n")))
    line = F.concat("head", "tail")
    records = lines.groupBy("type", "head", "tail").agg(F.sum("n").alias("n"))
    records = records.withColumn("line", line)
    for part, sought in (("head", values), ("tail", values), ("line", across)):
        texts = lines.withColumn("line", line).select(F.col(part).alias("text")).distinct()
        found = _holding(texts, sought, anchor).select(
            F.col("text").alias(part), F.lit(True).alias(f"_{part}")
        )
        records = records.join(found, part, "left")
    any_raw = (
        records.filter("_head OR _tail OR _line").groupBy("type").agg(F.sum("n").alias("n_any_raw"))
    )
    per_type = lines.groupBy("type").agg(
        F.sum("n").alias("n_entries"),
        F.sum(F.when(F.contains(line, F.col("raw")), F.col("n")).otherwise(0)).alias("n_own_raw"),
    )
    return per_type.join(any_raw, "type", "left").withColumn(
        "n_any_raw", F.coalesce("n_any_raw", F.lit(0))
    )


# -- reports ------------------------------------------------------------------


def report_by_type(entries: DataFrame) -> DataFrame:
    """The most frequent first; ``position`` says so whatever becomes of the order."""
    return (
        entries.groupBy("type")
        .agg(F.count("*").alias("n"))
        .withColumn("label", type_label("type"))
        .withColumn("position", F.row_number().over(Window.orderBy(F.desc("n"), "type")))
        .orderBy("position")
    )


def report_by_action(entries: DataFrame) -> DataFrame:
    return entries.groupBy("action").agg(F.count("*").alias("n")).orderBy("action")


def report_totals(entries: DataFrame) -> DataFrame:
    """Records, and the exact number of sources they come from.

    Distinct by a grouping of its own, so that a source with much of the data is
    reduced inside the tasks before it is shuffled.
    """
    per_file = entries.groupBy("file").agg(F.count("*").alias("n"))
    return per_file.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_fields"),
        F.count("*").alias("n_sources"),
    )
