"""Rewriting texts: masked text, redactions, policy and routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed_values import TYPE_LABELS
from ..functions.masking import NO_REDACTIONS, is_blocked, redactions_of, splice
from ..functions.spans import HIT, HIT_FIELDS, detections, with_python_spans
from ..functions.sqltext import case, keep, name, quote, transform
from ..rules import Rules


def redact_text(
    df: DataFrame, rules: Rules, text: str = "text", hits: str | None = None
) -> DataFrame:
    """``text`` rewritten in place, with what was done to it in further columns.

    Adds ``redactions``, ``original_len``, ``n_redactions``, ``changed`` and
    ``blocked``. One narrow step: nothing is exploded, nothing shuffled.
    ``hits`` names a column of hits found before.
    """
    column = name(text)
    # in steps, each with a small expression: one that holds everything takes the
    # analyzer several times as long
    if hits is None:
        df, python_spans = with_python_spans(df, column, rules)
        found = F.expr(detections(column, rules, python_spans))
        df = df.withColumn("_found", found).drop(*python_spans.values())
        hits = "_found"
        found = name(hits)
    else:
        found = f"sort_array({name(hits)})"
    done = df.withColumn(
        "redactions",
        F.expr(f"coalesce({redactions_of(found, rules)}, {NO_REDACTIONS})"),
    ).drop("_found")
    return done.withColumns(
        {
            text: F.expr(splice(column, "redactions", rules.masking.keeps_length)),
            "original_len": F.length(text),
            "n_redactions": F.size("redactions"),
            "changed": F.size("redactions") > 0,
            "blocked": F.expr(is_blocked("redactions")),
        }
    )


FILTER_BITS = 1 << 23  # bits of the filter of keys with hits: 1 MB, whatever the data


def redact_given_hits(
    df: DataFrame,
    hits: DataFrame,
    rules: Rules,
    text: str = "text",
    keys: Sequence[str] = ("doc_id",),
    bits: int = FILTER_BITS,
) -> DataFrame:
    """Rewrite texts by a hit table computed elsewhere.

    Hits are reduced to one per span before they are gathered, so what a text
    gathers is bounded by its own length. Texts that no hit names are never
    shuffled: the keys with hits set bits of a filter of ``bits`` bits (a Bloom
    filter of one hash, built by ``bitmap_construct_agg``), which is broadcast
    whatever the number of hits, as its size is fixed; texts whose bit is clear are
    redacted in place, with no hits. Only the others, texts with hits and the few
    the filter lets through by a shared bit, are joined to their lists. Texts with
    null keys or keys no hit has get no redactions; hits of keys without a text are
    ignored.
    """
    best = (
        _typed(hits)
        .groupBy(*keys, "start", "end")
        .agg(F.max_by(F.struct(*HIT_FIELDS), F.struct("confidence", -F.col("ord"))).alias("hit"))
    )
    lists = best.groupBy(*keys).agg(F.collect_list("hit").alias("_hits"))
    flagged = _flag_keys(df, lists.select(*keys), keys, bits)
    maybe = flagged.filter("_maybe_hits").drop("_maybe_hits").join(lists, list(keys), "left")
    none = flagged.filter("NOT _maybe_hits").drop("_maybe_hits")
    none = none.withColumn("_hits", F.lit(None).cast(lists.schema["_hits"].dataType))
    joined = maybe.unionByName(none)
    joined = joined.withColumn("_hits", F.expr(_fitted("_hits", name(text))))
    return redact_text(joined, rules, text, hits="_hits").drop("_hits")


def _flag_keys(df: DataFrame, present: DataFrame, keys: Sequence[str], bits: int) -> DataFrame:
    """``df`` with ``_maybe_hits``: false only where no row of ``present`` has the keys.

    A key is bit ``pmod(xxhash64(keys), bits)`` of a filter held as bitmaps of
    32,768 bits, at most ``bits / 32768`` rows; the rows of ``df`` look up their bit
    through a broadcast join and stay where they are.
    """
    place = (F.pmod(F.xxhash64(*keys), F.lit(bits)) + 1).alias("_key_bit")
    held = (
        present.select(place)
        .groupBy(F.expr("bitmap_bucket_number(_key_bit)").alias("_key_bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_key_bit))").alias("_key_bits"))
    )
    probe = df.withColumn("_key_bit", place).withColumn(
        "_key_bucket", F.expr("bitmap_bucket_number(_key_bit)")
    )
    at = "bitmap_bit_position(_key_bit)"
    bit = F.expr(
        f"shiftright(cast(conv(hex(substr(_key_bits, cast({at} div 8 + 1 AS INT), 1)), 16, 10)"
        f" AS INT), cast({at} % 8 AS INT)) & 1"
    )
    return (
        probe.join(F.broadcast(held), "_key_bucket", "left")
        .withColumn("_maybe_hits", F.coalesce(bit == 1, F.lit(False)))
        .drop("_key_bit", "_key_bucket", "_key_bits")
    )


_ABSENT = {"ord": 0, "confidence": 1.0, "checksum_valid": False}


def _typed(hits: DataFrame) -> DataFrame:
    """Hits with all fields, from any that have ``type``, ``start`` and ``end``.

    An absent confidence is 1, an absent order 0; check digits of which nothing is known
    count as not confirmed.
    """
    fields = []
    for field in T.StructType.fromDDL(HIT[len("struct<") : -1]).fields:
        value = F.col(field.name) if field.name in hits.columns else F.lit(None)
        if field.name in _ABSENT:
            value = F.coalesce(value, F.lit(_ABSENT[field.name]))
        fields.append(value.cast(field.dataType).alias(field.name))
    others = [c for c in hits.columns if c not in HIT_FIELDS]
    return hits.select(*others, *fields)


def _fitted(hits: str, text: str) -> str:
    """Spans clipped to the text, which also gives a value that is absent."""

    def fit(h: str) -> str:
        start, end = f"greatest({h}.start, 0)", f"least({h}.end, length({text}))"
        raw = f"coalesce({h}.raw, substr({text}, {start} + 1, {end} - {start}))"
        new = {"start": start, "end": end, "raw": raw}
        fields = ", ".join(f"{new.get(f, f'{h}.{f}')} AS {f}" for f in HIT_FIELDS)
        return f"struct({fields})"

    return keep(transform(hits, fit), lambda h: f"{h}.start < {h}.end")


def released(redacted: DataFrame) -> DataFrame:
    """What may leave: rows without a blocking redaction.

    Dropped by an explode of none or one row. Catalyst would push a filter on
    ``blocked`` below the redaction and evaluate that a second time for it.
    """
    row = F.struct(*[F.col(name(c)) for c in redacted.columns])
    kept = F.when(~F.col("blocked"), F.array(row)).otherwise(F.array())
    return redacted.select(F.explode(kept).alias("row")).select("row.*")


WRITTEN = ("type", "policy", "checksum_valid", "line", "col", "masked")
"""Fields of a redaction that may be written; the raw value is none of them."""


def without_raw(redacted: DataFrame) -> DataFrame:
    """Redactions reduced to what may leave; every sink of rows goes through here."""
    if "redactions" not in redacted.columns:
        return redacted
    fields = transform(
        "redactions", lambda r: f"struct({', '.join(f'{r}.{f} AS {f}' for f in WRITTEN)})"
    )
    return redacted.withColumn("redactions", F.expr(fields))


def with_route(redacted: DataFrame) -> DataFrame:
    """``route`` = output or quarantine; written with ``sinks.write_routed``."""
    return without_raw(redacted).withColumn(
        "route", F.when(F.col("blocked"), "quarantine").otherwise("output")
    )


def explode_redactions(redacted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per redaction."""
    exploded = redacted.select(
        *keys, F.posexplode_outer("redactions").alias("at", "r")
    ).filter(F.col("at").isNotNull())
    return exploded.select(*keys, (F.col("at") + 1).alias("redaction_no"), "r.*")


def counts_by_type(redacted: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Redactions per row and type, counted inside the row: no shuffle."""
    types = f"array_distinct({transform('redactions', lambda r: f'{r}.type')})"
    counts = transform(
        types,
        lambda t: f"struct({t} AS type, cast(size("
        + keep("redactions", lambda r: f"{r}.type = {t}")
        + ") AS bigint) AS n)",
    )
    return redacted.select(*keys, F.explode(F.expr(counts)).alias("c")).select(
        *keys, "c.*"
    )


def mask_summary(redacted: DataFrame) -> DataFrame:
    """Redactions per type over the run, the most frequent first."""
    return (
        explode_redactions(redacted, [])
        .groupBy("type")
        .agg(F.count("*").alias("n"))
        .withColumn("label", type_label("type"))
        .withColumn("position", F.row_number().over(Window.orderBy(F.desc("n"), "type")))
        .orderBy("position")
    )


def type_label(column: str):
    labels = {t: quote(label) for t, label in TYPE_LABELS.items()}
    return F.expr(case(column, labels, column))
