"""Rules kept as a table of (layer, path, value), applied to a hit table.

The rows are those of ``rules.rows_of``: a higher layer overrides a lower one path by
path, list entries add up. Settings reach the hits as one map value, so no join has
the few types of hits as its key. The allowlist may be of any size: the distinct values
that were hit are cut into pieces of the lengths that occur in it, and one equi join
finds those that contain an entry.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.masking import mask_full, mask_partial
from ..functions.sqltext import quote
from ..rules import LISTS, SETTINGS, Row, Rules, rows_of

SETTINGS_SCHEMA = "layer int, path array<string>, value string"
_DOT = "\x1f"


def _text(value: Any) -> str:
    if isinstance(value, Mapping):
        return json.dumps(value)
    return str(value).lower() if isinstance(value, bool) else str(value)


def settings_table(spark: SparkSession, *layers: Mapping[str, Any]) -> DataFrame:
    """Nested layers as a table, from layer 1 up."""
    rows: list[Row] = [r for i, layer in enumerate(layers, 1) for r in rows_of(i, layer)]
    return spark.createDataFrame(
        [(i, list(path), _text(value)) for i, path, value in rows], SETTINGS_SCHEMA
    )


def unpivoted(
    detectors: DataFrame | None = None,
    scalars: DataFrame | None = None,
    allowlist: DataFrame | None = None,
    labels: DataFrame | None = None,
    custom_patterns: DataFrame | None = None,
) -> DataFrame:
    """Tables with a column for each setting as one table of settings.

    ``detectors`` (layer, type, enabled, min_confidence, policy), ``scalars`` (layer,
    key, value; keys of ``masking`` by their own name), ``allowlist`` (layer, value),
    ``labels`` (layer, type, label), ``custom_patterns`` (layer, type, pattern, checksum,
    confidence).
    """

    def entry(name: str, value: Column) -> list[Column]:
        # a path of its own, equal for equal entries only
        path = F.array(F.lit(name), F.concat(F.col("layer"), F.lit("/"), F.abs(F.xxhash64(value))))
        return [F.col("layer"), path.alias("path"), value.alias("value")]

    parts: list[DataFrame] = []
    if detectors is not None:
        for name in ("enabled", "min_confidence", "policy"):
            path = F.array(F.lit("detectors"), F.col("type"), F.lit(name)).alias("path")
            parts.append(detectors.select("layer", path, F.col(name).cast("string").alias("value")))
    if scalars is not None:
        masking = [s.path[1] for s in SETTINGS if s.path[0] == "masking" and len(s.path) == 2]
        path = F.when(F.col("key").isin(masking), F.array(F.lit("masking"), "key"))
        path = path.otherwise(F.array("key")).alias("path")
        parts.append(scalars.select("layer", path, "value"))
    if labels is not None:
        path = F.array(F.lit("masking"), F.lit("labels"), "type").alias("path")
        parts.append(labels.select("layer", path, F.col("label").alias("value")))
    if allowlist is not None:
        parts.append(allowlist.select(*entry("allowlist", F.col("value"))))
    if custom_patterns is not None:
        fields = F.to_json(F.struct("type", "pattern", "checksum", "confidence"))
        parts.append(custom_patterns.select(*entry("custom_patterns", fields)))
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


def rules_of(settings: DataFrame) -> Rules:
    """The rules for a scan. What becomes part of its plan comes to the driver:
    everything but the allowlist, which ``apply_layers`` joins."""
    rows = settings.filter((F.col("path")[0] != "allowlist") & F.col("value").isNotNull())
    return Rules.from_rows((r.layer, tuple(r.path), r.value) for r in rows.collect()).without(
        "allowlist"
    )


def _resolved(settings: DataFrame) -> Column:
    """Path to value of the highest layer that sets one, lists left out."""
    one = (
        settings.filter(~F.col("path")[0].isin(*LISTS) & F.col("value").isNotNull())
        .groupBy(F.array_join("path", _DOT).alias("path"))
        .agg(F.max_by("value", "layer").alias("value"))
    )
    return one.agg(
        F.map_from_entries(F.collect_list(F.struct("path", "value")))
    ).scalar()


def _default(*path: str) -> Any:
    return next(s.default for s in SETTINGS if s.path == path)


class _MaskingColumns:
    """Masking whose settings are columns, for the functions that take ``Masking``."""

    keep_prefix, keep_suffix = "_keep_prefix", "_keep_suffix"
    replacement = "regexp_replace(_mask_char, '([\\\\\\\\$])', '\\\\\\\\$1')"


SALT = 32  # tasks among which the hits of one value are spread


def _with_allowed(hits: DataFrame, settings: DataFrame) -> DataFrame:
    """Hits whose value contains no entry of the allowlist; the verdict is taken once
    per distinct value. A null value is never allowed."""
    entries = settings.filter((F.col("path")[0] == "allowlist") & (F.col("value") != ""))
    entries = entries.select(F.col("value").alias("piece")).distinct()
    lengths = entries.agg(F.collect_set(F.length("piece"))).scalar()
    pieces = F.expr(
        "flatten(transform(filter(_lengths, n -> n <= length(raw)), n -> "
        "transform(sequence(1, length(raw) - n + 1), i -> substr(raw, i, n))))"
    )
    values = hits.select("raw").distinct().withColumn("_lengths", lengths)
    cut = values.select("raw", F.explode(F.array_distinct(pieces)).alias("piece"))
    allowed = cut.join(entries, "piece", "left_semi").select("raw").distinct()
    # hits of one value go to SALT tasks, not one: the salt is a hash of the hit's own
    # atomic fields, the same on every recompute; each allowed value is there SALT times
    atomic = [f.name for f in hits.schema.fields if isinstance(f.dataType, T.AtomicType)]
    salted = hits.withColumn("_salt", F.pmod(F.xxhash64(*atomic), F.lit(SALT)))
    every = allowed.select("raw", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt"))
    return salted.join(every, ["raw", "_salt"], "left_anti").drop("_salt")


def apply_layers(hits: DataFrame, settings: DataFrame) -> DataFrame:
    """Hits kept by the resolved settings, each with its policy and its mask.

    A setting that no layer has takes its default.
    """

    def get(*path: str | Column) -> Column:
        key = F.concat_ws(_DOT, *(p if isinstance(p, Column) else F.lit(p) for p in path))
        return F.try_element_at("_settings", key)

    def value(kind: str, *path: str) -> Column:
        return F.coalesce(get(*path).cast(kind), F.lit(_default(*path)).cast(kind))

    own = F.col("type")
    rows = _with_allowed(hits, settings).withColumn("_settings", _resolved(settings))
    rows = rows.withColumns(
        {
            "_style": value("string", "masking", "style"),
            "_mask_char": F.coalesce(F.nullif(get("masking", "mask_char"), F.lit("")), F.lit("*")),
            "_keep_prefix": value("int", "masking", "keep_prefix"),
            "_keep_suffix": value("int", "masking", "keep_suffix"),
            "_label": F.coalesce(
                get("masking", "labels", own),
                F.concat(F.lit("["), own, F.lit("-REDACTED]")),
            ),
            "_threshold": F.coalesce(
                get("detectors", own, "min_confidence").cast("double"),
                value("double", "min_confidence"),
            ),
            "policy": F.coalesce(
                get("detectors", own, "policy"), value("string", "default_policy")
            ),
            "_enabled": F.coalesce(
                F.lower(get("detectors", own, "enabled")).cast("boolean"), F.lit(True)
            ),
        }
    )
    masking = _MaskingColumns()
    masked = F.expr(
        f"CASE _style WHEN {quote('label')} THEN _label WHEN {quote('full')} THEN "
        f"{mask_full('raw', masking)} ELSE {mask_partial('raw', masking)} END"
    )
    kept = rows.filter("_enabled AND confidence >= _threshold")
    return kept.select(*hits.columns, "policy", masked.alias("masked"))


def with_defaults(spark: SparkSession, settings: DataFrame, base: Rules) -> DataFrame:
    """The settings over those of ``base``, which become layer 0."""
    rows: Iterable[tuple] = ((0, list(p), _text(v)) for p, v in base.values.items())
    return spark.createDataFrame(list(rows), SETTINGS_SCHEMA).unionByName(settings)
