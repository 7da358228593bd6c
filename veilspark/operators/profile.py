"""Checksum quality of table columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checksums import KIND_SHAPES, KIND_VALID, matches
from ..functions.sqltext import name


def checksum_profile(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Values of each column that are valid, fail their check digit, or have
    another shape; ``kinds`` maps columns to id_card, luhn, bank_card or uscc.

    One pass over the table: a row yields one small record per column, counted in
    the tasks before the shuffle.
    """
    counters = []
    for column, kind in kinds.items():
        value = name(column)
        valid = KIND_VALID[kind](value)
        shaped = f"coalesce({matches(value, KIND_SHAPES[kind])}, false)"
        counters.append(
            f"struct('{kind}' AS kind, {value} IS NOT NULL AS present, "
            f"{valid} AS valid, {shaped} AS shaped)"
        )
    checks = df.select(F.expr(f"inline_outer(array({', '.join(counters)}))"))
    return (
        checks.filter("present")
        .groupBy("kind")
        .agg(
            F.count_if("valid").alias("n_valid"),
            F.count_if(F.expr("shaped AND NOT valid")).alias("n_invalid"),
            F.count_if(F.expr("NOT shaped")).alias("n_other_shape"),
        )
    )
