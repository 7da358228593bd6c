"""Tables that cut a job in two, in the folder that all nodes share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import scratch_folder


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under ``spark.checkpoint.dir``.

    A local session that has no such setting, as in tests, gets one for its life.
    """
    if not spark.conf.get("spark.checkpoint.dir", None):
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder all nodes share")
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="veilspark-"))
    return scratch_folder(spark, purpose)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a table in the shared folder: what built them is not run again,
    and a lost executor loses none of them."""
    folder = shared_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def set_aside(
    docs: DataFrame, *names: str
) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The rows with columns of these names out of the way, and what brings them back:
    exactly the columns of ``docs``."""
    columns = docs.columns
    moved = {c: f"{c}__given" for c in columns if c in names}
    renamed = docs.withColumnsRenamed(moved)

    def restored(rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f"`{moved.get(c, c)}`").alias(c) for c in columns])

    return renamed, restored


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
