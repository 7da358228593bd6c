"""Writing masked texts, audit logs and hits."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import audit_json
from ..operators.redaction import released, with_route, without_raw


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder all executors share, for tables that cut or stage a job.

    It lies in the folder the cluster names in ``spark.checkpoint.dir``. A local
    session without that setting, as in tests, gets one folder for its life.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder all nodes share")
        base = tempfile.mkdtemp(prefix="veilspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def write_masked(redacted: DataFrame, path: str, columns: list[str]) -> None:
    """Only rows that are not blocked, as parquet, without raw values."""
    without_raw(released(redacted).select(*columns)).write.mode("append").parquet(path)


def write_routed(redacted: DataFrame, path: str) -> None:
    """All rows in one pass, in folders ``route=output`` and ``route=quarantine``.

    One write instead of two filters, which would detect everything twice.
    """
    with_route(redacted).write.mode("append").partitionBy("route").parquet(path)


def write_audit_log(entries: DataFrame, path: str) -> None:
    """Append records as JSON lines. Files of a failed attempt are never seen:
    the commit of the write takes the place of locks and flushes."""
    entries.select(audit_json().alias("value")).write.mode("append").text(path)


def hits_as_json(hits: DataFrame, file: str = "source") -> DataFrame:
    """What a scan reports of each hit; never the raw value."""
    return hits.select(
        F.col(file).alias("file"),
        "type",
        "line",
        "col",
        "checksum_valid",
        F.round("confidence", 3).alias("confidence"),
    )


def write_hits_json(hits: DataFrame, path: str, file: str = "source") -> None:
    hits_as_json(hits, file).write.mode("append").json(path)
