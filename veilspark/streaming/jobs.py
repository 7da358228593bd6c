"""The same redaction over streams: stateless, so any micro-batch size will do."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.audit import audit_entries, audit_json
from ..operators.nested import redact_payloads
from ..operators.redaction import redact_text, released, with_route
from ..rules import Rules
from ..sources.readers import parse_audit_lines


def read_text_stream(
    spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000
) -> DataFrame:
    """Parquet files of a folder as a stream of rows, as they arrive."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


ALL_NOW = {"availableNow": True}


def _redacted(
    df: DataFrame, rules: Rules, body: str, content_type: str | None
) -> DataFrame:
    """Bodies by their content type, or texts, with the same columns added."""
    if content_type is None:
        return redact_text(df, rules, body)
    done = redact_payloads(df.withColumn("original_len", F.length(body)), rules, body, content_type)
    return done.withColumn("n_redactions", F.size("redactions")).withColumn(
        "changed", F.size("redactions") > 0
    )


def _append_batch(
    batch: DataFrame, number: int, path: str, file: str, ts: str | None, audit: bool
) -> None:
    """One micro-batch, visible all at once or not at all.

    Both parts are written to a folder of this attempt under ``_staged``: the routed
    rows, with their redactions and without raw values, and the audit derived from
    what was written (redaction runs once). Only then is the batch's manifest, which
    names the attempt, put in place by one rename. Readers go by the manifests
    (:func:`committed`): a crash before the rename leaves nothing visible, and a rerun
    of the batch names its own attempt, so each batch is seen once.
    """
    attempt = uuid.uuid4().hex
    where = f"batch={number}/attempt={attempt}"
    routed = f"{path}/_staged/part=routed/{where}"
    with_route(batch).write.partitionBy("route").parquet(routed)
    if audit:
        written = batch.sparkSession.read.schema(with_route(batch).schema).parquet(routed)
        audit_entries(written, file, ts).select(audit_json().alias("value")).write.text(
            f"{path}/_staged/part=audit/{where}"
        )
    _commit(batch.sparkSession, f"{path}/_manifest", number, attempt)


def _commit(spark: SparkSession, folder: str, number: int, attempt: str) -> None:
    """Writes ``{"batch": number, "attempt": attempt}`` as the manifest of a batch:
    first to a file of its own, then renamed over the old one, which the file systems
    Spark writes to do at once."""
    _put(spark, folder, f"batch-{number}.json", {"batch": number, "attempt": attempt}, True)


def _put(spark: SparkSession, folder: str, name: str, payload: dict, replace: bool) -> None:
    """``payload`` as the file ``folder/name``, written whole under a name of its own
    and then renamed into place; without ``replace`` an existing file is an error."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    fs = target.getFileSystem(conf)
    temporary = jvm.org.apache.hadoop.fs.Path(f"{folder}/.{name}-{uuid.uuid4().hex}.tmp")
    out = fs.create(temporary, True)
    out.write(json.dumps(payload).encode())
    out.close()
    if replace and fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(temporary, target):
        raise OSError(f"could not put {name} at {folder}")


def committed(spark: SparkSession, path: str, part: str) -> DataFrame:
    """The rows of ``part`` (``routed``: parquet, ``audit``: lines) of all committed
    batches of :func:`stream_block_audit` at ``path``; attempts that no manifest names
    are left out. Before any batch has written, one column ``value`` and no rows."""
    staged = f"{path}/_staged/part={part}"
    reader = spark.read.option("basePath", staged)
    try:
        rows = reader.parquet(staged) if part == "routed" else reader.text(staged)
    except Exception as missing:  # no batch has written this part yet
        if "PATH_NOT_FOUND" not in str(missing) and "does not exist" not in str(missing):
            raise
        return spark.createDataFrame([], "value string")
    manifests = spark.createDataFrame([], "batch long, attempt string")
    known = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest")
    if known.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(known):
        manifests = spark.read.schema("batch long, attempt string").json(f"{path}/_manifest")
    return rows.join(manifests, ["batch", "attempt"], "left_semi").drop("batch", "attempt")


def stream_redact(
    stream: DataFrame,
    rules: Rules,
    path: str,
    checkpoint: str,
    text: str = "text",
    content_type: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Masked rows appended to ``path``; blocked rows are left out.

    With ``content_type``, a column, bodies of JSON are masked leaf by leaf. ``trigger``
    are the arguments of the stream's trigger; by default it ends with what is there.
    """
    masked = _redacted(stream, rules, text, content_type)
    kept = released(masked).select(*stream.columns, "n_redactions", "original_len")
    return (
        kept.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or ALL_NOW))
        .start()
    )


def stream_block_audit(
    stream: DataFrame,
    rules: Rules,
    path: str,
    checkpoint: str,
    text: str = "text",
    file: str = "source",
    ts: str | None = None,
    content_type: str | None = None,
    audit: bool = True,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Per micro-batch: every row routed and, with ``audit``, every redaction logged;
    both committed together by a manifest. Read them by :func:`committed`."""

    def write_batch(batch: DataFrame, number: int) -> None:
        done = _redacted(batch, rules, text, content_type)
        _append_batch(done, number, path, file, ts, audit)

    return (
        stream.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ALL_NOW))
        .start()
    )


def stream_audit_report(
    spark: SparkSession,
    log: str,
    path: str,
    checkpoint: str,
    files_per_batch: int = 1000,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Counts per type and action over a growing audit log.

    Each batch writes a new version of the report and then points to it; read the
    report by :func:`current_report`, which never sees a half-written or missing one.
    State is one row per type and action, whatever the length of the log.
    """
    lines = (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true")
        .text(log)
    )
    counts = parse_audit_lines(lines).groupBy("type", "action").agg(
        F.count("*").alias("n")
    )

    def replace_report(report: DataFrame, number: int) -> None:
        _publish_report(report, number, path)

    return (
        counts.writeStream.outputMode("complete")
        .foreachBatch(replace_report)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ALL_NOW))
        .start()
    )


def _publish_report(report: DataFrame, number: int, path: str) -> None:
    """The report of batch ``number`` as a version of its own under ``path/versions``,
    then a new pointer file naming it in ``path/_current``. Pointers get new names
    and are never overwritten, so the newest complete version is always named. Older
    pointers and versions but the one before are then removed."""
    spark = report.sparkSession
    version = f"batch={number:020d}-{uuid.uuid4().hex}"
    report.coalesce(1).write.parquet(f"{path}/versions/{version}")
    _put(spark, f"{path}/_current", f"v-{version}", {"version": version}, False)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    pointers = jvm.org.apache.hadoop.fs.Path(f"{path}/_current")
    fs = pointers.getFileSystem(conf)
    names = sorted(
        n for n in (st.getPath().getName() for st in fs.listStatus(pointers)) if n.startswith("v-")
    )
    for old in names[:-2]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{old[2:]}"), True)
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/_current/{old}"), False)


def current_report(spark: SparkSession, path: str) -> DataFrame:
    """The newest published report of :func:`stream_audit_report` at ``path``
    (type, action, n); before any is published, no rows."""
    jvm = spark.sparkContext._jvm
    pointers = jvm.org.apache.hadoop.fs.Path(f"{path}/_current")
    fs = pointers.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = []
    if fs.exists(pointers):
        names = sorted(
            n for n in (st.getPath().getName() for st in fs.listStatus(pointers)) if n.startswith("v-")
        )
    if not names:
        return spark.createDataFrame([], "type string, action string, n long")
    return spark.read.parquet(f"{path}/versions/{names[-1][2:]}")
