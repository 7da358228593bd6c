"""Queries on sources: files, unions of sources, audit logs; and on streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hits as H
from ..rules import Rules
from ..sources import readers, sinks
from ..streaming import jobs
from . import oracle as O
from .corpus import corpus
from .redaction import _BLOCKED, TS, blocking, entries
from .registry import query


FILES = 64


@query(
    "src_text_corpus",
    O.hits(texts="corpus AS (SELECT doc_id, 'f' AS source, text FROM documents)")
    + """ SELECT doc_id, CAST(length(text) + 1 AS INTEGER) AS n_chars,
        CAST(coalesce(n, 0) AS INTEGER) AS n_hits
    FROM corpus LEFT JOIN (SELECT doc_id, count(*) AS n FROM hits GROUP BY doc_id) AS h
        USING (doc_id)""",
)
def src_text_corpus(spark, folder):
    """Documents as lines of files, read back by byte ranges: a file of any size is
    many tasks, each line read by the range in which it starts."""
    path = sinks.scratch_folder(spark, "files")
    documents = readers.read_table(
        spark, f"{folder}/documents.parquet", ["doc_id", "text"], small=True
    )
    group = F.pmod(F.col("doc_id"), F.lit(FILES)).alias("part")
    line = F.concat(F.col("doc_id"), F.lit("\x1e"), F.translate("text", "\n", "\x1f"))
    documents.select(line.alias("value"), group).repartition("part").write.partitionBy(
        "part"
    ).text(path)
    lines = readers.read_text_lines(spark, path, glob="*.txt").filter("text <> ''")
    parts = F.split("text", "\x1e", 2)
    texts = lines.select(
        parts[0].cast("long").alias("doc_id"), F.translate(parts[1], "\x1f", "\n").alias("text")
    )
    counted = H.hit_counts(texts, Rules.default())
    return counted.select(
        "doc_id", (F.length("text") + 1).cast("int").alias("n_chars"), "n_hits"
    )


_UNION_SQL = """corpus AS (
    SELECT doc_id, 'documents' AS source, text FROM documents
    UNION ALL SELECT page_id, 'pages', html FROM pages
    UNION ALL SELECT conv_id * 1000 + turn, 'conversations', text FROM conversations
    UNION ALL SELECT item_id, 'benchmark', text FROM benchmark)"""


@query(
    "src_union_sources",
    O.hits(texts=_UNION_SQL)
    + """ SELECT source, count(*) AS n_texts, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_hits
    FROM corpus LEFT JOIN (SELECT doc_id, source, count(*) AS n FROM hits GROUP BY ALL) AS h
        USING (doc_id, source) GROUP BY ROLLUP (source)""",
)
def src_union_sources(spark, folder):
    def texts(table: str, column: str):
        read = readers.read_table(spark, f"{folder}/{table}.parquet", [column], small=True)
        return read.select(F.lit(table).alias("source"), F.col(column).alias("text"))

    together = readers.union_sources(
        texts("documents", "text"),
        texts("pages", "html"),
        texts("conversations", "text"),
        texts("benchmark", "text"),
    )
    counted = H.hit_counts(together, Rules.default())
    return counted.rollup("source").agg(
        F.count("*").alias("n_texts"), F.sum("n_hits").alias("n_hits")
    )


# Lines of an audit log by customer key: good ones, one with further keys and
# spaces around it, one with most keys missing, and three that must be skipped.
_LINES = f"""CASE c_custkey % 6
    WHEN 0 THEN '{{"schema":1,"ts":"{TS}","type":"phone","action":"block","checksum_valid":true,"file":"f'
        || CAST(c_custkey AS string) || '","line":3,"col":null,"rule_id":"r","masked_preview":"1*"}}'
    WHEN 1 THEN '   '
    WHEN 2 THEN 'NOT JSON ' || CAST(c_custkey AS string)
    WHEN 3 THEN '  {{"type":"uscc","more":{{"a":[1]}},"file":"f' || CAST(c_custkey AS string)
        || '","line":"7"}}  '
    WHEN 4 THEN '{{"file":"f' || CAST(c_custkey AS string) || '"}}'
    ELSE '[1,2]' END"""


@query(
    "src_audit_tolerant",
    f"""SELECT 1 AS schema, CASE c_custkey % 6 WHEN 0 THEN '{TS}' ELSE '' END AS ts,
        CASE c_custkey % 6 WHEN 0 THEN 'phone' WHEN 3 THEN 'uscc' ELSE '' END AS type,
        CASE c_custkey % 6 WHEN 0 THEN 'block' ELSE 'mask' END AS action,
        c_custkey % 6 = 0 AS checksum_valid, 'f' || c_custkey AS file,
        CAST(CASE c_custkey % 6 WHEN 0 THEN 3 WHEN 3 THEN 7 END AS INTEGER) AS line,
        CAST(NULL AS INTEGER) AS col,
        CASE c_custkey % 6 WHEN 0 THEN 'r' WHEN 3 THEN 'uscc' ELSE '' END AS rule_id,
        CASE c_custkey % 6 WHEN 0 THEN '1*' ELSE '' END AS masked_preview
    FROM customer WHERE c_custkey % 6 IN (0, 3, 4)""",
)
def src_audit_tolerant(spark, folder):
    path = sinks.scratch_folder(spark, "log")
    customer = readers.read_table(
        spark, f"{folder}/customer.parquet", ["c_custkey"], small=True
    )
    customer.select(F.expr(_LINES).alias("value")).write.text(path)
    return readers.read_audit_log(spark, path)


# -- streams ------------------------------------------------------------------


def _arriving(spark, folder):
    """The corpus as files of a folder, read as a stream of several batches."""
    path = sinks.scratch_folder(spark, "arriving")
    corpus(spark, folder).write.parquet(path)
    return jobs.read_text_stream(
        spark, path, "doc_id bigint, source string, text string", files_per_batch=6
    )


@query(
    "stream_redact",
    _BLOCKED
    + " SELECT doc_id, source, text, n_redactions FROM masked_text WHERE NOT blocked",
)
def stream_redact(spark, folder):
    out, state = (sinks.scratch_folder(spark, p) for p in ("stream", "state"))
    jobs.stream_redact(_arriving(spark, folder), blocking(), out, state).awaitTermination()
    return spark.read.parquet(out).select("doc_id", "source", "text", "n_redactions")


@query(
    "stream_block_audit",
    _BLOCKED
    + """ SELECT CAST(doc_id AS VARCHAR) || '/' || source AS place, text,
        CASE WHEN blocked THEN 'quarantine' ELSE 'output' END AS what, n_redactions AS n,
        CAST(NULL AS BOOLEAN) AS checksum_valid FROM masked_text
    UNION ALL SELECT source, masked, type || ' ' || policy, 1, checksum_valid FROM redactions""",
)
def stream_block_audit(spark, folder):
    """Every routed row, and every line of the audit."""
    out, state = (sinks.scratch_folder(spark, p) for p in ("gate", "state"))
    jobs.stream_block_audit(
        _arriving(spark, folder), blocking(), out, state, ts=TS
    ).awaitTermination()
    routed = jobs.committed(spark, out, "routed").select(
        F.concat_ws("/", "doc_id", "source").alias("place"),
        "text",
        F.col("route").alias("what"),
        F.size("redactions").alias("n"),
        F.lit(None).cast("boolean").alias("checksum_valid"),
    )
    logged = readers.parse_audit_lines(jobs.committed(spark, out, "audit")).select(
        F.col("file").alias("place"),
        F.col("masked_preview").alias("text"),
        F.concat_ws(" ", "type", "action").alias("what"),
        F.lit(1).alias("n"),
        "checksum_valid",
    )
    return routed.union(logged)


@query(
    "stream_audit_report",
    _BLOCKED + " SELECT type, policy AS action, count(*) AS n FROM redactions GROUP BY ALL",
)
def stream_audit_report(spark, folder):
    log, out, state = (sinks.scratch_folder(spark, p) for p in ("log", "report", "state"))
    sinks.write_audit_log(entries(spark, folder), log)
    jobs.stream_audit_report(spark, log, out, state, files_per_batch=4).awaitTermination()
    return jobs.current_report(spark, out)
