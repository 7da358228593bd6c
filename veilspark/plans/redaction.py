"""Queries on masking, rewriting, policy and the audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.masking import mask_value, masked_preview
from ..operators import audit as A
from ..operators import hits as H
from ..operators import redaction as R
from ..rules import Rules
from ..sources import sinks
from . import oracle as O
from .corpus import corpus
from .detection import CUSTOM_LAYER, CUSTOM_SEARCHES, HIT_COLUMNS, HIT_SQL
from .registry import query

TS = "2026-01-01T00:00:00+00:00"
BLOCKING = {
    "detectors": {"id_card": {"policy": "block"}, "uscc": {"policy": "block"}},
}
BLOCK_SQL = "CASE WHEN type IN ('id_card', 'uscc') THEN 'block' ELSE 'mask' END"


def blocking() -> Rules:
    return Rules.from_layers(BLOCKING)


# -- masks ------------------------------------------------------------------


def _mask(style: str) -> None:
    oracle = (
        O.hits() + f" SELECT doc_id, source, start, type, {O.mask(style)} AS masked FROM hits"
    )

    @query(f"mask_{style}", oracle)
    def masks(spark, folder):
        rules = Rules.default().with_style(style)
        found = H.scan(corpus(spark, folder), rules, positions=False)
        return found.select(
            "doc_id",
            "source",
            "start",
            "type",
            F.expr(mask_value("raw", "type", rules)).alias("masked"),
        )


for _style in ("partial", "full", "label"):
    _mask(_style)


@query(
    "mask_style_override",
    O.hits()
    + O.redactions("label")
    + O.spliced("label")
    + " SELECT doc_id, source, text, n_redactions FROM masked_text",
)
def mask_style_override(spark, folder):
    rules = Rules.from_layers({"masking": {"style": "full"}}).with_style("label")
    done = R.redact_text(corpus(spark, folder), rules)
    return done.select("doc_id", "source", "text", "n_redactions")


_SENTENCE = r"[A-Z][^.\n]{50,90}[.]"


@query(
    "masked_preview",
    O.hits(
        "phone",
        extra=[(6, O.Search("sentence", "sentence", "", _SENTENCE, "true", False, 0.6, ""))],
    )
    + f""", m AS (SELECT doc_id, source, start, {O.mask("full")} AS masked FROM hits WHERE ord = 6)
    SELECT doc_id, source, start, CASE WHEN length(masked) > 64
        THEN substr(masked, 1, 63) || '…' ELSE masked END AS preview FROM m""",
)
def preview(spark, folder):
    custom = {"custom_patterns": [{"type": "sentence", "pattern": _SENTENCE}]}
    rules = Rules.from_layers(custom).with_style("full")
    found = H.scan(corpus(spark, folder), rules, positions=False)
    masked = found.filter("type = 'sentence'").withColumn(
        "masked", F.expr(mask_value("raw", "type", rules))
    )
    return masked.select(
        "doc_id", "source", "start", F.expr(masked_preview("masked")).alias("preview")
    )


# -- rewriting --------------------------------------------------------------


@query("dedupe_spans", O.hits() + O.redactions() + HIT_SQL + " FROM redactions")
def dedupe_spans(spark, folder):
    # identical spans of a text are reduced inside its row: no shuffle
    found = H.scan(corpus(spark, folder), Rules.default(), positions=False, dedupe=True)
    return found.select(*HIT_COLUMNS)


_REWRITTEN = O.hits() + O.redactions() + O.spliced()


@query("redact_text", _REWRITTEN + " SELECT doc_id, source, text FROM masked_text")
def redact_text(spark, folder):
    done = R.redact_text(corpus(spark, folder), Rules.default())
    return done.select("doc_id", "source", "text")


@query(
    "redact_given_hits",
    O.hits("phone", "intranet_host")
    + O.redactions()
    + O.spliced()
    + " SELECT doc_id, source, text, n_redactions FROM masked_text",
)
def redact_given_hits(spark, folder):
    texts = corpus(spark, folder)
    given = H.scan(texts, Rules.default()).filter("ord IN (1, 5)")
    done = R.redact_given_hits(texts, given, Rules.default(), keys=["doc_id", "source"])
    return done.select("doc_id", "source", "text", "n_redactions")


@query(
    "resolve_policy",
    O.hits() + f" SELECT doc_id, source, start, type, {BLOCK_SQL} AS policy FROM hits",
)
def resolve_policy(spark, folder):
    found = H.scan(corpus(spark, folder), blocking(), positions=False)
    return H.resolve_policy(found, blocking()).select(
        "doc_id", "source", "start", "type", "policy"
    )


_BLOCKED = O.hits() + O.redactions(policy=BLOCK_SQL) + O.spliced()


@query(
    "block_route",
    _BLOCKED
    + """ SELECT doc_id, source, text, CASE WHEN blocked THEN 'quarantine' ELSE 'output' END
        AS route FROM masked_text""",
)
def block_route(spark, folder):
    path = sinks.scratch_folder(spark, "routed")
    done = R.redact_text(corpus(spark, folder), blocking())
    sinks.write_routed(done, path)
    return spark.read.parquet(path).select("doc_id", "source", "text", "route")


@query(
    "redact_metrics",
    _BLOCKED
    + """ SELECT doc_id, source, CAST(length(before) AS INTEGER) AS original_len, n_redactions,
        n_redactions > 0 AS changed, blocked FROM masked_text""",
)
def redact_metrics(spark, folder):
    done = R.redact_text(corpus(spark, folder), blocking())
    return done.select(
        "doc_id", "source", "original_len", "n_redactions", "changed", "blocked"
    )


@query(
    "counts_by_type",
    O.hits()
    + O.redactions()
    + " SELECT doc_id, source, type, count(*) AS n FROM redactions GROUP BY ALL",
)
def counts_by_type(spark, folder):
    done = R.redact_text(corpus(spark, folder), Rules.default())
    return R.counts_by_type(done, ["doc_id", "source"])


@query(
    "mask_summary",
    O.hits()
    + O.redactions()
    + f""" SELECT type, {O.type_label("type")} AS label, count(*) AS n,
        CAST(row_number() OVER (ORDER BY count(*) DESC, type) AS INTEGER) AS position
        FROM redactions GROUP BY type""",
)
def mask_summary(spark, folder):
    return R.mask_summary(R.redact_text(corpus(spark, folder), Rules.default()))


@query(
    "sink_masked",
    _BLOCKED + " SELECT doc_id, source, text FROM masked_text WHERE NOT blocked",
)
def sink_masked(spark, folder):
    path = sinks.scratch_folder(spark, "masked")
    done = R.redact_text(corpus(spark, folder), blocking())
    sinks.write_masked(done, path, ["doc_id", "source", "text"])
    return spark.read.parquet(path)


# -- audit ------------------------------------------------------------------

_ENTRIES = f"""SELECT 1 AS schema, '{TS}' AS ts, type, policy AS action, checksum_valid,
    source AS file, CAST(NULL AS INTEGER) AS line, CAST(NULL AS INTEGER) AS col,
    type AS rule_id, masked AS masked_preview"""


def entries(spark, folder, rules=None, **options):
    done = R.redact_text(corpus(spark, folder), rules or blocking())
    return A.audit_entries(done, ts=TS, **options)


@query("audit_entries", _BLOCKED + " " + _ENTRIES + " FROM redactions")
def audit_entries(spark, folder):
    return entries(spark, folder)


@query(
    "sink_audit_jsonl",
    _BLOCKED
    + f""" SELECT '{{"schema":1,"ts":"{TS}","type":"' || type || '","action":"' || policy
        || '","checksum_valid":' || CAST(checksum_valid AS VARCHAR) || ',"file":"' || source
        || '","line":null,"col":null,"rule_id":"' || type || '","masked_preview":"' || masked
        || '"}}' AS value FROM redactions""",
)
def sink_audit_jsonl(spark, folder):
    path = sinks.scratch_folder(spark, "audit")
    sinks.write_audit_log(entries(spark, folder), path)
    return spark.read.text(path)


@query(
    "sink_hits_json",
    O.hits()
    + """ SELECT h.source AS file, type,
        CAST(length(substr(text, 1, start)) - length(replace(substr(text, 1, start), chr(10), ''))
            + 1 AS INTEGER) AS line,
        CAST(length(string_split(substr(text, 1, start), chr(10))[-1]) + 1 AS INTEGER) AS col,
        checksum_valid, confidence
    FROM hits AS h JOIN corpus AS c ON h.doc_id = c.doc_id AND h.source = c.source""",
)
def sink_hits_json(spark, folder):
    path = sinks.scratch_folder(spark, "hits")
    sinks.write_hits_json(H.scan(corpus(spark, folder), Rules.default()), path)
    return spark.read.schema(
        "file string, type string, line int, col int, checksum_valid boolean, confidence double"
    ).json(path)


_LEAK_SQL = (
    O.hits(extra=CUSTOM_SEARCHES)
    + O.redactions()
    + f""",
records AS (SELECT type, raw,
    '{{"schema":1,"ts":"{TS}","type":"' || type || '","action":"mask","checksum_valid":'
    || CAST(checksum_valid AS VARCHAR) || ',"file":"' || source || '","line":null,"col":null,'
    || '"rule_id":"' || type || '","masked_preview":"' || masked || '"}}' AS json FROM redactions),
every AS (SELECT DISTINCT raw AS piece FROM records),
lines AS (SELECT DISTINCT json FROM records),
holding AS (SELECT DISTINCT json FROM lines JOIN every ON contains(json, piece))
SELECT type, count(*) AS n_entries, count(*) FILTER (contains(json, raw)) AS n_own_raw,
    count(*) FILTER (json IN (SELECT json FROM holding)) AS n_any_raw
FROM records GROUP BY type"""
)


@query("audit_leak_check", _LEAK_SQL)
def audit_leak_check(spark, folder):
    done = R.redact_text(corpus(spark, folder), Rules.from_layers(CUSTOM_LAYER))
    return A.leaks(A.audit_entries(done, ts=TS, keep_raw=True))


@query(
    "report_by_type",
    _BLOCKED
    + f""" SELECT type, {O.type_label("type")} AS label, count(*) AS n,
        CAST(row_number() OVER (ORDER BY count(*) DESC, type) AS INTEGER) AS position
        FROM redactions GROUP BY type""",
)
def report_by_type(spark, folder):
    return A.report_by_type(entries(spark, folder))


@query(
    "report_by_action",
    _BLOCKED + " SELECT policy AS action, count(*) AS n FROM redactions GROUP BY ALL",
)
def report_by_action(spark, folder):
    return A.report_by_action(entries(spark, folder))


@query(
    "report_totals",
    _BLOCKED
    + " SELECT count(*) AS n_fields, count(DISTINCT source) AS n_sources FROM redactions",
)
def report_totals(spark, folder):
    return A.report_totals(entries(spark, folder))
