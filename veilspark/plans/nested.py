"""Queries on JSON texts, nested columns and whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed_values import DETECTOR_TYPES
from ..operators import nested as N
from ..operators.redaction import redact_text
from ..rules import Rules
from ..sources.readers import read_table
from . import oracle as O
from .corpus import corpus, flipped_values_sql, planted, planted_sql, planted_values
from .redaction import BLOCK_SQL, blocking
from .registry import query

_PLANTED_ONLY = f"""corpus AS (
    SELECT doc_id, source, text FROM ({planted_sql("customer")}) AS planted)"""


_WHOLE_CORPUS = """corpus AS (
    SELECT doc_id, source, coalesce(text, '') AS text FROM documents
    UNION ALL SELECT doc_id, source, text FROM ({planted}) AS planted)"""


def _masked(*, policy: str = "'mask'", texts: str = _PLANTED_ONLY) -> str:
    return O.hits(texts=texts) + O.redactions(policy=policy) + O.spliced()


# Requests around the planted texts, as Spark and DuckDB both build them. The keys
# hold values too, which must stay.
_REQUEST = (
    "'{{\"13800138000\":\"none\",\"a\":[{{\"t\":' || {text} || '}},true,null,1.5,'"
    " || CAST(doc_id AS string) || '],\"b\":{{\"c\":' || {text} || ',\"d\":[[' || {text} || ']]}}}}'"
)


@query(
    "redact_json_strings",
    _masked(texts=_WHOLE_CORPUS.format(planted=planted_sql("customer")))
    + """ SELECT doc_id, '{"13800138000": "none", "a": [{"t": ' || to_json(text)
        || '}, true, null, 1.5, ' || doc_id || '], "b": {"c": ' || to_json(text)
        || ', "d": [[' || to_json(text) || ']]}}' AS body FROM masked_text""",
)
def redact_json_strings(spark, folder):
    json_text = "substr(to_json(struct(text AS v)), 6, length(to_json(struct(text AS v))) - 6)"
    # every document and the planted texts; a null text is the empty one
    texts = corpus(spark, folder).withColumn("text", F.coalesce("text", F.lit("")))
    bodies = texts.select("doc_id", F.expr(_REQUEST.format(text=json_text)).alias("body"))
    return N.redact_json_column(bodies, Rules.default()).select("doc_id", "body")


# Rules of redact_json_custom: two user patterns that only Python's re can run
# (repeated groups), all built-in detectors off.
PYTHON_ONLY_LAYER = {
    "custom_patterns": [
        {"type": "code", "pattern": r"(?:[A-Z]{2}-)+\d+"},
        {"type": "title", "pattern": r"(?:[A-Z][a-z]+ )+[A-Z][a-z]+"},
    ]
}
_PYTHON_ONLY_SEARCHES = [
    (6, O.Search("code", "code", "", r"(?:[A-Z]{2}-)+\d+", "true", False, 0.6, "")),
    (7, O.Search("title", "title", "", r"(?:[A-Z][a-z]+ )+[A-Z][a-z]+", "true", False, 0.6, "")),
]
@query(
    "redact_json_custom",
    O.hits(
        "none",
        texts=_WHOLE_CORPUS.format(planted=planted_sql("customer")),
        extra=_PYTHON_ONLY_SEARCHES,
    )
    + O.redactions()
    + O.spliced()
    + """ SELECT doc_id, source, '{"13800138000": "none", "a": [{"t": ' || to_json(text)
        || '}, true, null, 1.5, ' || doc_id || '], "b": {"c": ' || to_json(text)
        || ', "d": [[' || to_json(text) || ']]}}' AS body FROM masked_text""",
)
def redact_json_custom(spark, folder):
    """Requests around every whole text of documents and the planted ones, every leaf
    searched by two patterns that need Python's engine."""
    rules = Rules.from_layers(
        PYTHON_ONLY_LAYER, {"detectors": {t: {"enabled": False} for t in DETECTOR_TYPES}}
    )
    text = "coalesce(text, '')"
    json_text = f"substr(to_json(struct({text} AS v)), 6, length(to_json(struct({text} AS v))) - 6)"
    bodies = corpus(spark, folder).select(
        "doc_id", "source", F.expr(_REQUEST.format(text=json_text)).alias("body")
    )
    return N.redact_json_column(bodies, rules).select("doc_id", "source", "body")


CUSTOMER_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_NUMBERS_SQL = f"""WITH v AS ({flipped_values_sql("customer")})"""
_PAN_MASK = O.mask("partial", "pan")
_WITH_CUSTOMER = " FROM v JOIN customer ON c_custkey = k"


def _values_and_customer(spark, folder):
    """The planted values of each customer beside all of its columns."""
    customer = read_table(spark, f"{folder}/customer.parquet", CUSTOMER_COLUMNS)
    return planted_values(spark, folder).join(customer.withColumnRenamed("c_custkey", "k"), "k")
_PHONE_MASK = O.mask("partial", "phone")


@query(
    "redact_json_numbers",
    f"""{_NUMBERS_SQL} SELECT k,
        '{{"pan": ' || CASE WHEN {O.luhn_ok("pan")} THEN '"' || {_PAN_MASK} || '"' ELSE pan END
        || ', "phone": "' || {_PHONE_MASK} || '", "share": "' || {_PHONE_MASK} || '.0"'
        || ', "max_tokens": 256, "rate": 1.5, "neg": "-' || {_PHONE_MASK} || '"'
        || ', "big": "' || {_PHONE_MASK} || '.0", "name": "' || c_name || '", "nation": '
        || c_nationkey || ', "acctbal": ' || c_acctbal || ', "segment": "' || c_mktsegment
        || '", "flag": true}}' AS body{_WITH_CUSTOMER}""",
)
def redact_json_numbers(spark, folder):
    values = _values_and_customer(spark, folder)
    body = """'{"pan":' || pan || ',"phone":' || phone || ', "share": ' || phone || '.0'
        || ',"max_tokens":256,"rate":1.50,"neg":-' || phone || ',"big":' || substr(phone, 1, 1)
        || '.' || substr(phone, 2) || 'e10,"name":"' || c_name || '","nation":' || c_nationkey
        || ',"acctbal":' || c_acctbal || ',"segment":"' || c_mktsegment || '","flag":true}'"""
    bodies = values.select("k", F.expr(body).alias("body"))
    return N.redact_json_column(bodies, Rules.default()).select("k", "body")


@query(
    "redact_json_passthrough",
    f"""{_NUMBERS_SQL} SELECT k, '{{"' || phone || '": true, "n": null, "e": {{}}, "l": [], "f": false, '
        || '"' || c_name || '": [' || c_nationkey || ', ' || c_acctbal || ', "' || c_mktsegment || '"]}}'
        AS body, false AS blocked{_WITH_CUSTOMER}""",
)
def redact_json_passthrough(spark, folder):
    body = """'{"' || phone || '" : true,\n "n":null,"e":{ },"l":[ ],"f":false,"' || c_name
        || '":[' || c_nationkey || ',' || c_acctbal || ',"' || c_mktsegment || '"]}'"""
    bodies = _values_and_customer(spark, folder).select("k", F.expr(body).alias("body"))
    done = N.redact_json_column(bodies, blocking())
    return done.select("k", "body", "blocked")


@query(
    "json_blocked_any",
    f"""{_NUMBERS_SQL} SELECT k, {O.id_card_ok("id_no")} AND NOT (k % 5 = 0) AS blocked{_WITH_CUSTOMER}""",
)
def json_blocked_any(spark, folder):
    body = """'{"p":"' || phone || '","x":[{"y":["' || CASE WHEN k % 5 = 0 THEN 'none' ELSE id_no END
        || '"]}],"c":{"name":"' || c_name || '","nation":' || c_nationkey || ',"acctbal":'
        || c_acctbal || ',"segment":"' || c_mktsegment || '"}}'"""
    rules = Rules.from_layers({"detectors": {"id_card": {"policy": "block"}}})
    bodies = _values_and_customer(spark, folder).select("k", F.expr(body).alias("body"))
    return N.redact_json_column(bodies, rules).select("k", "blocked")


# -- payloads by content type -------------------------------------------------

_KIND = "CAST((doc_id - doc_id % 4) / 4 AS bigint) % 4"


@query(
    "src_payloads",
    _masked(policy=BLOCK_SQL, texts=_WHOLE_CORPUS.format(planted=planted_sql("customer")))
    + f""" SELECT doc_id, n_redactions > 0 AND {_KIND} <> 3 AND blocked AS blocked, CASE {_KIND}
        WHEN 0 THEN '{{"model": "m", "input": ' || to_json(text) || ', "n": ' || doc_id || '}}'
        WHEN 3 THEN 'null' ELSE text END AS body FROM masked_text""",
)
def src_payloads(spark, folder):
    json_text = "substr(to_json(struct(text AS v)), 6, length(to_json(struct(text AS v))) - 6)"
    # every document and the planted texts; a null text is the empty one
    texts = corpus(spark, folder).withColumn("text", F.coalesce("text", F.lit("")))
    payloads = texts.select(
        "doc_id",
        F.expr(
            f"""CASE {_KIND} WHEN 0 THEN 'application/json; charset=utf-8' WHEN 1 THEN 'text/plain'
            WHEN 2 THEN 'Application/JSON' ELSE 'application/json' END"""
        ).alias("content_type"),
        F.expr(
            f"""CASE {_KIND} WHEN 0 THEN '{{"model":"m","input":' || {json_text} || ',"n":'
            || doc_id || '}}' WHEN 3 THEN 'null' ELSE text END"""
        ).alias("body"),
    )
    return N.redact_payloads(payloads, blocking()).select("doc_id", "body", "blocked")


# -- chat -----------------------------------------------------------------

# A phone number or a host after every turn, by its conversation and turn
_SAID = (
    "text || ' 1' || CAST(3 + conv_id % 7 AS string) || "
    "lpad(CAST((conv_id * 7919 + turn) % 1000000000 AS string), 9, '0') || ' at db' || "
    "CAST(turn AS string) || '.corp'"
)


@query(
    "redact_chat_turns",
    _masked(
        policy="CASE WHEN type = 'phone' THEN 'block' ELSE 'mask' END",
        texts=f"""corpus AS (SELECT conv_id * 1000 + turn AS doc_id, role AS source,
            {_SAID} AS text FROM conversations)""",
    )
    + """ SELECT doc_id // 1000 AS conv_id, '{"model": "m", "messages": [' || string_agg(
        '{"role": "' || source || '", "content": ' || to_json(text) || '}', ', ' ORDER BY doc_id)
        || '], "max_tokens": 256}' AS body, CAST(sum(n_redactions) AS INTEGER) AS n_redactions,
        bool_or(blocked) AS blocked FROM masked_text GROUP BY doc_id // 1000""",
)
def redact_chat_turns(spark, folder):
    """A request of all messages of each conversation."""
    turns = read_table(
        spark, f"{folder}/conversations.parquet", ["conv_id", "turn", "role", "text"], small=True
    ).withColumn("content", F.expr(_SAID))
    requests = N.chat_requests(
        turns, "conv_id", "turn", "role", "content", model="m", messages=..., max_tokens=256
    )
    rules = Rules.from_layers({"detectors": {"phone": {"policy": "block"}}})
    done = N.redact_chat(requests, rules)
    return done.select("conv_id", "body", F.size("redactions").alias("n_redactions"), "blocked")


# -- typed columns ----------------------------------------------------------


@query(
    "redact_columns",
    f"""{_NUMBERS_SQL} SELECT k, CASE WHEN {O.id_card_ok("id_no")} OR CASE
            WHEN regexp_full_match(id_no, '\\d+') THEN {O.luhn_ok("id_no")} OR {O.uscc_ok("id_no")} ELSE false END
            THEN {O.mask("partial", "id_no")} ELSE id_no END AS id_no,
        {_PHONE_MASK} AS phone,
        CASE WHEN {O.luhn_ok("pan")} THEN {_PAN_MASK} ELSE pan END AS pan,
        'host ' || {O.mask("partial", "host")} AS tags, 'x' || k || ' ' || {_PHONE_MASK} AS by_name,
        k % 2 = 0 AS flag, {O.id_card_ok("id_no")} AS blocked, c_name,
        CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal,
        c_mktsegment FROM v JOIN customer ON c_custkey = k""",
)
def redact_columns(spark, folder):
    rules = Rules.from_layers({"detectors": {"id_card": {"policy": "block"}}})
    # every column of customer beside the planted values, all of them redacted
    customer = read_table(spark, f"{folder}/customer.parquet", CUSTOMER_COLUMNS)
    table = planted_values(spark, folder).join(
        customer.withColumnRenamed("c_custkey", "k"), "k"
    ).select(
        "k",
        *CUSTOMER_COLUMNS[1:],
        "id_no",
        F.col("phone").cast("long").alias("phone"),
        F.col("pan").cast("decimal(20,0)").alias("pan"),
        F.expr("array('host ' || host)").alias("tags"),
        F.expr("map('13800138000', named_struct('s', 'x' || k || ' ' || phone))").alias(
            "by_name"
        ),
        F.expr("k % 2 = 0").alias("flag"),
    )
    done = N.redact_columns(table, rules, table.columns)
    # numbers come back as variants (a number with a hit would become a string)
    return done.select(
        F.col("k").cast("string").cast("long").alias("k"),
        "c_name",
        F.col("c_nationkey").cast("string").alias("c_nationkey"),
        F.col("c_acctbal").cast("string").alias("c_acctbal"),
        "c_mktsegment",
        "id_no",
        F.col("phone").cast("string").alias("phone"),
        F.col("pan").cast("string").alias("pan"),
        F.col("tags")[0].alias("tags"),
        F.col("by_name")["13800138000"]["s"].alias("by_name"),
        "flag",
        "blocked",
    )


@query(
    "src_table_text",
    _masked(texts="corpus AS (SELECT doc_id, source, text FROM documents)")
    + " SELECT doc_id, text, n_redactions FROM masked_text",
)
def src_table_text(spark, folder):
    documents = read_table(
        spark, f"{folder}/documents.parquet", ["doc_id", "source", "text"], small=True
    )
    done = redact_text(documents, Rules.default())
    return done.select("doc_id", "text", "n_redactions")
