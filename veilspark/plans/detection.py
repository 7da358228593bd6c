"""Queries on detection: the recognizers, the filters, positions and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed_values import DETECTOR_TYPES
from ..operators import hits as H
from ..operators.layered_rules import apply_layers, rules_of, unpivoted
from ..operators.profile import checksum_profile
from ..rules import Rules
from . import oracle as O
from .corpus import corpus, flipped_values_sql, planted_values
from .registry import query

HIT_COLUMNS = "doc_id source type start end raw checksum_valid confidence".split()
HIT_SQL = ' SELECT doc_id, source, type, start, "end", raw, checksum_valid, confidence'

# Rules of the det_custom and audit queries
CUSTOM_LAYER = {
    "custom_patterns": [
        {"type": "employee_id", "pattern": r"EMP-\d{1,6}", "confidence": 0.8},
        {
            "type": "custom_card",
            "pattern": r"ID-(?P<v>\d{16})",
            "checksum": "bank_card",
            "confidence": 0.9,
        },
        {"type": "badge", "pattern": r"[A-Z]{4}-\d{4}"},
    ]
}
CUSTOM_SEARCHES = [
    (6, O.Search("employee_id", "employee_id", "", r"EMP-\d{1,6}", "true", False, 0.8, "")),
    (7, O.Search("custom_card", "custom_card", "", r"\d{16}", O.card_ok("raw"), True, 0.9, "ID-")),
    (8, O.Search("badge", "badge", "", r"[A-Z]{4}-\d{4}", "true", False, 0.6, "")),
]


def only(*types: str) -> Rules:
    """The default rules with all other detectors off."""
    off = {t: {"enabled": False} for t in DETECTOR_TYPES if t not in types}
    return Rules.from_layers({"detectors": off})


def _detector(order: int, search: O.Search) -> None:
    oracle = O.hits(search.name) + HIT_SQL + " FROM hits"

    @query(f"det_{search.name}", oracle)
    def detector(spark, folder):
        found = H.scan(corpus(spark, folder), only(search.type), positions=False)
        return found.filter(f"ord = {order}").select(*HIT_COLUMNS)


for _order, _search in enumerate(O.SEARCHES):
    _detector(_order, _search)


@query(
    "det_custom",
    O.hits("phone", extra=CUSTOM_SEARCHES) + HIT_SQL + " FROM hits WHERE ord > 5",
)
def det_custom(spark, folder):
    rules = Rules.from_layers(
        CUSTOM_LAYER, {"detectors": {t: {"enabled": False} for t in DETECTOR_TYPES}}
    )
    return H.scan(corpus(spark, folder), rules, positions=False).select(*HIT_COLUMNS)


@query(
    "checksum_profile",
    f"""WITH v AS ({flipped_values_sql("customer")}),
    checks AS (
        SELECT 'id_card' AS kind, regexp_full_match(id_no, '\\d{{17}}[0-9Xx]') AS shaped,
            {O.id_card_ok("id_no")} AS ok FROM v
        UNION ALL SELECT 'luhn', regexp_full_match(phone, '\\d+'), {O.luhn_ok("phone")} FROM v
        UNION ALL SELECT 'bank_card', regexp_full_match(pan, '\\d{{13,19}}'), {O.luhn_ok("pan")} FROM v
        UNION ALL SELECT 'uscc', regexp_full_match(host, '[0-9A-HJ-NPQRTUWXY]{{18}}'), false FROM v)
    SELECT kind, count(*) FILTER (shaped AND ok) AS n_valid,
        count(*) FILTER (shaped AND NOT ok) AS n_invalid,
        count(*) FILTER (NOT shaped) AS n_other_shape FROM checks GROUP BY kind""",
)
def checksum_profile_query(spark, folder):
    kinds = {"id_no": "id_card", "phone": "luhn", "pan": "bank_card", "host": "uscc"}
    return checksum_profile(planted_values(spark, folder), kinds)


@query("detect_all", O.hits() + HIT_SQL + " FROM hits")
def detect_all(spark, folder):
    found = H.scan(corpus(spark, folder), Rules.default(), positions=False)
    return found.select(*HIT_COLUMNS)


@query(
    "filter_enabled", O.hits() + HIT_SQL + " FROM hits WHERE type NOT IN ('phone', 'uscc')"
)
def filter_enabled(spark, folder):
    off = {"detectors": {"phone": {"enabled": False}, "uscc": {"enabled": False}}}
    found = H.scan(corpus(spark, folder), Rules.default(), positions=False)
    return H.filter_enabled(found, Rules.from_layers(off)).select(*HIT_COLUMNS)


@query(
    "filter_confidence",
    O.hits()
    + HIT_SQL
    + """ FROM hits WHERE confidence >= CASE type WHEN 'phone' THEN 0.8
        WHEN 'uscc' THEN 0.98 ELSE 0.9 END""",
)
def filter_confidence(spark, folder):
    bar = {
        "min_confidence": 0.9,
        "detectors": {"phone": {"min_confidence": 0.8}, "uscc": {"min_confidence": 0.98}},
    }
    found = H.scan(corpus(spark, folder), Rules.default(), positions=False)
    return H.filter_confidence(found, Rules.from_layers(bar)).select(*HIT_COLUMNS)


_ALLOWED = ("db1", "62220200", ".7", "")


@query(
    "filter_allowlist",
    O.hits(where="true")
    + HIT_SQL
    + f" FROM hits WHERE {O.allowed_filter(O.DEFAULT_ALLOWLIST + _ALLOWED[:3])}",
)
def filter_allowlist(spark, folder):
    found = H.scan(corpus(spark, folder), _no_allowlist(), positions=False)
    rules = Rules.from_layers({"allowlist": list(_ALLOWED)})
    return H.filter_allowlist(found, rules).select(*HIT_COLUMNS)


def _no_allowlist() -> Rules:
    from dataclasses import replace

    return Rules.default().without("allowlist")


@query(
    "sort_hits",
    O.hits()
    + """ SELECT doc_id, source, type, start, "end", raw,
        CAST(row_number() OVER (PARTITION BY doc_id, source ORDER BY start, "end", ord) AS INTEGER)
        AS hit_no FROM hits""",
)
def sort_hits(spark, folder):
    found = H.scan(corpus(spark, folder), Rules.default(), positions=False)
    # hits dealt round-robin, so that the rows of a text are scattered and out of
    # order; hit_no is taken from the order sort_hits gives, not from scan's
    scattered = found.drop("hit_no").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return H.place_in_text(H.sort_hits(scattered)).select(
        "doc_id", "source", "type", "start", "end", "raw", "hit_no"
    )


_BEFORE = "substr(text, 1, start)"


@query(
    "scan_positions",
    O.hits()
    + f""" SELECT h.doc_id, h.source, type, raw, checksum_valid, confidence,
        CAST(length({_BEFORE}) - length(replace({_BEFORE}, chr(10), '')) + 1 AS INTEGER) AS line,
        CAST(length(string_split({_BEFORE}, chr(10))[-1]) + 1 AS INTEGER) AS col
    FROM hits AS h JOIN corpus AS c ON h.doc_id = c.doc_id AND h.source = c.source""",
)
def scan_positions(spark, folder):
    found = H.scan(corpus(spark, folder), Rules.default())
    return found.select(
        "doc_id", "source", "type", "raw", "checksum_valid", "confidence", "line", "col"
    )


@query(
    "scan_gate",
    O.hits()
    + """ SELECT source, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_hits,
        coalesce(sum(n), 0) = 0 AS clean
    FROM corpus LEFT JOIN (SELECT doc_id, source, count(*) AS n FROM hits GROUP BY ALL) AS h
        USING (doc_id, source) GROUP BY source""",
)
def scan_gate(spark, folder):
    return H.scan_gate(corpus(spark, folder), Rules.default())


@query(
    "scan_failed",
    O.hits()
    + """, per_source AS (SELECT source, coalesce(sum(n), 0) = 0 AS clean
    FROM corpus LEFT JOIN (SELECT doc_id, source, count(*) AS n FROM hits GROUP BY ALL) AS h
        USING (doc_id, source) GROUP BY source)
    SELECT bool_or(NOT clean) AS failed, count(*) AS n_sources,
        count(*) FILTER (clean) AS n_clean FROM per_source""",
)
def scan_failed(spark, folder):
    return H.scan_failed(H.scan_gate(corpus(spark, folder), Rules.default()))


@query(
    "scan_totals",
    O.hits() + " SELECT source, count(*) AS n_hits FROM hits GROUP BY ROLLUP (source)",
)
def scan_totals(spark, folder):
    return H.scan_totals(H.scan(corpus(spark, folder), Rules.default(), positions=False))


_LAYERS = {
    "detectors": (
        "layer int, type string, enabled boolean, min_confidence double, policy string",
        [
            (0, "id_card", True, None, None),
            (0, "phone", True, 0.5, None),
            (0, "bank_card", True, None, "mask"),
            (0, "uscc", True, None, None),
            (0, "intranet_domain", True, None, None),
            (1, "uscc", False, None, None),
            (1, "phone", None, 0.9, None),
            (1, "bank_card", None, 0.9, "block"),
            (1, "intranet_domain", None, 0.85, None),
        ],
    ),
    "scalars": (
        "layer int, key string, value string",
        [
            (0, "default_policy", "mask"),
            (0, "min_confidence", "0.5"),
            (1, "min_confidence", "0.95"),
            (1, "keep_prefix", "2"),
            (1, "mask_char", "#"),
        ],
    ),
    "allowlist": (
        "layer int, value string",
        [(0, "00000000000000000X"), (0, "example.internal"), (1, "db1"), (1, "")],
    ),
    "labels": ("layer int, type string, label string", [(0, "phone", "<tel>")]),
    "custom_patterns": (
        "layer int, type string, pattern string, checksum string, confidence double",
        [(1, "order", "ORD-[0-9]{4,10}", None, 0.97)],
    ),
}


def _values(name: str) -> str:
    def literal(v):
        if v is None:
            return "NULL"
        return f"'{v}'" if isinstance(v, str) else str(v).lower()

    rows = _LAYERS[name][1]
    return ", ".join(f"({', '.join(map(literal, r))})" for r in rows)


@query(
    "rules_apply_layers",
    O.hits(where="true")
    + f""", rule_rows(layer, type, enabled, min_confidence, policy) AS (
        VALUES {_values("detectors")}),
    scalars(layer, key, value) AS (VALUES {_values("scalars")}),
    allowed(layer, value) AS (VALUES {_values("allowlist")}),
    resolved AS (SELECT type, arg_max(enabled, layer) FILTER (enabled IS NOT NULL) AS enabled,
        arg_max(min_confidence, layer) FILTER (min_confidence IS NOT NULL) AS min_confidence,
        arg_max(policy, layer) FILTER (policy IS NOT NULL) AS policy FROM rule_rows GROUP BY type),
    every AS (
        SELECT doc_id, source, type, raw, confidence FROM hits UNION ALL
        SELECT o_orderkey, 'orders', 'order', 'ORD-' || (10000 + o_custkey), 0.97 FROM orders),
    kept AS (SELECT h.doc_id, h.source, h.type, h.raw, coalesce(r.policy,
        (SELECT arg_max(value, layer) FROM scalars WHERE key = 'default_policy')) AS policy
    FROM every AS h LEFT JOIN resolved AS r ON h.type = r.type
    WHERE coalesce(r.enabled, true) AND h.confidence >= coalesce(r.min_confidence,
        (SELECT CAST(arg_max(value, layer) AS DOUBLE) FROM scalars WHERE key = 'min_confidence'))
        AND NOT EXISTS (SELECT 1 FROM allowed AS a WHERE a.value <> '' AND contains(h.raw, a.value)))
    SELECT *, substr(raw, 1, 2) || regexp_replace(substr(raw, 3, length(raw) - 6), '[^ -]', '#', 'g')
        || substr(raw, length(raw) - 3) AS masked FROM kept""",
)
def rules_apply_layers(spark, folder):
    tables = {
        name: spark.createDataFrame(rows, schema) for name, (schema, rows) in _LAYERS.items()
    }
    settings = unpivoted(**tables)
    texts = corpus(spark, folder).select("doc_id", "source", "text")
    orders = spark.read.parquet(f"{folder}/orders.parquet").select(
        F.col("o_orderkey").cast("bigint").alias("doc_id"),
        F.lit("orders").alias("source"),
        F.concat(
            F.lit("ref ORD-"), 10000 + F.col("o_custkey"), F.lit(", "), "o_orderstatus"
        ).alias("text"),
    )
    custom = rules_of(settings.filter("path[0] = 'custom_patterns'"))
    found = H.scan(texts.unionByName(orders), custom, positions=False)
    kept = apply_layers(found, settings)
    return kept.select("doc_id", "source", "type", "raw", "policy", "masked")
