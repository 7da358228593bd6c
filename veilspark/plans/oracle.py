"""The same results in plain SQL for DuckDB, written without the Spark kernel.

DuckDB's regular expressions have no look-around. So every character that may
stand next to a value is doubled first: two neighbouring values then need not
share one separator. Matches are put between marks, the doubling is undone, and
the pieces between the marks give values and offsets.
"""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.fixed_values import (
    DEFAULT_ALLOWLIST,
    ID_CARD_CHECK_CODES,
    ID_CARD_WEIGHTS,
    INTRANET_SUFFIXES,
    MASK_LABELS,
    TYPE_LABELS,
    USCC_ALPHABET,
    USCC_CLASS,
    USCC_WEIGHTS,
)
from .corpus import planted_sql


@dataclass(frozen=True)
class Search:
    name: str
    type: str
    beside: str  # the class a neighbour must not be in
    value: str  # over doubled text
    gate: str
    checked: bool
    confidence: float
    lead: str | None = None  # custom patterns: text before the value, no look-around


def _total(value: str, weights: tuple[int, ...], number: str) -> str:
    listed = ", ".join(map(str, weights))
    return (
        f"list_sum(list_transform(range(1, {len(weights) + 1}), "
        f"lambda i: ({number.format(c=f'substr({value}, CAST(i AS INTEGER), 1)')}) "
        f"* list_extract([{listed}], i)))"
    )


def id_card_ok(v: str) -> str:
    total = _total(v, ID_CARD_WEIGHTS, "CAST({c} AS INTEGER)")
    return (
        f"substr('{ID_CARD_CHECK_CODES}', CAST({total} % 11 AS INTEGER) + 1, 1)"
        f" = upper(substr({v}, 18, 1))"
    )


def luhn_ok(v: str) -> str:
    digit = f"CAST(substr(reverse({v}), CAST(i AS INTEGER), 1) AS INTEGER)"
    return (
        f"list_sum(list_transform(range(1, length({v}) + 1), lambda i: CASE WHEN i % 2 = 1 "
        f"THEN {digit} ELSE CAST(substr('0246813579', {digit} + 1, 1) AS INTEGER) END)) % 10 = 0"
    )


def card_ok(v: str) -> str:
    clean = f"replace(replace({v}, ' ', ''), '-', '')"
    return f"(length({clean}) BETWEEN 13 AND 19 AND {luhn_ok(clean)})"


def uscc_ok(v: str) -> str:
    number = f"instr('{USCC_ALPHABET}', {{c}}) - 1"
    total = _total(f"upper({v})", USCC_WEIGHTS, number)
    last = number.format(c=f"substr(upper({v}), 18, 1)")
    return f"({total} + {last}) % 31 = 0"


_ENDINGS = "|".join(s.replace(".", "\\.") for s in INTRANET_SUFFIXES)
# What the six kinds look like, in DuckDB's spelling.
SEARCHES = (
    Search("id_card", "id_card", "0-9A-Za-z", r"\d{17}[0-9Xx]", id_card_ok("raw"), True, 0.99),
    Search("phone", "phone", "0-9", r"1[3-9]\d{9}", "true", False, 0.8),
    Search(
        "bank_card",
        "bank_card",
        "0-9-",
        r"\d{13,19}|\d{4}(?:(?:  |-)\d{4}){2,4}(?:(?:  |-)\d{1,3})?",
        card_ok("raw"),
        True,
        0.9,
    ),
    Search(
        "uscc",
        "uscc",
        "0-9A-Za-z",
        USCC_CLASS + r"{2}\d{6}" + USCC_CLASS + "{10}",
        uscc_ok("raw"),
        True,
        0.97,
    ),
    Search(
        "private_ip",
        "intranet_domain",
        "0-9.",
        r"10\.\d{1,3}\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3}"
        r"|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}|127\.\d{1,3}\.\d{1,3}\.\d{1,3}",
        "list_max(list_transform(string_split(raw, '.'), lambda o: CAST(o AS INTEGER))) <= 255",
        False,
        0.9,
    ),
    Search(
        "intranet_host",
        "intranet_domain",
        r"\p{L}\p{N}_.-",
        r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,}",
        f"regexp_matches(lower(raw), '(?:{_ENDINGS})$')",
        False,
        0.85,
    ),
)
NAMES = tuple(s.name for s in SEARCHES)


def corpus_cte() -> str:
    return f"""corpus AS (
        SELECT doc_id, source, text FROM documents
        UNION ALL SELECT doc_id, source, text FROM ({planted_sql("customer")}) AS planted)"""


def search_ctes(
    searches: list[tuple[int, Search]], texts: str = "corpus", prefix: str = ""
) -> str:
    """CTEs ending in ``{prefix}found``: all gated hits of the texts."""
    ctes, parts = [], []
    for order, s in searches:
        n = f"{prefix}s{order}"
        b = s.beside
        if s.lead is not None:
            ctes.append(f"""{n}_marked AS (
        SELECT doc_id, source, ' ' || regexp_replace(text, '{s.lead}({s.value})',
            '{s.lead}' || chr(1) || '\\1' || chr(2), 'g') AS m FROM {texts})""")
        else:
            ctes.append(f"""{n}_marked AS (
        SELECT doc_id, source, regexp_replace(regexp_replace(
            regexp_replace(' ' || text || ' ', '([^{b}])', '\\1\\1', 'g'),
            '([^{b}])({s.value})([^{b}])', '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g'),
            '([^\\x01\\x02{b}])[^\\x01\\x02{b}]', '\\1', 'g') AS m FROM {texts})""")
        ctes.append(f"""{n}_pieces AS (
        SELECT doc_id, source, unnest(string_split(m, chr(1))) AS piece,
            generate_subscripts(string_split(m, chr(1)), 1) AS i
        FROM {n}_marked WHERE contains(m, chr(1)))""")
        ctes.append(f"""{n}_placed AS (
        SELECT doc_id, source, i, string_split(piece, chr(2))[1] AS raw,
            CAST(sum(length(piece)) OVER (PARTITION BY doc_id, source ORDER BY i
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - (i - 2) - 1 AS INTEGER) AS start
        FROM {n}_pieces)""")
        parts.append(f"""SELECT doc_id, source, start, CAST(start + length(raw) AS INTEGER) AS "end",
            {order} AS ord, '{s.type}' AS type, raw, {str(s.checked).lower()} AS checksum_valid,
            CAST({s.confidence} AS DOUBLE) AS confidence
        FROM {n}_placed WHERE i > 1 AND {s.gate}""")
    return ",\n".join(ctes) + f",\n{prefix}found AS (" + "\nUNION ALL ".join(parts) + ")"


def built_in(*names: str) -> list[tuple[int, Search]]:
    return [
        (order, s) for order, s in enumerate(SEARCHES) if not names or s.name in names
    ]


def allowed_filter(entries: tuple[str, ...] = DEFAULT_ALLOWLIST) -> str:
    return " AND ".join(f"NOT contains(raw, '{e}')" for e in entries) or "true"


def hits(
    *names: str,
    texts: str | None = None,
    where: str = "",
    extra: list[tuple[int, Search]] = (),
) -> str:
    """CTEs ``corpus`` and ``hits`` (allowlist applied)."""
    head = texts or corpus_cte()
    body = search_ctes([*built_in(*names), *extra])
    where = where or allowed_filter()
    return f"WITH {head},\n{body},\nhits AS (SELECT * FROM found WHERE {where})"


def case(key: str, table: dict[str, str], fallback: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {key} {whens} ELSE {fallback} END"


def type_label(key: str) -> str:
    return case(key, TYPE_LABELS, key)


def mask(style: str, raw: str = "raw", type_: str = "type", keep: int = 4) -> str:
    full = "regexp_replace({}, '[^ -]', '*', 'g')"
    if style == "full":
        return full.format(raw)
    if style == "label":
        return case(type_, MASK_LABELS, f"'[' || {type_} || '-REDACTED]'")
    n = f"CAST(length({raw}) AS INTEGER)"
    head = f"least({keep}, greatest({n} - 1, 0))"
    tail = f"least({keep}, greatest({n} - 1 - {head}, 0))"
    middle = full.format(f"substr({raw}, {head} + 1, {n} - {head} - {tail})")
    return f"(substr({raw}, 1, {head}) || {middle} || substr({raw}, {n} - {tail} + 1, {tail}))"


def redactions(style: str = "partial", policy: str = "'mask'") -> str:
    """CTE after ``hits``: deduplicated, masked hits in claiming order."""
    return f""",
redactions AS (
    SELECT *, {mask(style)} AS masked, {policy} AS policy,
        CAST(row_number() OVER (PARTITION BY doc_id, source ORDER BY start, "end" DESC) AS INTEGER)
            AS redaction_no
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, source, start, "end"
            ORDER BY confidence DESC, ord) AS best FROM hits) AS ranked WHERE best = 1)"""


def spliced(style: str = "partial") -> str:
    """CTE after ``redactions``: ``masked_text(doc_id, source, text, n, blocked)``."""
    left = (
        "substr(masked, greatest(taken - start, 0) + 1)"
        if style != "label"
        else "CASE WHEN taken <= start THEN masked ELSE '' END"
    )
    return f""",
reach AS (
    SELECT *, coalesce(max("end") OVER (PARTITION BY doc_id, source ORDER BY redaction_no
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM redactions),
joined AS (
    SELECT c.doc_id, c.source, max(r."end") AS last, count(*) AS n,
        bool_or(r.policy = 'block') AS blocked,
        string_agg(CASE WHEN start > taken THEN substr(c.text, taken + 1, start - taken) ELSE '' END
            || {left}, '' ORDER BY redaction_no) AS front
    FROM corpus AS c JOIN reach AS r ON c.doc_id = r.doc_id AND c.source = r.source
    GROUP BY c.doc_id, c.source),
masked_text AS (
    SELECT c.doc_id, c.source, c.text AS before,
        CASE WHEN j.doc_id IS NULL THEN c.text ELSE front || substr(c.text, last + 1) END AS text,
        CAST(coalesce(n, 0) AS INTEGER) AS n_redactions, coalesce(blocked, false) AS blocked
    FROM corpus AS c LEFT JOIN joined AS j ON c.doc_id = j.doc_id AND c.source = j.source)"""
