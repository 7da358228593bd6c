"""Texts with known personal data, derived from the given tables.

The given tables hold card numbers and public hosts but no Chinese ids, phones,
credit codes or internal hosts. So values of every kind are computed from the
keys of ``customer`` by plain SQL that Spark and DuckDB read alike; every third
row carries a wrong check digit. They are joined by the real ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.fixed_values import (
    ID_CARD_CHECK_CODES,
    ID_CARD_WEIGHTS,
    USCC_ALPHABET,
    USCC_WEIGHTS,
)
from ..sources.readers import read_table, spread
from ..sources.sinks import scratch_folder

PLANTED_FROM = 1_000_000_000


def _padded(number: str, width: int) -> str:
    return f"lpad(cast({number} AS string), {width}, '0')"


def _digit(value: str, at: int) -> str:
    return f"cast(substr({value}, {at}, 1) AS int)"


def _id_check(body: str) -> str:
    total = " + ".join(
        f"{_digit(body, i)} * {w}" for i, w in enumerate(ID_CARD_WEIGHTS, 1)
    )
    return f"substr('{ID_CARD_CHECK_CODES}', cast(({total}) % 11 AS int) + 1, 1)"


def _luhn_check(body: str, length: int) -> str:
    """Luhn check digit; a doubled digit is read off a table of its digit sums."""
    terms = []
    for i in range(1, length + 1):
        if (length - i) % 2 == 0:
            terms.append(f"cast(substr('0246813579', {_digit(body, i)} + 1, 1) AS int)")
        else:
            terms.append(_digit(body, i))
    return f"cast((10 - ({' + '.join(terms)}) % 10) % 10 AS string)"


def _uscc_check(body: str) -> str:
    total = " + ".join(
        f"(instr('{USCC_ALPHABET}', substr({body}, {i}, 1)) - 1) * {w}"
        for i, w in enumerate(USCC_WEIGHTS, 1)
    )
    return f"substr('{USCC_ALPHABET}', cast((31 - ({total}) % 31) % 31 AS int) + 1, 1)"


def _alphabet_char(number: str) -> str:
    return f"substr('{USCC_ALPHABET}', cast(({number}) % 31 AS int) + 1, 1)"


def values_sql(customer: str) -> str:
    """One row per customer with a value of every kind."""
    return f"""
SELECT k, id_body || {_id_check("id_body")} AS id_no,
    '1' || cast(3 + k % 7 AS string) || {_padded("k * 7919 % 1000000000", 9)} AS phone,
    pan_body || {_luhn_check("pan_body", 15)} AS pan,
    uscc_body || {_uscc_check("uscc_body")} AS uscc,
    'db' || cast(k % 97 AS string) || '.corp' AS host,
    '10.' || cast(k % 256 AS string) || '.' || cast(k % 300 AS string) || '.7' AS ip
FROM (
    SELECT c_custkey AS k,
        substr('110101310101440300510102', cast(k4 * 6 AS int) + 1, 6) || '19'
            || {_padded("70 + c_custkey % 30", 2)} || {_padded("1 + c_custkey % 12", 2)}
            || {_padded("1 + c_custkey % 28", 2)} || {_padded("c_custkey % 1000", 3)}
            AS id_body,
        '622202' || {_padded("c_custkey * 104729 % 1000000000", 9)} AS pan_body,
        '91' || {_padded("110000 + c_custkey % 9000", 6)}
            || {" || ".join(_alphabet_char(f"c_custkey * {m} + {m}") for m in (1, 3, 5, 7, 11, 13, 17, 19, 23))}
            AS uscc_body
    FROM (SELECT c_custkey, c_custkey % 4 AS k4 FROM {customer}) AS keyed
) AS bodies"""


def _flipped(value: str, length: int) -> str:
    """The value with its last character moved on by one, every third row."""
    last = f"substr({value}, {length}, 1)"
    other = f"substr('1234567890', instr('0123456789', {last}), 1)"
    wrong = (
        f"substr({value}, 1, {length - 1}) || "
        f"CASE WHEN instr('0123456789', {last}) > 0 THEN {other} ELSE '0' END"
    )
    return f"CASE WHEN k % 3 = 2 THEN {wrong} ELSE {value} END"


def flipped_values_sql(customer: str) -> str:
    """The values with every third row's check digits wrong."""
    return f"""
SELECT k, {_flipped("id_no", 18)} AS id_no, phone, {_flipped("pan", 16)} AS pan,
    {_flipped("uscc", 18)} AS uscc, host, ip
FROM ({values_sql(customer)}) AS v"""


def planted_sql(customer: str) -> str:
    """Texts of several lines around the values; layouts vary with the key."""
    nl = "chr(10)"
    spaced = (
        "substr(pan, 1, 4) || ' ' || substr(pan, 5, 4) || ' ' || "
        "substr(pan, 9, 4) || ' ' || substr(pan, 13, 4)"
    )
    return f"""
SELECT {PLANTED_FROM} + k AS doc_id, 'planted/' || cast(k % 7 AS string) AS source,
    CASE WHEN k % 4 = 0 THEN
        '客户 ' || cast(k AS string) || {nl} || 'id_card = "' || id_no || '", phone: ' || phone
        || {nl} || 'card=' || pan || ';host=' || host || {nl}
    WHEN k % 4 = 1 THEN
        'uscc "' || uscc || '"' || {nl} || 'card ' || {spaced} || ' end' || {nl} || {nl}
        || 'ip ' || ip || ', allowed.example.internal and api.example.com'
    WHEN k % 4 = 2 THEN
        phone || '.internal or +86' || phone || ' 号' || phone || '号' || {nl}
        || 'ref EMP-' || cast(k % 1000000 AS string) || ' badge ID-' || pan || ' for ABCD-'
        || {_padded("k % 10000", 4)} || ' ' || id_no
    ELSE
        'two: ' || phone || ' ' || phone || {nl} || host || ' ' || ip || {nl}
        || uscc || ' / ' || id_no || {nl} || '主机db01.corp 10.1.2.3. x' || id_no
    END AS text
FROM ({flipped_values_sql(customer)}) AS f"""


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, source, text``: the real documents and the planted texts."""
    documents = read_table(
        spark, f"{folder}/documents.parquet", ["doc_id", "source", "text"], small=True
    )
    return documents.unionByName(planted(spark, folder))


_staged: dict[tuple[str, str], str] = {}


def planted(spark: SparkSession, folder: str) -> DataFrame:
    """The planted texts, written out once per session: a text put together from
    dozens of expressions would be computed anew for every expression on it."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _staged:
        customer = read_table(
        spark, f"{folder}/customer.parquet", ["c_custkey"], small=True
    )
        path = scratch_folder(spark, "planted")
        spark.sql(planted_sql("{customer}"), customer=customer).write.parquet(path)
        _staged[key] = path
    return spread(spark.read.parquet(_staged[key]))


def planted_values(spark: SparkSession, folder: str) -> DataFrame:
    """The single values, wrong check digits included."""
    customer = read_table(
        spark, f"{folder}/customer.parquet", ["c_custkey"], small=True
    )
    return spark.sql(flipped_values_sql("{customer}"), customer=customer)
