"""Patterns that only Python's re can run, on leaves of JSON bodies and nested columns."""

import json

from pyspark.sql import functions as F

from veilspark.operators.nested import redact_columns, redact_json_column, redact_payloads
from veilspark.rules import Rules

RULES = Rules.from_layers(
    {"custom_patterns": [{"type": "code", "pattern": r"(?:[A-Z]{2}-)+\d+"},
                         {"type": "ab", "pattern": r"(?:a|b)+c"}]}
)
LEAVES = ["x AB-CD-123 y", "plain", "abac and bbc", "", "EF-9", "AB-CD-123"]


def masked(redact, texts):
    return [r.text for r in redact(texts, RULES)]


def test_the_patterns_need_python():
    assert any(r.python_pattern is not None for _, r in RULES.recognizers())


def test_json_bodies(spark, redact):
    want = dict(zip(LEAVES, masked(redact, LEAVES), strict=True))
    body = json.dumps({"a": LEAVES, "b": {"c": LEAVES[0], "AB-CD-1": [LEAVES[2], 7]}})
    df = spark.createDataFrame([(1, body), (2, "not json AB-CD-123"), (3, None)], "i int, body string")
    rows = {r.i: r for r in redact_json_column(df, RULES).collect()}
    got = json.loads(rows[1].body)
    assert got["a"] == [want[t] for t in LEAVES]
    assert got["b"]["c"] == want[LEAVES[0]] and got["b"]["AB-CD-1"] == [want[LEAVES[2]], 7]
    assert {h.type for h in rows[1].redactions} == {"code", "ab"}
    assert rows[2].body == masked(redact, ["not json AB-CD-123"])[0]
    assert rows[3].body is None and rows[3].redactions == []


def test_payloads_by_content_type(spark, redact):
    body = json.dumps({"m": "AB-CD-123"})
    df = spark.createDataFrame(
        [(body, "application/json"), (body, "text/plain")], "body string, content_type string"
    )
    rows = redact_payloads(df, RULES).collect()
    assert json.loads(rows[0].body)["m"] == masked(redact, ["AB-CD-123"])[0]
    assert rows[1].body == masked(redact, [body])[0]
    assert rows[0].redactions and set(df.columns) <= set(rows[0].asDict())
    assert not any(c.startswith("_leaf") for c in rows[0].asDict())


def test_nested_columns(spark, redact):
    want = dict(zip(LEAVES, masked(redact, LEAVES), strict=True))
    schema = "s struct<a:string, n:array<string>>, m map<string,string>, t string, k long"
    rows = [((LEAVES[0], LEAVES), {"AB-CD-9": LEAVES[2]}, LEAVES[4], 1),
            (None, None, None, None), ((None, [None, LEAVES[5]]), {}, "", 2)]
    df = spark.createDataFrame(rows, schema)
    got = redact_columns(df, RULES, numbers="string").collect()
    assert got[0].s.a == want[LEAVES[0]] and got[0].s.n == [want[t] for t in LEAVES]
    assert got[0].m == {"AB-CD-9": want[LEAVES[2]]} and got[0].t == want[LEAVES[4]]
    assert got[1].s is None and got[1].redactions == []
    assert got[2].s.n == [None, want[LEAVES[5]]]
    assert {h.type for h in got[0].redactions} == {"code", "ab"}


def test_variant_leaves(spark, redact):
    want = masked(redact, [LEAVES[0]])[0]
    df = spark.createDataFrame([(json.dumps({"v": [LEAVES[0], 3]}),)], "j string")
    df = df.select(F.parse_json("j").alias("v"))
    [row] = redact_columns(df, RULES).collect()
    assert json.loads(row.v.toJson())["v"][0] == want


def test_all_patterns_share_one_python_step(spark):
    df = spark.createDataFrame([(1, '{"a": "AB-CD-1 abc"}')], "i int, body string")
    plan = redact_json_column(df, RULES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
