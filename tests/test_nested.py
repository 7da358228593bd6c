import json

import pytest
from pyspark.sql import functions as F

from veilspark.functions.numbers import float_text
from veilspark.operators.nested import (
    chat_requests,
    is_json,
    redact_chat,
    redact_columns,
    redact_json_column,
    redact_payloads,
)
from veilspark.rules import Rules

ID, MASKED = "110101199003078515", "1101**********8515"


def run(spark, bodies, rules=None):
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    rows = redact_json_column(df, rules or Rules.default()).collect()
    return [r for _, r in sorted((r.i, r) for r in rows)]


def test_json_leaves(spark):
    body = {
        "model": "demo",
        ID: [f'fix this: id_card = "{ID}"\n\t\\ é', True, None, {"deep": [[ID]]}],
        "id": int(ID),
        "max_tokens": 256,
        "flag": True,
        "rate": 0.5,
        "empty": {},
        "list": [],
    }
    want = {**body, "id": MASKED}
    want[ID] = json.loads(json.dumps(body[ID]).replace(ID, MASKED))
    for text in (
        json.dumps(body),
        json.dumps(body, ensure_ascii=False, separators=(",", ":")),
        json.dumps(body, indent=2),
    ):
        [row] = run(spark, [text])
        assert row.body == json.dumps(want, ensure_ascii=False)
        assert not row.blocked and len(row.redactions) == 3


def test_bodies_that_are_not_json_are_text(spark):
    bodies = [f"see {ID}", f'{{"a": "{ID}"', f'{{"a":1}} {ID}', "null", None, "", f'"{ID}"', ID]
    rows = run(spark, bodies)
    assert [r.body for r in rows] == [
        f"see {MASKED}",
        f'{{"a": "{MASKED}"',
        f'{{"a":1}} {MASKED}',
        "null",
        None,
        "",
        f'"{MASKED}"',
        f'"{MASKED}"',
    ]


def test_blocked_by_any_leaf(spark):
    rules = Rules.from_layers({"detectors": {"phone": {"policy": "block"}}})
    rows = run(spark, [f'{{"a":["{ID}",{{"b":13800138000}}]}}', f'{{"a":"{ID}"}}'], rules)
    assert [r.blocked for r in rows] == [True, False]


def test_float_text_is_the_shortest_decimal(spark):
    values = [
        13800138000.0, 0.0, -0.5, 1.5, 1e15, 123456789012345.6, 1e16, 1.25e22, 1e-4,
        0.00012345, 1e-5, 1.5e-7, 13800138000.25, 9007199254740993.0, 0.1 + 0.2, 1e300, 1e23, 2e-3, -1.5e16,
    ]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(F.expr(float_text("v"))).collect()]
    assert got == [repr(v) for v in values]


def test_numbers_written_as_floats(spark):
    rows = run(spark, ['{"a":13800138000.0,"b":1.38e10,"c":1e5,"d":1.50,"e":-13800138000,"f":1e400}'])
    leaves = rows[0].body
    assert leaves.startswith('{"a": "1380***8000.0", ')
    assert '"b": "1380***0000.0"' in leaves and '"c": 100000.0, "d": 1.5' in leaves
    assert '"e": "-1380***8000"' in leaves


def test_escapes(spark):
    """An escape may hide a digit; others are written in their plain form."""
    bodies = [
        r'{"a":"1380013800\u0030 \u4e2d\/ \n"}',
        r'["\u4e2d \"\/\\ \t","a\n13800138000\n","plain\n\"q\""]',
        r'["db01\n.corp","db01.corp\n","\\13800138000","\ud83d\ude00 13800138000"]',
    ]
    want = [
        '{"a": "1380***8000 中/ \\n"}',
        '["中 \\"/\\\\ \\t", "a\\n1380***8000\\n", "plain\\n\\"q\\""]',
        '["db01\\n.corp", "db01*corp\\n", "\\\\1380***8000", "😀 1380***8000"]',
    ]
    assert [r.body for r in run(spark, bodies)] == want
    assert [json.loads(w) for w in want]


def test_json_check(spark):
    bodies = ["{}", "[1]", "1", '"a"', "null", " null ", "{", '{"a":1}x', "1],[2", "x", ""]
    df = spark.createDataFrame([(b,) for b in bodies], "b string")
    got = [r[0] for r in df.select(F.expr(is_json("b"))).collect()]
    assert got == [True] * 4 + [False] * 7


def test_payloads_by_content_type(spark):
    rows = [
        ("application/json; charset=utf-8", f'{{"k":{ID}}}'),
        ("text/plain", f'{{"k":{ID}}}'),
        ("Application/JSON", f"x {ID}"),
        (None, f'{{"k":{ID}}}'),
    ]
    df = spark.createDataFrame(rows, "content_type string, body string")
    got = [r.body for r in redact_payloads(df, Rules.default()).collect()]
    as_text = f'{{"k":{MASKED}}}'
    assert got == [f'{{"k": "{MASKED}"}}', as_text, f"x {MASKED}", as_text]


def test_chat(spark):
    body = json.dumps(
        {
            "model": "demo",
            "messages": [
                {"role": "user", "content": f"fix {ID}"},
                {"role": "system", "content": "no pii here"},
            ],
            "max_tokens": 256,
        }
    )
    df = spark.createDataFrame([(body,)], "body string")
    row = redact_chat(df, Rules.default()).first()
    assert json.loads(row.body) == json.loads(body.replace(ID, MASKED))
    assert (len(row.redactions), row.blocked) == (1, False)


def test_chat_keeps_what_it_does_not_know(spark):
    bodies = [
        json.dumps(
            {
                "model": "m 13800138000",
                "system": f"s {ID}",
                "temperature": 0.5,
                "messages": [{"name": "n", "content": [{"type": "text", "text": f"x {ID}"}]}],
            }
        ),
        f'{{"model": "m", broken {ID}',
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    rules = Rules.from_layers({"detectors": {"id_card": {"policy": "block"}}})
    first, broken = redact_chat(df, rules).orderBy("i").collect()
    want = bodies[0].replace(ID, MASKED).replace("13800138000", "1380***8000")
    assert json.loads(first.body) == json.loads(want)
    assert (len(first.redactions), first.blocked) == (3, True)
    assert broken.body == bodies[1].replace(ID, MASKED) and broken.blocked


def test_requests_of_whole_conversations(spark):
    turns = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", None)]
    df = spark.createDataFrame(turns, "c int, t int, r string, x string")
    made = chat_requests(df, "c", "t", "r", "x", model="m").orderBy("c").collect()
    assert json.loads(made[0].body) == {
        "model": "m",
        "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}],
    }
    assert json.loads(made[1].body)["messages"] == [{"role": "user"}]


def test_variants_are_masked_and_masked_again(spark):
    df = spark.sql(
        f"""SELECT parse_json('{{"a": ["tel 13800138000", {ID}, true, null]}}') AS v,
            array(parse_json('1.5'), NULL) AS more, cast(NULL AS variant) AS nothing"""
    )
    once = redact_columns(df, Rules.default())
    row = once.selectExpr("to_json(v) AS v", "to_json(more[0]) AS m", "nothing", "redactions").first()
    assert json.loads(row.v) == {"a": ["tel 1380***8000", MASKED, True, None]}
    assert (row.m, row.nothing, len(row.redactions)) == ("1.5", None, 2)
    custom = Rules.from_layers({"custom_patterns": [{"type": "t", "pattern": "tel"}]})
    again = redact_columns(once.drop("redactions", "blocked"), custom)
    row = again.selectExpr("to_json(v) AS v", "redactions").first()
    assert [r.type for r in row.redactions] == ["t"]


@pytest.mark.parametrize("numbers", ["variant", "string"])
def test_columns(spark, numbers):
    df = spark.sql(
        f"""SELECT {ID}L AS id, 256 AS n, true AS flag, 'x {ID}' AS s, date'2020-01-01' AS d,
            13800138000.0D AS f, cast({ID} AS decimal(20, 0)) AS dec,
            array(named_struct('k', '{ID}', 'n', {ID}L, 'b', true), NULL) AS a,
            map('{ID}', 'y {ID}') AS m, cast(NULL AS string) AS nothing, array(true) AS bools"""
    )
    done = redact_columns(df, Rules.default(), numbers=numbers)
    if numbers == "variant":
        row = done.select(
            *[F.expr(f"schema_of_variant({c})").alias(f"t_{c}") for c in ("id", "n")],
            *[F.col(c).cast("string").alias(c) for c in ("id", "n", "f", "dec")],
            F.expr("cast(a[0].n AS string)").alias("an"),
        ).first()
        assert (row.t_id, row.t_n) == ("STRING", "BIGINT")
        assert (row.id, row.n, row.an) == (MASKED, "256", MASKED)
        assert (row.f, row.dec) == ("1380***8000.0", MASKED)
        return
    row = done.first()
    assert (row.id, row.n, row.flag, row.s) == (MASKED, "256", True, f"x {MASKED}")
    assert (row.f, row.dec, row.nothing, row.bools) == ("1380***8000.0", MASKED, None, [True])
    assert row.a == [(MASKED, MASKED, True), None] and row.m == {ID: f"y {MASKED}"}
    assert len(row.redactions) == 7 and not row.blocked


def test_json_of_any_size_and_depth(spark):
    long = '{"13800138000": "' + "x" * 25_000_000 + f' {ID}"' + "}"
    deep = "[" * 2000 + f'"{ID}", 1' + "]" * 2000
    twice = f'{{"k{ID}": 1, "k{ID}": "{ID}", "n": NaN}}'
    broken = [f'{{"{ID}": 1,}}', f'{{"a": [1 2], "{ID}": 1}}', f'{{"a": \x02, "{ID}": 3}}', f'[1}} {ID}']
    rows = run(spark, [long, deep, twice, *broken])
    assert rows[0].body.startswith('{"13800138000": "xxx') and rows[0].body.endswith(f' {MASKED}"}}')
    assert rows[1].body == deep.replace(ID, MASKED)
    assert rows[2].body == twice.replace(f'"{ID}"', f'"{MASKED}"')
    for row, body in zip(rows[3:], broken, strict=True):
        assert row.body == body.replace(ID, MASKED)  # text, keys as well


def test_custom_patterns_in_json(spark):
    rules = Rules.from_layers({"custom_patterns": [{"type": "t", "pattern": r"^EMP-\d+$"}]})
    [row] = run(spark, ['{"EMP-1": ["EMP-12", "x EMP-12", "a\\nEMP-12", "EMP-\\u0031"]}'], rules)
    assert json.loads(row.body) == {"EMP-1": ["EMP-*2", "x EMP-12", "a\nEMP-12", "EMP-*"]}
