import pytest
from pyspark.sql import functions as F

from veilspark.functions.masking import mask_value, masked_preview
from veilspark.operators.hits import scan
from veilspark.operators.redaction import (
    counts_by_type,
    mask_summary,
    redact_given_hits,
    redact_text,
    released,
)
from veilspark.rules import Rules
from veilspark.sources.sinks import write_masked, write_routed

SNIPPET = (
    "def settle(amount):\n    fee = amount * 60 // 10000\n"
    '    customer = {"id_card": "110101199003078515", "phone": "13800138000"}\n'
    '    order_id = "110101199003078500"  # plain counter\n    return amount - fee\n'
)


def masked(spark, raw, type_, **masking):
    rules = Rules.from_layers({"masking": masking})
    df = spark.createDataFrame([(raw, type_)], "raw string, type string")
    return df.select(F.expr(mask_value("raw", "type", rules))).first()[0]


def test_masks(spark):
    assert masked(spark, "110101199003078515", "id_card") == "1101**********8515"
    assert masked(spark, "6222 0210 0011 2230", "bank_card") == "6222 **** **** 2230"
    assert masked(spark, "12345", "phone") == "1234*"
    assert masked(spark, "12345678", "phone") == "1234*678"
    assert masked(spark, "1", "x") == "*"
    assert masked(spark, "10.0.0.5", "intranet_domain") == "10.0*0.5"
    assert masked(spark, "13800138000", "phone", style="full") == "*" * 11
    assert masked(spark, "ab cd-e", "x", style="full", mask_char="$\\") == "$\\$\\ $\\$\\-$\\"
    assert masked(spark, "ab😀d", "x", style="full") == "****"
    assert masked(spark, "x", "id_card", style="label") == "[身份证-已脱敏]"
    assert masked(spark, "x", "badge", style="label") == "[badge-REDACTED]"
    assert masked(spark, "123456", "x", keep_prefix=0, keep_suffix=2) == "****56"
    assert masked(spark, "123456", "x", keep_prefix=0, keep_suffix=9) == "*23456"


def test_preview_is_cut_to_64(spark):
    df = spark.createDataFrame([("*" * 64,), ("*" * 65,)], "m string")
    got = [r[0] for r in df.select(F.expr(masked_preview("m"))).collect()]
    assert got == ["*" * 64, "*" * 63 + "…"]


def test_only_the_values_change(redact):
    [row, clean] = redact([SNIPPET, "no pii here\n"])
    want = SNIPPET.replace("110101199003078515", "1101**********8515")
    assert row.text == want.replace("13800138000", "1380***8000")
    assert [r.type for r in row.redactions] == ["id_card", "phone"]
    assert (row.n_redactions, row.changed, row.blocked, row.original_len) == (2, True, False, len(SNIPPET))
    assert (clean.text, clean.n_redactions, clean.changed) == ("no pii here\n", 0, False)


def test_overlap(redact):
    """The host starts where the phone does and is longer, so it owns the span."""
    text = "13800138000.internal end"
    [row] = redact([text])
    assert row.text == "1380************rnal end"
    assert [r.type for r in row.redactions] == ["intranet_domain", "phone"]
    [row] = redact([text], Rules.default().with_style("label"))
    assert row.text == "[内网域名-已脱敏] end"
    crossing = Rules.from_layers(
        {"custom_patterns": [{"type": "t", "pattern": "000 [a-z]+"}]}
    )
    # the tail of the later hit's own mask: "000 abc" is masked as "000 *bc"
    [row] = redact(["x 13800138000 abc y"], crossing)
    assert row.text == "x 1380***8000 *bc y"
    [row] = redact(["x 13800138000 abc y"], crossing.with_style("full"))
    assert row.text == "x *********** *** y"
    [row] = redact(["x 13800138000 abc y"], crossing.with_style("label"))
    assert row.text == "x [手机号-已脱敏] y"


def test_policy(spark, redact):
    [row] = redact([SNIPPET], Rules.default().with_default_policy("block"))
    assert row.blocked and {r.policy for r in row.redactions} == {"block"}
    mixed = Rules.from_layers({"detectors": {"phone": {"policy": "block"}}})
    rows = redact([SNIPPET, "110101199003078515"], mixed)
    assert [r.blocked for r in rows] == [True, False]
    assert [r.policy for r in rows[0].redactions] == ["mask", "block"]


def test_blocked_rows_are_not_released(spark, tmp_path):
    rules = Rules.from_layers({"detectors": {"phone": {"policy": "block"}}})
    df = spark.createDataFrame(
        [(1, SNIPPET), (2, "110101199003078515"), (3, None)], "doc_id int, text string"
    )
    done = redact_text(df, rules)
    assert sorted(r.doc_id for r in released(done).collect()) == [2, 3]
    write_routed(done, str(tmp_path / "routed"))
    routes = spark.read.parquet(str(tmp_path / "routed")).collect()
    assert {r.doc_id: r.route for r in routes} == {1: "quarantine", 2: "output", 3: "output"}


def test_given_hits_keep_their_positions(spark):
    df = spark.createDataFrame(
        [(1, "s", SNIPPET), (2, "s", "none")], "doc_id int, source string, text string"
    )
    rules = Rules.default()
    hits = scan(df, rules)
    doubled = hits.unionByName(hits)  # duplicates count once
    direct = {r.doc_id: r for r in redact_text(df, rules).collect()}
    given = {r.doc_id: r for r in redact_given_hits(df, doubled, rules).collect()}
    assert {k: r.text for k, r in given.items()} == {k: r.text for k, r in direct.items()}
    assert [(r.line, r.col) for r in given[1].redactions] == [(3, 29), (3, 60)]


def test_given_hits_of_any_shape(spark):
    texts = spark.createDataFrame([(1, "call 13800138000 now"), (2, "x")], "doc_id int, text string")
    hits = spark.createDataFrame(
        [(1, "phone", 5, 16), (1, "phone", -3, 2), (2, "t", 0, 99), (2, "t", 5, 9)],
        "doc_id int, type string, start int, end int",
    )
    done = {r.doc_id: r for r in redact_given_hits(texts, hits, Rules.default()).collect()}
    assert done[1].text == "c*ll 1380***8000 now" and done[2].text == "*"
    assert [(r.start, r.end, r.raw) for r in done[1].redactions] == [
        (0, 2, "ca"),
        (5, 16, "13800138000"),
    ]
    assert [(r.start, r.end, r.raw) for r in done[2].redactions] == [(0, 1, "x")]


@pytest.mark.parametrize("bits", [8, 1 << 23])
def test_given_hits_through_a_filter_of_any_size(spark, bits):
    from veilspark.operators.redaction import _flag_keys

    rows = [(i, None if i == 7 else f"call 1380013{i:04d} now") for i in range(300)]
    texts = spark.createDataFrame(rows + [(None, "13800138000")], "doc_id int, text string")
    hits = scan(texts.filter("doc_id % 3 = 0"), Rules.default(), keys=["doc_id"]).unionByName(
        spark.createDataFrame([(9999, "phone", 0, 3)], "doc_id int, type string, start int, end int"),
        allowMissingColumns=True,
    )
    got = {r.doc_id: r.text for r in redact_given_hits(texts, hits, Rules.default(), bits=bits).collect()}
    want = {r.doc_id: r.text for r in redact_text(texts, Rules.default()).collect()}
    assert len(got) == 301
    assert {k: v for k, v in got.items() if k is not None and k % 3 == 0} == {
        k: v for k, v in want.items() if k is not None and k % 3 == 0
    }
    assert all(got[k] == t for k, t in rows if k % 3) and got[None] == "13800138000"
    flags = {r.doc_id: r._maybe_hits for r in _flag_keys(texts, hits.select("doc_id"), ["doc_id"], bits).collect()}
    assert all(flags[k] for k in range(0, 300, 3))
    if bits > 8:
        assert sum(flags[k] for k in range(300) if k % 3) <= 2


def test_texts_without_hits_are_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "texts")
    rows = [(i, f"tel 1391234{i:04d}") for i in range(200)]
    spark.createDataFrame(rows, "doc_id int, text string").write.parquet(path)
    texts = spark.read.parquet(path)
    hits = scan(texts.filter("doc_id < 5"), Rules.default(), keys=["doc_id"])
    settings = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k) for k in settings}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # lists are not broadcast
    try:
        done = redact_given_hits(texts, hits, Rules.default())
        plan = done._jdf.queryExecution().executedPlan()
        assert done.filter("n_redactions > 0").count() == 5
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)

    def nodes(node):
        yield node
        for i in range(node.children().size()):
            yield from nodes(node.children().apply(i))

    [union] = [n for n in nodes(plan) if n.nodeName() == "Union"]
    clear = [c for c in (union.children().apply(i) for i in range(2)) if "NOT coalesce" in c.toString()]
    names = [n.nodeName() for n in nodes(clear[0])]
    assert any(n.startswith("Scan parquet") for n in names)
    assert "Exchange" not in names and "Sort" not in names


def test_no_sink_writes_raw_values(spark, tmp_path):
    df = spark.createDataFrame([(1, SNIPPET), (2, "tel 13912345678")], "doc_id int, text string")
    rules = Rules.from_layers({"detectors": {"id_card": {"policy": "block"}}})
    done = redact_text(df, rules)
    write_routed(done, str(tmp_path / "routed"))
    write_masked(done, str(tmp_path / "masked"), ["doc_id", "text", "redactions"])
    for folder in ("routed", "masked"):
        rows = spark.read.parquet(str(tmp_path / folder)).select(F.to_json(F.struct("*"))).collect()
        written = " ".join(r[0] for r in rows)
        assert rows and '"type":"phone"' in written
        for raw in ("110101199003078515", "13800138000", "13912345678"):
            assert raw not in written


def test_counts(spark):
    df = spark.createDataFrame(
        [(1, SNIPPET + " 13912345678"), (2, "10.0.0.1")], "doc_id int, text string"
    )
    done = redact_text(df, Rules.default())
    assert {(r.doc_id, r.type): r.n for r in counts_by_type(done).collect()} == {
        (1, "id_card"): 1,
        (1, "phone"): 2,
        (2, "intranet_domain"): 1,
    }
    assert [tuple(r) for r in mask_summary(done).select("type", "n", "label").collect()] == [
        ("phone", 2, "手机号"),
        ("id_card", 1, "身份证"),
        ("intranet_domain", 1, "内网域名"),
    ]


def test_full_mask_leaves_no_numeric_value(spark, detect, redact):
    rows = redact([SNIPPET, "a 6222 0210 0011 2230 b"], Rules.default().with_style("full"))
    assert detect([r.text for r in rows]) == [[], []]
