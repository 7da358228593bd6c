"""What the plans must look like: no shuffle on the way from text to masked text,
nothing evaluated twice, only the needed columns read."""

import pytest

from veilspark.operators.audit import audit_entries
from veilspark.operators.hits import scan, scan_gate
from veilspark.operators.redaction import counts_by_type, redact_text, released, with_route
from veilspark.rules import Rules

RULES = Rules.from_layers({"detectors": {"phone": {"policy": "block"}}})
ONE_PATTERN = "10X98765432"  # stands once in every evaluation of a detection


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "t")
    rows = [(1, "s", "tel 13800138000", "unused")]
    spark.createDataFrame(rows, "doc_id int, source string, text string, other string").write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "build",
    [
        lambda t: redact_text(t, RULES),
        lambda t: released(redact_text(t, RULES)),
        lambda t: with_route(redact_text(t, RULES)),
        lambda t: audit_entries(redact_text(t, RULES), ts="t"),
        lambda t: counts_by_type(redact_text(t, RULES)),
        lambda t: scan(t, RULES),
    ],
)
def test_narrow_and_evaluated_once(table, build):
    text = plan(build(table))
    assert "Exchange" not in text
    assert text.count(ONE_PATTERN) == 1


def test_gate_shuffles_partial_sums_of_needed_columns(table):
    text = plan(scan_gate(table, RULES))
    assert "partial_sum" in text and text.count("Exchange") == 1
    assert "ReadSchema: struct<source:string,text:string>" in text


def test_disabled_types_are_not_in_the_plan(table):
    off = Rules.from_layers({"detectors": {"id_card": {"enabled": False}}})
    assert ONE_PATTERN not in plan(redact_text(table, off))


def test_sorted_hits_keep_their_layout(spark, tmp_path):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from veilspark.operators.hits import place_in_text, sort_hits, write_sorted_hits

    rows = [(d, "s", 100 - i, 101 - i, i % 3) for d in range(7) for i in range(30)]
    hits = spark.createDataFrame(rows, "doc_id int, source string, start int, end int, ord int")
    placed = place_in_text(sort_hits(hits.repartition(5)))
    got = {(r.doc_id, r.start, r.end, r.ord): r.hit_no for r in placed.collect()}
    # places follow (start, end, ord) within a text, 1 to the number of its rows
    for d in range(7):
        mine = sorted((k for k in got if k[0] == d), key=lambda k: got[k])
        assert [k[1:] for k in mine] == sorted(k[1:] for k in mine)
        assert [got[k] for k in mine] == list(range(1, len(mine) + 1))
    before = sort_hits(hits.repartition(5))._jdf.queryExecution().executedPlan().toString()
    fresh = place_in_text(sort_hits(hits.repartition(5)))
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == before.count("Exchange")
    table = f"hits_{abs(hash(str(tmp_path))) % 10**8}"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        write_sorted_hits(hits, table, 4)
        read = spark.table(table)
        ranked = read.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "source").orderBy("start")))
        assert "Exchange" not in ranked._jdf.queryExecution().executedPlan().toString()
        assert ranked.count() == len(rows)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
