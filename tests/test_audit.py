import json

import pytest
from pyspark.sql import functions as F

from veilspark.operators.audit import (
    FIELDS,
    audit_entries,
    audit_json,
    leaks,
    record_parts,
    report_by_action,
    report_by_type,
    report_totals,
)
from veilspark.operators.hits import scan
from veilspark.operators.layered_rules import (
    SETTINGS_SCHEMA,
    apply_layers,
    rules_of,
    settings_table,
    with_defaults,
)
from veilspark.operators.redaction import redact_text
from veilspark.rules import Rules
from veilspark.sources import readers, sinks

TS = "2026-01-01T00:00:00+00:00"
ROWS = [
    (1, "a.py", "110101199003078515 13800138000"),
    (2, "a.py", "中 13912345678"),
    (3, "b.py", "nothing"),
]
SCHEMA = "doc_id int, source string, text string"


def redacted(spark, rules=None):
    return redact_text(spark.createDataFrame(ROWS, SCHEMA), rules or Rules.default())


def test_entries_hold_no_raw_value(spark):
    entries = audit_entries(redacted(spark), ts=TS)
    lines = [r[0] for r in entries.select(audit_json()).collect()]
    assert len(lines) == 3
    for line in lines:
        assert list(json.loads(line)) == FIELDS and " " not in line
        assert not any(v in line for v in ("110101199003078515", "13800138000", "13912345678"))
    first = json.loads(next(x for x in lines if "id_card" in x))
    assert first == {
        "schema": 1, "ts": TS, "type": "id_card", "action": "mask", "checksum_valid": True,
        "file": "a.py", "line": None, "col": None, "rule_id": "id_card",
        "masked_preview": "1101**********8515",
    }


def test_time_is_utc_to_the_second(spark):
    [ts] = {r.ts for r in audit_entries(redacted(spark)).select("ts").collect()}
    assert len(ts) == 25 and ts.endswith("+00:00") and ts[10] == "T"


def test_log_round_trip_and_reports(spark, tmp_path):
    path = str(tmp_path / "audit")
    rules = Rules.from_layers({"detectors": {"id_card": {"policy": "block"}}})
    entries = audit_entries(redacted(spark, rules), ts=TS)
    sinks.write_audit_log(entries, path)
    sinks.write_audit_log(entries, path)  # appends
    log = readers.read_audit_log(spark, path)
    assert sorted(map(tuple, log.collect()), key=str) == sorted(
        [tuple(r) for r in entries.collect()] * 2, key=str
    )
    assert [tuple(r) for r in report_by_type(log).select("type", "n", "label").collect()] == [
        ("phone", 4, "手机号"),
        ("id_card", 2, "身份证"),
    ]
    assert [tuple(r) for r in report_by_action(log).collect()] == [("block", 2), ("mask", 4)]
    assert tuple(report_totals(log).first()) == (6, 1)
    assert tuple(report_totals(log.limit(0)).first()) == (0, 0)


def test_bad_lines_are_skipped(spark, tmp_path):
    good = '{"schema":1,"type":"id_card","action":"mask","file":"f"}'
    (tmp_path / "audit.jsonl").write_text(
        f"{good}\nNOT JSON HERE\n{good}\n   \n[1]\n\t {good[:-1]},\"extra\":[1]}}  \n{{\"a\":1}} x\n",
        encoding="utf-8",
    )
    rows = readers.read_audit_log(spark, str(tmp_path)).collect()
    assert len(rows) == 3 and {r.type for r in rows} == {"id_card"}
    assert {r.rule_id for r in rows} == {"id_card"}


def test_leaks_are_found(spark):
    layer = {"custom_patterns": [{"type": "badge", "pattern": r"[A-Z]{4}-\d{4}"}]}
    rules = Rules.from_layers(layer)
    df = spark.createDataFrame(
        [(1, "a", "ABCD-1234 13800138000"), (2, "see 13800138000", "13912345678")], SCHEMA
    )
    entries = audit_entries(
        redact_text(df, rules), ts=TS, keys=["doc_id"], keep_raw=True
    )
    got = {r.type: tuple(r)[1:] for r in leaks(entries).collect()}
    # the badge's only masked character is a dash; a source label holds a phone
    assert got == {"badge": (1, 1, 1), "phone": (2, 0, 1)}


def test_hits_json_has_no_raw(spark, tmp_path):
    path = str(tmp_path / "hits")
    sinks.write_hits_json(scan(spark.createDataFrame(ROWS, SCHEMA), Rules.default()), path)
    rows = [json.loads(r[0]) for r in spark.read.text(path).collect()]
    assert len(rows) == 3 and "raw" not in rows[0]
    assert list(rows[0]) == "file type line col checksum_valid confidence".split()


def test_whole_files_with_bad_bytes(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "x.py").write_bytes(b'id = "110101199003078515"\r\n\xff\xfe 10.0.0.1\n')
    (tmp_path / "b" / "y.py").write_text("clean\n", encoding="utf-8")
    files = readers.read_text_files(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    hits = scan(files, Rules.default(), keys=["source"]).orderBy("hit_no").collect()
    assert [(h.type, h.line, h.col) for h in hits] == [("id_card", 1, 7), ("intranet_domain", 2, 4)]
    assert files.count() == 2


LAYER = {
    "min_confidence": 0.95,
    "default_policy": "block",
    "detectors": {"phone": {"min_confidence": 0.8, "policy": "mask"}},
    "allowlist": ["139"],
    "masking": {"style": "full", "mask_char": "$"},
}


def test_a_value_inside_another_preview_is_a_leak(spark):
    rules = Rules.from_layers({"custom_patterns": [{"type": "badge", "pattern": r"EMP-\d+"}]})
    df = spark.createDataFrame([(1, "a", "EMP-1"), (2, "b", "EMP-12345678")], SCHEMA)
    entries = audit_entries(redact_text(df, rules), ts=TS, keep_raw=True)
    # the preview EMP-****5678 holds no value, but EMP-* of the first one stays clear
    masked = {r.masked_preview for r in entries.collect()}
    assert masked == {"EMP-*", "EMP-****5678"}
    changed = entries.withColumn("masked_preview", F.regexp_replace("masked_preview", r"-\*{4}", "-12**"))
    [row] = leaks(changed).collect()
    assert tuple(row) == ("badge", 2, 0, 1)


def test_layered_tables_agree_with_layers(spark):
    rules = Rules.from_layers(LAYER)
    hits = scan(spark.createDataFrame(ROWS, SCHEMA), Rules.default())
    settings = with_defaults(spark, settings_table(spark, LAYER), Rules.default())
    fields = ("raw", "policy", "masked")
    got = {tuple(r[f] for f in fields) for r in apply_layers(hits, settings).collect()}
    want = redact_text(spark.createDataFrame(ROWS, SCHEMA), rules)
    assert got == {
        tuple(r[f] for f in fields) for row in want.collect() for r in row.redactions
    }
    assert {g[:2] for g in got} == {("110101199003078515", "block"), ("13800138000", "mask")}
    assert rules_of(settings).values.keys() == rules.without("allowlist").values.keys()


@pytest.mark.parametrize("style", ["partial", "full", "label"])
@pytest.mark.parametrize("char", ["*", "\\", "$", "xy"])
def test_masks_of_tables_are_those_of_rules(spark, style, char):
    layer = {"masking": {"style": style, "mask_char": char, "keep_prefix": 2, "labels": {"phone": "T"}}}
    rules = Rules.from_layers(layer)
    hits = scan(spark.createDataFrame(ROWS, SCHEMA), rules)
    settings = with_defaults(spark, settings_table(spark, layer), Rules.default())
    got = {(r.raw, r.masked) for r in apply_layers(hits, settings).collect()}
    want = redact_text(spark.createDataFrame(ROWS, SCHEMA), rules).collect()
    assert got >= {(r.raw, r.masked) for row in want for r in row.redactions} and got


def test_absent_settings_have_defaults(spark):
    hits = scan(spark.createDataFrame(ROWS, SCHEMA), Rules.default())
    empty = spark.createDataFrame([], SETTINGS_SCHEMA)
    kept = apply_layers(hits, empty)
    assert kept.count() == hits.count() and {r.policy for r in kept.collect()} == {"mask"}


def test_an_allowlist_of_any_size(spark):
    hits = scan(spark.createDataFrame(ROWS, SCHEMA), Rules.default())
    rows = [(1, ["allowlist", f"1/{i}"], f"{i:07}no") for i in range(20_000)]
    many = spark.createDataFrame([*rows, (1, ["allowlist", "1/x"], "1380013")], SETTINGS_SCHEMA)
    left = {r.raw for r in apply_layers(hits, many).collect()}
    assert left == {r.raw for r in hits.collect() if "1380013" not in r.raw}


@pytest.mark.parametrize("anchor", [2, 5, 8])
def test_leaks_agree_with_every_pair(spark, anchor):
    import random

    chance = random.Random(anchor)
    digits = "0123456789"
    raws = ["".join(chance.choice(digits) for _ in range(chance.randrange(1, 14))) for _ in range(40)]
    rows = []
    for i in range(300):
        raw = chance.choice(raws + ["", None])
        inside = chance.choice(raws) if chance.random() < 0.3 else "x"
        rows.append((chance.choice("abc"), raw, f"EMP-{inside}*{chance.randrange(99)}"))
    rows += rows[:20]  # repeated records
    entries = spark.createDataFrame(rows, "type string, raw string, masked_preview string")
    for field in FIELDS:
        if field not in entries.columns:
            entries = entries.withColumn(field, F.lit(None).cast("string"))
    lines = [(r.type, r.raw, r.line) for r in entries.select("type", "raw", audit_json().alias("line")).collect()]
    values = {r for _, r, _ in lines if r}
    want = {}
    for t, r, line in lines:
        n, own, anyr = want.get(t, (0, 0, 0))
        want[t] = (n + 1, own + (r is not None and r in line), anyr + any(v in line for v in values))
    got = {r.type: tuple(r)[1:] for r in leaks(entries, anchor).collect()}
    assert got == want
    assert leaks(entries.limit(0), anchor).collect() == []


def test_a_frequent_value_is_spread_over_tasks(spark):
    from veilspark.operators.layered_rules import _with_allowed

    rows = [(i, "phone", "13800138000" if i % 2 else f"1391234{i:04d}", 0, 11) for i in range(400)]
    rows += [(1000 + i, "phone", None, 0, 0) for i in range(3)] + [rows[0], rows[1]]
    hits = spark.createDataFrame(rows, "doc_id int, type string, raw string, start int, end int")
    settings = settings_table(spark, {"allowlist": ["12340"]})
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        kept = _with_allowed(hits, settings).withColumn("_task", F.spark_partition_id()).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = sorted(map(repr, (r for r in rows if r[2] is None or "12340" not in r[2])))
    names = ("doc_id", "type", "raw", "start", "end")
    assert sorted(repr(tuple(r[n] for n in names)) for r in kept) == want
    hot = {r._task for r in kept if r.raw == "13800138000"}
    assert len(hot) > 4


def test_records_are_searched_in_two_parts(spark):
    """Records of one source and type share all but the preview; a value across the cut is found."""
    rules = Rules.from_layers({"custom_patterns": [{"type": "odd", "pattern": r"preview\":\"\S+"}]})
    texts = [(i, "a", f"1380013{i:04d} 139123{i:05d}") for i in range(200)]
    texts += [(1000, "b", 'preview":"p 13800138000'), (1001, "b", "13800139000")]
    entries = audit_entries(
        redact_text(spark.createDataFrame(texts, SCHEMA), rules), ts=TS, keep_raw=True
    )
    head, tail = record_parts()
    parts = entries.select(audit_json().alias("line"), head.alias("head"), tail.alias("tail"))
    rows = parts.collect()
    assert all(r.line == r.head + r.tail for r in rows)
    assert len({r.head for r in rows}) == 3 and max(len(r.tail) for r in rows) < 40
    raws, pairs = [r.raw for r in entries.select("raw").collect()], [r.line for r in rows]
    want = sum(any(raw in line for raw in raws) for line in pairs)
    assert sum(r.n_any_raw for r in leaks(entries).collect()) == want > 0
