from pyspark.sql import functions as F

from veilspark.operators.nested import redact_payloads
from veilspark.operators.redaction import redact_text, released
from veilspark.rules import Rules
from veilspark.sources.readers import parse_audit_lines
from veilspark.streaming import jobs

SCHEMA = "doc_id bigint, source string, text string"
RULES = Rules.from_layers({"detectors": {"id_card": {"policy": "block"}}})


def arrive(spark, folder, first, last):
    rows = [
        (i, f"s{i % 3}", "110101199003078515" if i % 5 == 0 else f"tel 1380013{i:04d}")
        for i in range(first, last)
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    df.repartition(3).write.mode("append").parquet(folder)
    return df


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    folder, out, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    batch = arrive(spark, folder, 0, 30)
    for first, last in ((0, 0), (30, 50)):
        if last:
            batch = batch.unionByName(arrive(spark, folder, first, last))
        stream = jobs.read_text_stream(spark, folder, SCHEMA, files_per_batch=2)
        jobs.stream_redact(stream, RULES, out, state).awaitTermination()
    want = released(redact_text(batch, RULES)).select("doc_id", "text", "n_redactions")
    got = spark.read.parquet(out).select("doc_id", "text", "n_redactions")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_audit_and_routes_once_per_batch(spark, tmp_path):
    folder, out, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    arrive(spark, folder, 0, 40)
    for again in (state, state + "-lost"):  # a lost checkpoint replays the batches
        stream = jobs.read_text_stream(spark, folder, SCHEMA, files_per_batch=2)
        jobs.stream_block_audit(stream, RULES, out, again, ts="t").awaitTermination()
        routed = jobs.committed(spark, out, "routed")
        assert routed.count() == 40
        assert routed.filter("route = 'quarantine'").count() == 8
        log = parse_audit_lines(jobs.committed(spark, out, "audit"))
        assert log.groupBy("action").count().orderBy("action").collect() == [
            ("block", 8),
            ("mask", 32),
        ]


def test_report_grows_with_the_log(spark, tmp_path):
    log, out, state = (str(tmp_path / p) for p in ("log", "report", "state"))
    line = '{"type":"phone","action":"mask","file":"f"}'
    for n in (3, 8):
        spark.range(5 if n == 8 else 3).select(F.lit(line)).write.mode("append").text(log)
        jobs.stream_audit_report(spark, log, out, state).awaitTermination()
        assert [tuple(r) for r in jobs.current_report(spark, out).collect()] == [("phone", "mask", n)]


def test_a_reader_never_sees_an_empty_report(spark, tmp_path):
    log, out, state = (str(tmp_path / p) for p in ("log", "report", "state"))
    line = '{"type":"phone","action":"mask","file":"f"}'
    for i in range(6):
        spark.range(1).select(F.lit(line)).write.mode("append").text(log)
    assert jobs.current_report(spark, out).count() == 0
    query = jobs.stream_audit_report(spark, log, out, state, files_per_batch=1)
    seen = []
    while query.isActive or not seen:
        rows = jobs.current_report(spark, out).collect()
        if seen or rows:
            assert len(rows) == 1
            seen.append(rows[0].n)
        if not query.isActive and seen:
            break
    query.awaitTermination()
    seen.append(jobs.current_report(spark, out).collect()[0].n)
    assert seen == sorted(seen) and seen[-1] == 6
    # only the newest two versions are kept
    import os

    assert len(os.listdir(f"{out}/versions")) <= 2


def test_bodies_and_audit_hold_no_raw_value(spark, tmp_path):
    folder, out, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    rows = [
        (1, "a", '{"13800138000": "tel 13800138000", "n": 110101199003078515}', "application/json"),
        (2, "b", "tel 13800138000", "text/plain"),
        (3, "c", "{broken 13800138000", "application/json"),
    ]
    schema = "doc_id bigint, source string, text string, kind string"
    batch = spark.createDataFrame(rows, schema)
    batch.write.parquet(folder)
    stream = jobs.read_text_stream(spark, folder, schema)
    jobs.stream_block_audit(
        stream, RULES, out, state, ts="t", content_type="kind", trigger={"availableNow": True}
    ).awaitTermination()
    want = redact_payloads(batch, RULES, "text", "kind").select("doc_id", "text", "blocked")
    got = jobs.committed(spark, out, "routed")
    routed = {(r.doc_id, r.text, r.route == "quarantine") for r in got.collect()}
    assert routed == {tuple(r) for r in want.collect()}
    keys = '{"13800138000": '  # keys of JSON stay
    texts = " ".join(r[0] for r in got.select(F.to_json(F.struct("*"))).collect())
    logged = " ".join(r[0] for r in jobs.committed(spark, out, "audit").collect())
    assert "13800138000" not in texts.replace(keys.replace('"', '\\"'), "") + logged
    assert "110101199003078515" not in texts + logged and '"type":"id_card"' in logged
    state2, out2 = state + "2", out + "2"
    jobs.stream_redact(
        jobs.read_text_stream(spark, folder, schema), RULES, out2, state2, content_type="kind"
    ).awaitTermination()
    left = {(r.doc_id, r.text) for r in spark.read.parquet(out2).collect()}
    assert left == {r[:2] for r in routed if not r[2]}


def test_a_crash_between_the_writes_shows_neither_part(spark, tmp_path, monkeypatch):
    folder, out, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    arrive(spark, folder, 0, 20)
    real = jobs._commit

    def crash(*args):
        raise RuntimeError("executor lost before the commit")

    monkeypatch.setattr(jobs, "_commit", crash)
    stream = jobs.read_text_stream(spark, folder, SCHEMA, files_per_batch=100)
    query = jobs.stream_block_audit(stream, RULES, out, state, ts="t")
    try:
        query.awaitTermination()
    except Exception:
        pass
    assert jobs.committed(spark, out, "routed").count() == 0
    assert jobs.committed(spark, out, "audit").count() == 0
    assert spark.read.parquet(f"{out}/_staged/part=routed").count() == 20  # written, not seen
    monkeypatch.setattr(jobs, "_commit", real)
    stream = jobs.read_text_stream(spark, folder, SCHEMA, files_per_batch=100)
    jobs.stream_block_audit(stream, RULES, out, state, ts="t").awaitTermination()
    assert jobs.committed(spark, out, "routed").count() == 20
    assert parse_audit_lines(jobs.committed(spark, out, "audit")).count() == 20
