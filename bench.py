"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; one JSON line.

Each query is written to a noop sink. A warm-up run is followed by three timed
runs; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators import audit, hits, nested, redaction
from veilspark.plans.corpus import corpus
from veilspark.rules import Rules
from veilspark.sources import sinks
from veilspark.sources.readers import read_table
from veilspark.streaming import jobs

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
TS = "2026-01-01T00:00:00+00:00"


def noop(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    rules = Rules.default()
    custom = Rules.from_layers(
        {"custom_patterns": [{"type": f"t{i}", "pattern": rf"EMP{i}-(?P<v>\d{{4,6}})"} for i in range(5)]}
    )

    def texts() -> DataFrame:
        return corpus(spark, SF_DIR)

    def documents() -> DataFrame:
        return read_table(
            spark, f"{SF_DIR}/documents.parquet", ["doc_id", "source", "text"], small=True
        )

    def redacted() -> DataFrame:
        return redaction.redact_text(texts(), rules)

    def json_bodies() -> DataFrame:
        body = F.to_json(F.struct("doc_id", F.array(F.struct("text")).alias("parts")))
        return texts().select("doc_id", body.alias("body"))

    arriving = sinks.scratch_folder(spark, "arriving")
    texts().write.parquet(arriving)

    def stream() -> None:
        source = jobs.read_text_stream(
            spark, arriving, "doc_id bigint, source string, text string"
        )
        out, state = (sinks.scratch_folder(spark, p) for p in ("out", "state"))
        jobs.stream_redact(source, rules, out, state).awaitTermination()

    queries = {
        "read_only": lambda: noop(documents()),
        "detect_documents": lambda: noop(hits.scan(documents(), rules, positions=False)),
        "positions_documents": lambda: noop(hits.scan(documents(), rules)),
        "custom_documents": lambda: noop(hits.scan(documents(), custom, positions=False)),
        "detect_all": lambda: noop(hits.scan(texts(), rules, positions=False)),
        "scan_positions": lambda: noop(hits.scan(texts(), rules)),
        "scan_gate": lambda: noop(hits.scan_gate(texts(), rules)),
        "redact_documents": lambda: noop(redaction.redact_text(documents(), rules)),
        "redact_text": lambda: noop(redacted()),
        "redact_json_strings": lambda: noop(
            nested.redact_json_column(json_bodies(), rules)
        ),
        "audit_entries": lambda: noop(audit.audit_entries(redacted(), ts=TS)),
        "report_by_type": lambda: noop(
            audit.report_by_type(audit.audit_entries(redacted(), ts=TS))
        ),
        "stream_redact": stream,
    }
    size = documents().agg(
        F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars")
    ).first()
    seconds, spread = {}, {}
    for name, run in queries.items():
        run()
        times = []
        for _ in range(3):
            start = time.perf_counter()
            run()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        spread[name] = round(max(times) - min(times), 3)
    rate = size["chars"] / seconds["redact_documents"]
    print(
        json.dumps(
            {
                "metric": "sum of query medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "spread": spread,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(CPUS),
                "documents": {"rows": size["rows"], "chars": size["chars"]},
                "redact_documents_chars_per_sec": round(rate),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
