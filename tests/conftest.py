import os
import sys

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def detect(spark):
    """Hits of a list of texts, as one list of tuples per text."""
    from veilspark.functions.spans import detections, with_python_spans
    from veilspark.rules import Rules

    def run(texts, rules=None):
        rules = rules or Rules.default()
        df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
        df, python_spans = with_python_spans(df, "text", rules)
        hits = F.expr(detections("text", rules, python_spans)).alias("hits")
        rows = {r.i: r.hits for r in df.select("i", hits).collect()}
        return [
            [(h.type, h.start, h.end, h.raw) for h in rows[i]] for i in range(len(texts))
        ]

    return run


@pytest.fixture(scope="session")
def redact(spark):
    """Redacted rows of a list of texts."""
    from veilspark.operators.redaction import redact_text
    from veilspark.rules import Rules

    def run(texts, rules=None):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
        done = redact_text(df, rules or Rules.default()).collect()
        return [row for _, row in sorted((r.i, r) for r in done)]

    return run
