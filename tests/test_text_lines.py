"""Text files read by byte ranges: line numbers and columns as a whole read gives them."""

import random

from veilspark.operators.hits import scan
from veilspark.rules import Rules
from veilspark.sources.readers import read_text_lines


def test_lines_of_a_file_split_into_many_ranges(spark, tmp_path):
    chance = random.Random(4)
    lines = []
    for i in range(3000):
        words = [chance.choice(["alpha", "beta", "13800138000", "x" * 300, "é"]) for _ in range(chance.randrange(0, 12))]
        lines.append(" ".join(words))
    (tmp_path / "big.txt").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (tmp_path / "small.txt").write_text("one\n\ntwo 13800138000", encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        df = read_text_lines(spark, str(tmp_path), glob="*.txt")
        assert df.rdd.getNumPartitions() > 20
        got = {(r.source.rsplit("/", 1)[-1], r.line_no): r.text for r in df.collect()}
        hits = scan(df, Rules.default(), keys=["source", "line_no"]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {("big.txt", i + 1): t for i, t in enumerate(lines)}
    want |= {("small.txt", 1): "one", ("small.txt", 2): "", ("small.txt", 3): "two 13800138000"}
    assert got == want
    whole = "\n".join(lines)
    places = sorted((r.line_no, r.col) for r in hits if r.source.endswith("big.txt"))
    expected = []
    for i, text in enumerate(lines):
        at = text.find("13800138000")
        while at >= 0:
            expected.append((i + 1, at + 1))
            at = text.find("13800138000", at + 1)
    assert places == expected and whole.count("13800138000") == len(expected)
