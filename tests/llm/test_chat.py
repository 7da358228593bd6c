import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import chat as C

TURNS = "conv_id long, turn long, role string, text string"


def conversations(n=300):
    chance = random.Random(1)
    rows = []
    for c in range(n):
        roles = (["system"] if c % 3 == 0 else []) + ["user", "assistant"] * chance.randrange(1, 5)
        for t, role in enumerate(roles):
            long = chance.randrange(400, 900) if role == "assistant" else chance.randrange(20, 200)
            rows.append((c, t, role, "w " * (long // 2)))
    return rows


def test_roles_of_held_out_conversations(spark):
    df = spark.createDataFrame(conversations(), TURNS)
    got = C.chat_report(df).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == df.count() and len(held) > 50
    assert sum(r.role == r.predicted for r in held) / len(held) > 0.95
    rows = {(r.conv_id, r.turn): r for r in got}
    for r in got:
        before = rows.get((r.conv_id, r.turn - 1))
        assert r.opens == (before is None or before.predicted != r.predicted)
        assert r.rendered.startswith(f"<|{r.predicted}|>\n") == r.opens


def plain_viterbi(symbols, model):
    v = model.first + model.emit[:, symbols[0]]
    back = []
    for s in symbols[1:]:
        total = v[:, None] + model.step
        back.append(total.argmax(0))
        v = total.max(0) + model.emit[:, s]
    path = [int(v.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def model_of(seed):
    chance = np.random.default_rng(seed)
    draw = lambda *shape: np.round(1000 * np.log(chance.random(shape) + 1e-3)).astype(np.int64)
    return C.Model(draw(3), draw(3, 3), draw(3, C.SYMBOLS))


@pytest.mark.parametrize("seed", range(6))
def test_cut_sequences_are_solved_as_whole_ones(seed):
    chance = np.random.default_rng(seed)
    model = model_of(seed)
    lengths = [1, 1, 40, 3, 1, 200, 2] if seed % 2 else [150]
    keys = np.repeat(np.arange(len(lengths)), lengths)
    symbols = chance.integers(0, C.SYMBOLS, len(keys))
    want = np.concatenate([plain_viterbi(symbols[keys == k], model) for k in range(len(lengths))])
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    assert (C.viterbi(symbols, starts, model) == want).all()

    import pyarrow as pa

    cuts = [0, *sorted(chance.choice(len(keys), 9, replace=False).tolist()), len(keys)]
    parts = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
    sums = []
    for p, (a, b) in enumerate(parts):
        table = pa.table(
            {"id": range(a, b), "part": [p] * (b - a), "conv_id": keys[a:b], "symbol": symbols[a:b]}
        )
        sums += [type("Row", (), r) for r in C._summary(table, model).to_pylist()]
    borders, got = C._borders(sums), []
    for p, (a, b) in enumerate(parts):
        reach, _, last = borders[p]
        own = np.array(C._segments(keys[a:b].tolist()))
        got.append(C.viterbi(symbols[a:b], own, model, reach, last))
    assert (np.concatenate(got) == want).all()


def test_one_conversation_over_many_ranges(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", "w " * (20 if i % 2 else 300)) for i in range(500)]
    df = spark.createDataFrame(rows, TURNS)
    model = C.learn(C._in_ranges(df.withColumn("symbol", C.symbol("text"))).withColumn("part", F.shiftright("id", 33)))
    whole = C.recover_roles(df.repartition(1), model).orderBy("turn").collect()
    assert [r.predicted for r in whole] == [r.predicted for r in C.recover_roles(df, model).orderBy("turn").collect()]


def test_transcripts_by_markers(spark):
    text = "User: hi\nthere\nAssistant: hello\n\n**Human**: and\nBot> yes"
    lines = C.transcript_lines(spark.createDataFrame([(1, text), (2, None), (3, "")], "k long, text string"), "k")
    rows = C.recover_roles(lines.withColumn("role", F.lit(None).cast("string"))).orderBy("turn").collect()
    marked = [r for r in rows if r.text != "there"]
    assert [r.predicted for r in marked] == ["user", "assistant", "user", "assistant"]
    assert [r.rendered.split("\n")[-1] for r in rows] == ["hi", "there", "hello", "and", "yes"]


def test_awkward_rows(spark):
    rows = [
        (None, None, None, None), (None, 0, "user", "x"), (1, 0, "other", ""), (1, 0, "user", "same"),
        (1, 0, "user", "same"), (2, None, "assistant", "w " * 50_000), (3, 1, "system", "é\n" * 9),
    ]
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(1) for c in ("id", "part", "symbol", "state")})
    got = C.chat_report(df).collect()
    assert len(got) == 7 and all(r.predicted in C.ROLES and r.rendered is not None for r in got)
    assert C.chat_report(spark.createDataFrame([], TURNS)).count() == 0
