import random

from pyspark.sql import functions as F

from veilspark.llm import toxicity as T

from .data import prose, table, with_clashes

LABELS = "doc_id long, quality int, toxic int"
BAD = ("zorgly", "zorglets", "zorglen", "blarfo", "blarfoth")


def corpus(n=900):
    chance = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = prose(i, 30 + i % 50).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(chance.randrange(len(words)), chance.choice(BAD))
        elif i % 25 == 1:
            words[3:3] = ["blarfo", "tree"]  # a harmless phrase
        rows.append((i, " ".join(words), "en", "a", 1))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_documents_are_told_apart(spark):
    rows, labels = corpus()
    docs, known = table(spark, rows), spark.createDataFrame(labels, LABELS)
    model = T.learn(docs, known)
    assert any(e.startswith("zorg") for e in model.weights)
    assert "blarfo tree" in model.exceptions
    got = T.toxicity_report(docs, known).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(rows) and len(held) > 150
    right = [r.predicted == int(r.doc_id % 5 == 0) for r in held]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_labels_held_out_teach_nothing(spark):
    rows, labels = corpus(300)
    docs, known = table(spark, rows), spark.createDataFrame(labels, LABELS)
    flipped = known.withColumn("toxic", F.when(T.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda k: sorted(map(tuple, T.toxicity_report(docs, k).collect()))
    assert score(flipped) == score(known)


def test_disguises_and_boundaries():
    search = T.Model({"scum": 2.0, "lowei*": 1.0, "idiot": 3.0}, {"scum lake"}).automaton()
    found = lambda t: sorted(T.matches(T.fold(t), search))
    assert found("Scum! ѕсum $cum sc%um sсum") == [2.0] * 4
    assert found("LOWEI loweichen xlowei") == [1.0, 1.0]
    assert found("1d10t id10t idiot$$$ idiots 1234") == [3.0, 3.0, 3.0]
    assert found("the scum lake and scum") == [2.0]
    assert found("") == [] and T.matches("x", None) == []
    assert T.features(None, search) == (0.0, 0.0)


def test_awkward_rows(spark):
    _, labels = corpus(10)
    labels += [(1, None, None), (2, 1, 1), (2, 1, 0), (None, 1, 1)]
    known = spark.createDataFrame(labels, LABELS)
    got = T.toxicity_report(with_clashes(table(spark)), known)
    assert got.count() == 14 and got.filter("score IS NULL OR held_out IS NULL").count() == 0
    assert T.toxicity_report(table(spark, []), known).count() == 0
    nothing = spark.createDataFrame([], LABELS)
    assert T.toxicity_report(table(spark), nothing).filter("predicted = 1").count() == 0
    kept = T.drop_toxic(with_clashes(table(spark)), nothing)
    assert kept.columns == with_clashes(table(spark)).columns and kept.count() == 14
