import re
import zlib

from veilspark.llm import spelling as S

from .data import awkward, prose, table, with_clashes


def brute(rows):
    counts = {}
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] = counts.get(run, 0) + 1
    vocab = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def one_edit(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long_ = sorted((a, b), key=len)
        return any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))

    out, form = {}, {}
    for w, n in vocab.items():
        near = [o for o in vocab if one_edit(w, o)]
        best = min(near, key=lambda o: (-vocab[o], o), default=None)
        form[w] = best if best is not None and vocab[best] >= 2 * n else None
        out[w] = (len(near), form[w])
    rows = []
    for w, n in vocab.items():
        root = w
        while form[root] is not None:
            root = form[root]
        f = form[w]
        rows.append((w, f, root, n, out[w][0], vocab[f] if f else None))
    return sorted(rows, key=str)


def run(spark, rows):
    got = S.spelling_variants(with_clashes(table(spark, rows))).collect()
    return sorted(map(tuple, got), key=str)


def variants(seed):
    base = ["colour", "organise", "théâtre", "Naïve", "recieve", "Grammar", "ÀÉÎÕÜ"]
    text = []
    for i in range(40):
        for b in base:
            text.append(b)
            if i % 3 == 0:
                text.append(b[:2] + b[3:])  # deletion
            if i % 5 == 0:
                text.append(b[:3] + "x" + b[3:])  # insertion
            if i % 7 == 0:
                text.append(b[:-1] + "é")  # replacement
    return " ".join(text) + " " + prose(seed, 300)


def test_against_brute_force(spark):
    rows = [(i, variants(i), "en", "s", 1) for i in range(12)] + awkward()
    rows += [(None, "colour colour colour colr", "en", "s", 1), (50, "x" * 100_000 + " cölour", "en", "s", 1)]
    want = brute(rows)
    assert any(r[1] for r in want)
    assert run(spark, rows) == want


def test_chains_of_forms(spark):
    text = " ".join(["abcdefgh"] * 40 + ["abcdefg"] * 12 + ["abcdef"] * 6 + ["abcdex"] * 3)
    got = run(spark, [(1, text, "en", "s", 1)])
    assert got == brute([(1, text, "en", "s", 1)])
    assert {r[0]: r[2] for r in got}["abcdex"] == "abcdefgh"


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, "en", "s", 1), (2, "", "en", "s", 1)]) == []


def test_one_sided_keys_meet_every_near_pair(spark):
    import itertools
    import random

    from pyspark.sql import functions as F

    chance = random.Random(5)
    letters = "abcéèxyz"
    base = ["".join(chance.choice(letters) for _ in range(chance.randrange(5, 9))) for _ in range(60)]
    words = set(base)
    for w in base:
        i = chance.randrange(len(w))
        words |= {w[:i] + w[i + 1 :], w[:i] + chance.choice(letters) + w[i + 1 :], w[:i] + "q" + w[i:]}
    words = sorted(words)
    df = spark.createDataFrame([(w,) for w in words], "word string")
    keys = {r.word: (set(r.full), set(r.half), r.r) for r in df.select(
        "word", S.neighbourhood(S.reduced()).alias("full"), S.one_sided(S.reduced()).alias("half"),
        S.reduced().alias("r")).collect()}
    for a, b in itertools.combinations(words, 2):
        full = keys[b][2] in keys[a][0] or keys[a][2] in keys[b][0]
        half = keys[b][2] in keys[a][1] or keys[a][2] in keys[b][1]
        assert full == half
        assert keys[a][1] <= keys[a][0]
