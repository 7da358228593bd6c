import random

from tests import plain
from veilspark.functions.fixed_values import INTRANET_SUFFIXES
from veilspark.operators.hits import dedupe_hits, scan, scan_failed, scan_gate, scan_totals
from veilspark.rules import Rules

SAMPLE = (
    '身份证 = "110101199003078515"\nphone = "13800138000"\ncard = "6222021000112230"\n'
    'uscc = "91110108MA01ABCD1E"\nhost = "db01.internal"\nip = "10.0.0.5"\n'
)
# text -> values expected
CASES = {
    SAMPLE: "110101199003078515 13800138000 6222021000112230 91110108MA01ABCD1E db01.internal 10.0.0.5",
    'order_id = "110101199003078500"': "",
    'ref = "12345678901"': "",
    "https://api.example.com/v1": "",
    "hosts = [10.1.2.3, 192.168.0.1, 172.16.5.4, 127.0.0.1]": "10.1.2.3 192.168.0.1 172.16.5.4 127.0.0.1",
    "dns = 8.8.8.8 and 172.32.0.1 and 10.0.0.256": "",
    'doc_host = "example.internal" or foo.example.internal': "",
    "+8613800138000": "",
    "10.0.0.5. and db01.internal.": "",
    "主机db01.internal": "",
    "threading.local": "threading.local",
    "A.B.HOME.ARPA": "A.B.HOME.ARPA",
    "x" + "1" * 30: "",
    "call 13８００138000 now": "13８００138000",
    "0000 0000 0000 0000 0000": "",  # twenty digits: the long match fails, none shorter
}


def values(hits):
    return [raw for *_, raw in hits]


def test_cases(detect):
    got = detect(list(CASES))
    for text, hits in zip(CASES, got):
        assert values(hits) == CASES[text].split(), text


def test_grouped_card_keeps_its_spaces(detect):
    [hits] = detect(['card = "6222 0210 0011 2230"'])
    assert hits == [("bank_card", 8, 27, "6222 0210 0011 2230")]


def test_suffixes(detect):
    got = detect([f'host = "service01{s}"' for s in INTRANET_SUFFIXES])
    assert [values(h) for h in got] == [[f"service01{s}"] for s in INTRANET_SUFFIXES]


def test_value_of_two_types_is_two_hits_and_one_redaction(detect, redact):
    [hits] = detect(["310101198512251235"])
    assert [h[0] for h in hits] == ["id_card", "bank_card"]
    [row] = redact(["310101198512251235"])
    assert [r.type for r in row.redactions] == ["id_card"]


def test_null_and_empty(detect):
    assert detect([None, "", "plain"]) == [[], [], []]


def test_mark_characters_in_the_text_do_no_harm(detect):
    [hits] = detect(["\x01a\x01\x0213800138000\x01 db.corp\x01"])
    assert hits == [("phone", 4, 15, "13800138000"), ("intranet_domain", 17, 24, "db.corp")]


def test_random_texts_agree_with_plain_python(detect, redact):
    random.seed(7)
    parts = (
        "110101199003078515 13800138000 6222021000112230 6222 0210 0011 2230"
        " 91110108MA01ABCD1E db01.internal 10.0.0.5 440300197809150047 example.internal"
    ).split() + ["6222 0210 0011 2230", "6222-0210-0011-2230", "١٢٣", "５", "é", "主", "😀"]
    glue = ["", " ", "-", ".", ",", "\n", "x", "1", "_", " 1234 "]
    texts = [
        "".join(
            random.choice(parts) + random.choice(glue) for _ in range(random.randint(1, 9))
        )
        for _ in range(1500)
    ]
    texts += ["".join(random.choices("0123456789X.- \nax", k=60)) for _ in range(500)]
    got = detect(texts)
    assert sum(map(len, got)) > 2000
    for text, hits in zip(texts, got):
        want = [(kind, s, e, raw) for s, e, _, kind, raw, _ in plain.detect(text)]
        assert hits == want, text
    for text, row in zip(texts, redact(texts)):
        assert row.text == plain.redact(text), text


def test_long_texts_of_many_hits(detect, redact, spark):
    """Offsets and cuts across blocks, and the scan beyond a few matches."""
    line = "t 13800138000 é 10.0.0.5, db01.corp 😀 6222021000112230 end\n"
    text = "x" * 4090 + "\n" + line * 700
    [hits] = detect([text])
    assert hits == [(k, s, e, raw) for s, e, _, k, raw, _ in plain.detect(text)]
    [row] = redact([text])
    assert row.text == plain.redact(text)
    df = spark.createDataFrame([(1, "s", text)], "doc_id int, source string, text string")
    for h in scan(df, Rules.default()).collect():
        before = text[: h.start]
        assert h.line == before.count("\n") + 1
        assert h.col == h.start - (before.rfind("\n") + 1) + 1


def test_name_of_very_many_labels_does_not_exhaust_the_stack(detect):
    name = "a." * 30_000 + "corp"
    assert values(detect([name])[0]) == [name]


def test_positions_and_order(spark):
    text = "line one\n身份证: 110101199003078515\nlast 13800138000\n"
    df = spark.createDataFrame([(1, "a", text)], "doc_id int, source string, text string")
    hits = scan(df, Rules.default()).orderBy("hit_no").collect()
    assert [(h.type, h.line, h.col) for h in hits] == [("id_card", 2, 6), ("phone", 3, 6)]


def test_gate_and_totals(spark):
    rows = [
        (1, "a.py", 'id = "110101199003078515"'),
        (2, "b.py", 'phone = "13800138000"'),
        (3, "clean.py", "def add(a, b): return a + b"),
        (4, "null.py", None),
    ]
    df = spark.createDataFrame(rows, "doc_id int, source string, text string")
    gate = scan_gate(df, Rules.default())
    assert {r.source: (r.n_hits, r.clean) for r in gate.collect()} == {
        "a.py": (1, False),
        "b.py": (1, False),
        "clean.py": (0, True),
        "null.py": (0, True),
    }
    assert tuple(scan_failed(gate).first()) == (True, 4, 2)
    assert tuple(scan_failed(gate.filter("clean")).first()) == (False, 2, 2)
    totals = scan_totals(scan(df, Rules.default()))
    assert {r.source: r.n_hits for r in totals.collect()} == {"a.py": 1, "b.py": 1, None: 2}


def test_dedupe_prefers_confidence_then_order(spark):
    rows = [(1, "s", 0, 18, 2, 0.9), (1, "s", 0, 18, 0, 0.99), (1, "s", 0, 18, 1, 0.99)]
    df = spark.createDataFrame(
        rows, "doc_id int, source string, start int, end int, ord int, confidence double"
    )
    assert [r.ord for r in dedupe_hits(df).collect()] == [0]


def test_dedupe_in_the_row_is_the_dedupe_of_the_table(spark):
    from veilspark.operators.hits import dedupe_hits, scan

    rules = Rules.from_layers({"custom_patterns": [{"type": "eleven", "pattern": r"1\d{10}"}]})
    rows = [(1, "a", "tel 13800138000 and 13912345678"), (2, "b", None), (3, "c", ""), (4, "d", "13800138000")]
    df = spark.createDataFrame(rows, "doc_id int, source string, text string")
    fields = ("doc_id", "source", "start", "end", "type", "confidence")
    table = scan(df, rules, positions=False)
    assert table.count() > table.select("doc_id", "start", "end").distinct().count()
    want = sorted(tuple(r[f] for f in fields) for r in dedupe_hits(table).collect())
    inrow = scan(df, rules, positions=False, dedupe=True)
    assert sorted(tuple(r[f] for f in fields) for r in inrow.collect()) == want
    assert "Exchange" not in inrow._jdf.queryExecution().executedPlan().toString()
