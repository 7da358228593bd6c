"""Secret scans: credential patterns, and guess costs of values in credential context.

A value's guess cost is the least number of guesses, as a power of ten, over all ways
to cut it into common words, dates, repeats, keyboard walks and single characters
(dynamic programming over the end of the last piece). Values that follow a credential
word and cost more than ``HARD`` are reported besides the fixed patterns: the values
of assignments with all their signs, where a base span does not hold them whole, and
values after other credential words.

Each text is scanned whole in the task that reads it; nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import slices

KINDS = ("assign", "access", "hex", "guess")
HARD = 8.0
"""Guesses, as a power of ten, from which a value counts as a secret."""

# The patterns of the three base kinds.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LENGTH = 12

CONTEXT = re.compile(
    r"""\b(?:pwd|pass|passphrase|passcode|auth|authorization|bearer|credentials?|"""
    r"""(?:access|private|secret|signing|encryption)[_-]?key|pin|login)\b["']?"""
    r"""(?:\x20{0,4}[:=]\x20{0,4}|\x20is\x20)["']?([!#-&(-~]{8,})""",
    re.IGNORECASE | re.ASCII,
)

# The credential words of ASSIGN before values with other signs too. After " is " only
# values with a digit or sign inside are judged: "the secret is understanding" is prose.
KEY = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?(\x20*[:=]\x20*|\x20is\x20)["']?""",
    re.IGNORECASE | re.ASCII,
)
VALUE = re.compile(r"[!#-&(-~]+")
CLOSING = ",;:.)]}>"
"""Signs that, next to a value, are taken as those of the text around it."""

# Common parts of passwords, the commonest first.
COMMON = (
    "password 123456 qwerty admin welcome login letmein monkey dragon football iloveyou "
    "master sunshine princess shadow secret hello superman batman trustno1 baseball "
    "michael jordan jennifer hunter soccer harley ranger george thomas summer winter "
    "spring autumn love lover angel daniel andrew joshua ashley jessica charlie freedom "
    "whatever starwars computer internet google facebook cookie cheese pepper ginger "
    "orange banana purple yellow silver golden diamond flower killer hockey tigger "
    "maggie buster test user root guest demo temp default system server changeme pass "
    "access token key api data base access manager service account client public "
    "private example sample string value null none true false your enter here insert "
    "replace todo xxx foo bar the and you for new old one two home work house money "
    "happy lucky magic power music black white green blue red cat dog fish bird tree"
).split()
WORD_COST = {w: math.log10(2 + i) for i, w in reversed([*enumerate(COMMON)])}
LONGEST_WORD = max(map(len, COMMON))
# Rows of a keyboard and the orders people walk through.
WALKS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
_NEXT = {(a, b) for row in WALKS for a, b in zip(row, row[1:], strict=False)}
_NEXT |= {(b, a) for a, b in _NEXT} | {(a, b) for a, b in zip("qaz", "azx", strict=True)}
_DATE = re.compile(
    r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])"
    r"|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d"
    r"|(?:19|20)\d\d"
)


def _alphabet(c: str) -> float:
    """Guesses for one character, as a power of ten."""
    size = 10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33
    return math.log10(size)


def _runs(text: str, joined) -> list[int]:
    """For each place, where the run of joined neighbours that it is in ends."""
    ends = [len(text)] * len(text)
    for i in range(len(text) - 2, -1, -1):
        ends[i] = ends[i + 1] if joined(text[i], text[i + 1]) else i + 1
    return ends


def _agreement(text: str, size: int) -> list[int]:
    """For each place, how many characters from there equal the one ``size`` later."""
    out = [0] * (len(text) + 1)
    for i in range(len(text) - size - 1, -1, -1):
        out[i] = out[i + 1] + 1 if text[i] == text[i + size] else 0
    return out


def guess_cost(value: str) -> float:
    """The least guesses, as a power of ten, that reach ``value``; 0 for an empty one.

    Linear in the length: a piece is a common word, a date, a whole run of repeats or
    of a walk, the rest of a repeated block, or one character.
    """
    low, n = value.lower(), len(value)
    same = _runs(low, lambda a, b: a == b)
    walk = _runs(low, lambda a, b: (a, b) in _NEXT)
    blocks = [(size, _agreement(low, size)) for size in range(2, 9)]
    best = [0.0] + [math.inf] * n
    capital = [0.0]
    for a in value:
        capital.append(capital[-1] + a.isupper())
    for i in range(n):
        base = best[i] + (0.3 if i else 0.0)  # a further piece: its place must be guessed
        pieces = [(i + 1, best[i] + _alphabet(value[i]))]
        if same[i] - i > 2:
            pieces.append((same[i], base + _alphabet(value[i]) + math.log10(same[i] - i)))
        if walk[i] - i > 2:
            pieces.append((walk[i], base + 1.7 + math.log10(walk[i] - i)))
        for size in range(3, min(LONGEST_WORD, n - i) + 1):
            cost = WORD_COST.get(low[i : i + size])
            if cost is not None:
                pieces.append((i + size, base + cost))
        if low[i].isdigit() and (date := _DATE.match(low, i)):
            pieces.append((date.end(), base + (4.4 if date.end() - i > 4 else 2.1)))
        for size, agree in blocks:
            if agree[i] >= size:
                times = 1 + agree[i] // size
                own = sum(map(_alphabet, low[i : i + size]))
                pieces.append((i + size * times, base + own + math.log10(times)))
                break
        for end, cost in pieces:
            if 0 < capital[end] - capital[i] < end - i and end - i > 1:
                cost += 0.3 * min(capital[end] - capital[i], 3)
            best[end] = min(best[end], cost)
    return best[n]


def _assigned(text: str) -> Iterator[tuple[int, int]]:
    """Whole values after the words of ASSIGN; one inside another is part of that."""
    last = 0
    for m in KEY.finditer(text):
        a = m.end()
        if a < last or not (value := VALUE.match(text, a)):
            continue
        last = b = value.end()
        if text[a - 1] not in "\"'":
            b = a + len(value[0].rstrip(CLOSING))
        prose = "is" in m[1].lower() and text[a:b].strip(CLOSING).isalpha()
        if b - a >= 6 and not prose:
            yield a, b


def secrets_of(text: str) -> list[tuple[int, int, int, float | None]]:
    """(start, kind's number, end, guess cost) of all secrets, in order.

    Base kinds are found leftmost and without overlaps inside a kind. Values judged by
    cost are left out where base spans hold all of them but closing signs.
    """
    found = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= ASSIGN_LENGTH:
            found.append((m.start(), 0, m.end(), guess_cost(m[2])))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), None) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), None) for m in HEX.finditer(text)]
    values = [*_assigned(text), *(m.span(1) for m in CONTEXT.finditer(text))]
    base = sorted((a, b) for a, _, b, _ in found)
    taken: list[tuple[int, int]] = []
    for a, b in sorted(set(values)):
        held = a
        for x, y in base:
            if x <= held < y:
                held = y
        if not text[held:b].strip(CLOSING) or (taken and a < taken[-1][1]):
            continue
        cost = guess_cost(text[a:b])
        if cost >= HARD:
            taken.append((a, b))
            found.append((a, 3, b, cost))
    return sorted(found, key=lambda s: s[:3])


_SECRETS = "array<struct<start:bigint,kind:string,end:bigint,guesses:double>>"
_ARROW = pa.list_(
    pa.struct(
        [
            ("start", pa.int64()),
            ("kind", pa.string()),
            ("end", pa.int64()),
            ("guesses", pa.float64()),
        ]
    )
)


def find_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all) of ``docs`` and ``_secrets``, spans in code points.

    A null or empty text has none. Very long values cost time in proportion to their
    length. A column ``_secrets`` of ``docs`` is replaced.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c != "_secrets"]
    docs = docs.drop("_secrets")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, text):
            rows = [
                [
                    {"start": a, "kind": KINDS[k], "end": b, "guesses": cost}
                    for a, k, b, cost in secrets_of(value or "")
                ]
                for value in batch.column(text).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(rows, _ARROW)],
                names=[*names, "_secrets"],
            )

    schema = docs.select(*names, F.expr(f"cast(array() AS {_SECRETS})").alias("_secrets")).schema
    return docs.mapInArrow(run, schema)


def secrets_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, digest of the base spans and all spans."""
    found = find_secrets(docs.select("doc_id", "text"), keep=["doc_id"])

    def joined(array: str) -> str:
        one = "s -> concat(s.kind, ':', s.start, ':', s.end)"
        return f"array_join(transform({array}, {one}), ',')"

    counts = [
        F.expr(f"cast(size(filter(_secrets, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}")
        for k in KINDS
    ]
    base = "filter(_secrets, s -> s.kind <> 'guess')"
    return found.select(
        "doc_id",
        *counts,
        F.expr(f"sha2({joined(base)}, 256)").alias("base_sha256"),
        F.expr(joined("_secrets")).alias("spans"),
        F.expr("array_max(transform(_secrets, s -> s.guesses))").alias("most_guesses"),
    )
