"""The rules of detection and rewriting once more, in plain Python, for
comparison on small inputs."""

from __future__ import annotations

import re

from veilspark.functions.fixed_values import (
    CONFIDENCE,
    DEFAULT_ALLOWLIST,
    ID_CARD_CHECK_CODES,
    ID_CARD_WEIGHTS,
    INTRANET_SUFFIXES,
    USCC_ALPHABET,
    USCC_CLASS,
    USCC_WEIGHTS,
)



def id_ok(v):
    s = sum(int(a) * b for a, b in zip(v, ID_CARD_WEIGHTS))
    return ID_CARD_CHECK_CODES[s % 11] == v[17].upper()


def luhn_ok(v):
    s = 0
    for at, c in enumerate(v[::-1]):
        d = (ord(c) - 48) * (1 + at % 2)
        s += d - 9 if at % 2 and d > 9 else d
    return s % 10 == 0


def card_ok(v):
    v = v.replace(" ", "").replace("-", "")
    return 13 <= len(v) <= 19 and luhn_ok(v)


def uscc_ok(v):
    if any(c not in USCC_ALPHABET for c in v.upper()):
        return False
    n = [USCC_ALPHABET.index(c) for c in v.upper()]
    return (sum(a * b for a, b in zip(n, USCC_WEIGHTS)) + n[17]) % 31 == 0


def ip_ok(v):
    return all(int(o) <= 255 for o in v.split("."))


def host_ok(v):
    return v.lower().endswith(INTRANET_SUFFIXES)


# What the six kinds look like, in Python's spelling.
KINDS = [
    ("id_card", "id_card", r"(?<![0-9A-Za-z])\d{17}[0-9Xx](?![0-9A-Za-z])", id_ok),
    ("phone", "phone", r"(?<!\d)1[3-9]\d{9}(?!\d)", lambda v: True),
    (
        "bank_card",
        "bank_card",
        r"(?<![\d-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2,4}(?:[ -]\d{1,3})?)(?![\d-])",
        card_ok,
    ),
    ("uscc", "uscc", rf"(?<![0-9A-Za-z]){USCC_CLASS}{{2}}\d{{6}}{USCC_CLASS}{{10}}(?![0-9A-Za-z])", uscc_ok),
    (
        "private_ip",
        "intranet_domain",
        r"(?<![\d.])(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3}"
        r"|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}|127\.\d{1,3}\.\d{1,3}\.\d{1,3})(?![\d.])",
        ip_ok,
    ),
    (
        "intranet_host",
        "intranet_domain",
        r"(?<![\w.-])(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![\w.-])",
        host_ok,
    ),
]


def detect(text):
    found = [
        (m.start(), m.end(), order, kind, m[0], CONFIDENCE[name])
        for order, (name, kind, pattern, ok) in enumerate(KINDS)
        for m in re.finditer(pattern, text)
        if ok(m[0]) and not any(a in m[0] for a in DEFAULT_ALLOWLIST)
    ]
    return sorted(found)


def mask(raw, keep=4):
    head = min(keep, len(raw) - 1)
    tail = min(keep, len(raw) - 1 - head)
    middle = raw[head : len(raw) - tail]
    return raw[:head] + re.sub("[^ -]", "*", middle) + raw[len(raw) - tail :]


def redact(text):
    """Each position belongs to the hit that starts first, the longest on a tie."""
    best = {}
    for start, end, order, kind, raw, confidence in detect(text):
        if (start, end) not in best or confidence > best[start, end][1]:
            best[start, end] = (raw, confidence)
    out = list(text)
    for (start, end), (raw, _) in sorted(best.items(), key=lambda b: (-b[0][0], b[0][1])):
        out[start:end] = mask(raw)
    return "".join(out)
