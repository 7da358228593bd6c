"""Check-digit tests as SQL predicates: true or false, never null, never raising."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

from .fixed_values import (
    ID_CARD_CHECK_CODES,
    ID_CARD_WEIGHTS,
    USCC_ALPHABET,
    USCC_WEIGHTS,
)
from .sqltext import fresh, let, quote, transform_at, zip_with

DIGIT = r"\p{Nd}"


def _decimal_digit_pairs() -> tuple[str, str]:
    """Every non-ASCII decimal digit and its ASCII counterpart."""
    digits = [
        chr(c)
        for c in range(128, sys.maxunicode + 1)
        if unicodedata.category(chr(c)) == "Nd"
    ]
    return "".join(digits), "".join(str(unicodedata.digit(d)) for d in digits)


_FROM_DIGITS, _TO_DIGITS = map(quote, _decimal_digit_pairs())


def ascii_digits(value: str) -> str:
    """``value`` with decimal digits of any script turned into 0-9."""
    other_script = matches(value, r"(?![0-9])\p{Nd}")
    return f"if({other_script}, translate({value}, {_FROM_DIGITS}, {_TO_DIGITS}), {value})"


def matches(value: str, pattern: str) -> str:
    return f"rlike({value}, {quote(pattern)})"


def _sum(terms: str) -> str:
    total, term = fresh("total"), fresh("term")
    return f"aggregate({terms}, 0, ({total}, {term}) -> {total} + {term})"


def _weighted_sum(
    value: str, weights: tuple[int, ...], number_of: Callable[[str], str]
) -> str:
    listed = ", ".join(map(str, weights))
    return _sum(
        zip_with(
            f"slice(split({value}, ''), 1, {len(weights)})",
            f"array({listed})",
            lambda char, weight: f"{number_of(char)} * {weight}",
        )
    )


def _only_if(shape: str, check: str) -> str:
    return f"coalesce(CASE WHEN {shape} THEN {check} END, false)"


def id_card_valid(value: str) -> str:
    """GB 11643: 17 weighted digits, the 18th character is the mod-11 check code."""

    def code(digits: str) -> str:
        total = _weighted_sum(digits, ID_CARD_WEIGHTS, lambda c: f"(ascii({c}) - 48)")
        return f"substr({quote(ID_CARD_CHECK_CODES)}, {total} % 11 + 1, 1)"

    return _only_if(
        matches(value, KIND_SHAPES["id_card"]),
        f"upper(substr({value}, 18, 1)) = {let(ascii_digits(value), code)}",
    )


def luhn_valid(value: str) -> str:
    """Mod-10 over a string of digits, every second one from the right doubled.

    A digit counts as its code point minus 48, which for digits outside ASCII is
    not their numeric value; kept so because the rule is defined that way.
    """

    def term(char: str, at: str) -> str:
        digit = f"(ascii({char}) - 48)"
        return f"if({at} % 2 = 0, {digit}, 2 * {digit} - if({digit} > 4, 9, 0))"

    terms = transform_at(f"split(reverse({value}), '')", term)
    return _only_if(matches(value, KIND_SHAPES["luhn"]), f"{_sum(terms)} % 10 = 0")


def bank_card_valid(value: str) -> str:
    length = f"length({value}) BETWEEN 13 AND 19"
    return f"coalesce({length} AND {luhn_valid(value)}, false)"


def uscc_valid(value: str) -> str:
    """GB 32100: 17 weighted base-31 characters, the 18th closes the sum mod 31."""

    def number_of(char: str) -> str:
        return f"(instr({quote(USCC_ALPHABET)}, {char}) - 1)"

    def closes(upper: str) -> str:
        total = _weighted_sum(upper, USCC_WEIGHTS, number_of)
        return f"({total} + {number_of(f'substr({upper}, 18, 1)')}) % 31 = 0"

    return _only_if(
        matches(value, KIND_SHAPES["uscc"]), let(f"upper({value})", closes)
    )


def grouped_bank_card_valid(value: str) -> str:
    return let(f"translate({value}, ' -', '')", bank_card_valid)


# what a value of each checksum kind looks like
KIND_SHAPES = {
    "id_card": rf"\A{DIGIT}{{17}}[0-9Xx]\z",
    "luhn": rf"\A{DIGIT}+\z",
    "bank_card": rf"\A{DIGIT}{{13,19}}\z",
    "uscc": rf"(?i)\A[{USCC_ALPHABET}]{{18}}\z",
}
KIND_VALID = {
    "id_card": id_card_valid,
    "luhn": luhn_valid,
    "bank_card": bank_card_valid,
    "uscc": uscc_valid,
}

# gates a custom pattern may name
GATES = {
    "id_card": id_card_valid,
    "bank_card": grouped_bank_card_valid,
    "uscc": uscc_valid,
}
