"""What is looked for: candidate pattern, gate and confidence per recognizer.

``\\d`` means any decimal digit and ``\\w`` any letter, number or underscore of
any script, spelled out as ``\\p{..}`` classes because Java's shorthands are
ASCII-only. A candidate's first character comes before the look-behind: most
positions of a text then fail on one cheap test.

``guard`` is a cheap necessary condition. All guards are joined into one
pattern; a row without a match of it holds no built-in hit, so the six patterns
never run on it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from .checksums import GATES, ascii_digits
from .fixed_values import CONFIDENCE, INTRANET_SUFFIXES, USCC_CLASS
from .sqltext import fresh

D = r"\p{Nd}"
W = r"\p{L}\p{N}_"
_ALNUM = "0-9A-Za-z"
_BASE31 = USCC_CLASS[1:-1]
_SUFFIX = (
    r"\.(?i:" + "|".join(s[1:].replace(".", r"\.") for s in INTRANET_SUFFIXES) + ")"
)
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\."


@dataclass(frozen=True)
class Recognizer:
    type: str
    name: str
    pattern: str
    confidence: float
    gate: Callable[[str], str] | None = None
    checked: bool = False  # the gate is a check digit
    guard: tuple[str, ...] = ()  # alternatives; a hit contains one of them
    lead_group: int | None = None  # group before the value, else the match is it
    value_group: int = 0
    python_pattern: str | None = None  # for patterns only Python's re can run


def octets_valid(address: str) -> str:
    octet = fresh("octet")
    split = f"split({ascii_digits(address)}, '[.]')"
    return f"forall({split}, {octet} -> coalesce(try_cast({octet} AS int) <= 255, false))"


_OCTETS = rf"\.{D}{{1,3}}\.{D}{{1,3}}"

BUILT_IN = (
    Recognizer(
        type="id_card",
        name="id_card",
        pattern=rf"{D}(?<![{_ALNUM}]{D}){D}{{16}}[0-9Xx](?![{_ALNUM}])",
        confidence=CONFIDENCE["id_card"],
        gate=GATES["id_card"],
        checked=True,
        guard=(rf"{D}{{11}}",),
    ),
    Recognizer(
        type="phone",
        name="phone",
        pattern=rf"1(?<!{D}1)[3-9]{D}{{9}}(?!{D})",
        confidence=CONFIDENCE["phone"],
        guard=(rf"{D}{{11}}",),
    ),
    Recognizer(
        type="bank_card",
        name="bank_card",
        pattern=(
            rf"(?={D})(?<![{D}-])"
            rf"(?:{D}{{13,19}}|{D}{{4}}(?:[ -]{D}{{4}}){{2,4}}(?:[ -]{D}{{1,3}})?)"
            rf"(?![{D}-])"
        ),
        confidence=CONFIDENCE["bank_card"],
        gate=GATES["bank_card"],
        checked=True,
        guard=(rf"{D}{{11}}", rf"{D}{{4}}[ -]{D}{{4}}[ -]{D}{{4}}"),
    ),
    Recognizer(
        type="uscc",
        name="uscc",
        pattern=(
            rf"[{_BASE31}]{{2}}{D}(?<![{_ALNUM}][{_BASE31}]{{2}}{D})"
            rf"{D}{{5}}[{_BASE31}]{{10}}(?![{_ALNUM}])"
        ),
        confidence=CONFIDENCE["uscc"],
        gate=GATES["uscc"],
        checked=True,
        guard=(rf"{D}{{6}}[{_ALNUM}]{{10}}",),
    ),
    Recognizer(
        type="intranet_domain",
        name="private_ip",
        pattern=(
            rf"1(?<![{D}.]1)(?:(?:0|27)\.{D}{{1,3}}{_OCTETS}"
            rf"|92\.168{_OCTETS}|72\.(?:1[6-9]|2{D}|3[01]){_OCTETS})(?![{D}.])"
        ),
        confidence=CONFIDENCE["private_ip"],
        gate=octets_valid,
        guard=(rf"{D}\.{D}{{1,3}}\.{D}",),
    ),
    Recognizer(
        type="intranet_domain",
        name="intranet_host",
        # A match is a whole run of [\w.-], so "ends in an internal suffix" can be
        # asked inside the pattern. The possessive ++ keeps the match iterative:
        # a name of many thousand labels would otherwise exhaust the stack.
        pattern=(
            rf"(?=[A-Za-z0-9])(?<![{W}.-])(?:{_LABEL})++[A-Za-z]{{2,}}"
            rf"(?<={_SUFFIX})(?![{W}.-])"
        ),
        confidence=CONFIDENCE["intranet_host"],
        guard=(rf"{_SUFFIX}(?![{W}.-])",),
    ),
)


def joint_guard(recognizers: list[Recognizer]) -> str:
    """Every guard starts with a digit or a dot, so most characters fail at once."""
    alternatives = dict.fromkeys(g for r in recognizers for g in r.guard)
    return rf"(?=[.{D}])(?:{'|'.join(alternatives)})"
