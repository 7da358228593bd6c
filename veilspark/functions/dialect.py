"""User patterns are written for Python's ``re``; Spark runs Java's.

``to_java`` rewrites what differs. What it does not know for certain gets
``None`` and is left to Python's own engine in an Arrow UDF (``spans.py``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from .recognizers import D, W

# Fixed value: what str.isspace() accepts
_SPACE = (
    r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
_SHORTHAND = {
    r"\d": D,
    r"\D": r"\P{Nd}",
    r"\w": f"[{W}]",
    r"\W": f"[^{W}]",
    r"\s": f"[{_SPACE}]",
    r"\S": f"[^{_SPACE}]",
    r"\b": f"(?:(?<=[{W}])(?![{W}])|(?<![{W}])(?=[{W}]))",
    r"\A": r"\A",
    r"\Z": r"\z",
    ".": r"[^\n]",
    "^": r"\A",
    "$": r"(?=\n?\z)",
}
_IN_CLASS = {r"\d": D, r"\w": W, r"\s": _SPACE}
_TOKEN = re.compile(
    r"(?P<escape>\\.)"
    r"|(?P<set>\[\^?\]?(?:\\.|[^\]\\])*\])"
    r"|(?P<named>\(\?P<(?P<name>\w+)>)"
    r"|(?P<open>\((?:\?(?::|<?[=!]))?(?!\?))"
    r"|(?P<close>\))"
    r"|(?P<repeat>\{\d+(?:,\d*)?\}|[*+?])"
    r"|(?P<bar>\|)"
    r"|(?P<brace>[{}])"
    r"|(?P<special>[.^$])"
    r"|(?P<literal>[^\\\[\](){}*+?|.^$])",
    re.S,
)
_PLAIN_ESCAPE = re.compile(r"\\(?:[^0-9A-Za-z]|[nrtf])")


@dataclass(frozen=True)
class JavaPattern:
    pattern: str
    lead_group: int | None
    value_group: int


# Java matches a repeated group by recursion, so a long match ends the stack; Python's
# engine does not. Repeats of a single character are loops in both.
_OPEN_REPEAT = re.compile(r"[*+]|\{\d*,\}|\{(?:\d*,)?\d{3,}\}")


def to_java(pattern: str) -> JavaPattern | None:
    """The Java form of a Python pattern, or None where it is not certain.

    With a group named ``v`` the text before it is captured as well: the length
    of that capture is the offset of the value inside the match.
    """
    if re.compile(pattern).groupindex.keys() - {"v"} or _may_be_empty(pattern):
        return None
    out: list[str] = []
    depth = groups = at = 0
    value_at = value_group = None
    value_closed = False
    top_level_bar = False
    while at < len(pattern):
        token = _TOKEN.match(pattern, at)
        if token is None or token["brace"]:
            return None
        piece, at = token[0], token.end()
        if token["escape"]:
            if piece in _SHORTHAND:
                piece = _SHORTHAND[piece]
            elif not _PLAIN_ESCAPE.fullmatch(piece):
                return None
        elif token["set"]:
            piece = _set_to_java(piece)
            if piece is None:
                return None
        elif token["named"]:
            if depth:
                return None
            groups += 1
            value_at, value_group = len(out), groups
            depth += 1
            piece = "("
        elif token["open"]:
            groups += piece == "("
            depth += 1
        elif token["close"]:
            depth -= 1
            if _OPEN_REPEAT.match(pattern, at):
                return None
            if value_at is not None and not value_closed and depth == 0:
                value_closed = True
                if re.match(r"[*+?{]", pattern[at:]):
                    return None
        elif token["bar"]:
            top_level_bar |= depth == 0
        elif token["special"]:
            piece = _SHORTHAND[piece]
        out.append(piece)
    if value_at is None:
        return JavaPattern("".join(out), None, 0)
    if top_level_bar:
        return None
    lead, rest = "".join(out[:value_at]), "".join(out[value_at:])
    return JavaPattern(f"({lead}){rest}", 1, value_group + 1)


def _may_be_empty(pattern: str) -> bool:
    return re._parser.parse(pattern).getwidth()[0] == 0


def _set_to_java(piece: str) -> str | None:
    """A character set, unless it holds what the two engines read differently."""
    negated = piece.startswith("[^")
    body = piece[2 if negated else 1 : -1]
    out = []
    for item in re.findall(r"\\.|[\s\S]", body):
        if item in _IN_CLASS:
            item = _IN_CLASS[item]
        elif item in "[&" or (
            item.startswith("\\") and not _PLAIN_ESCAPE.fullmatch(item)
        ):
            return None
        elif item in "]^":
            item = "\\" + item
        out.append(item)
    return ("[^" if negated else "[") + "".join(out) + "]"
