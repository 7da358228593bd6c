"""Composing SQL expressions as text.

The expressions of this library are deep: built node by node through the Python
API one of them costs seconds of driver time, parsed as one SQL expression it
costs milliseconds. A fragment is a ``str`` holding a SQL expression.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

_numbers = itertools.count(1)


def fresh(stem: str) -> str:
    """A lambda variable name no enclosing fragment uses."""
    return f"{stem}_{next(_numbers)}"


def quote(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(column: str) -> str:
    """A column name, quoted."""
    return "`" + column.replace("`", "``") + "`"


def let(value: str, body: Callable[[str], str]) -> str:
    """Evaluate ``value`` once per row and use it many times in ``body``.

    Catalyst shares common subexpressions in generated code only, not in the
    interpreted part under a higher-order function.
    """
    var = fresh("v")
    return f"get(transform(array({value}), {var} -> {body(var)}), 0)"


def transform(array: str, body: Callable[[str], str]) -> str:
    var = fresh("x")
    return f"transform({array}, {var} -> {body(var)})"


def transform_at(array: str, body: Callable[[str, str], str]) -> str:
    var, at = fresh("x"), fresh("i")
    return f"transform({array}, ({var}, {at}) -> {body(var, at)})"


def keep(array: str, test: Callable[[str], str]) -> str:
    var = fresh("x")
    return f"filter({array}, {var} -> {test(var)})"


def exists(array: str, test: Callable[[str], str]) -> str:
    var = fresh("x")
    return f"exists({array}, {var} -> {test(var)})"


def zip_with(left: str, right: str, body: Callable[[str, str], str]) -> str:
    a, b = fresh("a"), fresh("b")
    return f"zip_with({left}, {right}, ({a}, {b}) -> {body(a, b)})"


def case(key: str, table: dict[str, str], fallback: str) -> str:
    """Look ``key`` up in a small table of fragments."""
    if not table:
        return fallback
    whens = " ".join(f"WHEN {quote(k)} THEN {v}" for k, v in table.items())
    return f"CASE {key} {whens} ELSE {fallback} END"
