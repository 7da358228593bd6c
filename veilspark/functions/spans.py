"""Detection: from a text to an array of hits with offsets.

Spark's regex functions return values, not offsets. But cut at its matches a text
is gap, match, gap, match, .., gap, so a running sum over the lengths of the parts
gives the end of every match.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rules import Rules
from .arrays import running_sum, with_positions
from .recognizers import Recognizer, joint_guard
from .sqltext import (
    exists,
    fresh,
    keep,
    let,
    name,
    quote,
    transform,
    transform_at,
    zip_with,
)

SPANS = "array<struct<start:int,end:int,raw:string>>"
# line and col stay null until a scan places the hits
HIT_FIELDS = "start end ord type raw checksum_valid confidence line col".split()
HIT = (
    "struct<start:int,end:int,ord:int,type:string,raw:string,"
    "checksum_valid:boolean,confidence:double,line:int,col:int>"
)
NO_HITS = f"cast(array() AS array<{HIT}>)"


def detections(text: str, rules: Rules, python_spans: dict | None = None) -> str:
    """``array<HIT>`` of one text, ordered by (start, end, recognizer).

    A plain expression: no shuffle, and usable inside nested types. Built-in
    recognizers run only on rows with a match of their joint guard.
    ``python_spans`` names the columns :func:`with_python_spans` has added, or gives
    for each pattern a function from the text to its spans, as
    :func:`with_leaf_spans` does for leaves of nested values.
    """
    built_in, custom, parts = [], [], []
    for order, recognizer in rules.recognizers():
        if recognizer.guard:
            built_in.append((order, recognizer))
        elif recognizer.python_pattern is not None:
            parts.append(_python_hits(text, order, recognizer, python_spans or {}))
        else:
            custom.append((order, recognizer))
    if custom:
        # one pass decides for most rows that none of the user's patterns matches
        found = [
            f"if(rlike({text}, {quote(r.pattern)}), {_custom_hits(text, order, r)}, {NO_HITS})"
            for order, r in custom
        ]
        guard = quote(_alternatives([r.pattern for _, r in custom]))
        parts.append(f"if(rlike({text}, {guard}), concat({', '.join(found)}), {NO_HITS})")
    if built_in:
        guard = joint_guard([r for _, r in built_in])
        found = _located(text, built_in)
        parts.append(f"if(rlike({text}, {quote(guard)}), {found}, {NO_HITS})")
    if not parts:
        return NO_HITS
    together = parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"
    allowed = keep(together, lambda h: f"NOT {rules.is_allowed(f'{h}.raw')}")
    return f"coalesce(sort_array({allowed}), {NO_HITS})"


def guard_of(rules: Rules) -> str | None:
    """A pattern without a match of which no text holds a hit, None if unknown."""
    recognizers = [r for _, r in rules.recognizers()]
    if not recognizers or not all(r.guard for r in recognizers):
        return None
    return joint_guard(recognizers)


def _alternatives(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def exact_guard_of(rules: Rules) -> str | None:
    """As :func:`guard_of` with the user's patterns: it must be given the very text that
    is searched. None where a pattern needs Python's engine."""
    recognizers = [r for _, r in rules.recognizers()]
    if not recognizers or any(r.python_pattern is not None for r in recognizers):
        return None
    guarded = [r for r in recognizers if r.guard]
    own = [r.pattern for r in recognizers if not r.guard]
    return _alternatives([joint_guard(guarded), *own] if guarded else own)


def copy_fields(item: str, fields: list[str]) -> str:
    """Fields of a struct, for building another struct."""
    return ", ".join(f"{item}.{f} AS {name(f)}" for f in fields)


def positioned(text: str, hits: str) -> str:
    """The hits with their line and column in the text.

    Lines are counted only where there are hits.
    """

    def placed(found: str) -> str:
        positions = with_positions(
            text,
            found,
            lambda hit, line, col: f"struct({copy_fields(hit, HIT_FIELDS[:-2])}, "
            f"{line} AS line, {col} AS col)",
        )
        return f"if(size({found}) > 0, {positions}, {NO_HITS})"

    return let(hits, placed)


def with_python_spans(
    df: DataFrame, text: str, rules: Rules
) -> tuple[DataFrame, dict[int, str]]:
    """Add the spans of patterns that only Python's ``re`` can run, as columns."""
    columns: dict[int, str] = {}
    for order, recognizer in rules.recognizers():
        if recognizer.python_pattern is not None:
            columns[order] = f"_python_spans_{order}"
            find = _python_finder(recognizer.python_pattern)
            df = df.withColumn(columns[order], find(F.expr(text)))
    return df, columns


def _located(text: str, recognizers: list[tuple[int, Recognizer]]) -> str:
    """The hits of several recognizers; the arithmetic on offsets is shared."""

    def all_of(text: str) -> str:
        candidates = ", ".join(_candidates(text, order, r) for order, r in recognizers)
        passing = keep(f"array({candidates})", lambda c: f"{c}.pieces IS NOT NULL")
        return f"flatten({transform(passing, _hits_of)})"

    return let(_without_mark(text), all_of)


# A built-in pattern cannot tell one control character from another, so those that
# serve as marks are swapped for a third one; offsets stay as they are.
_MARK = "\x01"
FEW = 20


def _without_mark(text: str) -> str:
    mark, other = quote(_MARK), quote("\x03")
    return f"if(contains({text}, {mark}), translate({text}, {mark}, {other}), {text})"


def _candidates(text: str, order: int, recognizer: Recognizer) -> str:
    """The text cut at the matches of one pattern, in one pass: gap, match, gap,
    match, .., gap. Null where no match passes its gate."""
    pattern = quote(recognizer.pattern)
    marked = f"regexp_replace({text}, {pattern}, {quote(_MARK + '$0' + _MARK)})"
    pieces = f"split({marked}, {quote(_MARK)}, -1)"
    if len(recognizer.guard) == 1:
        pieces = f"if(rlike({text}, {quote(recognizer.guard[0])}), {pieces}, NULL)"

    def checked(cut: str) -> str:
        if recognizer.gate is None:
            return _candidate(
                order, recognizer, f"if(size({cut}) > 1, {cut}, NULL)", "NULL"
            )
        gates = transform(_matches(cut), recognizer.gate)
        return let(
            gates,
            lambda passed: _candidate(
                order,
                recognizer,
                f"if({exists(passed, lambda p: p)}, {cut}, NULL)",
                passed,
            ),
        )

    return let(pieces, checked)


def _matches(pieces: str) -> str:
    x, i = fresh("x"), fresh("i")
    return f"filter({pieces}, ({x}, {i}) -> {i} % 2 = 1)"


def _candidate(order: int, recognizer: Recognizer, pieces: str, passed: str) -> str:
    constants = ", ".join(
        f"{value} AS {field}" for field, value in _constants(order, recognizer).items()
    )
    return (
        f"struct({constants}, {pieces} AS pieces, "
        f"cast({passed} AS array<boolean>) AS passed)"
    )


def _hits_of(candidate: str) -> str:
    """A running sum over the lengths of the pieces ends every match."""
    pieces = f"{candidate}.pieces"
    kind = {
        field: f"{candidate}.{field}"
        for field in ("ord", "type", "checksum_valid", "confidence")
    }
    ends = running_sum(transform(pieces, lambda p: f"length({p})"))
    ends = f"if(size({pieces}) > {FEW}, {ends}, NULL)"

    def hit(raw: str, i: str, ends: str) -> str:
        passed = f"coalesce(get({candidate}.passed, {i}), {candidate}.passed IS NULL)"
        total, piece = fresh("total"), fresh("piece")
        # a few parts are added up anew for each match, which beats the scan
        added = (
            f"aggregate(slice({pieces}, 1, {i} * 2 + 1), 0, "
            f"({total}, {piece}) -> {total} + length({piece}))"
        )
        start = f"if({ends} IS NULL, {added}, get({ends}, {i} * 2))"
        made = let(start, lambda s: _hit(s, f"{s} + length({raw})", raw, kind))
        return f"if({passed}, {made}, NULL)"

    return let(
        ends,
        lambda e: keep(
            transform_at(_matches(pieces), lambda raw, i: hit(raw, i, e)),
            lambda h: f"{h} IS NOT NULL",
        ),
    )


def _custom_hits(text: str, order: int, recognizer: Recognizer) -> str:
    """Hits of a user's pattern, which may match any character.

    The gaps come from a second pass (``split``), made only where a match passes
    its gate. The length of the group before the value is the value's offset.
    """
    pattern = quote(recognizer.pattern)
    constants = _constants(order, recognizer)

    def group(number: int) -> str:
        return f"regexp_extract_all({text}, {pattern}, {number})"

    def length(part: str) -> str:
        return f"coalesce(length({part}), 0)"

    def located(found: str, values: str, leads: str) -> str:
        ends = running_sum(
            zip_with(
                f"split({text}, {pattern}, -1)",
                found,
                lambda gap, match: f"{length(gap)} + {length(match)}",
            )
        )

        def hit(raw: str, i: str, ends: str) -> str:
            lead = f"coalesce(length(get({leads}, {i})), 0)" if leads else "0"
            start = f"get({ends}, {i}) - length(get({found}, {i})) + {lead}"
            return _hit(start, f"{start} + length({raw})", raw, constants)

        hits = let(ends, lambda e: transform_at(values, lambda raw, i: hit(raw, i, e)))
        if recognizer.gate is None:
            return hits
        return keep(hits, lambda h: recognizer.gate(f"{h}.raw"))

    def if_any(found: str, values: str, leads: str) -> str:
        gate = recognizer.gate or (lambda raw: "true")
        some = exists(values, gate)
        return f"if({some}, {located(found, values, leads)}, {NO_HITS})"

    if recognizer.lead_group is None:
        hits = let(group(0), lambda found: if_any(found, found, ""))
    else:
        hits = let(
            group(0),
            lambda found: let(
                group(recognizer.value_group),
                lambda values: let(
                    group(recognizer.lead_group),
                    lambda leads: if_any(found, values, leads),
                ),
            ),
        )
    return f"coalesce({hits}, {NO_HITS})"


def _constants(order: int, recognizer: Recognizer) -> dict[str, str]:
    return {
        "ord": str(order),
        "type": quote(recognizer.type),
        "checksum_valid": str(recognizer.checked).lower(),
        "confidence": f"{float(recognizer.confidence)!r}D",
    }


def _hit(start: str, end: str, raw: str, kind: dict[str, str]) -> str:
    return f"""struct({start} AS start, {end} AS `end`, {kind["ord"]} AS ord,
        {kind["type"]} AS type, {raw} AS raw, {kind["checksum_valid"]} AS checksum_valid,
        {kind["confidence"]} AS confidence,
        cast(NULL AS int) AS line, cast(NULL AS int) AS col)"""


def _python_hits(text: str, order: int, recognizer: Recognizer, python_spans: dict) -> str:
    if order not in python_spans:
        raise ValueError(
            f"pattern {recognizer.python_pattern!r} needs Python's re: give its spans "
            "by with_python_spans, or by with_leaf_spans for leaves of nested values"
        )
    given = python_spans[order]
    spans = given(text) if callable(given) else name(given)
    if recognizer.gate is not None:
        spans = keep(spans, lambda s: recognizer.gate(f"{s}.raw"))
    constants = _constants(order, recognizer)
    hits = transform(
        spans, lambda s: _hit(f"{s}.start", f"{s}.end", f"{s}.raw", constants)
    )
    return f"coalesce({hits}, {NO_HITS})"


def with_leaf_spans(
    df: DataFrame, leaves: str, rules: Rules
) -> tuple[DataFrame, dict[int, Callable[[str], str]], list[str]]:
    """Spans of the patterns that only Python's ``re`` can run, for every leaf of a row.

    ``leaves`` is an SQL ``array<string>`` of the texts of all leaves of the row (of
    JSON bodies, nested columns, or both), in any order, with repeats and nulls. Its
    distinct texts go to Python once per Arrow batch; each leaf then finds its spans
    by its own text, which is all they depend on, so no path or place need travel.
    Returns the frame with the added columns, the lookup of each pattern for
    :func:`detections`, and the names of the added columns.
    """
    python = [(o, r) for o, r in rules.recognizers() if r.python_pattern is not None]
    if not python:
        return df, {}, []
    x = fresh("leaf")
    df = df.withColumn(
        "_leaves", F.expr(f"array_distinct(filter({leaves}, {x} -> {x} IS NOT NULL))")
    )
    # all patterns in one step: one Python worker a task, whatever their number
    found = {
        f"_leaf_spans_{order}": _python_leaf_finder(recognizer.python_pattern)("_leaves")
        for order, recognizer in python
    }
    tables = {
        f"_leaf_table_{order}": F.map_from_arrays("_leaves", f"_leaf_spans_{order}")
        for order, _ in python
    }
    df = df.withColumns(found).withColumns(tables)
    added, lookups = ["_leaves", *found, *tables], {}
    for order, _ in python:
        table = f"_leaf_table_{order}"
        lookups[order] = lambda text, table=table: (
            f"if({text} IS NULL, NULL, try_element_at({name(table)}, {text}))"
        )
    return df, lookups, added


TEXTS_AT_ONCE = 256
"""Texts that are Python strings at one time."""


def _spans_of(compiled: re.Pattern, texts: pa.Array) -> pa.Array:
    """Spans of the pattern in each text, none in a null one, as Arrow lists.

    Only ``TEXTS_AT_ONCE`` texts and their matches are Python objects at a time.
    """
    group = "v" if "v" in compiled.groupindex else 0
    kind = pa.struct({"start": pa.int32(), "end": pa.int32(), "raw": texts.type})
    parts = [pa.array([], pa.list_(kind))]
    for i in range(0, len(texts), TEXTS_AT_ONCE):
        cuts, starts, ends, raws = [0], [], [], []
        for text in texts.slice(i, TEXTS_AT_ONCE).to_pylist():
            for m in compiled.finditer(text) if text else ():
                if m[group] is not None:
                    starts.append(m.start(group))
                    ends.append(m.end(group))
                    raws.append(m[group])
            cuts.append(len(raws))
        spans = [pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(raws, texts.type)]
        spans = pa.StructArray.from_arrays(spans, fields=list(kind))
        parts.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), spans))
    return pa.concat_arrays(parts)


def _python_leaf_finder(pattern: str):
    """Arrow UDF giving, for an array of texts, the spans of each."""

    @F.arrow_udf(f"array<{SPANS}>")
    def find(leaves: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(leaves), 0)
        ends = pc.cumulative_sum(pc.cast(sizes, pa.int32()))
        cuts = pa.concat_arrays([pa.array([0], pa.int32()), ends])
        spans = _spans_of(re.compile(pattern), leaves.flatten())
        return pa.ListArray.from_arrays(cuts, spans, mask=leaves.is_null())

    return find


def _python_finder(pattern: str):
    """Arrow UDF giving the spans of a pattern by Python's own engine."""

    @F.arrow_udf(SPANS)
    def find(texts: pa.Array) -> pa.Array:
        return _spans_of(re.compile(pattern), texts)

    return find
