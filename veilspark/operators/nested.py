"""Redaction of every leaf of nested columns and of JSON texts.

Typed columns: an expression is generated from the schema; strings are masked,
numbers become VARIANT values that are a masked string where they held a hit and
the same number elsewhere; keys, booleans and all other types are untouched.

JSON texts of unknown schema: the text is taken apart into its string and number
tokens, each leaf token is rewritten and the parts are joined again, so key order
and nesting need no schema and stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.masking import NO_REDACTIONS, is_blocked, redact
from ..functions.numbers import float_text, integer_text
from ..functions.spans import exact_guard_of, guard_of, with_leaf_spans
from ..functions.sqltext import (
    fresh,
    let,
    name,
    quote,
    transform,
    zip_with,
)
from ..rules import Rules

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)


# -- typed columns ------------------------------------------------------------


def redact_columns(
    df: DataFrame,
    rules: Rules,
    columns: Sequence[str] | None = None,
    numbers: str = "variant",
) -> DataFrame:
    """Every string and number leaf of the columns masked.

    Adds ``redactions``, those of all leaves of the row, and ``blocked``.
    ``numbers`` is the type a number column turns into: ``variant`` keeps the
    values without a hit as numbers, ``string`` gives text throughout.
    """
    if numbers not in ("variant", "string"):
        raise ValueError("numbers must be variant or string")
    chosen = list(df.columns if columns is None else columns)
    kinds = {c: df.schema[c].dataType for c in chosen}
    flat = [c for c in chosen if _leaf_text(name(c), kinds[c]) is not None]
    deep = [c for c in chosen if c not in flat and _has_leaf(kinds[c])]

    # First every leaf is redacted, then the results are put in place: the long
    # redaction expression stands once for all flat columns and once for each
    # leaf of a nested type.
    texts = ", ".join(_leaf_text(name(c), kinds[c]) for c in flat)
    leaves = [f"array({texts})"] if flat else []
    leaves += [_leaves(name(c), kinds[c]) for c in deep]
    done, spans, _ = with_leaf_spans(df, f"concat({', '.join(leaves) or 'array()'})", rules)
    if flat:
        done = done.withColumn(
            "_flat",
            F.expr(transform(f"array({texts})", lambda t: redact(t, rules, python_spans=spans))),
        )
    for c in deep:
        done = done.withColumn(f"_done_{c}", F.expr(_done(name(c), kinds[c], rules, spans)))

    masked, parts = {}, []
    for i, c in enumerate(flat):
        result = f"get(_flat, {i})"
        masked[c] = _masked_leaf(name(c), result, kinds[c], numbers)
        parts.append(f"{result}.redactions")
    for c in deep:
        result = name(f"_done_{c}")
        masked[c] = _masked(result, kinds[c], numbers)
        parts.append(_redactions(result, kinds[c]))
    together = f"concat({', '.join(parts)})" if parts else NO_REDACTIONS
    return done.select(
        *[F.expr(masked.get(c, name(c))).alias(c) for c in df.columns],
        F.expr(together).alias("redactions"),
    ).withColumn("blocked", F.expr(is_blocked("redactions")))


def _leaf_text(value: str, kind: T.DataType) -> str | None:
    """What is searched of a leaf, None for other types."""
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, _INTEGRAL):
        return integer_text(value)
    if isinstance(kind, T.DecimalType) and kind.scale == 0:
        return integer_text(value)
    if isinstance(kind, (*_FLOATING, T.DecimalType)):
        return float_text(value)
    return None


def _has_leaf(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_leaf(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_leaf(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_has_leaf(f.dataType) for f in kind.fields)
    return isinstance(kind, T.VariantType) or _leaf_text("x", kind) is not None


def _rebuild(value: str, kind: T.DataType, leaf: Callable[[str, T.DataType], str]) -> str:
    """The value with ``leaf`` applied to every leaf, keys and shape unchanged."""
    if not _has_leaf(kind):
        return value
    if isinstance(kind, T.ArrayType):
        return transform(value, lambda x: _rebuild(x, kind.elementType, leaf))
    if isinstance(kind, T.MapType):
        key, item = fresh("k"), fresh("x")
        inner = _rebuild(item, kind.valueType, leaf)
        return f"transform_values({value}, ({key}, {item}) -> {inner})"
    if isinstance(kind, T.StructType):
        fields = ", ".join(
            f"{_rebuild(f'{value}.{name(f.name)}', f.dataType, leaf)} AS {name(f.name)}"
            for f in kind.fields
        )
        return f"if({value} IS NULL, NULL, struct({fields}))"
    return leaf(value, kind)


_NO_LEAVES = "cast(array() AS array<string>)"


def _leaves(value: str, kind: T.DataType) -> str:
    """``array<string>`` of the texts of all leaves of a value, as they are searched;
    never null."""
    if not _has_leaf(kind):
        return _NO_LEAVES
    if isinstance(kind, (T.ArrayType, T.MapType)):
        items = value if isinstance(kind, T.ArrayType) else f"map_values({value})"
        inner = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType
        return f"coalesce(flatten({transform(items, lambda x: _leaves(x, inner))}), {_NO_LEAVES})"
    if isinstance(kind, T.StructType):
        parts = [_leaves(f"{value}.{name(f.name)}", f.dataType) for f in kind.fields]
        return f"if({value} IS NULL, {_NO_LEAVES}, concat({', '.join(parts)}))"
    if isinstance(kind, T.VariantType):
        return f"coalesce({json_leaves(f'to_json({value})')}, {_NO_LEAVES})"
    return f"array({_leaf_text(value, kind)})"


def json_leaves(body: str) -> str:
    """``array<string>``: the body itself and the text of each of its tokens, as
    :func:`redact_json` and :func:`redact_payloads` search them."""
    tokens = f"regexp_extract_all({body}, {quote(JSON_TOKEN)}, 0)"
    return f"concat(array({body}), {transform(tokens, _leaf_of)})"


def _done(value: str, kind: T.DataType, rules: Rules, spans: dict | None = None) -> str:
    """The same shape with each leaf turned into the leaf and its redaction."""

    def leaf(x: str, k: T.DataType) -> str:
        if isinstance(k, T.VariantType):
            result = let(f"to_json({x})", lambda t: redact_json(t, rules, spans))
        else:
            result = let(_leaf_text(x, k), lambda t: redact(t, rules, python_spans=spans))
        return f"struct({x} AS original, {result} AS result)"

    return _rebuild(value, kind, leaf)


def _masked(done: str, kind: T.DataType, numbers: str) -> str:
    return _rebuild(
        done,
        kind,
        lambda x, k: _masked_leaf(f"{x}.original", f"{x}.result", k, numbers),
    )


def _masked_leaf(original: str, result: str, kind: T.DataType, numbers: str) -> str:
    if isinstance(kind, T.StringType):
        return f"{result}.text"
    if isinstance(kind, T.VariantType):
        changed = f"coalesce(size({result}.redactions), 0) > 0"
        return f"if({changed}, parse_json({result}.text), {original})"
    same = original if numbers == "variant" else f"{result}.text"
    return (
        f"if(size({result}.redactions) > 0, "
        f"cast({result}.text AS {numbers}), cast({same} AS {numbers}))"
    )


def _redactions(done: str, kind: T.DataType) -> str:
    """The redactions of all leaves of a value in one array."""
    if not _has_leaf(kind):
        return NO_REDACTIONS
    if isinstance(kind, T.StructType):
        parts = [
            _redactions(f"{done}.{name(f.name)}", f.dataType)
            for f in kind.fields
            if _has_leaf(f.dataType)
        ]
        return f"concat({', '.join(parts)})"
    if isinstance(kind, (T.ArrayType, T.MapType)):
        is_map = isinstance(kind, T.MapType)
        items = f"map_values({done})" if is_map else done
        inner = kind.valueType if is_map else kind.elementType
        each = transform(items, lambda x: _redactions(x, inner))
        return f"coalesce(flatten({each}), {NO_REDACTIONS})"
    return f"coalesce({done}.result.redactions, {NO_REDACTIONS})"


# -- JSON texts ---------------------------------------------------------------

# A string (with its colon if it is a key) or a number. Possessive throughout:
# the match never backtracks and never recurses.
JSON_TOKEN = (
    r'"(?:[^"\\]++|\\.)*+"(?:\s*+:)?+'
    r"|-?+[0-9]++(?:\.[0-9]++)?+(?:[eE][+-]?+[0-9]++)?+"
)
# escapes that may hide a digit, or that output spells in another way
_OTHER_SPELLING = r"\\[u/]"


def is_json(body: str) -> str:
    """True for one whole JSON value other than null.

    Wrapped in a list and in a map, since the parser stops after the first value
    and text after it must not pass. What the parser refuses may only be too long, too
    deep or have a key twice: then the grammar itself decides, which has no limits.
    """
    tests = [
        f"try_parse_json(concat({quote(left)}, {body}, {quote(right)})) IS NOT NULL"
        for left, right in (("[", "]"), ('{"v":', "}"))
    ]
    return (
        f"coalesce(trim({body}) <> 'null' AND (({' AND '.join(tests)}) "
        f"OR {_fits_grammar(body)}), false)"
    )


# Possessive throughout, as above. \x01 stands for a string, \x02 for any other value;
# JSON holds neither.
_GRAMMAR_STRING = r'"(?:[^"\\\x00-\x1f]++|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*+"'
_GRAMMAR_VALUE = (
    r"-?+(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?+[0-9]++)?+(?![0-9.eE])"
    r"|true|false|null|NaN|-?Infinity"
)
_INNERMOST = (
    r"\{(?:\x01:[\x01\x02](?:,\x01:[\x01\x02])*+)?+\}"
    r"|\[(?:[\x01\x02](?:,[\x01\x02])*+)?+\]"
)


def _fits_grammar(body: str) -> str:
    """Tokens become single characters, and the innermost brackets values, level by level."""

    def replaced(text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, {quote(pattern)}, {quote(by)})"

    def reduced(tokens: str) -> str:
        brackets = f"split({replaced(tokens, r'[^\[\]{}]', '')}, '')"
        depth, bracket, value, level = (fresh(x) for x in "dbvl")
        deepest = (
            f"aggregate({brackets}, struct(0 AS now, 1 AS most), ({depth}, {bracket}) -> struct("
            f"{depth}.now + CASE WHEN {bracket} IN ('[', '{{') THEN 1 "
            f"WHEN {bracket} = '' THEN 0 ELSE -1 END AS now, "
            f"greatest({depth}.most, {depth}.now + 1) AS most)).most"
        )
        return (
            f"aggregate(sequence(1, {deepest}), {tokens}, ({value}, {level}) -> "
            f"{replaced(value, _INNERMOST, chr(2))}) IN ({quote(chr(1))}, {quote(chr(2))})"
        )

    tokens = replaced(body, _GRAMMAR_STRING, "\x01")
    tokens = replaced(tokens, _GRAMMAR_VALUE, "\x02")
    tokens = replaced(tokens, r"[ \t\r\n]", "")
    opens = f"rlike({body}, {quote(r'^[ \t\r\n]*[\[{]')})"
    foreign = f"rlike({body}, {quote(r'[\x01\x02]')})"
    return f"({opens} AND NOT {foreign} AND {let(tokens, reduced)})"


def redact_json(body: str, rules: Rules, spans: dict | None = None) -> str:
    """``struct<text, redactions, blocked>`` of a JSON text, leaf by leaf.

    Parts are spaced as ``", "`` and ``": "``, untouched leaves keep their value,
    a number with a hit becomes a string. ``spans`` are the lookups of
    :func:`~veilspark.functions.spans.with_leaf_spans` over :func:`json_leaves`, for
    patterns that need Python's engine.
    """

    def unchanged(token: str) -> str:
        return f"struct({token} AS token, {NO_REDACTIONS} AS redactions)"

    def redacted(token: str, leaf: str) -> str:
        def result(done: str) -> str:
            spelled = (
                f"if(size({done}.redactions) > 0, "
                f"{_as_json_string(f'{done}.text')}, {_spelled(token, leaf)})"
            )
            return f"struct({spelled} AS token, {done}.redactions AS redactions)"

        return let(redact(leaf, rules, python_spans=spans), result)

    def rewritten(token: str) -> str:
        key = f"regexp_replace({token}, r'\\s*:\\z', ': ')"
        return f"""CASE
            WHEN startswith({token}, '"') AND endswith({token}, ':') THEN {unchanged(key)}
            WHEN {_settled(token, rules)} THEN {unchanged(token)}
            ELSE {let(_leaf_of(token), lambda leaf: redacted(token, leaf))} END"""

    def joined(done: str) -> str:
        gaps = f"split({body}, {quote(JSON_TOKEN)}, -1)"
        spaced = transform(
            gaps, lambda g: f"replace(regexp_replace({g}, r'\\s', ''), ',', ', ')"
        )
        tokens = transform(done, lambda d: f"{d}.token")
        pairs = zip_with(spaced, tokens, lambda g, t: f"concat({g}, coalesce({t}, ''))")
        redactions = f"flatten({transform(done, lambda d: f'{d}.redactions')})"
        return let(
            redactions,
            lambda r: f"struct(array_join({pairs}, '') AS text, {r} AS redactions, "
            f"{is_blocked(r)} AS blocked)",
        )

    tokens = f"regexp_extract_all({body}, {quote(JSON_TOKEN)}, 0)"
    return let(transform(tokens, rewritten), joined)


def _settled(token: str, rules: Rules) -> str:
    """A string token that stays as it is, seen without decoding it: no hit can be
    in it, and none of its escapes is spelled otherwise on output."""
    guard = guard_of(rules)
    if guard is None and (exact := exact_guard_of(rules)) is not None:
        inner = f"substr({token}, 2, length({token}) - 2)"
        return (
            f"startswith({token}, '\"') AND NOT contains({token}, '\\\\') "
            f"AND NOT rlike({inner}, {quote(exact)})"
        )
    if guard is None:
        return "false"
    return (
        f"startswith({token}, '\"') AND NOT rlike({token}, {quote(guard)}) "
        f"AND NOT rlike({token}, {quote(_OTHER_SPELLING)})"
    )


def _leaf_of(token: str) -> str:
    """The text of a leaf token."""
    inner = f"substr({token}, 2, length({token}) - 2)"
    decoded = f"""from_json(concat('{{"v":', {token}, '}}'), 'v string').v"""
    return f"""CASE
        WHEN startswith({token}, '"') AND contains({token}, '\\\\') THEN {decoded}
        WHEN startswith({token}, '"') THEN {inner}
        WHEN rlike({token}, '[.eE]') THEN {float_text(token)}
        ELSE {token} END"""


def _spelled(token: str, leaf: str) -> str:
    """An untouched leaf: escapes resolved where they are not needed."""
    return f"""CASE
        WHEN startswith({token}, '"') AND contains({token}, '\\\\')
        THEN {_as_json_string(leaf)}
        WHEN startswith({token}, '"') THEN {token}
        ELSE {leaf} END"""


def _as_json_string(text: str) -> str:
    return let(
        f"to_json(struct({text} AS v))", lambda j: f"substr({j}, 6, length({j}) - 6)"
    )


def redact_payloads(
    df: DataFrame, rules: Rules, body: str = "body", content_type: str = "content_type"
) -> DataFrame:
    """Request bodies by content type: JSON leaf by leaf, anything else as text.

    A JSON content type whose body is not JSON, or is null, is taken as text.
    """
    column = name(body)
    json_type = f"contains(lower({name(content_type)}), 'application/json')"
    done, spans, added = with_leaf_spans(df, json_leaves(column), rules)
    done = done.withColumn(
        "_done",
        F.expr(
            f"if(coalesce({json_type}, false) AND {is_json(column)}, "
            f"{redact_json(column, rules, spans)}, {redact(column, rules, python_spans=spans)})"
        ),
    )
    return (
        done.withColumn(body, F.col("_done.text"))
        .withColumn("redactions", F.col("_done.redactions"))
        .withColumn("blocked", F.col("_done.blocked"))
        .drop("_done", *added)
    )


def redact_json_column(df: DataFrame, rules: Rules, body: str = "body") -> DataFrame:
    """A column of JSON texts, leaf by leaf; what is not JSON is masked as text."""
    typed = df.withColumn("_type", F.lit("application/json"))
    return redact_payloads(typed, rules, body, "_type").drop("_type")


def redact_chat(df: DataFrame, rules: Rules, body: str = "body") -> DataFrame:
    """Model requests: every leaf of the whole request masked, whatever its keys.

    Adds ``redactions`` and ``blocked``. A request that is not JSON is masked as text.
    """
    return redact_json_column(df, rules, body)


def chat_requests(
    turns: DataFrame, key: str, order: str, role: str, content: str, **settings
) -> DataFrame:
    """(key, body): one request for each conversation, its messages in order.

    ``settings`` are further keys of the request, before and after ``messages`` as
    they are given: a setting of ``...`` marks the place of the messages.
    """
    message = F.struct(F.col(role).alias("role"), F.col(content).alias("content"))
    gathered = turns.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(order, message.alias("m")))).alias("all")
    )
    messages = F.transform("all", lambda x: x["m"]).alias("messages")
    fields = [
        messages if value is ... else F.lit(value).alias(name_)
        for name_, value in settings.items()
    ]
    if ... not in settings.values():
        fields.append(messages)
    return gathered.select(key, F.to_json(F.struct(*fields)).alias("body"))
