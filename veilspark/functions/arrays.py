"""Work inside one row that stays near linear.

A row may hold a very long text with very many hits, so nothing here may cost
(hits x text length) or (hits x hits):

* ``running`` is a prefix scan in chunks of about sqrt(n) elements;
* ``blocks_of`` cuts a text once into blocks of fixed size, after which any span
  or position is found inside one block.
"""

from __future__ import annotations

from collections.abc import Callable

from .sqltext import fresh, let, transform, transform_at

BLOCK = 4096  # a power of two


def running(values: str, combine: Callable[[str, str], str]) -> str:
    """Inclusive prefix scan, from 0, of an int array."""

    def fold(part: str) -> str:
        done, x = fresh("done"), fresh("x")
        step = combine(f"element_at({done}, -1)", x)
        return f"aggregate({part}, array(0), ({done}, {x}) -> concat({done}, array({step})))"

    def scan(items: str, width: str) -> str:
        starts = f"sequence(1, size({items}), {width})"
        chunks = transform(starts, lambda at: fold(f"slice({items}, {at}, {width})"))
        return let(chunks, join)

    def join(chunks: str) -> str:
        totals = transform(chunks, lambda c: f"element_at({c}, -1)")
        return let(
            fold(totals),
            lambda carried: "flatten("
            + transform_at(
                chunks,
                lambda c, i: transform(
                    f"slice({c}, 2, size({c}))",
                    lambda x: combine(f"get({carried}, {i})", x),
                ),
            )
            + ")",
        )

    def chunked(items: str) -> str:
        width = f"cast(ceil(sqrt(size({items}))) AS int)"
        scanned = let(width, lambda w: scan(items, w))
        return f"if(size({items}) > 0, {scanned}, cast(array() AS array<int>))"

    return let(values, chunked)


def running_sum(values: str) -> str:
    return running(values, lambda a, b: f"({a} + {b})")


def running_max(values: str) -> str:
    return running(values, lambda a, b: f"greatest({a}, {b})")


def blocks_of(text: str) -> str:
    # [\s\S] is one character whatever it is, line ends included
    blocks = f"regexp_extract_all({text}, r'[\\s\\S]{{1,{BLOCK}}}', 0)"
    return f"if(length({text}) <= {BLOCK}, array({text}), {blocks})"


def block_at(offset: str) -> str:
    return f"shiftright({offset}, {BLOCK.bit_length() - 1})"


def cut(blocks: str, start: str, end: str) -> str:
    """``text[start:end]``, 0-based characters, from the blocks of the text."""

    def between(a: str, b: str) -> str:
        across = let(
            f"struct({block_at(a)} AS p, {block_at(b)} AS q, {a} % {BLOCK} AS i, {b} % {BLOCK} AS j)",
            lambda at: f"""CASE
                WHEN {at}.p > {at}.q OR ({at}.p = {at}.q AND {at}.i >= {at}.j) THEN ''
                WHEN {at}.p = {at}.q
                THEN substr(get({blocks}, {at}.p), {at}.i + 1, {at}.j - {at}.i)
                ELSE concat(
                    substr(get({blocks}, {at}.p), {at}.i + 1, {BLOCK}),
                    array_join(slice({blocks}, {at}.p + 2, {at}.q - {at}.p - 1), ''),
                    coalesce(substr(get({blocks}, {at}.q), 1, {at}.j), ''))
                END""",
        )
        within = f"substr(get({blocks}, 0), {a} + 1, {b} - {a})"
        return f"if(size({blocks}) = 1, {within}, {across})"

    return between(start, end)


def count_newlines(text: str) -> str:
    return f"(length({text}) - length(replace({text}, '\\n', '')))"


def after_last_newline(text: str) -> str:
    """Number of characters after the last newline."""
    return f"length(substring_index({text}, '\\n', -1))"


def with_positions(text: str, hits: str, build: Callable[[str, str, str], str]) -> str:
    """``build(hit, line, col)`` of each hit; 1-based, only ``\\n`` ends a line."""

    def line_table(blocks: str) -> str:
        newlines = running_sum(transform(blocks, count_newlines))
        # where the last line begun inside the block starts, 0 if none did
        starts = running_max(
            transform_at(
                blocks,
                lambda b, i: f"if(contains({b}, '\\n'), "
                f"{i} * {BLOCK} + length({b}) - {after_last_newline(b)}, 0)",
            )
        )
        table = f"struct({newlines} AS newlines, {starts} AS starts)"
        # a text of one block has nothing before the block
        return f"if(size({blocks}) = 1, NULL, {table})"

    def place(blocks: str, lines: str) -> str:
        def one(hit: str) -> str:
            at = block_at(f"{hit}.start")
            before = f"coalesce(substr(get({blocks}, {at}), 1, {hit}.start % {BLOCK}), '')"

            def located(pre: str) -> str:
                line = (
                    f"coalesce(get({lines}.newlines, {at} - 1), 0)"
                    f" + {count_newlines(pre)} + 1"
                )
                col = (
                    f"if(contains({pre}, '\\n'), {after_last_newline(pre)}, "
                    f"{hit}.start - coalesce(get({lines}.starts, {at} - 1), 0)) + 1"
                )
                return build(hit, line, col)

            return let(before, located)

        return transform(hits, one)

    def with_blocks(blocks: str) -> str:
        return let(line_table(blocks), lambda lines: place(blocks, lines))

    return let(blocks_of(text), with_blocks)
