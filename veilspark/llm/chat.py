"""Chat formatting: a hidden Markov model recovers the speakers of a transcript.

What is seen of each line (or message) is a symbol made of its speaker marker and of
features of its shape; what is hidden is its role. Chances of roles, of their sequence
and of symbols are counted from labelled rows, and Viterbi's algorithm finds the
likeliest roles of each transcript, which are then rendered in one canonical form.

A transcript may hold any share of all rows. Lines are sorted into ranges, and a
transcript that crosses ranges is solved range by range: each range sums its part up in
a matrix of best scores from state to state (a few numbers), these are chained in
order, and each range then decodes with the scores that reach it and the state that it
must end in. Scores are whole numbers, so the result does not depend on the cuts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import stored

ROLES = ("system", "user", "assistant")
# Names that transcripts give the speakers.
MARKERS = {
    "system": "system|sys|instructions?|context",
    "user": "user|human|customer|client|question|q|me|you|prompter|guest",
    "assistant": "assistant|ai|bot|chatbot|agent|answer|a|model|gpt|support",
}
SYMBOLS = 4 * 8 * 4 * 2
SCALE = 1000
"""Scores are logarithms in thousandths."""
FAR = -(1 << 40)

_OPEN, _CLOSE = r"^\s{0,4}(?:[#*>\[<|]{1,3}\s?)?", r"(?:\s?[\]>|*]{1,3})?\s{0,2}[:>\]]\s?"


def marker(text: str) -> Column:
    """1, 2 or 3 for the role that a line's beginning names, else 0."""
    out = F.lit(0)
    for i, role in enumerate(ROLES):
        found = F.col(text).rlike(f"(?i){_OPEN}(?:{MARKERS[role]}){_CLOSE}")
        out = F.when(found, i + 1).otherwise(out)
    return F.when(F.col(text).isNull(), 0).otherwise(out)


def symbol(text: str) -> Column:
    """What the model sees of a line: marker, length, number of lines, question."""
    length = F.coalesce(F.length(text), F.lit(0))
    size = F.least(F.floor(F.log2((length + 16) / F.lit(16.0))), F.lit(7))
    breaks = length - F.coalesce(F.length(F.translate(text, "\n", "")), F.lit(0))
    lines = F.when(breaks > 2, 3).otherwise(breaks)
    asks = F.coalesce(F.rtrim(text).endswith("?"), F.lit(False)).cast("int")
    return (((marker(text) * 8 + size) * 4 + lines) * 2 + asks).cast("int")


def transcript_lines(transcripts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(conv_id, turn, text): the lines of whole transcripts, blank ones left out.

    A null or empty transcript has no lines.
    """
    lines = transcripts.select(
        F.col(key).alias("conv_id"), F.posexplode(F.split(text, "\n")).alias("turn", "text")
    )
    return lines.filter(F.trim("text") != "").withColumn("turn", F.col("turn").cast("long"))


@dataclass
class Model:
    """Scores of first roles, of the next role by role, and of symbols by role."""

    first: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("conv_id").cast("string")) % 4 == 2, F.lit(False))


def _in_ranges(lines: DataFrame) -> DataFrame:
    """The rows in order of transcript and turn, nulls last, numbered range by range.

    Ties are ordered by text and role; rows equal in all of these are alike.
    """
    order = [F.col("conv_id").isNull(), "conv_id", F.col("turn").isNull(), "turn"]
    order += [F.xxhash64("text", "role")]
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order, "text", "role")
    return stored(dealt.withColumn("id", F.monotonically_increasing_id()), "lines")


def learn(ranged: DataFrame) -> Model:
    """Counts over all labelled transcripts that are not held out, one added to each.

    Rows with a null or another role teach nothing. Without any the markers decide.
    """
    number = F.coalesce(
        *[F.when(F.col("role") == role, F.lit(i)) for i, role in enumerate(ROLES)]
    )
    rows = ranged.select("id", "conv_id", number.alias("r"), "symbol", "part")
    before = F.lag(F.struct("conv_id", "r")).over(W.partitionBy("part").orderBy("id"))
    rows = rows.withColumn("before", before)
    # what precedes the first row of a range is the last of the range before
    ends = rows.groupBy("part").agg(
        F.max_by(F.struct("conv_id", "r"), "id").alias("end"), F.min("id").alias("id")
    )
    ends = ends.select("id", F.lag("end").over(W.orderBy("part")).alias("end"))
    rows = rows.join(F.broadcast(ends), "id", "left")
    rows = rows.withColumn("before", F.coalesce("before", "end"))
    same = F.coalesce(rows["before.conv_id"].eqNullSafe(rows["conv_id"]), F.lit(False))
    counts = (
        rows.filter(~held_out() & F.col("r").isNotNull())
        .groupBy(
            F.when(same & F.col("before").isNotNull(), F.coalesce("before.r", F.lit(-2)))
            .otherwise(F.lit(-1))
            .alias("p"),
            "r",
            "symbol",
        )
        .count()
        .collect()  # at most one row for each pair of roles and symbol
    )
    k = len(ROLES)
    first, step = np.ones(k), np.ones((k, k))
    emit = np.full((k, SYMBOLS), 0.1)
    marks = np.arange(SYMBOLS) // 64
    for i in range(k):
        emit[i, marks == i + 1] += 10.0  # a marker names its role until data say otherwise
    for row in counts:
        if row.p == -1:
            first[row.r] += row["count"]
        elif row.p >= 0:
            step[row.p, row.r] += row["count"]
        emit[row.r, row.symbol] += row["count"]
    score = lambda m: np.round(SCALE * np.log(m / m.sum(-1, keepdims=True))).astype(np.int64)
    return Model(score(first), score(step), score(emit))


def _chain(matrices: np.ndarray) -> np.ndarray:
    """The product of a sequence of score matrices, where times is plus and plus is max."""
    while len(matrices) > 1:
        n = len(matrices) // 2
        pair = (matrices[0 : 2 * n : 2, :, :, None] + matrices[1 : 2 * n : 2, None]).max(2)
        matrices = np.concatenate([pair, matrices[2 * n :]])
    return matrices[0]


def _segments(keys: list) -> np.ndarray:
    """Where transcripts begin in the sorted rows of a range."""
    return np.array([i for i, k in enumerate(keys) if i == 0 or k != keys[i - 1]], np.int64)


def _summary(table: pa.Table, model: Model) -> pa.Table:
    """What a range says about the transcripts that cross its ends."""
    table = table.sort_by("id")
    keys, symbols = table["conv_id"].to_pylist(), table["symbol"].to_numpy()
    starts = _segments(keys)
    emit = model.emit[:, symbols].T
    steps = model.step[None] + emit[:, None, :]
    head = int(starts[1]) if len(starts) > 1 else len(keys)
    tail = int(starts[-1])
    through = _chain(steps[:head])
    fresh = model.first + emit[tail]
    if len(keys) > tail + 1:
        fresh = (fresh[:, None] + _chain(steps[tail + 1 :])).max(0)
    return pa.table(
        {
            "part": pa.array([table["part"][0].as_py()], pa.int64()),
            "head": pa.array([str(keys[0])]),
            "tail": pa.array([str(keys[-1])]),
            "single": pa.array([len(starts) == 1]),
            "through": pa.array([through.ravel().tolist()], pa.list_(pa.int64())),
            "fresh": pa.array([fresh.tolist()], pa.list_(pa.int64())),
        }
    )


def _borders(summaries: list) -> dict[int, tuple[list[int] | None, int | None, int | None]]:
    """For each range: scores that reach it, the last state before it, its last state.

    None where a transcript does not cross that end.
    """
    k, n = len(ROLES), len(summaries)
    crosses = [i > 0 and summaries[i - 1].tail == s.head for i, s in enumerate(summaries)]
    reach, out = [None] * n, [None] * n
    for i, s in enumerate(summaries):
        through = np.array(s.through).reshape(k, k)
        if crosses[i]:
            reach[i] = out[i - 1]
        if s.single and crosses[i]:
            out[i] = (reach[i][:, None] + through).max(0)
        else:
            out[i] = np.array(s.fresh)
    last: list[int | None] = [None] * n
    for i in range(n - 1, -1, -1):
        if i + 1 < n and crosses[i + 1]:
            through = np.array(summaries[i + 1].through).reshape(k, k)
            total = reach[i + 1][:, None] + through
            whole = summaries[i + 1].single and last[i + 1] is not None
            end = last[i + 1] if whole else int(np.argmax(total.max(0)))
            last[i] = int(np.argmax(total[:, end]))
    return {
        s.part: (
            None if reach[i] is None else reach[i].tolist(),
            last[i - 1] if crosses[i] else None,
            last[i],
        )
        for i, s in enumerate(summaries)
    }


def viterbi(
    symbols: np.ndarray,
    starts: np.ndarray,
    model: Model,
    reach: list[int] | None = None,
    last: int | None = None,
) -> np.ndarray:
    """The likeliest states of all sequences at once; the smallest state wins a tie.

    ``reach``: scores before the first sequence, which then continues another.
    ``last``: the state that the last sequence must end in.
    """
    n, k = len(symbols), len(ROLES)
    ends = np.append(starts[1:], n)
    emit = model.emit[:, symbols].T
    back = np.zeros((n, k), np.int8)
    scores = np.zeros((n, k), np.int64)
    order = np.argsort(-(ends - starts), kind="stable")
    begin, size = starts[order], (ends - starts)[order]
    for t in range(int(size[0]) if len(size) else 0):
        active = begin[: np.searchsorted(-size, -t, "left")] + t
        if t == 0:
            scores[active] = model.first + emit[active]
            if reach is not None:
                total = np.array(reach)[:, None] + model.step
                back[0], scores[0] = total.argmax(0), total.max(0) + emit[0]
        else:
            total = scores[active - 1][:, :, None] + model.step[None]
            back[active] = total.argmax(1)
            scores[active] = total.max(1) + emit[active]
    states = np.zeros(n, np.int64)
    states[ends - 1] = scores[ends - 1].argmax(1)
    if last is not None and n:
        states[n - 1] = last
    finish = ends[order] - 1
    for t in range(1, int(size[0]) if len(size) else 0):
        at = finish[: np.searchsorted(-size, -t, "left")] - t
        states[at] = back[at + 1, states[at + 1]]
    return states


def recover_roles(lines: DataFrame, model: Model | None = None) -> DataFrame:
    """Columns conv_id, turn, role and text of ``lines`` with ``predicted``, ``opens``
    and ``rendered``.

    ``opens`` marks the first line of a canonical turn: the transcript begins, or the
    speaker changes. ``rendered`` is the line without its marker, below a header
    ``<|role|>`` if it opens a turn; rendered lines of a transcript in order of turn,
    joined by new lines, are its canonical form. A null text is an empty line, a null
    conv_id a transcript of its own, a null turn comes last. An empty table gives no
    rows.
    """
    lines = lines.select("conv_id", "turn", "role", "text")
    ranged = _in_ranges(lines.withColumn("symbol", symbol("text")))
    ranged = ranged.withColumn("part", F.shiftright("id", 33))
    model = model or learn(ranged)
    narrow = ranged.select("id", "part", "conv_id", "symbol")
    sums = narrow.groupBy("part").applyInArrow(
        lambda table: _summary(table, model),
        "part long, head string, tail string, single boolean, "
        "through array<long>, fresh array<long>",
    )
    # a row of a few numbers for each range, as many as a shuffle has partitions
    borders = _borders(sorted(sums.collect(), key=lambda s: s.part))

    def decode(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        reach, before, last = borders[table["part"][0].as_py()]
        starts = _segments(table["conv_id"].to_pylist())
        states = viterbi(table["symbol"].to_numpy(), starts, model, reach, last)
        opens = np.append(True, states[1:] != states[:-1])
        opens[starts] = True
        opens[0] = before is None or before != states[0]
        return pa.table({"id": table["id"], "state": states, "opens": opens})

    decoded = narrow.groupBy("part").applyInArrow(decode, "id long, state long, opens boolean")
    names = F.array(*map(F.lit, ROLES))
    anywhere = "|".join(MARKERS.values())
    plain = F.regexp_replace(
        F.coalesce("text", F.lit("")), f"(?i){_OPEN}(?:{anywhere}){_CLOSE}", ""
    )
    predicted = F.element_at(names, (F.col("state") + 1).cast("int"))
    rows = ranged.join(decoded, "id").withColumn("predicted", predicted)
    header = F.when(F.col("opens"), F.concat(F.lit("<|"), "predicted", F.lit("|>\n")))
    return rows.select(
        *lines.columns,
        "predicted",
        "opens",
        F.concat(F.coalesce(header, F.lit("")), plain).alias("rendered"),
    )


def chat_report(conversations: DataFrame) -> DataFrame:
    """Every row of the conversations with its recovered role and canonical form.

    The given role is used for training only where ``held_out`` is false.
    """
    rows = recover_roles(conversations)
    return rows.select(
        "conv_id", "turn", "role", "predicted", "opens", held_out().alias("held_out"), "rendered"
    )
