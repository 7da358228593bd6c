"""What a value looks like once masked, and the text with all hits masked."""

from __future__ import annotations

from ..rules import Masking, Rules
from .arrays import blocks_of, cut, running_max
from .fixed_values import AUDIT_PREVIEW_LENGTH
from .spans import HIT, HIT_FIELDS, copy_fields, detections
from .sqltext import exists, fresh, let, quote, transform, transform_at

REDACTION = HIT[:-1] + ",masked:string,policy:string>"
NO_REDACTIONS = f"cast(array() AS array<{REDACTION}>)"


def mask_full(raw: str, masking: Masking) -> str:
    """Every character but space and dash masked."""
    return f"regexp_replace({raw}, '[^ -]', {masking.replacement})"


def mask_partial(raw: str, masking: Masking) -> str:
    """Head and tail kept, the middle masked, at least one character not kept."""
    prefix, suffix = masking.keep_prefix, masking.keep_suffix
    head = f"least({prefix}, greatest(length({raw}) - 1, 0))"

    def masked(keep: str) -> str:
        tail = f"least({suffix}, greatest(length({raw}) - 1 - {keep}, 0))"
        return let(
            tail,
            lambda t: f"""concat(substr({raw}, 1, {keep}),
                {mask_full(f"substr({raw}, {keep} + 1, length({raw}) - {keep} - {t})", masking)},
                substr({raw}, length({raw}) - {t} + 1, {t}))""",
        )

    return let(head, masked)


def mask_value(raw: str, type_: str, rules: Rules) -> str:
    masking = rules.masking
    if masking.style == "label":
        return rules.label_of(type_)
    if masking.style == "full":
        return mask_full(raw, masking)
    return mask_partial(raw, masking)


def masked_preview(masked: str) -> str:
    limit = AUDIT_PREVIEW_LENGTH
    return (
        f"if(length({masked}) > {limit}, "
        f"concat(substr({masked}, 1, {limit - 1}), '…'), {masked})"
    )


def dedupe_spans(hits: str) -> str:
    return let(hits, _dedupe)


def _dedupe(hits: str) -> str:
    """One hit per identical span: the most confident, the first on a tie.

    Ordered by start, the longest first on equal starts: the order in which the
    hits claim the text.
    """
    ranked = transform(
        hits,
        lambda h: f"struct({h}.start AS start, -{h}.end AS longest, "
        f"-{h}.confidence AS surest, {h}.ord AS ord, {h} AS hit)",
    )

    def firsts(items: str) -> str:
        x, i = fresh("x"), fresh("i")
        before = f"get({items}, {i} - 1)"
        new_span = (
            f"{i} = 0 OR {x}.start <> {before}.start OR {x}.longest <> {before}.longest"
        )
        return transform(f"filter({items}, ({x}, {i}) -> {new_span})", lambda y: f"{y}.hit")

    # hits come ordered by (start, end): with all starts different nothing is to do
    starts = f"array_distinct({transform(hits, lambda h: f'{h}.start')})"
    full = let(f"sort_array({ranked})", firsts)
    return f"if(size({starts}) = size({hits}), {hits}, {full})"


def redactions_of(hits: str, rules: Rules) -> str:
    """Deduplicated hits with what replaces each and under which policy."""
    return transform(
        dedupe_spans(hits),
        lambda h: f"""struct({copy_fields(h, HIT_FIELDS)},
            {mask_value(f"{h}.raw", f"{h}.type", rules)} AS masked,
            {rules.policy_of(f"{h}.type")} AS policy)""",
    )


def splice(text: str, redactions: str, keeps_length: bool) -> str:
    """``text`` with every redaction's mask in place of its span.

    Where spans overlap, a position belongs to the hit that starts first, the
    longest on a tie. If masks keep the length of the value, the later hit masks
    what is left of its span; otherwise the overlapping hits become one interval
    with the first one's mask.
    """

    def spliced(blocks: str, reach: str) -> str:
        def piece(item: str, i: str) -> str:
            return let(
                f"coalesce(get({reach}, {i} - 1), 0)",
                lambda taken: f"concat({cut(blocks, taken, f'{item}.start')}, "
                f"{mask_left(item, f'greatest({taken} - {item}.start, 0)')})",
            )

        def mask_left(item: str, overlap: str) -> str:
            if keeps_length:
                return f"substr({item}.masked, {overlap} + 1)"
            return f"if({overlap} = 0, {item}.masked, '')"

        tail = cut(blocks, f"element_at({reach}, -1)", f"length({text})")
        return f"concat(array_join({transform_at(redactions, piece)}, ''), {tail})"

    ends = transform(redactions, lambda r: f"{r}.end")
    overlaps = transform_at(
        redactions, lambda r, i: f"{r}.start < get({redactions}, {i} - 1).end"
    )
    reach = f"if({exists(overlaps, lambda o: o)}, {running_max(ends)}, {ends})"
    spliced_text = let(
        blocks_of(text),
        lambda blocks: let(reach, lambda r: spliced(blocks, r)),
    )
    return f"if(size({redactions}) = 0, {text}, {spliced_text})"


def redact(
    text: str,
    rules: Rules,
    hits: str | None = None,
    python_spans: dict[int, str] | None = None,
) -> str:
    """``struct<text, redactions, blocked>`` of one text.

    ``hits`` come from :func:`detections` unless given from outside.
    """
    found = detections(text, rules, python_spans) if hits is None else hits
    return let(
        f"coalesce({redactions_of(found, rules)}, {NO_REDACTIONS})",
        lambda redactions: f"""struct(
            {splice(text, redactions, rules.masking.keeps_length)} AS text,
            {redactions} AS redactions,
            {is_blocked(redactions)} AS blocked)""",
    )


def is_blocked(redactions: str) -> str:
    return exists(redactions, lambda r: f"{r}.policy = 'block'")
