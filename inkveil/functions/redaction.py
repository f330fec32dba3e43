"""Replace findings in a text by typed placeholders."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.functions.sqltext import column, expr, let, running, struct
from inkveil.functions.text import cut, pieces

MODES = ("safe", "exact")
GROUP = "struct<start:int,`end`:int,type:string>"


def placeholder_sql(kind: str) -> str:
    return f"concat('[', upper({kind}), '_REDACTED]')"


def covering_sql(found: str) -> str:
    """Per finding, ordered by (start, widest first, detector): the span that covers
    it so far, with the type of the finding that opened that span."""
    ordered = (
        f"sort_array(transform({found}, _d -> named_struct("
        "'start', _d.start, 'back', -_d.end, 'ordinal', _d.ordinal, 'type', _d.type)))"
    )

    def advance(group: str, item: str) -> str:
        apart = f"{item}.start >= {group}.end"
        return struct(
            start=f"CASE WHEN {apart} THEN {item}.start ELSE {group}.start END",
            end=f"greatest(-{item}.back, {group}.end)",
            type=f"CASE WHEN {apart} THEN {item}.type ELSE {group}.type END",
        )

    return running(
        ordered,
        struct(start="0", end="0", type="cast(NULL AS string)"),
        advance,
        GROUP,
        "group",
    )


def merged_sql(found: str) -> str:
    """Overlapping findings as one span each: the last state of every group."""
    is_last = "_i = size(_states) - 1 OR _states[least(_i + 1, size(_states) - 1)].start <> _g.start"
    return let("_states", covering_sql(found), f"filter(_states, (_g, _i) -> {is_last})")


def _rebuilt(text: str, groups: str) -> str:
    """The text between the spans, with placeholders; one cut per span."""
    before = f"CASE WHEN _i = 0 THEN 0 ELSE {groups}[_i - 1].end END"
    part = f"concat({cut('_pieces', before, '_g.start')}, {placeholder_sql('_g.type')})"
    tail = cut("_pieces", f"{groups}[size({groups}) - 1].end", f"length({text})")
    joined = f"concat(array_join(transform({groups}, (_g, _i) -> {part}), ''), {tail})"
    return let("_pieces", pieces(text), joined)


def _clusters_sql(found: str) -> str:
    """Overlapping findings as one cluster each, with its members from last to first."""
    ordered = (
        f"sort_array(transform({found}, _d -> named_struct("
        "'start', _d.start, 'back', -_d.end, 'ordinal', _d.ordinal, 'type', _d.type)))"
    )
    is_last = "_i = size(_states) - 1 OR _states[least(_i + 1, size(_states) - 1)].start <> _g.start"
    lasts = (
        f"filter(transform(_states, (_g, _i) -> CASE WHEN {is_last} THEN _i END), "
        "_l -> _l IS NOT NULL)"
    )
    first = "CASE WHEN _i = 0 THEN 0 ELSE _lasts[greatest(_i - 1, 0)] + 1 END"
    members = (
        f"sort_array(transform(slice(_ordered, {first} + 1, _l + 1 - {first}), _d -> "
        "named_struct('back', -_d.start, 'ordinal', _d.ordinal, 'end', -_d.back, 'type', _d.type)))"
    )
    cluster = struct(start="_states[_l].start", end="_states[_l].end", members=members)
    made = f"transform(_lasts, (_l, _i) -> {cluster})"
    return let("_ordered", ordered, let("_states", covering_sql(found), let("_lasts", lasts, made)))


def _folded(text: str, found: str) -> str:
    """Spans replaced from last to first at their original offsets, overlaps included.

    A span whose inside has become shorter reaches into what follows it.  Each cluster
    of overlapping spans is folded by itself, over its own characters, and counts how
    many characters of the rest it takes.  These are then taken from the text between
    the clusters, or from the next ones, in one pass.
    """
    state = "struct<at:int,made:string,taken:int>"
    shrunk = "(_d.end - _acc.at)"
    advance = struct(
        at="cast(-_d.back AS int)",
        made=(
            f"concat({placeholder_sql('_d.type')}, CASE WHEN _d.end <= _acc.at "
            f"THEN concat({cut('_pieces', '_d.end', '_acc.at')}, _acc.made) "
            f"ELSE substring(_acc.made, {shrunk} + 1) END)"
        ),
        taken=f"cast(_acc.taken + greatest(0, {shrunk} - length(_acc.made)) AS int)",
    )
    zero = struct(at="cast(_k.end AS int)", made="''", taken="0")
    made = (
        f"aggregate(_k.members, cast({zero} AS {state}), (_acc, _d) -> cast({advance} AS {state}))"
    )
    end_before = "CASE WHEN _i = 0 THEN 0 ELSE _clusters[greatest(_i - 1, 0)].end END"
    done = let(
        "_made", made, struct(gap=f"_k.start - {end_before}", made="_made.made", taken="_made.taken")
    )
    left = running(
        "_done",
        "0",
        lambda now, item: (
            f"cast(greatest(0, greatest(0, {now} - {item}.gap) - length({item}.made))"
            f" + {item}.taken AS int)"
        ),
        "int",
        "left",
    )
    owed = "CASE WHEN _i = 0 THEN 0 ELSE _left[greatest(_i - 1, 0)] END"
    between = cut("_pieces", f"least({end_before} + {owed}, _k.start)", "_k.start")
    rest = f"substring(_done[_i].made, greatest(0, {owed} - _done[_i].gap) + 1)"
    parts = f"transform(_clusters, (_k, _i) -> concat({between}, {rest}))"
    last = "_clusters[size(_clusters) - 1].end + _left[size(_left) - 1]"
    tail = cut("_pieces", f"least({last}, length({text}))", f"length({text})")
    joined = f"concat(array_join({parts}, ''), {tail})"
    folded = let("_done", f"transform(_clusters, (_k, _i) -> {done})", let("_left", left, joined))
    return let("_pieces", pieces(text), let("_clusters", _clusters_sql(found), folded))


def redact_sql(text: str, found: str, mode: str = "safe") -> str:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}, expected one of {MODES}")
    rebuilt = _rebuilt(text, "_groups")
    if mode == "exact":
        overlap = f"size(_groups) < size({found})"
        rebuilt = f"CASE WHEN {overlap} THEN {_folded(text, found)} ELSE {rebuilt} END"
    replaced = let("_groups", merged_sql(found), rebuilt)
    return f"CASE WHEN size({found}) > 0 THEN {replaced} ELSE {text} END"


def redact(text: str, found: str, mode: str = "safe") -> Column:
    """``text`` with each finding replaced by ``[TYPE_REDACTED]``.

    ``found`` is a column made by :func:`inkveil.detections` in code points.

    ``"safe"`` merges overlapping findings into one span, named after the
    outermost.  ``"exact"`` replaces one finding after another from the last to
    the first at their original offsets; where findings overlap, this loses or
    repeats characters around them.  Without overlaps both give the same.
    """
    return expr(redact_sql(column(text), column(found), mode))


def only(
    found: str,
    types: Iterable[str] | None = None,
    categories: Iterable[str] | None = None,
) -> Column:
    """The findings of the given types and categories."""

    def wanted(d: Column) -> Column:
        keep = F.lit(True)
        if types is not None:
            keep = keep & d["type"].isin(*types)
        if categories is not None:
            keep = keep & d["category"].isin(*categories)
        return keep

    return F.filter(found, wanted)
