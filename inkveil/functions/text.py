"""Lengths, cuts and line positions of long texts, as SQL text."""

from __future__ import annotations

from inkveil.functions.sqltext import let, literal, running, struct

PIECE = 4096

DETECTION_FIELDS = ("type", "category", "severity", "start", "end", "message", "value", "ordinal")
DETECTION = (
    "struct<type:string,category:string,severity:string,start:int,`end`:int,"
    "message:string,value:string,ordinal:int>"
)
POSITION = "struct<pos:int,line:int,col:int>"


def text_length(text: str, utf16: bool = False) -> str:
    """Characters of ``text``: code points, or UTF-16 units."""
    if not utf16:
        return f"length({text})"
    others = literal(r"[^\x{10000}-\x{10FFFF}]+")
    return f"(length({text}) + length(regexp_replace({text}, {others}, '')))"


def pieces(text: str) -> str:
    """``text`` as an array of pieces of ``PIECE`` code points.

    ``substring`` walks a string from its first byte, so thousands of cuts from
    one long text would cost its length each.  A cut from pieces walks at most
    a few of them.
    """
    return f"regexp_extract_all({text}, {literal(f'(?s).{{1,{PIECE}}}+')}, 0)"


def cut(parts: str, start: str, end: str) -> str:
    """Code points ``[start, end)`` of a text split by :func:`pieces`."""
    first = f"(({start}) div {PIECE})"
    count = f"(({end}) div {PIECE} - {first} + 1)"
    window = f"array_join(slice({parts}, cast({first} + 1 AS int), cast({count} AS int)), '')"
    return (
        f"substring({window}, cast(({start}) - {first} * {PIECE} + 1 AS int), ({end}) - ({start}))"
    )


def with_lines(parts: str, found: str) -> str:
    """Add ``line`` (1-based) and ``col`` (0-based) to findings sorted by start.

    Each step looks only at the text between two neighbouring findings.
    """

    def advance(at: str, item: str) -> str:
        between = f"split({cut(parts, f'{at}.pos', f'{item}.start')}, '\\n', -1)"
        moved = struct(
            pos=f"{item}.start",
            line=f"{at}.line + size(_lines) - 1",
            col=(
                f"CASE WHEN size(_lines) > 1 THEN 0 ELSE {at}.col END + length(_lines[size(_lines) - 1])"
            ),
        )
        return let("_lines", between, moved)

    at = running(found, struct(pos="0", line="1", col="0"), advance, POSITION, "line")
    kept = {name: f"_d.`{name}`" for name in DETECTION_FIELDS}
    lined = struct(**kept, line="_at[_i].line", col="_at[_i].col")
    return let("_at", at, f"transform({found}, (_d, _i) -> {lined})")
