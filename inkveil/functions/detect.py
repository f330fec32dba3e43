"""Column expressions that find sensitive values in a text column.

Everything is built of Spark's own functions, so a scan is one projection: no
shuffle, no Python worker.  A text without any match costs a byte search or one
regex pass per detector; positions are worked out only where there are matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column

from inkveil.functions.detectors import Detector, selected
from inkveil.functions.sqltext import column, empty_array, expr, let, literal, running, struct
from inkveil.functions.text import DETECTION, DETECTION_FIELDS, text_length

Chosen = list[tuple[int, Detector]]

TYPE_COUNT = "struct<ordinal:int,type:string,category:string,severity:string,n_findings:int>"


def _literal_test(text: str, d: Detector) -> str | None:
    tests = " OR ".join(f"contains({text}, {literal(each)})" for each in d.literals)
    return f"({tests})" if tests else None


def _guarded(text: str, d: Detector, result: str) -> str:
    """``result``, but NULL where a byte search shows that nothing can match."""
    test = _literal_test(text, d)
    return f"CASE WHEN {test} THEN {result} END" if test else result


def _screened(chosen: Chosen) -> list[tuple[str | None, Chosen]]:
    """Detectors by the screen they share, so that each screen runs once per text."""
    groups: dict[str | None, Chosen] = {}
    for entry in chosen:
        groups.setdefault(entry[1].screen, []).append(entry)
    return list(groups.items())


def _screen_test(text: str, screen: str) -> str:
    if re.escape(screen) == screen:
        return f"contains({text}, {literal(screen)})"
    return f"rlike({text}, {literal(screen)})"


def _pattern_sql(d: Detector) -> str:
    return literal(d.pattern)


def _searched(text: str, d: Detector) -> str:
    """The part of the text that a pattern is searched in."""
    return let("text", text, d.within) if d.within else text


def _matches(text: str, d: Detector, group: int = 0) -> str:
    return f"regexp_extract_all({_searched(text, d)}, {_pattern_sql(d)}, {group})"


def _spans(text: str, d: Detector) -> str:
    """Spans of a detector that brings its own finder."""
    return let("text", text, d.finder)


def _hit(text: str, slot: int, d: Detector) -> str:
    """Matches of one detector: ``slot``, ``found`` and, from a finder, the ``gaps``."""
    if d.pattern:
        found = _matches(text, d)
        gaps = "cast(NULL AS array<string>)"
        if d.within:
            gaps = f"split({_searched(text, d)}, {_pattern_sql(d)}, -1)"
        return struct(slot=str(slot), found=found, gaps=gaps)
    values = f"transform(_spans, _s -> substring({text}, _s.start + 1, _s.end - _s.start))"
    before = "CASE WHEN _i = 0 THEN 0 ELSE _spans[_i - 1].end END"
    gaps = f"transform(_spans, (_s, _i) -> substring({text}, {before} + 1, _s.start - {before}))"
    return let("_spans", _spans(text, d), struct(slot=str(slot), found=values, gaps=gaps))


def _messages(chosen: Chosen, slot: str, label: str, values: str) -> str:
    """Message of each value, NULL where the detector's check rejects it."""
    checks = "".join(
        f" WHEN {n} THEN {d.check}" for n, (_, d) in enumerate(chosen) if d.check
    )
    message = f"CASE {slot}{checks} ELSE {label}.message END" if checks else f"{label}.message"
    return f"transform({values}, value -> {message})"


def _labels(chosen: Chosen) -> str:
    """Constant array with the labels of the detectors, by slot."""
    rows = [
        struct(
            ordinal=str(ordinal),
            type=literal(d.name),
            category=literal(d.category),
            severity=literal(d.severity),
            message=literal(d.message),
            pattern=literal(d.pattern or ""),
            span_group=str(d.group),
        )
        for ordinal, d in chosen
    ]
    return f"array({', '.join(rows)})"


def _placed(text: str, chosen: Chosen, utf16: bool) -> str:
    """Findings of one hit: matches that passed their check, with their spans.

    The way from the end of one match to the end of the next is the gap in
    front, taken from a split at the same pattern, plus the match itself.
    Running sums of these steps are the positions.
    """
    steps = "transform(_hit.found, (_m, _i) -> " + struct(
        step=f"{text_length('_gaps[_i]', utf16)} + {text_length('_m', utf16)}",
        width=text_length("_values[_i]", utf16),
        value="_values[_i]",
        message="_messages[_i]",
    ) + ")"
    ends = running("_steps", "0", lambda end, part: f"{end} + {part}.step", "int", "end")
    finding = struct(
        start="_ends[_i] - _part.width",
        ordinal="_label.ordinal",
        end="_ends[_i]",
        value="_part.value",
        message="_part.message",
        type="_label.type",
        category="_label.category",
        severity="_label.severity",
    )
    all_found = f"transform(_steps, (_part, _i) -> {finding})"
    kept = f"filter({all_found}, _f -> _f.message IS NOT NULL)"
    findings = let(
        "_gaps",
        f"coalesce(_hit.gaps, split({text}, _label.pattern, -1))",
        let("_steps", steps, let("_ends", ends, kept)),
    )
    checked = let(
        "_messages",
        _messages(chosen, "_hit.slot", "_label", "_values"),
        f"CASE WHEN exists(_messages, _msg -> _msg IS NOT NULL) THEN {findings} END",
    )
    values = (
        f"CASE WHEN _label.span_group = 0 THEN _hit.found"
        f" ELSE regexp_extract_all({text}, _label.pattern, _label.span_group) END"
    )
    return let("_label", f"{_labels(chosen)}[_hit.slot]", let("_values", values, checked))


def _bound(text: str, result: str, otherwise: str) -> str:
    """``result`` over the variable ``_text``, or ``otherwise`` for NULL.

    A filter is pushed below the projection that makes its columns.  With one
    mention of the text, an expression behind it is copied there only once.
    """
    return let("_text", text, f"CASE WHEN _text IS NULL THEN {otherwise} ELSE {result} END")


def detections_sql(text: str, chosen: Chosen, utf16: bool = False) -> str:
    nothing = empty_array(DETECTION)
    if not chosen:
        return nothing
    screens = [screen for screen, _ in _screened(chosen) if screen is not None]
    hits = []
    for slot, (_, d) in enumerate(chosen):
        tests = [f"_screens[{screens.index(d.screen)}]"] if d.screen else []
        literals = _literal_test("_text", d)
        tests += [literals] if literals else []
        hit = _hit("_text", slot, d)
        hits.append(f"CASE WHEN {' AND '.join(tests)} THEN {hit} END" if tests else hit)
    placed = f"transform(_hits, _hit -> {_placed('_text', chosen, utf16)})"
    # sorted by (start, ordinal): equal starts stay in detector order
    ordered = f"sort_array(flatten(filter({placed}, _f -> _f IS NOT NULL)))"
    fields = struct(**{name: f"_d.`{name}`" for name in DETECTION_FIELDS})
    found = f"transform({ordered}, _d -> {fields})"
    result = let(
        "_hits",
        f"filter(array({', '.join(hits)}), _h -> _h IS NOT NULL AND size(_h.found) > 0)",
        f"CASE WHEN size(_hits) > 0 THEN {found} ELSE {nothing} END",
    )
    if screens:
        tests = ", ".join(_screen_test("_text", screen) for screen in screens)
        result = let("_screens", f"array({tests})", result)
    return _bound(text, result, nothing)


def detections(
    text: str,
    enabled: Iterable[str | Detector] | None = None,
    min_severity: str = "low",
    *,
    utf16: bool = False,
) -> Column:
    """Findings in a text column as ``array<struct>``, sorted by position.

    ``start`` is 0-based and inclusive, ``end`` exclusive, both in code points
    (in UTF-16 units with ``utf16=True``).  Overlapping findings of different
    detectors are all kept.  NULL text gives an empty array.
    """
    return expr(detections_sql(column(text), selected(enabled, min_severity), utf16))


def _count(text: str, d: Detector) -> str:
    if d.finder:
        values = (
            f"transform({_spans(text, d)}, _s -> substring({text}, _s.start + 1, _s.end - _s.start))"
        )
    else:
        values = _matches(text, d, d.group)
    if d.check:
        values = f"filter({values}, value -> ({d.check}) IS NOT NULL)"
    return f"coalesce({_guarded(text, d, f'size({values})')}, 0)"


def finding_count(
    text: str, enabled: Iterable[str | Detector] | None = None, min_severity: str = "low"
) -> Column:
    """Number of findings in a text column, without working out their positions."""
    sums = []
    for screen, members in _screened(selected(enabled, min_severity)):
        total = " + ".join(_count('_text', d) for _, d in members)
        if screen is not None:
            total = f"CASE WHEN {_screen_test('_text', screen)} THEN {total} ELSE 0 END"
        sums.append(f"({total})")
    return expr(_bound(column(text), " + ".join(sums) or "0", "0"))


def counts_by_type(
    text: str, enabled: Iterable[str | Detector] | None = None, min_severity: str = "low"
) -> Column:
    """``array<struct<ordinal, type, category, severity, n_findings>>`` of the types found."""
    nothing = empty_array(TYPE_COUNT)
    groups = []
    for screen, members in _screened(selected(enabled, min_severity)):
        counts = [
            struct(
                ordinal=str(ordinal),
                type=literal(d.name),
                category=literal(d.category),
                severity=literal(d.severity),
                n_findings=_count('_text', d),
            )
            for ordinal, d in members
        ]
        group = f"array({', '.join(counts)})"
        if screen is not None:
            group = f"CASE WHEN {_screen_test('_text', screen)} THEN {group} ELSE {nothing} END"
        groups.append(group)
    if not groups:
        return expr(nothing)
    found = f"filter(concat({', '.join(groups)}), _c -> _c.n_findings > 0)"
    return expr(_bound(column(text), found, nothing))


def _present(text: str, d: Detector) -> str:
    if d.pattern and not d.check:
        test = f"rlike({_searched(text, d)}, {_pattern_sql(d)})"
    else:
        test = f"{_count(text, d)} > 0"
    guard = _literal_test(text, d)
    return f"({guard} AND {test})" if guard else f"({test})"


def has_findings(
    text: str, enabled: Iterable[str | Detector] | None = None, min_severity: str = "low"
) -> Column:
    """Whether a text column has any finding; stops at the first.

    Detectors that a byte search can rule out go first, checked matches last.
    """
    chosen = selected(enabled, min_severity)
    chosen.sort(key=lambda entry: (not entry[1].literals, entry[1].check is not None))
    tests = []
    for screen, members in _screened(chosen):
        test = " OR ".join(_present('_text', d) for _, d in members)
        tests.append(f"({_screen_test('_text', screen)} AND ({test}))" if screen else f"({test})")
    return expr(_bound(column(text), f"({' OR '.join(tests) or 'false'})", "false"))
