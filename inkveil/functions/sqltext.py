"""Building blocks for column expressions written as SQL text.

A full scan is one expression of many nested array functions.  Composed through
the Python API it takes thousands of round trips to the JVM (seconds); as SQL
text it is parsed there in one.  The functions here take and return SQL text.
Lambda variables start with ``_`` so that they do not shadow columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 32


def literal(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def column(name: str) -> str:
    """SQL text for a column name; other expressions are put in parentheses."""
    return f"`{name}`" if name.isidentifier() else f"({name})"


def expr(text: str) -> Column:
    return F.expr(text)


def struct(**fields: str) -> str:
    inner = ", ".join(f"'{name}', {value}" for name, value in fields.items())
    return f"named_struct({inner})"


def empty_array(element_type: str) -> str:
    return f"cast(array() AS array<{element_type}>)"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, computed once per row.

    Catalyst would otherwise paste ``value`` into every place where ``body``
    uses it, and run it as often.  ``element_at`` rather than ``[0]``: the latter
    works out the type of its argument anew for every row.
    """
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def running(
    items: str, start: str, advance: Callable[[str, str], str], state_type: str, tag: str
) -> str:
    """The states of a left-to-right fold over ``items``, one per item.

    ``advance(state, item)`` gives the next state.  ``aggregate`` copies its
    buffer at every step, so collecting n states in one buffer takes n * n / 2
    copies.  Here blocks of about sqrt(n) items are folded one after another,
    which takes n * sqrt(n).  ``tag`` keeps the variables of nested folds apart.
    """
    names = ("states", "item", "acc", "block", "done", "n", "items", "width")
    states, item, acc, block, done, n, bound, width = (f"_{name}_{tag}" for name in names)
    within = (
        f"aggregate({block}, array({acc}.state), ({states}, {item}) -> "
        f"array_append({states}, {advance(f'{states}[size({states}) - 1]', item)}))"
    )
    step = let(
        done,
        within,
        struct(
            state=f"{done}[size({done}) - 1]",
            full=f"array_append({acc}.full, slice({done}, 2, size({block})))",
        ),
    )
    zero = struct(state=start, full=empty_array(f"array<{state_type}>"))
    blocks = (
        f"transform(sequence(0, ({n} - 1) div {width}), "
        f"_b -> slice({bound}, cast(_b * {width} + 1 AS int), {width}))"
    )
    folded = f"aggregate({blocks}, {zero}, ({acc}, {block}) -> {step}, {acc} -> flatten({acc}.full))"
    sized = let(width, f"cast(greatest({BLOCK}, ceil(sqrt({n}))) AS int)", folded)
    guarded = f"CASE WHEN {n} > 0 THEN {sized} ELSE {empty_array(state_type)} END"
    return let(bound, items, let(n, f"size({bound})", guarded))
