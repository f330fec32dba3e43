"""Shannon entropy and the rules that sort out harmless token runs."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from inkveil.functions.sqltext import column, expr, let, literal
from inkveil.functions.text import text_length

# --- fixed values: limits of the entropy detector ---------------------------
THRESHOLD = 4.5
MIN_DISTINCT = 4
MAX_LOWER_SHARE = 0.85
MAX_HEX_LENGTH = 64

ROUNDING = 12


def distinct_chars(text: str) -> str:
    return f"array_distinct(regexp_extract_all({text}, '(?s).', 0))"


def entropy_sql(text: str, alphabet: str) -> str:
    """Bits per character of ``text``, whose distinct characters are ``alphabet``.

    Counting by ``replace`` keeps the work in native byte loops: one pass per
    distinct character instead of one interpreted step per character.
    """
    count = f"(length({text}) - length(replace({text}, _char, '')))"
    term = let("_count", f"cast({count} AS double)", "_count / _n * log2(_n / _count)")
    total = f"aggregate({alphabet}, 0D, (_bits, _char) -> _bits + {term})"
    n = f"cast({text_length(text, utf16=True)} AS double)"
    return f"round({let('_n', n, total)}, {ROUNDING})"


@F.pandas_udf(ArrayType(LongType()))
def _counts(texts: pd.Series) -> pd.Series:
    """UTF-16 units of each text, then how often each character stands there, by its first place."""

    def counted(text: str | None) -> list[int] | None:
        if text is None:
            return None
        found = Counter(text)
        pairs = sum(n for char, n in found.items() if char > "\uffff")
        return [len(text) + pairs, *found.values()]

    return texts.map(counted)


def shannon_entropy(text: str) -> Column:
    """Bits per character of a text column, rounded to 12 places; 0 for the empty text.

    For whole texts: a character is counted in one pass, whatever others there are.  Terms
    are added up as in :func:`entropy_sql`, so both give the same bits.
    """

    def bits(counts: Column) -> Column:
        n = F.element_at(counts, 1).cast("double")

        def add(total: Column, count: Column) -> Column:
            return total + count.cast("double") / n * F.log2(n / count)

        return F.aggregate(F.slice(counts, 2, F.size(counts)), F.lit(0.0), add)

    # bound once: a lambda can't call Python
    total = F.element_at(F.transform(F.array(_counts(expr(column(text)))), bits), 1)
    return F.round(total, ROUNDING)


def rejection_sql(candidate: str) -> str:
    """Why a token run is not a likely secret, or NULL; first rule that applies."""
    lower = f"length(regexp_replace({candidate}, '[^a-z]+', ''))"
    padded = literal(r"\A[A-Za-z0-9+/]*+={2,}\z")
    digest = literal(r"\A[0-9a-fA-F]++\z")
    return f"""CASE
        WHEN size({distinct_chars(candidate)}) < {MIN_DISTINCT} THEN 'few-distinct'
        WHEN rlike({candidate}, {padded}) THEN 'base64-padding'
        WHEN {lower} / length({candidate}) > {MAX_LOWER_SHARE}D THEN 'mostly-lower-case'
        WHEN length({candidate}) <= {MAX_HEX_LENGTH} AND rlike({candidate}, {digest})
            THEN 'hex-digest'
        END"""


def rejection(candidate: str) -> Column:
    return expr(rejection_sql(column(candidate)))


def distinct_needed(threshold: float) -> int:
    """Fewest distinct characters that can exceed ``threshold``: ``d`` of them have
    at most ``log2(d)`` bits."""
    return math.floor(2**threshold) + 1


def entropy_message_sql(candidate: str, threshold: float) -> str:
    """Message for a token run above the threshold that is a likely secret, else NULL.

    Most runs are settled by counting their distinct characters.
    """
    message = "format_string('High-entropy string detected (entropy: %.2f)', round(_bits, 2))"
    measured = let(
        "_bits",
        entropy_sql(candidate, "_chars"),
        f"CASE WHEN _bits > {threshold}D THEN {message} END",
    )
    likely = f"size(_chars) >= {distinct_needed(threshold)} AND ({rejection_sql(candidate)}) IS NULL"
    return let("_chars", distinct_chars(candidate), f"CASE WHEN {likely} THEN {measured} END")
