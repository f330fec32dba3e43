"""Checks on payment card numbers."""

from __future__ import annotations

from pyspark.sql import Column

from inkveil.functions.sqltext import column, expr, let

# --- fixed values: length and issuer prefixes -------------------------------
MIN_DIGITS, MAX_DIGITS = 13, 19
VISA = "4"
MASTERCARD_TWO = ("51", "55")
MASTERCARD_FOUR = ("2221", "2720")
AMEX = ("34", "37")
DISCOVER_FOUR = "6011"
DISCOVER_TWO = "65"


def digits_sql(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]+', '')"


def _length_ok(digits: str) -> str:
    return f"length({digits}) BETWEEN {MIN_DIGITS} AND {MAX_DIGITS}"


def _luhn(digits: str) -> str:
    return f"({_length_ok(digits)} AND luhn_check({digits}))"


def _issuer(digits: str) -> str:
    # prefixes are digit strings of fixed width, so string order is number order
    two, four = f"left({digits}, 2)", f"left({digits}, 4)"
    low, high = MASTERCARD_TWO
    low_four, high_four = MASTERCARD_FOUR
    return f"""CASE
        WHEN NOT ({_length_ok(digits)}) THEN NULL
        WHEN startswith({digits}, '{VISA}') THEN 'visa'
        WHEN {two} BETWEEN '{low}' AND '{high}' THEN 'mastercard'
        WHEN {four} BETWEEN '{low_four}' AND '{high_four}' THEN 'mastercard'
        WHEN {two} IN {AMEX} THEN 'amex'
        WHEN {four} = '{DISCOVER_FOUR}' OR {two} = '{DISCOVER_TWO}' THEN 'discover'
        END"""


def digits_of(value: str) -> Column:
    return expr(digits_sql(column(value)))


def passes_luhn(value: str) -> Column:
    """Whether the digits of ``value`` are 13 to 19 and end in a right check digit."""
    return expr(let("_digits", digits_sql(column(value)), _luhn("_digits")))


def issuer(value: str) -> Column:
    """Name of the card issuer by number prefix, or NULL."""
    return expr(let("_digits", digits_sql(column(value)), _issuer("_digits")))


def card_number_sql(value: str) -> str:
    return let(
        "_digits", digits_sql(value), f"({_issuer('_digits')}) IS NOT NULL AND {_luhn('_digits')}"
    )
