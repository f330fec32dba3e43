"""Further detectors, for policies that carry them: bank accounts and network addresses.

    findings(docs, ["doc_id"], "text", ScanPolicy(extra=(IBAN, IPV6)))

Both are checked, not only matched: an IBAN by the length its country has and by its
remainder, an address by the grammar of compressed forms.
"""

from __future__ import annotations

from inkveil.functions.detectors import Detector
from inkveil.functions.patterns import NOT_IN_WORD, WORD_ENDS
from inkveil.functions.sqltext import let

# --- fixed values: countries by the length of their account numbers -----------
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FO GL NL",
    19: "MK SI",
    20: "AT BA EE KZ LT LU XK",
    21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS",
    23: "AE GI IL IQ TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "PT ST",
    26: "IS TR",
    27: "FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR PS QA UA",
    30: "JO KW MU",
    31: "MT SC",
    32: "LC",
}
MODULUS, REMAINDER = 97, 1


def iban_pattern() -> str:
    """Country, two check digits, as many signs as the country has; single spaces between."""
    by_length = (
        rf"(?:{'|'.join(countries.split())})\d{{2}}(?: ?[A-Z0-9]){{{length - 4}}}"
        for length, countries in IBAN_LENGTHS.items()
    )
    return f"{NOT_IN_WORD}(?:{'|'.join(by_length)}){WORD_ENDS}"


def iban_valid_sql(value: str) -> str:
    """Whether a number, its first four signs put last and letters read as 10 to 35, has the
    remainder that valid ones have.

    A fold over the signs: the number itself would have 68 digits.
    """
    signs = "regexp_extract_all(concat(substring(_iban, 5), left(_iban, 4)), '.', 0)"
    step = (
        f"CASE WHEN _sign <= '9' THEN (_rest * 10 + cast(_sign AS int)) % {MODULUS}"
        f" ELSE (_rest * 100 + ascii(_sign) - 55) % {MODULUS} END"
    )
    return let(
        "_iban",
        f"replace({value}, ' ', '')",
        f"aggregate({signs}, 0, (_rest, _sign) -> {step}) = {REMAINDER}",
    )


HEX_GROUP = "[0-9A-Fa-f]{0,4}"
#: begins where nothing like an address goes before, takes all groups there are
IPV6_PATTERN = (
    rf"(?<![\w:.]){HEX_GROUP}(?::{HEX_GROUP}){{2,8}}+(?:(?:\.\d{{1,3}}){{3}})?(?![\w:])"
)


def ipv6_valid_sql(value: str) -> str:
    """Whether a run of groups is an address.

    Eight groups, or fewer with one double colon in the place of the missing ones; the last
    two may be written as an IPv4 address.  A double colon alone says nothing and is none.
    """
    octets = "regexp_extract_all(_address, '(?:^|[:.])([0-9]{1,3})(?=[.]|$)', 1)"
    dotted = "contains(_address, '.')"
    good_octets = f"forall(slice({octets}, -4, 4), _o -> cast(_o AS int) <= 255)"
    # an IPv4 tail stands for two groups of the usual kind
    plain = f"CASE WHEN {dotted} THEN regexp_replace(_address, '[0-9]+(?:[.][0-9]+)+$', '0:0') ELSE _address END"
    doubles = "size(split(_plain, '::', -1)) - 1"
    groups = "size(filter(split(_plain, ':', -1), _g -> _g <> ''))"
    shape = (
        f"CASE {doubles} WHEN 0 THEN {groups} = 8 AND size(split(_plain, ':', -1)) = 8"
        f" WHEN 1 THEN {groups} BETWEEN 1 AND 7 AND NOT contains(_plain, ':::')"
        " AND NOT (rlike(_plain, '^:[^:]') OR rlike(_plain, '[^:]:$'))"
        " ELSE false END"
    )
    tail = (
        f"(NOT {dotted} OR (rlike(_address, ':[0-9]{{1,3}}(?:[.][0-9]{{1,3}}){{3}}$')"
        f" AND {good_octets}))"
    )
    return let("_address", value, f"{tail} AND {let('_plain', plain, shape)}")


def _checked(condition: str, message: str) -> str:
    return f"CASE WHEN {condition} THEN '{message}' END"


IBAN = Detector(
    "iban",
    "pii",
    "high",
    "IBAN detected (checksum validated)",
    "International bank account numbers (mod 97)",
    iban_pattern(),
    check=_checked(iban_valid_sql("value"), "IBAN detected (checksum validated)"),
    screen=r"[A-Z]{2}\d{2} ?[A-Z0-9]",
)

IPV6 = Detector(
    "ipv6-address",
    "pii",
    "medium",
    "IPv6 address detected",
    "IPv6 addresses, compressed ones included",
    IPV6_PATTERN,
    (":",),
    check=_checked(ipv6_valid_sql("value"), "IPv6 address detected"),
    screen=rf"{HEX_GROUP}:{HEX_GROUP}:",
)
