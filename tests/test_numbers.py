"""Account numbers and network addresses next to plain Python."""

from __future__ import annotations

import ipaddress
import random
import re

import pytest

from inkveil import ScanPolicy, findings
from inkveil.functions.numbers import IBAN, IBAN_LENGTHS, IPV6

RIGHT = ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "FR1420041010050500013M02606", "NO9386011117947",
         "MT84MALT011000012345MTLCAST001S", "LC55HEMM000100010012001200023015", "BE68 5390 0754 7034"]


def values(texts, detector, *given):
    found = findings(texts(*given), ["n"], "text", ScanPolicy(enabled=(), extra=(detector,)))
    return [(r.n, r.start, r.value) for r in sorted(found.collect(), key=lambda r: (r.n, r.start))]


def valid_iban(value):
    v = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def test_ibans(texts):
    given = [f"pay {v}, now" for v in RIGHT]
    assert values(texts, IBAN, *given) == [(n, 4, v) for n, v in enumerate(RIGHT)]
    wrong = ["GB82WEST12345698765433", "DE8937040044053201300", "xDE89370400440532013000", "DE893704004405320130001",
             "ZZ89370400440532013000", "de89370400440532013000", "DE89  370400440532013000", "DE89370400440532013000_"]
    assert values(texts, IBAN, *wrong, None, "") == []
    assert values(texts, IBAN, "DE89 3704 0044 0532 0130 00 EUR\nDE89370400440532013000") == [
        (0, 0, "DE89 3704 0044 0532 0130 00"),
        (0, 32, "DE89370400440532013000"),
    ]


def test_random_ibans(texts):
    rng = random.Random(1)
    lengths = {c: n for n, cs in IBAN_LENGTHS.items() for c in cs.split()}
    assert len(lengths) > 70
    given = []
    for _ in range(300):
        country = rng.choice(list(lengths))
        rest = "".join(rng.choice("0123456789ABCXYZ") for _ in range(lengths[country] - 4))
        check = 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97
        given.append(f"{country}{check:02d}{rest}" if rng.random() < 0.6 else f"{country}{rng.randint(10, 97)}{rest}")
    expected = [(n, 0, v) for n, v in enumerate(given) if valid_iban(v)]
    assert values(texts, IBAN, *given) == expected and len(expected) > 100


def is_ipv6(value):
    try:
        return ipaddress.IPv6Address(value) is not None and value != "::"
    except ValueError:
        return False


@pytest.mark.parametrize("text,expected", [
    ("at 2001:db8::1, fe80::1%eth0 and ::1.", ["2001:db8::1", "fe80::1", "::1"]),
    ("12:34:56 std::string a::b::c 1:::2 :1::2 1::2: ::", []),
    ("[2001:0db8:85a3:0000:0000:8a2e:0370:7334]:443", ["2001:0db8:85a3:0000:0000:8a2e:0370:7334"]),
    ("::ffff:192.0.2.33 64:ff9b::192.0.2.256 ::1.2.3", ["::ffff:192.0.2.33", "::1"]),
    ("1:2:3:4:5:6:7 1:2:3:4:5:6:7:8:9 1:2:3:4:5:6:7::", ["1:2:3:4:5:6:7::"]),
    ("x2001:db8::1 2001:db8::1x 2001:db8::g12345:1::2", []),
])
def test_addresses(texts, text, expected):
    assert [v for _, _, v in values(texts, IPV6, text)] == expected


def test_random_addresses(texts):
    rng = random.Random(2)
    given = []
    for _ in range(1500):
        groups = [rng.choice(["0", "1", "ab", "FFFF", "12345", "g", ""]) if rng.random() < 0.1 else
                  f"{rng.randrange(1 << 16):x}" for _ in range(rng.randint(2, 9))]
        value = ":".join(groups)
        if rng.random() < 0.6:
            at = rng.randrange(len(groups))
            value = ":".join(groups[:at]) + "::" + ":".join(groups[at + 1 :])
        if rng.random() < 0.2:
            value += f":{rng.randint(0, 300)}.{rng.randint(0, 9)}.{rng.randint(0, 260)}.{rng.randint(0, 255)}"
        given.append(value)
    found = {n for n, start, v in values(texts, IPV6, *given) if v == given[n]}
    expected = {n for n, v in enumerate(given) if is_ipv6(v)}
    assert found == expected and len(expected) > 300


def test_long_texts(texts):
    """Patterns stay linear."""
    many = ["1:" * 200_000, ":" * 300_000, "DE89" * 100_000, "a::" * 100_000, "GB82 " * 100_000]
    assert values(texts, IPV6, *many) == [] and values(texts, IBAN, *many) == []


def test_only_for_policies_that_carry_them(texts):
    found = findings(texts("DE89370400440532013000 ::1"), ["n"])
    assert not {"iban", "ipv6-address"} & {r.type for r in found.collect()}
    assert re.fullmatch(IPV6.pattern, "::1")
