"""Private-address test for IPv4 and IPv6 text, as integer and prefix arithmetic inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# IPv4 networks that are not globally reachable, and single addresses excepted from them.
PRIVATE_V4 = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.0.170/31",
    "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
    "255.255.255.255/32",
]
PUBLIC_V4 = ["192.0.0.9", "192.0.0.10"]
# IPv6 networks that are not globally reachable, and networks excepted from them, as Python 3.13 lists them.
PRIVATE_V6 = [
    "::1/128", "::/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16",
    "fc00::/7", "fe80::/10",
]
PUBLIC_V6 = ["2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"]

V4_PATTERN = r"^((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.(?!$)|$)){4}$"
V6_PATTERN = (
    r"^(([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}"
    r"|(?=([0-9a-f]{0,4}:){2,7}[0-9a-f]{0,4}$)(([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?::([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?))$"
)


def _v4_int(text: str) -> int:
    a, b, c, d = (int(x) for x in text.split("."))
    return (a << 24) | (b << 16) | (c << 8) | d


def _v6_groups(text: str) -> list[int]:
    head, _, tail = text.partition("::")
    left = [int(x, 16) for x in head.split(":") if x]
    right = [int(x, 16) for x in tail.split(":") if x]
    return left + [0] * (8 - len(left) - len(right)) + right


def ipv4_number(text: Column) -> Column:
    """IPv4 text as an integer; NULL when malformed."""
    part = F.split(text, r"\.")
    octet = [F.get(part, F.lit(i)).try_cast("bigint") for i in range(4)]
    value = octet[0] * 16777216 + octet[1] * 65536 + octet[2] * 256 + octet[3]
    return F.when(text.rlike(V4_PATTERN), value)


def _in_v4(value: Column, network: str) -> Column:
    base, bits = network.split("/")
    low = _v4_int(base)
    return value.between(low, low + (1 << (32 - int(bits))) - 1)


def _ipv6_groups(text: Column) -> Column:
    """The eight 16-bit groups of a well-formed IPv6 text as an array of integers."""
    shown = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")
    left, right = shown(F.split_part(text, F.lit("::"), F.lit(1))), shown(F.split_part(text, F.lit("::"), F.lit(2)))
    zeros = F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right))
    return F.transform(F.concat(left, zeros, right), lambda g: F.conv(g, 16, 10).cast("int"))


def _in_v6(groups: Column, network: str) -> Column:
    base, bits = network.split("/")
    tests, left = [], int(bits)
    for i, want in enumerate(_v6_groups(base)):
        if left <= 0:
            break
        mask = 0xFFFF if left >= 16 else (0xFFFF << (16 - left)) & 0xFFFF
        tests.append(F.get(groups, F.lit(i)).bitwiseAND(mask) == (want & mask))
        left -= 16
    return reduce(lambda a, b: a & b, tests)


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _plain_v6(text: Column) -> Column:
    """IPv6 text without its scope and with a dotted tail written as two groups; NULL if either is malformed."""
    bare = F.when(text.contains("%"), F.when(text.rlike("^[^%]*%[^%]+$"), F.split_part(text, F.lit("%"), F.lit(1)))).otherwise(text)

    def undotted(bare: Column) -> Column:
        dotted = F.regexp_extract(bare, r":([0-9.]*\.[0-9.]*)$", 1)
        pair = lambda v: F.concat_ws(":", F.lower(F.hex(F.shiftright(v, 16))), F.lower(F.hex(v.bitwiseAND(65535))))
        head = F.left(bare, F.length(bare) - F.length(dotted))
        return F.when(dotted == "", bare).otherwise(_with(ipv4_number(dotted), lambda v: F.when(v.isNotNull(), F.concat(head, pair(v)))))

    return _with(bare, undotted)


def _private_v4(value: Column) -> Column:
    return reduce(lambda a, b: a | b, [_in_v4(value, n) for n in PRIVATE_V4]) & ~value.isin([_v4_int(a) for a in PUBLIC_V4])


def is_private(address: Column) -> Column:
    """1.0 for an address that is not globally reachable, 0.0 for the others and for malformed text.

    A mapped address (``::ffff:a.b.c.d``) is judged by its IPv4 part, and a scope (``%eth0``) does not matter.
    """
    def of_groups(groups: Column) -> Column:
        listed = reduce(lambda a, b: a | b, [_in_v6(groups, n) for n in PRIVATE_V6])
        listed = listed & ~reduce(lambda a, b: a | b, [_in_v6(groups, n) for n in PUBLIC_V6])
        mapped = F.get(groups, F.lit(6)).cast("bigint") * 65536 + F.get(groups, F.lit(7))
        return F.when(_in_v6(groups, "::ffff:0:0/96"), _with(mapped, _private_v4)).otherwise(listed)

    v6 = _with(_plain_v6(F.lower(address)), lambda low: F.when(low.rlike(V6_PATTERN), _with(_ipv6_groups(low), of_groups)))
    answer = F.when(address.contains(":"), v6).otherwise(_with(ipv4_number(address), _private_v4))
    return F.coalesce(answer, F.lit(False)).cast("double")
