"""Category of an IP address: why an outbound request to it would be blocked."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INVALID = "invalid"

# --- fixed values: blocked IPv4 ranges, first match wins ---
IPV4_RANGES = [
    ("loopback", "127.0.0.0/8"),
    ("link-local", "169.254.0.0/16"),
    ("multicast", "224.0.0.0/4"),
    ("unspecified", "0.0.0.0/32"),
    (None, "192.0.0.9/32"),
    (None, "192.0.0.10/32"),
    ("private", "0.0.0.0/8"),
    ("private", "10.0.0.0/8"),
    ("private", "172.16.0.0/12"),
    ("private", "192.0.0.0/24"),
    ("private", "192.0.2.0/24"),
    ("private", "192.168.0.0/16"),
    ("private", "198.18.0.0/15"),
    ("private", "198.51.100.0/24"),
    ("private", "203.0.113.0/24"),
    ("private", "240.0.0.0/4"),
]


def ipv4_number(address: Column) -> Column:
    """A dotted IPv4 address as a number, NULL when it is not one."""
    parts = F.split(address, r"\.")
    octets = [F.try_element_at(parts, F.lit(i)).try_cast("bigint") for i in range(1, 5)]
    number = octets[0] * (1 << 24) + octets[1] * (1 << 16) + octets[2] * (1 << 8) + octets[3]
    # A leading zero might mean an octal number elsewhere, so it is refused.
    well_formed = address.rlike(r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$")
    return F.when(well_formed & (F.greatest(*octets) <= 255), number)


def ipv4_category(address: Column) -> Column:
    number = ipv4_number(address)
    category = F.when(number.isNull(), INVALID)
    for name, cidr in IPV4_RANGES:
        block = ipaddress.ip_network(cidr)
        inside = number.between(int(block.network_address), int(block.broadcast_address))
        category = category.when(inside, F.lit(name).cast("string"))
    return category


# --- fixed values: blocked IPv6 ranges, first match wins ---
IPV6_RANGES = [
    ("loopback", "::1/128"),
    ("link-local", "fe80::/10"),
    ("multicast", "ff00::/8"),
    ("unspecified", "::/128"),
    (None, "2001:1::1/128"),
    (None, "2001:1::2/128"),
    (None, "2001:3::/32"),
    (None, "2001:4:112::/48"),
    (None, "2001:20::/28"),
    (None, "2001:30::/28"),
    ("private", "64:ff9b:1::/48"),
    ("private", "100::/64"),
    ("private", "2001::/23"),
    ("private", "2001:db8::/32"),
    ("private", "2002::/16"),
    ("private", "fc00::/7"),
]


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ipv6_groups(address: Column) -> Column:
    """The eight groups of an IPv6 address as numbers, NULL when it is not one.

    A zone after ``%`` is left out; a dotted tail counts as two groups.
    """
    none = F.array().cast("array<string>")

    def without_zone(zone: Column) -> Column:
        good = (F.size(zone) == 1) | ((F.size(zone) == 2) & (F.get(zone, F.lit(1)) != ""))
        return F.when(good, F.get(zone, F.lit(0)))

    def without_dots(plain: Column) -> Column:
        tail = F.regexp_extract(plain, r"^.*:([^:]*\.[^:]*)$", 1)
        head = F.regexp_replace(plain, r"[^:]*\.[^:]*$", "")
        words = _with(ipv4_number(tail), lambda n: F.concat(head, F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n.bitwiseAND(0xFFFF))))
        return F.when(plain.contains("."), words).otherwise(plain)

    def sides(halves: Column) -> Column:
        parts = F.transform(halves, lambda h: F.when(h == "", none).otherwise(F.split(h, ":", -1)))
        return F.when(F.size(halves) <= 2, parts)

    def filled(parts: Column) -> Column:
        missing = 8 - F.size(F.flatten(parts))
        short = F.size(parts) == 2
        zeros = F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)))
        whole = F.when(short, F.concat(F.get(parts, F.lit(0)), zeros, F.get(parts, F.lit(1)))).otherwise(F.get(parts, F.lit(0)))
        return F.when(F.when(short, missing >= 1).otherwise(missing == 0), whole)

    def numbers(groups: Column) -> Column:
        good = F.forall(groups, lambda g: g.rlike("^[0-9a-fA-F]{1,4}$"))
        return F.when(good, F.transform(groups, lambda g: F.conv(g, 16, 10).cast("bigint")))

    plain = _with(F.split(address, "%"), without_zone)
    halves = F.split(_with(plain, without_dots), "::", -1)
    return _with(_with(_with(halves, sides), filled), numbers)


def ipv6_category(address: Column) -> Column:
    """Category of an IPv6 address; one that maps an IPv4 address has that one's."""

    def category(groups: Column) -> Column:
        mapped = (F.size(F.filter(F.slice(groups, 1, 5), lambda g: g != 0)) == 0) & (F.get(groups, F.lit(5)) == 0xFFFF)
        pair = [F.get(groups, F.lit(k)) for k in (6, 7)]
        dotted = F.concat_ws(".", *[x for g in pair for x in (F.shiftright(g, 8), g.bitwiseAND(255))])
        found = F.when(groups.isNull(), INVALID).when(mapped, _with(dotted, ipv4_category))
        for name, cidr in IPV6_RANGES:
            block = ipaddress.ip_network(cidr)
            bits = int(block.network_address)
            inside = F.lit(True)
            for k in range(8):
                width = min(16, max(0, block.prefixlen - 16 * k))
                if width:
                    own = (bits >> (112 - 16 * k)) & 0xFFFF
                    inside = inside & (F.shiftright(F.get(groups, F.lit(k)), 16 - width) == own >> (16 - width))
            found = found.when(inside, F.lit(name).cast("string"))
        return found

    return _with(ipv6_groups(address), category)


def address_category(address: Column) -> Column:
    """Blocking category of an IPv4 or IPv6 address, NULL when public.

    Text that is no address is ``invalid``.
    """
    return F.when(address.contains(":"), ipv6_category(address)).otherwise(ipv4_category(address))


def address_bits(address: Column) -> Column:
    """``4`` or ``6`` and the bits of an address as zeros and ones, NULL when it is none.

    An IPv6 address that maps an IPv4 address gives that one's.
    """

    def four(number: Column) -> Column:
        return F.concat(F.lit("4"), F.lpad(F.bin(number), 32, "0"))

    def six(groups: Column) -> Column:
        bits = F.array_join(F.transform(groups, lambda g: F.lpad(F.bin(g), 16, "0")), "")
        mapped = bits.startswith("0" * 80 + "1" * 16)
        return F.when(mapped, F.concat(F.lit("4"), F.substring(bits, 97, 32))).otherwise(F.concat(F.lit("6"), bits))

    return F.when(address.contains(":"), _with(ipv6_groups(address), six)).otherwise(_with(ipv4_number(address), four))
