"""IP address rules, all as built-in expressions so they stay inside code generation."""

from __future__ import annotations

import ipaddress
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from footfall import fixed_values as fv

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_H = "[0-9A-Fa-f]{1,4}"


def _v6_pattern() -> str:
    """Full form, every position of ``::``, and each of them with a dotted tail."""
    forms = []
    for tail, groups in ((_H, 8), (V4, 7)):
        forms.append(f"(?:{_H}:){{{groups - 1}}}{tail}")
        for before in range(groups):
            after = groups - 1 - before
            head = f"{_H}(?::{_H}){{{before - 1}}}" if before else ""
            ends = f"(?:{_H}:){{0,{after - 1}}}{tail}" if after else ""
            if tail is _H:
                ends = f"(?:{ends})?" if ends else ""
            elif not ends:
                continue
            forms.append(f"{head}::{ends}")
    return "(?:" + "|".join(forms) + ")"


V6 = _v6_pattern()


def is_ipv4(c: Column) -> Column:
    return c.rlike(f"^{V4}$")


def is_ipv6(c: Column) -> Column:
    return c.contains(":") & c.rlike(f"^{V6}$")


def is_ip(c: Column) -> Column:
    return is_ipv4(c) | is_ipv6(c)


def ipv4_to_long(c: Column) -> Column:
    """Address as a number; NULL when it is no IPv4 address."""
    upto = lambda n: F.substring_index(c, ".", n)
    octets = [upto(1), F.substring_index(upto(2), ".", -1), F.substring_index(upto(3), ".", -1), upto(-1)]
    value = sum(o.cast("long") * (256 ** (3 - i)) for i, o in enumerate(octets))
    return F.when(is_ipv4(c), value)


def _hex4(c: Column) -> Column:
    return F.lpad(F.lower(c), 4, "0")


def ipv6_to_hex(c: Column) -> Column:
    """Address as 32 lower-case hex digits; NULL when it is no IPv6 address."""
    dotted = F.regexp_extract(c, rf"({V4})$", 1)
    octets = F.split(dotted, r"\.")
    pair = lambda i: F.lpad(F.lower(F.hex(octets[i].cast("int"))), 2, "0")
    tail = F.concat(pair(0), pair(1), F.lit(":"), pair(2), pair(3))
    plain = F.when(c.contains("."), F.concat(F.regexp_replace(c, rf"{V4}$", ""), tail)).otherwise(c)
    groups = lambda text: F.filter(F.split(text, ":"), lambda g: g != "")
    head = groups(F.substring_index(plain, "::", 1))
    rest = F.when(plain.contains("::"), groups(F.substring_index(plain, "::", -1))).otherwise(
        F.array().cast("array<string>")
    )
    zeros = F.array_repeat(F.lit("0000"), 8 - F.size(head) - F.size(rest))
    return F.when(
        is_ipv6(c),
        F.concat_ws("", F.transform(head, _hex4), zeros, F.transform(rest, _hex4)),
    )


def _anonymous_v6(hex32: Column) -> Column:
    """Canonical text of the /48 network: the last five groups are zero, so ``::`` ends it."""
    group = lambda i: F.regexp_replace(F.substring(hex32, 4 * i + 1, 4), "^0{1,3}", "")
    kept = F.concat_ws(":", group(0), group(1), group(2))
    return F.concat(F.regexp_replace(kept, r"^(?:0:)*0$|(?::0)+$", ""), F.lit("::"))


def anonymize_ip(c: Column) -> Column:
    """Last IPv4 octet to zero; IPv6 to its /48; anything else becomes ``0.0.0.0``."""
    return (
        F.when(is_ipv4(c), F.regexp_replace(c, r"\d+$", "0"))
        .when(is_ipv6(c), _anonymous_v6(ipv6_to_hex(c)))
        .otherwise(F.lit("0.0.0.0"))
    )


def client_ip(*headers: Column) -> Column:
    """First valid address among the headers (first item of a list); else the loopback address."""
    first = [F.trim(F.substring_index(h, ",", 1)) for h in headers]
    return F.coalesce(*[F.when(is_ip(v), v) for v in first], F.lit("127.0.0.1"))


def cidr_bounds(cidr: str) -> tuple[int, str, str] | None:
    """(family, low, high) of a block or single address, as hex; NULL-like for anything invalid.

    As in bit-wise matching, host bits set below the prefix are ignored.
    """
    base, _, bits = cidr.strip().partition("/")
    try:
        address = ipaddress.ip_address(base)
        net = ipaddress.ip_network(f"{base}/{int(bits)}" if bits else base, strict=False)
    except ValueError:
        return None
    width = 8 if address.version == 4 else 32
    return (
        address.version,
        format(int(net.network_address), f"0{width}x"),
        format(int(net.broadcast_address), f"0{width}x"),
    )


def in_any_cidr(c: Column, cidrs: Sequence[str]) -> Column:
    """True when the address lies in a listed block; the list is configuration, so it is inlined."""
    bounds = [b for b in map(cidr_bounds, cidrs) if b]
    v4 = [(int(lo, 16), int(hi, 16)) for fam, lo, hi in bounds if fam == 4]
    v6 = [(lo, hi) for fam, lo, hi in bounds if fam == 6]
    # one-element arrays bind the parsed address to a name, so it is written and computed once
    hit = F.lit(False)
    if v4:
        hit = hit | _bound(ipv4_to_long(c), lambda n: _any([n.between(lo, hi) for lo, hi in v4]))
    if v6:
        hit = hit | _bound(ipv6_to_hex(c), lambda x: _any([x.between(lo, hi) for lo, hi in v6]))
    return hit


def _bound(value: Column, test) -> Column:
    return F.coalesce(F.exists(F.array(value), test), F.lit(False))


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def is_private_ip(c: Column) -> Column:
    """Private, reserved or not an address at all."""
    return F.coalesce(~is_ip(c), F.lit(True)) | in_any_cidr(c, fv.PRIVATE_V4 + fv.PRIVATE_V6)
