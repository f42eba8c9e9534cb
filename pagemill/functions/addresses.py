"""Private-network test for resolved IP addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.binding import let

# IPv4 ranges that must not be fetched, as network and prefix length.
PRIVATE_V4 = [
    ("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16),  # private
    ("127.0.0.0", 8),                                          # loopback
    ("169.254.0.0", 16),                                       # link local
    ("100.64.0.0", 10),                                        # carrier-grade NAT
]

OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
V4 = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"
V6_GROUP = "[0-9a-f]{1,4}"


def _v4_number(address: Column) -> Column:
    octets = [F.regexp_extract(address, V4, i).cast("long") for i in (1, 2, 3, 4)]
    return octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]


def _network(address: str, prefix: int) -> tuple[int, int]:
    start = 0
    for octet in address.split("."):
        start = start * 256 + int(octet)
    return start, start + 2 ** (32 - prefix) - 1


def is_private_address(address: Column) -> Column:
    """True for private, loopback, link-local, unique-local and carrier NAT addresses.

    Anything that is not a well-formed IPv4 or IPv6 address counts as private.
    """
    return let(F.lower(F.trim(address)), _is_private)


def _is_private(text: Column) -> Column:
    number = _v4_number(text)
    v4_private = F.lit(False)
    for start, end in (_network(*net) for net in PRIVATE_V4):
        v4_private = v4_private | number.between(start, end)

    groups = F.filter(F.split(text, ":"), lambda g: g != "")
    shortened = F.contains(text, F.lit("::"))
    v6_valid = (
        text.rlike(rf"^({V6_GROUP})?(:{{1,2}}{V6_GROUP})*(::)?$")
        & ~text.rlike(":::|::.*::")
        & F.contains(text, F.lit(":"))
        & F.when(shortened, F.size(groups) <= 7).otherwise((F.size(groups) == 8) & ~text.rlike("^:|:$"))
    )
    first = F.when(text.startswith("::"), F.lit(0)).otherwise(
        F.conv(F.element_at(groups, 1), 16, 10).cast("long")
    )
    loopback = (
        (F.size(groups) > 0)
        & ~text.endswith("::")
        & (F.conv(F.element_at(groups, -1), 16, 10) == "1")
        & F.forall(F.slice(groups, F.lit(1), F.greatest(F.size(groups) - 1, F.lit(0))), lambda g: g.rlike("^0+$"))
    )
    v6_private = first.between(0xFE80, 0xFEBF) | first.between(0xFC00, 0xFDFF) | loopback

    return F.coalesce(
        F.when(text.rlike(V4), v4_private).when(v6_valid, v6_private).otherwise(F.lit(True)), F.lit(True)
    )


def is_fetchable(addresses: Column) -> Column:
    """A host may be fetched if it resolves and none of its addresses is private."""
    known = F.coalesce(addresses, F.array().cast("array<string>"))
    return (F.size(known) > 0) & ~F.exists(known, is_private_address)
