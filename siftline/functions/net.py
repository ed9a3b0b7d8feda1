"""Address and URL safety predicates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from siftline.functions.draws import let
from siftline.functions.urls import url_authority, url_host, url_scheme

# IPv4 ranges a resolved host must not fall into (special-purpose registry,
# multicast, reserved, shared address space).
BLOCKED_IPV4 = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "100.64.0.0/10",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "224.0.0.0/4",
    "240.0.0.0/4",
)
# Globally reachable addresses inside a blocked range.
ALLOWED_IPV4 = ("192.0.0.9", "192.0.0.10")
ALLOWED_SCHEMES = ("http", "https")

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
_MAPPED = r"(?i)^::ffff:(\d+\.\d+\.\d+\.\d+)$"


def _col(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def ipv4_number(address: Column | str) -> Column:
    """The address as a BIGINT, or null when it is not a dotted quad."""
    column = _col(address)
    value = F.lit(0).cast("long")
    for i in range(1, 5):
        value = value * 256 + F.split_part(column, F.lit("."), F.lit(i)).cast("long")
    return F.when(column.rlike(IPV4), value)


def _cidr_bounds(cidr: str) -> tuple[int, int]:
    address, width = cidr.split("/")
    low = 0
    for part in address.split("."):
        low = low * 256 + int(part)
    return low, low + 2 ** (32 - int(width)) - 1


@F.pandas_udf(T.BooleanType())
def _blocked_ipv6(address: pd.Series) -> pd.Series:
    import ipaddress

    def blocked(text):
        if text is None:
            return None
        try:
            ip = ipaddress.ip_address(text)
        except ValueError:
            return True
        return bool(
            ip.is_private
            or ip.is_loopback
            or ip.is_link_local
            or ip.is_multicast
            or ip.is_reserved
            or ip.is_unspecified
        )

    return address.map(blocked)


def is_blocked_ipv4(address: Column | str) -> Column:
    """Native range test; null when the value is not a dotted quad."""

    def in_a_range(number: Column) -> Column:
        blocked = F.lit(False)
        for cidr in BLOCKED_IPV4:
            low, high = _cidr_bounds(cidr)
            blocked = blocked | number.between(low, high)
        return blocked

    return let(ipv4_number(address), in_a_range) & ~_col(address).isin(*ALLOWED_IPV4)


def is_blocked_ip(address: Column | str) -> Column:
    """Whether an address is internal or otherwise not publicly routable.

    A mapped IPv6 address is judged by the IPv4 address inside it. Only other IPv6
    addresses go to Python; text that is no address at all counts as blocked.
    """
    column = _col(address)
    inner = F.regexp_extract(column, _MAPPED, 1)
    plain = F.when(inner != "", inner).otherwise(column)
    six = F.when(~plain.rlike(IPV4), plain)
    return F.when(column.isNull(), None).otherwise(
        F.coalesce(is_blocked_ipv4(plain), _blocked_ipv6(six), F.lit(True))
    )


def url_rejection(url: Column | str) -> Column:
    """Reason a URL is refused before any lookup, or null."""
    column = _col(url)
    scheme = url_scheme(column)
    return (
        F.when(~scheme.isin(*ALLOWED_SCHEMES), F.concat(F.lit("scheme not accepted: "), scheme))
        .when(url_authority(column).contains("@"), "address carries a user name")
        .when(F.coalesce(url_host(column), F.lit("")) == "", "address names no host")
    )
