"""Network-shaped features (FTR-16..19) as native expressions.

IPv4 is handled fully in the JVM (validation regex + octets -> 32-bit integer
-> range tests). Only values containing ':' (IPv6 candidates) reach a
vectorized pandas UDF that uses the standard library's ``ipaddress``.
"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# IPv4 networks the interpreter's ``ipaddress`` treats as
# private (Python 3.13), and the two exceptions inside 192.0.0.0/24.
IPV4_PRIVATE_NETS = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
]
IPV4_PRIVATE_EXCEPTIONS = ["192.0.0.9/32", "192.0.0.10/32"]

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_REGEX = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def _cidr_bounds(cidr: str) -> tuple[int, int]:
    net = ipaddress.ip_network(cidr)
    return int(net.network_address), int(net.broadcast_address)


def ipv4_to_long(s: Column) -> Column:
    """Validated dotted quad -> unsigned 32-bit value as long; invalid -> null."""
    valid = s.rlike(IPV4_REGEX)
    parts = F.split(s, r"\.")
    value = F.lit(0).cast("long")
    for i in range(4):
        value = value * 256 + F.element_at(parts, i + 1).cast("long")
    return F.when(valid, value)


def _in_ranges(v: Column, cidrs: list[str]) -> Column:
    cond = F.lit(False)
    for cidr in cidrs:
        lo, hi = _cidr_bounds(cidr)
        cond = cond | v.between(lo, hi)
    return cond


_IP6_SCHEMA = T.StructType([
    T.StructField("is_private", T.LongType()),
    T.StructField("is_loopback", T.LongType()),
    T.StructField("version", T.LongType()),
])


@F.pandas_udf(_IP6_SCHEMA)
def _ipv6_props(values: pd.Series) -> pd.DataFrame:
    known: dict = {}
    for v in values.dropna().unique():
        try:
            known[v] = ipaddress.ip_address(v)
        except ValueError:
            continue
    table = pd.DataFrame({"is_private": [int(a.is_private) for a in known.values()],
                          "is_loopback": [int(a.is_loopback) for a in known.values()],
                          "version": [a.version for a in known.values()]}, index=list(known), dtype="Int64")
    out = table.reindex(values).reset_index(drop=True)
    return out.fillna({"is_private": 0, "is_loopback": 0})


def ip_features(c: Column, v4: Column | None = None) -> dict[str, Column]:
    """is_private / is_loopback / ip_version; ``v4`` may be a precomputed :func:`ipv4_to_long`."""
    s = c.cast("string")
    v4 = ipv4_to_long(s) if v4 is None else v4
    is_v4 = v4.isNotNull()
    v6 = _ipv6_props(F.when(s.contains(":"), s))
    private = F.when(is_v4, (_in_ranges(v4, IPV4_PRIVATE_NETS)
                             & ~_in_ranges(v4, IPV4_PRIVATE_EXCEPTIONS)).cast("long"))
    loopback = F.when(is_v4, _in_ranges(v4, ["127.0.0.0/8"]).cast("long"))
    version = F.when(is_v4, F.lit(4).cast("long"))
    return {
        "is_private": F.coalesce(private, F.when(s.contains(":"), v6["is_private"]), F.lit(0).cast("long")),
        "is_loopback": F.coalesce(loopback, F.when(s.contains(":"), v6["is_loopback"]), F.lit(0).cast("long")),
        "ip_version": F.coalesce(version, F.when(s.contains(":"), v6["version"])),
    }


def try_double(c: Column) -> Column:
    return c.try_cast("double")


def port_features(c: Column) -> dict[str, Column]:
    n = try_double(c)
    zero = F.lit(0).cast("long")
    return {
        "is_well_known": F.coalesce((n < 1024).cast("long"), zero),
        "is_registered": F.coalesce(((n >= 1024) & (n < 49152)).cast("long"), zero),
        "is_dynamic": F.coalesce((n >= 49152).cast("long"), zero),
    }


def url_path(c: Column) -> Column:
    """Path part as the reference derives it: URLs -> urlparse path (no ;params), else text before '?'."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    is_url = s.startswith("http://") | s.startswith("https://")
    raw = F.regexp_extract(s, r"^https?://[^/?#]*([^?#]*)", 1)
    no_params = F.regexp_replace(raw, r";[^/]*$", "")
    url_path_ = F.when(no_params == "", F.lit("/")).otherwise(no_params)
    return F.when(is_url, url_path_).otherwise(F.substring_index(s, "?", 1))


def path_features(c: Column, path: Column | None = None) -> dict[str, Column]:
    """depth / extension / has_query; ``path`` may be a precomputed :func:`url_path`."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    p = url_path(c) if path is None else path
    seg = F.substring_index(p, "/", -1)
    ext = F.when(F.instr(seg, ".") > 0, F.nullif(F.lower(F.substring_index(seg, ".", -1)), F.lit("")))
    return {
        "depth": F.size(F.filter(F.split(p, "/"), lambda x: x != "")).cast("long"),
        "extension": ext,
        "has_query": F.instr(s, "?").__gt__(0).cast("long"),
    }


def status_category(c: Column) -> Column:
    n = try_double(c)
    whole = n.try_cast("long")  # truncates toward zero like int(); inf/nan -> null
    floor_div = F.floor(whole.cast("double") / 100).cast("long")
    return F.when(whole.isNotNull(), F.concat(floor_div.cast("string"), F.lit("xx")))
