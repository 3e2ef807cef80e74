"""IP address classification (private / loopback / link-local / reserved)
with the verdicts of Python 3.13's `ipaddress`, as native Column expressions.

IPv4 is parsed with a strict dotted-quad regex (no leading zeros), turned
into a BIGINT and tested against the ranges below, all in generated code.
IPv6 literals (rows containing ':') are classified by Python's ipaddress in
an Arrow-batched pandas UDF: its validity rules (zone ids, embedded IPv4,
'::' placement) and reserved/private tables are the reference semantics.
"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from triage.rules import PRIVATE_LITERAL_ADDRS

# FIXED VALUES: IPv4 networks for which Python 3.13 reports
# is_private / is_loopback / is_link_local / is_reserved (start, prefix).
IPV4_PRIVATE_NETS = [
    ("0.0.0.0", 8),
    ("10.0.0.0", 8),
    ("127.0.0.0", 8),
    ("169.254.0.0", 16),
    ("172.16.0.0", 12),
    ("192.0.0.0", 24),
    ("192.0.0.170", 31),
    ("192.0.2.0", 24),
    ("192.168.0.0", 16),
    ("198.18.0.0", 15),
    ("198.51.100.0", 24),
    ("203.0.113.0", 24),
    ("240.0.0.0", 4),
    ("255.255.255.255", 32),
]
# Inside 192.0.0.0/24 these two are globally reachable (not private).
IPV4_PRIVATE_EXCEPTIONS = ["192.0.0.9", "192.0.0.10"]

OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9])"
IPV4_RE = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"


def _v4_to_int(a: str) -> int:
    o = [int(x) for x in a.split(".")]
    return (o[0] << 24) | (o[1] << 16) | (o[2] << 8) | o[3]


IPV4_RANGES = [(_v4_to_int(a), _v4_to_int(a) + (1 << (32 - p)) - 1) for a, p in IPV4_PRIVATE_NETS]


def ipv4_int(addr: Column) -> Column:
    """BIGINT value of a strict dotted quad, else NULL."""
    parts = F.split(addr, r"\.")
    val = F.lit(0).cast("bigint")
    for i in range(4):
        val = val * 256 + F.get(parts, i).cast("bigint")
    return F.when(addr.rlike(IPV4_RE), val)


def _v4_private(n: Column) -> Column:
    cond = F.lit(False)
    for lo, hi in IPV4_RANGES:
        cond = cond | n.between(lo, hi)
    exc = [_v4_to_int(a) for a in IPV4_PRIVATE_EXCEPTIONS]
    return cond & ~n.isin(exc)


def _v6_batch(addrs: pd.Series) -> pd.Series:
    """Verdict for IPv6-looking strings with Python's ipaddress (NULL in ->
    NULL out); each distinct value in a batch is classified once."""
    seen: dict[str, bool] = {}

    def one(a):
        if a is None:
            return None
        if a not in seen:
            try:
                ip = ipaddress.ip_address(a)
                seen[a] = bool(ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved)
            except ValueError:
                seen[a] = False
        return seen[a]

    return addrs.map(one).astype("boolean")


_UDF: dict = {}


def ipv6_private(addr: Column) -> Column:
    """Arrow-batched UDF over the rows that contain ':' (others pass NULL)."""
    if "v6" not in _UDF:
        _UDF["v6"] = pandas_udf(_v6_batch, "boolean")
    return _UDF["v6"](F.when(addr.contains(":"), addr))


def with_private_ip(df: DataFrame, addr: str, out: str) -> DataFrame:
    """Add boolean ``out``: is the (already stripped) address private?

    Literal wildcards are private; dotted quads are classified natively;
    IPv6 literals go to ``ipv6_private``; anything else is *not* private
    (so it surfaces for review).
    """
    a = F.col(addr)
    s = df.withColumns({"_ip_v4n": ipv4_int(a), "_ip_v6": ipv6_private(a)})
    v4, v6 = F.col("_ip_v4n"), F.col("_ip_v6")
    verdict = (F.when(a.isin(PRIVATE_LITERAL_ADDRS), F.lit(True))
                .when(v4.isNotNull(), _v4_private(v4))
                .when(a.contains(":"), F.coalesce(v6, F.lit(False)))
                .otherwise(F.lit(False)))
    return s.withColumn(out, verdict).drop("_ip_v4n", "_ip_v6")
