"""Text-report sources: netstat listings (SRC-09) and severity-flagged IDs
from a scanner report (SRC-10), parsed with column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage import rules as R

NETSTAT_HEADERS = ["pid", "process_name", "protocol", "state", "src-addr", "src-port", "dst-addr", "dst-port"]


def parse_netstat(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines 'Proto Local Foreign State [PID]' -> connection rows.

    Blank, '#' and 'Proto' lines are skipped; fewer than four tokens is not
    a row; addresses split at their last ':' (IPv6 safe).
    """
    line = F.trim(F.col(value))
    t = lines.select(F.split(line, r"\s+").alias("t"), line.alias("l")).where(
        (F.col("l") != "") & ~F.col("l").startswith("#") & ~F.col("l").startswith("Proto"))
    t = t.where(F.size("t") >= 4)
    local, remote = F.get(F.col("t"), 1), F.get(F.col("t"), 2)

    def addr(x):
        return F.when(x.contains(":"), F.regexp_extract(x, r"^(.*):[^:]*$", 1)).otherwise(x)

    def port(x):
        return F.when(x.contains(":"), F.regexp_extract(x, r":([^:]*)$", 1)).otherwise(F.lit(""))

    return t.select(
        F.coalesce(F.get(F.col("t"), 4), F.lit("")).alias("pid"),
        F.get(F.col("t"), 0).alias("protocol"), F.get(F.col("t"), 3).alias("state"),
        addr(local).alias("src-addr"), port(local).alias("src-port"),
        addr(remote).alias("dst-addr"), port(remote).alias("dst-port"))


def flagged_ids(lines: DataFrame, value: str = "value") -> DataFrame:
    """Distinct first all-digit token of lines naming a severity keyword."""
    up = F.upper(F.col(value))
    hit = F.lit(False)
    for kw in R.SEVERITY_KEYWORDS:
        hit = hit | up.contains(kw)
    toks = F.split(F.trim(F.translate(F.col(value), ",|", "  ")), r"\s+")
    first = F.get(F.filter(toks, lambda x: x.rlike(r"^[0-9]+$")), 0)
    return lines.where(hit).select(first.alias("pid")).where(F.col("pid").isNotNull()).distinct()


def lossy_text(content):
    """SCL-14: bytes as UTF-8 text; what is no UTF-8 becomes U+FFFD, nothing fails."""
    return F.make_valid_utf8(content.cast("string"))
