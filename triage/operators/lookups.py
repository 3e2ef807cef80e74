"""PID-keyed lookups and lineage joins.

Lookup tables are built with a hash aggregate (partial aggregation on the
map side, so a PID that owns a large share of rows collapses before the
shuffle).  Joins against them are left equi-joins: AQE turns them into a
broadcast join when the runtime size is under
``spark.sql.adaptive.autoBroadcastJoinThreshold`` and otherwise splits
skewed partitions of the probe side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage.operators import aliases as A
from triage.table import ForensicTable


def pid_name_lookup(proc: ForensicTable | None, spec: dict | None = None) -> DataFrame | None:
    """DataFrame(pid, name): for a PID listed several times the last row wins.

    Returns None when the table or its pid/name columns are absent (every
    probe then resolves to the caller's default).
    """
    if proc is None:
        return None
    df, present = A.resolve(proc, spec or A.PROCESS_LOOKUP)
    if not (present["pid"] and present["name"]):
        return None
    return (df.where(F.col("pid") != "")
              .groupBy("pid")
              .agg(F.max_by("name", "_row_id").alias("name")))


def with_owner_name(df: DataFrame, lookup: DataFrame | None, pid_col: str = "pid",
                    out: str = "proc_name", default: str = "<unknown>") -> DataFrame:
    """Left-join a PID lookup; unmatched (or no lookup) -> default."""
    if lookup is None:
        return df.withColumn(out, F.lit(default))
    lk = lookup.select(F.col("pid").alias("_lk_pid"), F.col("name").alias("_lk_name"))
    return (df.join(lk, df[pid_col] == lk["_lk_pid"], "left")
              .withColumn(out, F.coalesce(F.col("_lk_name"), F.lit(default)))
              .drop("_lk_pid", "_lk_name"))


def with_parent_name(df: DataFrame, lookup: DataFrame | None) -> DataFrame:
    """parent_name := explicit column if non-empty, else name of ppid, else ''."""
    if lookup is None:
        return df.withColumn("parent_name_resolved", F.col("parent_name"))
    lk = lookup.select(F.col("pid").alias("_pp_pid"), F.col("name").alias("_pp_name"))
    joined = df.join(lk, df["ppid"] == lk["_pp_pid"], "left")
    return (joined.withColumn(
        "parent_name_resolved",
        F.when(F.col("parent_name") != "", F.col("parent_name"))
         .otherwise(F.coalesce(F.col("_pp_name"), F.lit(""))))
        .drop("_pp_pid", "_pp_name"))


def process_lineage(proc: ForensicTable) -> DataFrame:
    """Parent and grandparent resolution over a process table (ENR-02).

    Every row gets parent_name / pppid from the process with pid == ppid,
    then grandparent_name from the process with pid == pppid.  The lookup
    side keeps one row per PID (last wins), so the joins never fan out.
    """
    df, _ = A.resolve(proc, {"pid": A.PID, "ppid": A.PPID, "name": A.PROC_NAME})
    info = (df.where(F.col("pid") != "")
              .groupBy("pid")
              .agg(F.max_by(F.struct("name", "ppid"), "_row_id").alias("i"))
              .select("pid", F.col("i.name").alias("name"), F.col("i.ppid").alias("ppid")))
    p = info.select(F.col("pid").alias("_p_pid"), F.col("name").alias("_p_name"),
                    F.col("ppid").alias("_p_ppid"))
    g = info.select(F.col("pid").alias("_g_pid"), F.col("name").alias("_g_name"))
    out = (df.join(p, df["ppid"] == p["_p_pid"], "left")
             .join(g, F.col("_p_ppid") == g["_g_pid"], "left"))
    return out.select(
        "_row_id", "pid", "ppid",
        F.coalesce("_p_ppid", F.lit("")).alias("pppid"),
        "name",
        F.coalesce("_p_name", F.lit("")).alias("parent_name"),
        F.when(F.col("_p_pid").isNotNull(), F.coalesce("_g_name", F.lit(""))).otherwise(F.lit(""))
         .alias("grandparent_name"),
    )
