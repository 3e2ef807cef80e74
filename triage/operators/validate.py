"""Validation checks over typed tables (VAL-01..04).

Every check returns rows (table, check, status, detail); the report is their
union plus a PASS/FAIL roll-up.  Counts come from aggregates (one scan per
table); the orphan listing is a distributed top-20, so no table is ever
collected to the driver or into one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triage.functions.cells import PY_WHITESPACE
from triage.table import ForensicTable

RESULT = T.StructType([T.StructField(c, T.StringType(), False) for c in ("table", "check", "status", "detail")])
UNTYPED = ("raw", "string")


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RESULT)


def _union(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else _empty(spark)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, row_count) for a set of tables, one aggregate each."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table"), "row_count")
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def check_parity(spark: SparkSession, manifest: DataFrame, typed: dict[str, DataFrame]) -> DataFrame:
    """Row counts of typed_<t> against the manifest entry <t>.csv.

    manifest: (filename, row_count).  A typed table without a manifest entry
    fails; manifest entries without a typed table are not checked.
    """
    if not typed:
        return _empty(spark)
    counts = table_counts(typed).withColumn("filename", F.concat("table", F.lit(".csv")))
    m = manifest.select("filename", F.col("row_count").cast("long").alias("raw_count"))
    j = counts.join(m, "filename", "left")
    raw, tc = F.col("raw_count").cast("string"), F.col("row_count").cast("string")
    status = F.when(F.col("raw_count").isNull() | (F.col("raw_count") != F.col("row_count")), "FAIL").otherwise("PASS")
    detail = (F.when(F.col("raw_count").isNull(),
                     F.concat(F.lit("No manifest entry for '"), F.col("filename"), F.lit("'. typed_"),
                              F.col("table"), F.lit(".csv has "), tc, F.lit(" rows.")))
               .when(F.col("raw_count") == F.col("row_count"), F.concat(F.lit("raw="), raw, F.lit(", typed="), tc))
               .otherwise(F.concat(F.lit("ROW MISMATCH — raw="), raw, F.lit(", typed="), tc)))
    return j.select(F.col("filename").alias("table"), F.lit("parity").alias("check"),
                    status.alias("status"), detail.alias("detail"))


def check_constraints(spark: SparkSession, typed: dict[str, ForensicTable],
                      specs: dict[str, dict[str, str]]) -> DataFrame:
    """Declared (non raw/string) columns must have no blank cell.

    Tables without a spec are skipped; a spec without typed columns passes.
    """
    parts = []
    for name, t in typed.items():
        spec = specs.get(name)
        if not spec:
            continue
        cols = {h: c for h, c in zip(t.headers, t.columns) if h in spec and spec[h] not in UNTYPED}
        label = F.lit(f"{name}.csv").alias("table")
        if not cols:
            parts.append(spark.range(1).select(label, F.lit("constraint").alias("check"), F.lit("PASS").alias("status"),
                                               F.lit("No typed (non-raw/string) columns to check.").alias("detail")))
            continue
        blank = lambda c: F.btrim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit(PY_WHITESPACE)) == ""
        agg = t.df.agg(F.count(F.lit(1)).alias("n"),
                       F.array(*[F.struct(F.lit(h).alias("col"), F.count_if(blank(c)).alias("cnt"))
                                 for h, c in sorted(cols.items())]).alias("cells"))
        bad = F.filter("cells", lambda x: x["cnt"] > 0)
        detail = F.when(F.size(bad) == 0, F.concat(
            F.lit(f"All {len(cols)} typed column(s) have non-null values across "), F.col("n").cast("string"),
            F.lit(" rows."))).otherwise(F.concat(
                F.lit("Null values in typed columns — "),
                F.array_join(F.transform(bad, lambda x: F.concat(x["col"], F.lit(": "), x["cnt"].cast("string"),
                                                                 F.lit(" null(s)"))), "; ")))
        parts.append(agg.select(label, F.lit("constraint").alias("check"),
                                F.when(F.size(bad) == 0, "PASS").otherwise("FAIL").alias("status"),
                                detail.alias("detail")))
    return _union(spark, parts)


def check_relations(spark: SparkSession, process: ForensicTable | None, net: ForensicTable | None,
                    key: str = "pid", limit: int = 20) -> DataFrame:
    """Every non-empty net.<key> must exist in process.<key> (exact header).

    Orphans are deduplicated with a hash aggregate and anti-joined; the
    detail lists the count and the first ``limit`` orphans in sort order
    (a distributed top-k, not a collect).
    """
    if process is None or net is None or key not in process.headers or key not in net.headers:
        return _empty(spark)
    strip = lambda c: F.btrim(F.coalesce(F.col(f"`{c}`"), F.lit("")), F.lit(PY_WHITESPACE))
    pcol = process.columns[process.headers.index(key)]
    ncol = net.columns[net.headers.index(key)]
    # one aggregate per side: distinct keys with their row counts (blank
    # keys included, so the sums are the table row counts)
    nk = net.df.groupBy(strip(ncol).alias("k")).agg(F.count(F.lit(1)).alias("nc"))
    pk = process.df.groupBy(strip(pcol).alias("k")).agg(F.count(F.lit(1)).alias("pc"))
    keys = nk.join(pk, "k", "full_outer")
    orphan = (F.col("k") != "") & F.col("nc").isNotNull() & F.col("pc").isNull()
    typed_null = lambda t: F.lit(None).cast(t)
    stats = reduce(DataFrame.unionByName, [
        keys.agg(F.count_if(orphan).alias("n"), typed_null("array<string>").alias("top"),
                 F.coalesce(F.sum("nc"), F.lit(0)).cast("long").alias("net_rows"),
                 F.coalesce(F.sum("pc"), F.lit(0)).cast("long").alias("proc_rows")),
        keys.where(orphan).select("k").orderBy("k").limit(limit).agg(
            typed_null("long").alias("n"), F.array_sort(F.collect_list("k")).alias("top"),
            typed_null("long").alias("net_rows"), typed_null("long").alias("proc_rows")),
    ]).agg(*[F.max(c).alias(c) for c in ("n", "top", "net_rows", "proc_rows")])
    n = F.col("n")
    detail = F.when(n == 0, F.concat(
        F.lit("All PIDs in net.csv ("), F.col("net_rows").cast("string"), F.lit(" rows) exist in process.csv ("),
        F.col("proc_rows").cast("string"), F.lit(" rows)."))).otherwise(F.concat(
            n.cast("string"), F.lit(" orphan PID(s) in net.csv not in process.csv: "),
            F.array_join("top", ", "), F.when(n > limit, F.lit(" …")).otherwise(F.lit(""))))
    return stats.select(F.lit("net.csv → process.csv").alias("table"), F.lit("relation").alias("check"),
                        F.when(n == 0, "PASS").otherwise("FAIL").alias("status"), detail.alias("detail"))


def orphans(process: ForensicTable, net: ForensicTable, key: str = "pid") -> DataFrame:
    """Every orphan of ``check_relations``: key, number of rows that use it."""
    strip = lambda t: F.btrim(F.coalesce(F.col(f"`{t.columns[t.headers.index(key)]}`"), F.lit("")), F.lit(PY_WHITESPACE))
    used = net.df.groupBy(strip(net).alias(key)).agg(F.count(F.lit(1)).alias("rows")).where(F.col(key) != "")
    return used.join(process.df.select(strip(process).alias(key)), key, "left_anti")


def summary(results: DataFrame) -> DataFrame:
    """passed, failed, total, overall status."""
    return results.agg(F.count_if(F.col("status") == "PASS").alias("passed"),
                       F.count_if(F.col("status") == "FAIL").alias("failed"),
                       F.count(F.lit(1)).alias("total")).withColumn(
        "overall", F.when(F.col("failed") == 0, "PASS").otherwise("FAIL"))


def report_markdown(results: DataFrame, title: str = "Validation report") -> str:
    """SNK-05: Markdown table of the check rows ('|' escaped) with totals.
    The result has one row per check, so it is rendered on the driver."""
    rows = results.select("table", "check", "status",
                          F.regexp_replace("detail", r"\|", r"\\|").alias("detail")).collect()
    passed = sum(1 for r in rows if r.status == "PASS")
    failed = sum(1 for r in rows if r.status == "FAIL")
    lines = [f"# {title}", "", f"**Overall: {'PASS' if failed == 0 else 'FAIL'}** "
             f"({passed} passed, {failed} failed)", "", "| Table | Check | Status | Detail |",
             "|---|---|---|---|"]
    lines += [f"| {r.table} | {r.check} | {r.status} | {r.detail} |" for r in rows]
    return "\n".join(lines) + "\n"
