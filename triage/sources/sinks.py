"""Sinks (SNK-01..06): fully quoted CSV, append-mode error log, typed-table
Parquet/CSV, inventory JSON and flat manifest.  All are DataFrame writers:
each task writes its own part files; nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triage.table import ForensicTable

CSV_OPTIONS = {"header": "true", "quoteAll": "true", "escape": '"', "quote": '"',
               "emptyValue": '""', "nullValue": "", "encoding": "UTF-8",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_quoted_csv(t: ForensicTable | DataFrame, path: str, mode: str = "overwrite") -> str:
    """Every field quoted, header included; '' and NULL both written as ""."""
    if isinstance(t, ForensicTable):
        df = t.df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(h)
                           for h, c in zip(t.headers, t.columns)])
    else:
        df = t.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in t.columns])
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)
    return path


def write_parse_errors(errors: DataFrame, path: str, source_file: str) -> str:
    """Append parse errors (source_file, row_index, column, raw_value,
    expected_type, error) partitioned by source file; an empty error set
    writes nothing new."""
    (errors.select(F.lit(source_file).alias("source_file"), "row_index", "column", "raw_value",
                   "expected_type", "error")
           .write.mode("append").partitionBy("source_file").options(**CSV_OPTIONS).csv(path))
    return path


def write_typed(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.options(**CSV_OPTIONS).csv(path)
    else:
        w.parquet(path)
    return path


def read_in_order(spark: SparkSession, path: str) -> DataFrame:
    """A written Parquet table with every row's place (from 1) in the order in
    which a sorted DataFrame was written: part files by number, rows as they lie
    in them.  Only the row counts of the files meet in one window."""
    name = F.col("_metadata.file_name")
    rows = spark.read.parquet(path).select("*", name.alias("_file"), F.col("_metadata.row_index").alias("_at"))
    number = [F.regexp_extract("_file", rx, 1).cast("int") for rx in (r"^part-(\d+)", r"-c(\d+)\.")]
    before = Window.orderBy(*number, "_file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("_file").agg((F.max("_at") + 1).alias("_n"))
    starts = files.select(F.col("_file").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (rows.join(starts, F.col("_file") == F.col("_of")).withColumn("place", F.col("_start") + F.col("_at") + 1)
            .drop("_file", "_at", "_of", "_start"))


def write_inventory_json(entries: DataFrame, path: str) -> str:
    """Nested inventory entries (headers / anomalies arrays) as JSON lines."""
    entries.write.mode("overwrite").json(path)
    return path


def manifest_frame(entries: DataFrame) -> DataFrame:
    """filename, row_count, sha256, header_count, anomalies ('; '-joined)."""
    return entries.select(
        "filename", F.col("row_count").cast("string").alias("row_count"), "sha256",
        F.size("headers").cast("string").alias("header_count"),
        F.array_join("anomalies", "; ").alias("anomalies"))


def write_manifest(entries: DataFrame, path: str) -> str:
    return write_quoted_csv(manifest_frame(entries), path)
