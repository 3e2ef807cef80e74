"""File-level sources: encoding detection (SRC-03), recovered-file
listing by extension (SRC-11), manifest load (SRC-14), typed-table and spec
discovery (SRC-15/16) and table selection (SRC-18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triage import rules as R
from triage.sources.csv import read_csv_lossless


def detect_encoding(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """path, encoding: UTF-8 when the bytes are valid UTF-8, else ISO-8859-1
    (a leading BOM is valid UTF-8 and is dropped by the CSV reader)."""
    df = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
          .option("recursiveFileLookup", "true").load(root))
    ok = F.is_valid_utf8(F.col("content").cast("string"))
    return df.select("path", F.when(ok, F.lit("UTF-8")).otherwise(F.lit("ISO-8859-1")).alias("encoding"))


def read_csv_any_encoding(spark: SparkSession, root: str, name: str = ""):
    """Lossless read where each file is decoded with its detected encoding:
    one read per encoding group, unioned (the group list is tiny)."""
    groups = detect_encoding(spark, root).groupBy("encoding").agg(F.collect_list("path").alias("paths"))
    parts = [read_csv_lossless(spark, r["paths"], encoding=r["encoding"], name=name)
             for r in groups.collect()]
    if not parts:
        return None
    first = parts[0]
    df, errs = first.table.df, first.errors
    for p in parts[1:]:
        df = df.unionByName(p.table.df.select(*first.table.df.columns))
        errs = errs.unionByName(p.errors)
    first.table.df, first.errors = df, errs
    return first


def recovered_files(listing: DataFrame, path: str = "path") -> DataFrame:
    """Files whose extension marks an executable artefact."""
    exts = "|".join(e.lstrip(".") for e in R.RECOVERED_EXTENSIONS)
    return listing.where(F.lower(F.col(path)).rlike(rf"\.({exts})$"))


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """filename -> row_count (unparsable -> 0), last entry per filename wins."""
    m = (spark.read.options(header=True, multiLine=True, escape='"').csv(path)
         .withColumn("_row_id", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))))
    if "filename" not in m.columns:
        return spark.createDataFrame([], "filename string, row_count long, sha256 string")
    cnt = F.coalesce(F.col("row_count").try_cast("long"), F.lit(0)) if "row_count" in m.columns else F.lit(0)
    sha = F.col("sha256") if "sha256" in m.columns else F.lit("")
    return (m.select("filename", "_row_id", cnt.alias("row_count"), sha.alias("sha256"))
             .groupBy("filename")
             .agg(F.max_by(F.struct("row_count", "sha256"), "_row_id").alias("m"))
             .select("filename", "m.row_count", "m.sha256"))


def typed_table_name(path: F.Column) -> F.Column:
    """typed_<table>.csv -> <table> (SRC-15)."""
    return F.regexp_extract(path, r"typed_(.*)\.csv(/.*)?$", 1)


def match_specs(entries: DataFrame, spec_names: list[str]) -> DataFrame:
    """SRC-16: entries joined to the spec registry by table stem; unmatched
    entries get status no_spec."""
    stem = F.regexp_replace(F.col("filename"), r"\.[^.]*$", "")
    return entries.select("filename", stem.alias("table"),
                          F.when(stem.isin(spec_names), F.lit("matched")).otherwise(F.lit("no_spec")).alias("spec_status"))


def select_tables(registry: list[str], only: str | None = None, exclude: str | None = None):
    """SRC-18: (selected names in registry order, unknown requested names)."""
    want = [x.strip() for x in only.split(",")] if only else list(registry)
    drop = {x.strip() for x in exclude.split(",")} if exclude else set()
    unknown = sorted((set(want) | drop) - set(registry))
    return [n for n in registry if n in want and n not in drop], unknown
