"""File enrichment (ENR-01, JN-08, AGG-04, SCL-04..06, UDF-01).

Content statistics are computed once per stored file (entropy, md5,
sha256, size) and joined to the rows that reference the file.  A raw path
resolves through prioritised candidate keys (as given, relative to the
store root, stripped of leading separators / drive letter, basename); the
candidates of each distinct path are exploded, equi-joined to the store and
the best-ranked hit wins (``min_by`` per path) — a hash join, never a per-row file lookup.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from triage.functions.cells import PY_WHITESPACE


def _entropy_batch(content: pd.Series) -> pd.Series:
    """Shannon entropy (bits/byte, rounded to 6) of each binary value,
    vectorised per value with numpy (one Arrow batch per call)."""
    out = np.zeros(len(content), dtype="float64")
    for i, b in enumerate(content):
        if b is None or len(b) == 0:
            continue
        counts = np.bincount(np.frombuffer(b, dtype=np.uint8), minlength=256)
        p = counts[counts > 0] / len(b)
        out[i] = round(float(-(p * np.log2(p)).sum()), 6)
    return pd.Series(out)


_UDF = {}


def byte_entropy(c: Column) -> Column:
    """Column wrapper; the Arrow UDF is created on first use (needs a session)."""
    if "entropy" not in _UDF:
        _UDF["entropy"] = pandas_udf(_entropy_batch, "double")
    return _UDF["entropy"](c)


def content_stats(store: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, entropy ('%.6f'), md5, sha256, file_size per stored file."""
    c = F.col(content)
    return store.select(
        F.col(path).alias("path"),
        F.format_string("%.6f", byte_entropy(c)).alias("entropy"),
        F.md5(c).alias("md5"), F.sha2(c, 256).alias("sha256"),
        F.octet_length(c).cast("string").alias("file_size"))


def candidate_keys(raw: Column, root: str) -> Column:
    """array<struct<prio, key>>: the four lookup keys of a raw path, best first."""
    p = F.btrim(raw, F.lit(PY_WHITESPACE))
    lead = F.regexp_replace(F.regexp_replace(p, "^/+", ""), r"^\\+", "")
    no_drive = F.when(F.substring(lead, 2, 1) == ":",
                      F.regexp_replace(F.regexp_replace(F.substring(lead, 3, 1 << 30), "^/+", ""), r"^\\+", "")
                      ).otherwise(lead)
    base = F.regexp_extract(p, r"([^/\\]*)$", 1)
    r = root.rstrip("/")
    keys = [F.lit(1), p], [F.lit(2), F.concat(F.lit(r + "/"), p)], \
           [F.lit(3), F.concat(F.lit(r + "/"), no_drive)], [F.lit(4), F.concat(F.lit(r + "/"), base)]
    return F.when(p != "", F.array(*[F.struct(a.alias("prio"), b.alias("key")) for a, b in keys]))


def enrich_files(files: DataFrame, store_stats: DataFrame, root: str, path_col: str = "file_path",
                 id_col: str | None = "file_id") -> DataFrame:
    """ENR-01: file_path, file_id, entropy, md5, sha256, file_size, status.

    Each distinct path is resolved once and joined back on the path itself,
    so a file that many rows reference is one row of the resolution."""
    rows = files.select(F.coalesce(F.col(f"`{path_col}`"), F.lit("")).alias("file_path"),
                        (F.coalesce(F.col(f"`{id_col}`"), F.lit("")) if id_col else F.lit("")).alias("file_id"))
    cands = (rows.select("file_path").distinct()
             .select("file_path", F.explode(candidate_keys(F.col("file_path"), root)).alias("c"))
             .select(F.col("file_path").alias("_raw"), "c.prio", "c.key"))
    hits = (cands.join(store_stats, cands["key"] == store_stats["path"])
                 .groupBy("_raw")
                 .agg(F.min_by(F.struct("entropy", "md5", "sha256", "file_size"), "prio").alias("s")))
    j = rows.join(hits, rows["file_path"] == hits["_raw"], "left")
    found = F.col("s").isNotNull()
    return j.select(
        "file_path", "file_id",
        *[F.when(found, F.col(f"s.{c}")).otherwise(F.lit("")).alias(c)
          for c in ("entropy", "md5", "sha256", "file_size")],
        F.when(found, F.lit("ok")).otherwise(F.lit("not_found")).alias("status"))


def enrichment_status(enriched: DataFrame) -> DataFrame:
    """AGG-14: processed / found / not found, status partial if any missing."""
    return enriched.agg(F.count(F.lit(1)).alias("processed"),
                        F.count_if(F.col("status") == "ok").alias("found"),
                        F.count_if(F.col("status") != "ok").alias("not_found")).withColumn(
        "status", F.when(F.col("not_found") > 0, "partial").otherwise("ok"))


def enrich_file_table(t, store_stats: DataFrame, root: str) -> DataFrame:
    """ENR-01 over a files table: the path column is found by alias (last
    occurrence on duplicate headers), falling back to the first column; the
    id column is optional."""
    from triage.operators.aliases import FILE_ID, FILE_PATH, find_header
    if not t.headers:
        return enrich_files(t.df.select(F.lit("").alias("p"), F.lit("").alias("i")).limit(0),
                            store_stats, root, "p", "i")
    pi = find_header(t.headers, FILE_PATH, dup="last")
    ii = find_header(t.headers, FILE_ID, dup="last")
    path_col = t.columns[pi if pi is not None else 0]
    id_col = t.columns[ii] if ii is not None else None
    return enrich_files(t.df, store_stats, root, path_col, id_col)


STATISTICS = ("entropy", "md5", "sha256", "file_size")


def join_back(table: DataFrame, enriched: DataFrame, path: str) -> DataFrame:
    """JN-13: a table with the statistics of its files, by file path; '' where
    there are none.  Files listed several times under one path have one set of
    statistics, so rows of the table are not multiplied."""
    stats = enriched.where("file_path <> '' and status = 'ok'").groupBy("file_path").agg(*(F.max(c).alias(c) for c in STATISTICS))
    out = table.join(stats, table[path] == stats["file_path"], "left")
    return out.select(*(table[c] for c in table.columns), *(F.coalesce(stats[c], F.lit("")).alias(c) for c in STATISTICS))
