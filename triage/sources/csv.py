"""Lossless CSV ingest (SRC-01/02/05) on Spark's CSV reader.

* every cell is a string; missing trailing cells of a short record become ''
  (no error); a long record keeps its first n cells and yields an ingest
  error row "Extra columns: expected n, got m" with the verbatim record;
* quoted newlines are kept (multiLine); the escape character is '"' so
  Windows paths with backslashes are read verbatim;
* each file's header is its first record; the table keeps the header list
  as-is (duplicates included) and maps it to positional columns;
* rows carry _source_file, _row_index (0-based, contiguous per file) and
  _row_id = (file, _row_index), which orders a table of several files.

The header line is parsed on the driver with Python's csv module (one line
per table, like Spark's own header inference); all data parsing happens in
Spark tasks.  multiLine CSV files are not splittable, so a table arrives
as many files or is converted to Parquet once and queried from there.
"""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triage.table import ForensicTable

NULL_SENTINEL = "\u0000<missing>\u0000"
CORRUPT = "_corrupt"
# a CSV field behind its comma: quoted (with "" escapes) or anything up to the next comma
FIELD_RE = r',("(?:[^"]|"")*"|[^,]*)'
MID_SHIFT = 1 << 33          # monotonically_increasing_id = partition << 33 | record


@dataclass
class CsvRead:
    table: ForensicTable
    errors: DataFrame            # _source_file, line_number, raw_line, error


def parse_header(line: str) -> list[str]:
    """Header cells of the first line (driver side, one line)."""
    rows = list(csv.reader(io.StringIO(line)))
    return rows[0] if rows else []


def fields_of(record: Column) -> Column:
    """The fields of a record, quotes included; a comma goes in front, so that
    an empty first field is a field like any other."""
    return F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(FIELD_RE), 1)


def first_line(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str | None:
    """First line of the first file by name that has one.  ``head`` of a single
    file reads its first split alone, which begins the file."""
    for f in sorted(spark.read.text(path).inputFiles()):
        rows = spark.read.option("encoding", encoding).text(f).head(1)
        if rows:
            return rows[0]["value"].lstrip("﻿")
    return None


def with_row_index(df: DataFrame, by: str, mid: str = "_row_id", out: str = "_row_index") -> DataFrame:
    """Contiguous 0-based position of each row within its ``by`` group, in
    read order, without a global sort: count rows per (group, partition),
    turn counts into offsets over the per-partition table, join back.
    """
    part = F.floor(F.col(mid) / MID_SHIFT).cast("long")
    local = F.col(mid) - part * MID_SHIFT
    stats = (df.groupBy(F.col(by).alias("_ix_by"), part.alias("_ix_part"))
               .agg(F.count(F.lit(1)).alias("_ix_n"), F.min(local).alias("_ix_lo")))
    w = Window.partitionBy("_ix_by").orderBy("_ix_part").rowsBetween(Window.unboundedPreceding, -1)
    offs = stats.withColumn("_ix_off", F.coalesce(F.sum("_ix_n").over(w), F.lit(0)))
    # one row per (file, input partition), bounded by the number of splits: it
    # is broadcast, so that the table itself is neither shuffled nor sorted
    j = df.join(F.broadcast(offs), (F.col(by) == F.col("_ix_by")) & (part == F.col("_ix_part")), "left")
    return (j.withColumn(out, F.col("_ix_off") + local - F.col("_ix_lo"))
             .drop("_ix_by", "_ix_part", "_ix_n", "_ix_lo", "_ix_off"))


def read_csv_lossless(spark: SparkSession, path: str | list[str], headers: list[str] | None = None,
                      encoding: str = "UTF-8", name: str = "") -> CsvRead:
    paths = [path] if isinstance(path, str) else list(path)
    if headers is None:
        line = first_line(spark, paths[0], encoding)
        headers = parse_header(line) if line is not None else []
    n = len(headers)
    cols = [f"_c{i}" for i in range(n)]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in cols]
                          + [T.StructField(CORRUPT, T.StringType())])
    if n == 0:
        empty = spark.createDataFrame([], "_row_id struct<file: string, at: bigint>, _row_index long, _source_file string")
        errs = spark.createDataFrame([], "_source_file string, line_number long, raw_line string, error string")
        return CsvRead(ForensicTable(empty, [], [], name), errs)
    raw = (spark.read.schema(schema)
           .options(header=True, multiLine=True, escape='"', quote='"', mode="PERMISSIVE",
                    columnNameOfCorruptRecord=CORRUPT, nullValue=NULL_SENTINEL, emptyValue="",
                    encoding=encoding, enforceSchema=True, ignoreLeadingWhiteSpace=False,
                    ignoreTrailingWhiteSpace=False)
           .csv(paths)
           .select("*", F.col("_metadata.file_path").alias("_source_file"),
                   F.monotonically_increasing_id().alias("_row_id")))
    raw = _file_order(with_row_index(raw, "_source_file"))
    # (the first-cell test keeps a data column in every plan: Spark rejects
    # scans that reference only the corrupt-record column)
    nfields = F.when(F.col(CORRUPT).isNotNull() & (F.coalesce(F.length(F.col(cols[0])), F.lit(0)) >= 0),
                     F.size(fields_of(F.regexp_replace(F.col(CORRUPT), "\r?\n$", ""))))
    raw = raw.withColumn("_nfields", nfields)
    data = raw.select("_source_file", "_row_id", "_row_index",
                      *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in cols])
    errors = (raw.where(F.col("_nfields") > n)
                 .select("_source_file", (F.col("_row_index") + 2).alias("line_number"),
                         F.regexp_replace(F.col(CORRUPT), "\r?\n$", "").alias("raw_line"),
                         F.concat(F.lit(f"Extra columns: expected {n}, got "),
                                  F.col("_nfields").cast("string")).alias("error")))
    return CsvRead(ForensicTable(data, list(headers), cols, name), errors)


def read_lines(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """Physical lines with file and 0-based line number (text sources)."""
    df = (spark.read.option("encoding", encoding).text(path)
          .select(F.col("value"), F.col("_metadata.file_path").alias("_source_file"),
                  F.monotonically_increasing_id().alias("_row_id")))
    return _file_order(with_row_index(df, "_source_file", out="_line_index"), "_line_index")


def _file_order(df: DataFrame, index: str = "_row_index") -> DataFrame:
    """``_row_id`` := (file, position in the file): Spark packs splits by size,
    so the read order of a table's files is not their order."""
    return df.withColumn("_row_id", F.struct(F.col("_source_file").alias("file"), F.col(index).alias("at")))


def read_csv_linewise(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8",
                      name: str = "") -> CsvRead:
    """SRC-02: every physical line parsed on its own (no multi-line records).
    Blank lines are skipped; lines the parser rejects become error rows."""
    lines = read_lines(spark, path, encoding)
    header = lines.where(F.col("_line_index") == 0).select("value").limit(1).collect()
    headers = parse_header(header[0][0].lstrip("﻿")) if header else []
    n = len(headers)
    cols = [f"_c{i}" for i in range(n)]
    body = lines.where((F.col("_line_index") > 0) & (F.trim(F.col("value")) != ""))
    body = body.withColumn("_fields", fields_of(F.col("value")))
    well_formed = F.col("value").rlike(r'^(?:"(?:[^"]|"")*"|[^,"]*)(?:,(?:"(?:[^"]|"")*"|[^,"]*))*$')
    unq = lambda f: F.when(f.startswith('"'), F.regexp_replace(F.substring(f, F.lit(2), F.length(f) - 2), '""', '"')).otherwise(f)  # noqa: E731,E501
    data = body.where(well_formed).select(
        "_source_file", "_row_id", (F.col("_line_index") - 1).alias("_row_index"),
        *[F.coalesce(unq(F.get(F.col("_fields"), i)), F.lit("")).alias(c) for i, c in enumerate(cols)])
    extra = body.where(well_formed & (F.size("_fields") > n)).select(
        "_source_file", (F.col("_line_index") + 1).alias("line_number"), F.col("value").alias("raw_line"),
        F.concat(F.lit(f"Extra columns: expected {n}, got "), F.size("_fields").cast("string")).alias("error"))
    broken = body.where(~well_formed).select(
        "_source_file", (F.col("_line_index") + 1).alias("line_number"), F.col("value").alias("raw_line"),
        F.lit("unparsable CSV line").alias("error"))
    return CsvRead(ForensicTable(data, headers, cols, name), extra.unionByName(broken))
