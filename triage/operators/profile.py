"""Directory inventory, anomaly tagging and spec scaffolding (PRF-01..03,
SRC-04/06, AGG-01/06/07/13).

One CSV pass parses every record of every file under the case directory:
Spark's multi-line reader splits records, each record's cells are recovered
from its verbatim text with a quote-aware field pattern, the first record
of a file is its header.  Per-file statistics are aggregates; records meet
only a one-row-per-file table of header widths (broadcast by AQE when its
runtime size allows).

A top-level entry ``X.csv`` may be a plain file or a directory of part files
(how Spark writes tables); parts of one entry are folded together.
"""

from __future__ import annotations

import hashlib
import re
from urllib import parse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triage.session import ship_package
from triage.sources.csv import fields_of

CORRUPT = "_corrupt"
#: Bytes that one value of a binary column can hold.
LARGEST = (1 << 31) - 1
# FIXED VALUE: tag of a file that the operating system does not let be read
LOCKED = "locked_by_os"
TOO_LARGE = f"larger than {LARGEST} bytes"
UNREADABLE = "could not be read"
#: A file of more bytes is hashed piece by piece; a smaller one is one binary value.
WHOLE = 8 << 20
#: Bytes of a piece, and of the pieces or lines that a Python worker gets at once.
PIECE, BATCH_BYTES = 1 << 14, 4 << 20
# FIXED VALUES: endings of files that Spark unpacks as it reads their lines; the mark that it leaves out
PACKED = r"\.(bz2|deflate|gz|lz4|snappy|zst)$"
BOM = b"\xef\xbb\xbf"
# FIXED VALUES: characters that make a column name need YAML quoting
YAML_SPECIAL = ":{},[]&*?|>!%@`#'\"\\"


def unquote(f: Column) -> Column:
    return F.when(f.startswith('"') & f.endswith('"') & (F.length(f) >= 2),
                  F.regexp_replace(F.substring(f, F.lit(2), F.length(f) - 2), '""', '"')).otherwise(f)


def _norm_root(root: str) -> str:
    return re.sub(r"^file:(//(?=/))?", "", root).rstrip("/")


def entry_of(path: Column, root: str) -> Column:
    """Top-level entry name under ``root`` for a file path (URI or plain)."""
    return F.regexp_extract(path, re.escape(_norm_root(root)) + r"/([^/]+)", 1)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """All files below root, zero-byte files included: path, entry, length,
    fault (NULL, or why the file cannot be inventoried).

    File listing is metadata: it goes through the Hadoop FileSystem API on
    the driver (as Spark's own file index does); hidden files (_x, .x) are
    skipped like Spark does.  One row per file.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(conf)
    read = jvm.org.apache.hadoop.fs.permission.FsAction.READ
    rows = []
    if fs.exists(p):
        it = fs.listFiles(p, True)
        while it.hasNext():
            st = it.next()
            fp = st.getPath()
            rel = fp.toUri().getPath()[len(_norm_root(p.toUri().getPath())):]
            if any(part.startswith(("_", ".")) for part in rel.strip("/").split("/")):
                continue
            fault = TOO_LARGE if st.getLen() > LARGEST else None
            try:
                fs.access(fp, read)
            except Py4JJavaError as e:
                kind = e.java_exception.getClass().getSimpleName()
                fault = LOCKED if "AccessControl" in kind else UNREADABLE
            rows.append((fp.toString(), int(st.getLen()), fault))
    df = spark.createDataFrame(rows, "path string, length long, fault string")
    return df.withColumn("entry", entry_of(F.col("path"), root))


#: A file that vanishes or fails while it is read costs its own rows alone.
ISOLATED = {"ignoreMissingFiles": "true", "ignoreCorruptFiles": "true"}


def _without(df: DataFrame, faulty: list[str]) -> DataFrame:
    """Leaves files out before they are opened: a filter on file metadata prunes the scan."""
    return df.where(~F.col("_metadata.file_path").isin(faulty)) if faulty else df


def _pieces(batches):
    """Lines of files (percent-encoded path, size, start of the split, line) ->
    (path, size, start, at, n, data): the bytes of each split in pieces, every
    line with its line feed.  A row without data gives
    the bytes that the task has read of a file, and sorts before its pieces."""
    read, at = {}, 0
    for b in batches:
        path, size, start, line = (b.column(x) for x in ("path", "size", "start", "line"))
        ends = np.union1d(*(pc.run_end_encode(x).run_ends.to_numpy() for x in (path, start))) if b.num_rows else []
        lo = 0
        for hi in map(int, ends):
            text = pc.binary_join_element_wise(line.slice(lo, hi - lo), b"", b"\n")
            offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset:text.offset + len(text) + 1]
            n = int(offsets[-1] - offsets[0])
            cuts = np.append(np.arange(0, n, PIECE), n).astype(np.int32)
            k, of = len(cuts) - 1, (parse.unquote(path[lo].as_py()), size[lo].as_py())     # as binaryFile and the listing name it
            read[of] = read.get(of, 0) + n
            data = pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(cuts), text.buffers()[2].slice(int(offsets[0]), n)])
            yield pa.RecordBatch.from_arrays([pa.repeat(of[0], k), pa.repeat(of[1], k), pa.repeat(start[lo].as_py(), k), pa.array(np.arange(at, at + k)),
                                              pa.array(np.diff(cuts).astype(np.int64)), data], ["path", "size", "start", "at", "n", "data"])
            lo, at = hi, at + k
    if read:
        yield pa.RecordBatch.from_pylist([{"path": p, "size": size, "start": -1, "at": 0, "n": n, "data": None} for (p, size), n in read.items()],
                                         pa.schema([("path", pa.string()), ("size", pa.int64()), ("start", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("data", pa.binary())]))


def _digests(batches):
    """Sorted pieces -> (path, size, sha256, md5) of every file that they make
    up.  Lines do not tell whether the last one has a line feed, nor a byte
    order mark: the file's size does."""
    path, size, left, missing, hashes = None, 0, None, 0, ()

    def finished():
        whole = path is not None and left == 0 and missing in (0, -1, len(BOM), len(BOM) - 1)
        return [pa.RecordBatch.from_pylist([{"path": path, "size": size, "sha256": hashes[0].hexdigest(), "md5": hashes[1].hexdigest()}])] if whole else []

    for b in batches:
        for p, of, n, data in zip(*(b.column(x) for x in ("path", "size", "n", "data"))):
            if p.as_py() != path:
                yield from finished()
                path, size, left, hashes = p.as_py(), of.as_py(), None, (hashlib.sha256(), hashlib.md5(usedforsecurity=False))
                missing = size
            if not data.is_valid:
                missing -= n.as_py()
                continue
            new = memoryview(data.as_buffer())
            if left is None:
                left = size
                if missing > 0:
                    left -= len(BOM)
                    for x in hashes:
                        x.update(BOM)
            new = new[:left]
            left -= len(new)
            for x in hashes:
                x.update(new)
    yield from finished()


def fingerprints(spark: SparkSession, root: str, faulty: list[str] | None = None) -> DataFrame:
    """SRC-04: sha256 / md5 / size of every readable file's bytes.  No file
    over WHOLE bytes is held: its splits are read as lines wherever they fall,
    and their pieces meet, sorted, in the task that hashes the file."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    name = F.col("_metadata.file_path")
    whole = (F.col("_metadata.file_size") <= WHOLE) | name.rlike(PACKED)
    small = _without(spark.read.format("binaryFile").options(recursiveFileLookup="true", **ISOLATED).load(root), faulty or []).where(whole)
    lines = _without(spark.read.options(recursiveFileLookup="true", lineSep="\n", **ISOLATED).text(root), faulty or []).where(~whole)
    pieces = lines.select(name.alias("path"), F.col("_metadata.file_size").alias("size"),
                          F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
    pieces = pieces.mapInArrow(_pieces, "path string, size long, start long, at long, n long, data binary")
    large = pieces.repartition("path").sortWithinPartitions("path", "start", "at").mapInArrow(_digests, "path string, size long, sha256 string, md5 string")
    df = small.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5")).unionByName(large)
    return df.select("path", entry_of(F.col("path"), root).alias("entry"), "size", "sha256", "md5")


def records(spark: SparkSession, root: str, encoding: str = "UTF-8", faulty: list[str] | None = None) -> DataFrame:
    """Every CSV record of every file: path, _row_id (file order), cells."""
    schema = T.StructType([T.StructField("_c0", T.StringType()), T.StructField(CORRUPT, T.StringType())])
    raw = (_without(spark.read.schema(schema)
           .options(**ISOLATED,
                    header=False, multiLine=True, escape='"', quote='"', mode="PERMISSIVE",
                    columnNameOfCorruptRecord=CORRUPT, nullValue="\u0000<missing>\u0000", emptyValue="",
                    encoding=encoding, recursiveFileLookup=True, ignoreLeadingWhiteSpace=False,
                    ignoreTrailingWhiteSpace=False)
           .csv(root), faulty or [])
           .select("_c0", CORRUPT, F.col("_metadata.file_path").alias("path"),
                   F.monotonically_increasing_id().alias("_row_id")))
    # cells stay in their raw (quoted) form; only header rows are unquoted
    # later, so the per-record work is one regex and no lambda
    single = F.col(CORRUPT).isNull()
    cells = F.when(single, F.array(F.coalesce("_c0", F.lit("")))).otherwise(
        fields_of(F.col(CORRUPT)))
    return raw.select("path", "_row_id", cells.alias("cells"), single.alias("_single"))


def file_stats(spark: SparkSession, root: str, faulty: list[str] | None = None) -> DataFrame:
    """Per physical file: headers, data rows, rows wider than the header."""
    rec = records(spark, root, faulty=faulty)
    # records are counted by width, so that one pass serves the rows and the errors; no record is sorted
    widths = rec.groupBy("path", F.size("cells").alias("_w")).agg(F.count(F.lit(1)).alias("_n"), F.min("_row_id").alias("_id"))
    stats = (widths.withColumn("_head", F.min_by("_w", "_id").over(Window.partitionBy("path")))
             .groupBy("path").agg(F.min("_id").alias("_hid"), (F.sum("_n") - 1).alias("row_count"),
                                  F.sum(F.when(F.col("_w") > F.col("_head"), F.col("_n")).otherwise(0)).alias("ingest_errors"))
             .withColumnRenamed("path", "_of"))
    first = rec.join(F.broadcast(stats), (F.col("path") == F.col("_of")) & (F.col("_row_id") == F.col("_hid")))     # a row for each file
    return first.select("path", F.when(F.col("_single"), F.col("cells")).otherwise(F.transform("cells", unquote)).alias("headers"), "row_count", "ingest_errors")


def anomalies(headers: Column, row_count: Column) -> Column:
    """PRF-01: empty_file | empty_data + duplicate_header: X (sorted)."""
    dups = F.array_sort(F.array_distinct(F.filter(
        headers, lambda h: F.size(F.filter(headers, lambda g: g == h)) > 1)))
    return F.when(F.size(headers) == 0, F.array(F.lit("empty_file"))).otherwise(F.concat(
        F.when(row_count == 0, F.array(F.lit("empty_data"))).otherwise(F.array().cast("array<string>")),
        F.transform(dups, lambda d: F.concat(F.lit("duplicate_header: "), d))))


def inventory(spark: SparkSession, root: str, pattern: str = r"\.csv$", files: DataFrame | None = None) -> DataFrame:
    """PRF-02: one entry per top-level *.csv entry of ``root``.

    A file that is locked, larger than one value can hold, or cannot be read
    (any more) tags its own entry with read_error, without headers, rows or
    hash; all others are inventoried.  ``files``: a listing taken before.

    filename, filepath, headers, row_count, ingest_errors, sha256, anomalies.
    Entries whose name starts with typed_ / alerts_ / _ are outputs of later
    stages and are not inventoried.
    """
    files = listing(spark, root) if files is None else files
    lst = files.where(F.col("entry").rlike(pattern) & ~F.col("entry").rlike(r"^(typed_|alerts_|_)"))
    faulty = [r.path for r in files.where("fault is not null").select("path").collect()]     # by exception, few
    stats = file_stats(spark, root, faulty)
    fp = fingerprints(spark, root, faulty).select("path", "sha256")
    per_file = lst.join(stats, "path", "left").join(fp, "path", "left").withColumn(
        "fault", F.coalesce("fault", F.when((F.col("length") > 0) & F.col("sha256").isNull(), F.lit(UNREADABLE))))
    # fold parts: header from the first non-empty part, counts summed,
    # sha256 of a single file as is, else over the ordered part hashes
    e = per_file.groupBy("entry").agg(
        F.min_by("headers", F.when(F.col("headers").isNotNull(), F.col("path"))).alias("headers"),
        F.sum(F.coalesce("row_count", F.lit(0))).alias("row_count"),
        F.sum(F.coalesce("ingest_errors", F.lit(0))).alias("ingest_errors"),
        F.count(F.lit(1)).alias("_parts"),
        F.array_sort(F.collect_list(F.struct("path", "sha256"))).alias("_h"),
        F.min("path").alias("_p"), F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("path"))).alias("_fault"),
    )
    none, fine = F.array().cast("array<string>"), F.col("_fault").isNull()
    e = e.withColumns({"headers": F.when(fine, F.coalesce("headers", none)).otherwise(none),
                       **{c: F.when(fine, F.col(c)).otherwise(0) for c in ("row_count", "ingest_errors")}})
    headers = F.col("headers")
    sha = F.when(~fine, F.lit("")).when(F.col("_parts") == 1, F.col("_h")[0]["sha256"]).otherwise(
        F.sha2(F.array_join(F.transform("_h", lambda x: x["sha256"]), ""), 256))
    return e.select(F.col("entry").alias("filename"),
                    F.col("_p").alias("filepath"),
                    headers.alias("headers"), F.col("row_count").cast("long").alias("row_count"),
                    F.col("ingest_errors").cast("long").alias("ingest_errors"), sha.alias("sha256"),
                    F.when(fine, anomalies(headers, F.col("row_count"))).otherwise(F.array(F.concat(F.lit("read_error: "), "_fault"))).alias("anomalies"))


def anomaly_summary(entries: DataFrame) -> DataFrame:
    """AGG-07: sorted filename lists per anomaly class (one row)."""
    has = lambda p: F.exists("anomalies", lambda a: a.startswith(p))
    pick = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("filename"))))
    return entries.agg(
        F.count(F.lit(1)).alias("total_files"),
        pick(has("duplicate_header")).alias("duplicate_headers"),
        pick(F.array_contains("anomalies", "empty_file") | F.array_contains("anomalies", "empty_data")).alias("empty_files"),
        pick(F.exists("anomalies", lambda a: a.contains("locked_by_os"))).alias("locked_files"),
        pick(has("read_error")).alias("read_errors"),
    )


def yaml_name(c: Column) -> Column:
    special = "[" + re.escape(YAML_SPECIAL) + "]"
    return F.when(c.rlike(special), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(c)


def spec_text(filename: Column, headers: Column) -> Column:
    """All-raw YAML spec scaffold for one table."""
    body = F.when(F.size(headers) == 0, F.lit("  {}  # No headers detected")).otherwise(
        F.array_join(F.transform(headers, lambda h: F.concat(
            F.lit("  "), yaml_name(h), F.lit(': { type: "raw" }  # To be filled later'))), "\n"))
    return F.concat(F.lit("table: "), filename, F.lit("\ncolumns:\n"), body, F.lit("\nvalidations: []\n"))


def scaffold(entries: DataFrame, existing: list[str], overwrite: bool = False) -> DataFrame:
    """PRF-03: table, action (created | skipped | skipped_no_headers), spec."""
    table = F.regexp_replace(F.col("filename"), r"\.[^.]*$", "")
    action = (F.when(F.size("headers") == 0, F.lit("skipped_no_headers"))
               .when(table.isin(existing) & F.lit(not overwrite), F.lit("skipped"))
               .otherwise(F.lit("created")))
    return entries.select(table.alias("table"), action.alias("action"),
                          F.when(action == "created", spec_text(F.col("filename"), F.col("headers"))).alias("spec"))


def scaffold_counts(plan: DataFrame) -> DataFrame:
    """AGG-13: number of tables per scaffold action."""
    return plan.groupBy("action").agg(F.count(F.lit(1)).alias("tables"))
