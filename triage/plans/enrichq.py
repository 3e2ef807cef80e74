"""Queries for enrichment and text sources over data Spark derives from
the documents / orders / events tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triage.operators import enrich as E
from triage.operators.lookups import pid_name_lookup, with_owner_name
from triage.plans import derive as D
from triage.plans import fixtures as X
from triage.plans.derive import pick
from triage.session import shared_scratch
from triage.sources import csv as C
from triage.sources import sinks as K
from triage.sources import text as TX

STORE_ROOT = "/forensic"


def _rel(doc_id: Column, lang: Column) -> Column:
    name = F.concat(doc_id.cast("string"), F.lit(".txt"))
    return F.when(doc_id % 2 == 0, name).otherwise(F.concat(lang, F.lit("/"), name))


def doc_store(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as a file store: path, content (UTF-8 bytes)."""
    d = D.table(spark, sf, "documents")
    return d.select(F.concat(F.lit(STORE_ROOT + "/"), _rel(F.col("doc_id"), F.col("lang"))).alias("path"),
                    F.encode("text", "UTF-8").alias("content"))


def doc_files(spark: SparkSession, sf: str) -> DataFrame:
    """A files table referencing the store in five path dialects; a third
    of the rows point at one hot file."""
    d = D.table(spark, sf, "documents").select("doc_id", "lang")
    k = F.col("doc_id")
    rel = _rel(k, F.col("lang"))
    path = (F.when(k % 7 == 0, F.lit(""))
             .when(k % 3 == 0, F.lit(STORE_ROOT + "/0.txt"))
             .when(k % 5 == 0, F.concat(F.lit(STORE_ROOT + "/"), rel))
             .when(k % 5 == 1, rel)
             .when(k % 5 == 2, F.concat(F.lit("C:/"), rel))
             .when(k % 5 == 3, F.concat(F.lit("/elsewhere/dir/"), k.cast("string"), F.lit(".txt")))
             .otherwise(F.concat(F.lit("missing/"), k.cast("string"), F.lit(".bin"))))
    return d.select(path.alias("file_path"), F.concat(F.lit("F"), k.cast("string")).alias("file_id"))


def file_entropy(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    st = E.content_stats(d.withColumn("path", F.col("doc_id").cast("string")))
    return st.select(F.col("path").cast("long").alias("doc_id"), "entropy", "md5", "sha256", "file_size")


def path_resolution(spark, sf):
    stats = E.content_stats(doc_store(spark, sf))
    return E.enrich_files(doc_files(spark, sf), stats, STORE_ROOT)


def path_resolution_ids(spark, sf):
    """The same files under an id that comes from other columns than the path."""
    d = doc_files(spark, sf).withColumn("doc_id", F.substring("file_id", 2, 30).cast("long"))
    other = D.table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit(":"), F.col("n_chars").cast("string")).alias("other"))
    files = d.join(other, "doc_id").select("file_path", F.col("other").alias("file_id"))
    return E.enrich_files(files, E.content_stats(doc_store(spark, sf)), STORE_ROOT)


def enrichment_status(spark, sf):
    return E.enrichment_status(path_resolution(spark, sf))


def netstat_lines(spark: SparkSession, sf: str) -> DataFrame:
    o = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    k = F.col("k")
    m = k % 11
    row = F.concat_ws("  ", pick(X.PROTOCOLS, k), pick(X.NETSTAT_LOCAL, k), pick(X.NETSTAT_REMOTE, F.floor(k / 3)),
                      pick(X.NETSTAT_STATES, F.floor(k / 5)),
                      F.when(k % 4 == 0, F.lit(None)).otherwise(F.col("c").cast("string")))
    line = (F.when(m == 0, F.lit("")).when(m == 1, F.concat(F.lit("# comment "), k.cast("string")))
             .when(m == 2, F.lit("Proto  Local Address  Foreign Address  State  PID"))
             .when(m == 3, F.concat(F.lit("TCP 10.0.0."), (k % 250).cast("string")))
             .otherwise(F.concat(F.lit("  "), row)))
    return o.select(line.alias("value"))


def netstat_parse(spark, sf):
    path = shared_scratch(spark, "netstat")
    netstat_lines(spark, sf).write.mode("overwrite").text(path)
    conns = TX.parse_netstat(C.read_lines(spark, path))
    named = with_owner_name(conns, pid_name_lookup(D.process(spark, sf)), out="process_name", default="")
    return named.select(*TX.NETSTAT_HEADERS)


def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    e = D.table(spark, sf, "events").select(F.col("event_id").alias("k"), F.col("user_id").cast("string").alias("u"))
    k, u = F.col("k"), F.col("u")
    m = k % 6
    line = (F.when(m == 0, F.concat(F.lit("CRITICAL | "), u, F.lit(" | injected code")))
             .when(m == 1, F.concat(F.lit("info: pid "), u, F.lit(" ok")))
             .when(m == 2, F.concat(F.lit("HIGH,proc"), u, F.lit(","), u, F.lit(",x")))
             .when(m == 3, F.lit("Alert: no pid here"))
             .when(m == 4, F.concat(F.lit("malicious: "), u, F.lit("x 77")))
             .otherwise(F.lit("")))
    return e.select(line.alias("value"))


def flagged_ids(spark, sf):
    """SRC-10 + SET-02: report-flagged PIDs union LSASS PIDs (distinct)."""
    path = shared_scratch(spark, "report")
    report_lines(spark, sf).write.mode("overwrite").text(path)
    flagged = TX.flagged_ids(C.read_lines(spark, path))
    from triage.operators.aliases import PROCESS_LOOKUP, resolve
    proc, _ = resolve(D.process(spark, sf), PROCESS_LOOKUP)
    lsass = proc.where((F.lower("name") == "lsass.exe") & F.col("pid").rlike("^[0-9]+$")).select("pid")
    return flagged.unionByName(lsass).distinct()


def timeline_union(spark, sf):
    """SRC-07/08: a family of timeline_<type>.csv tables (plus timeline_all
    and an unrelated table) written as one partitioned table; selecting the
    family by prefix is partition pruning; rows counted per source."""
    root = shared_scratch(spark, "timeline")
    ev = D.table(spark, sf, "events").select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), F.col("event_type").alias("type"),
        F.lit("").alias("action"), F.col("user_id").cast("string").alias("pid"), F.lit("").alias("path"),
        F.col("props").alias("description"))
    fam = (ev.withColumn("source", F.concat(F.lit("timeline_"), F.col("type"), F.lit(".csv")))
             .unionByName(ev.withColumn("source", F.lit("timeline_all.csv")))
             .unionByName(ev.withColumn("source", F.lit("process.csv"))))
    fam.write.mode("overwrite").partitionBy("source").options(**K.CSV_OPTIONS).csv(root)
    t = (spark.read.options(header=True, multiLine=True, escape='"').csv(root)
         .where(F.col("source").startswith("timeline_")))
    return t.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))


def entropy_join_back(spark, sf):
    """The files table with the statistics found for its paths."""
    files = doc_files(spark, sf)
    return E.join_back(files, path_resolution(spark, sf), "file_path")


def lossy_decode(spark, sf):
    """Document texts with bytes put in that are no UTF-8: a stray one, the
    first of two, the first two of three, or none, by id."""
    k = F.col("doc_id") % 4
    stray = F.when(k == 0, F.unhex(F.lit("FF"))).when(k == 1, F.unhex(F.lit("C3"))).when(k == 2, F.unhex(F.lit("E282"))).otherwise(F.unhex(F.lit("")))
    content = F.concat(F.encode(F.substring("text", 1, 5), "UTF-8"), stray, F.encode(F.expr("substring(text, 6)"), "UTF-8"))
    return D.table(spark, sf, "documents").select("doc_id", TX.lossy_text(content).alias("text"))
