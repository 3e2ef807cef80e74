"""Queries for sources, sinks and rule sets over files that Spark writes from
the given tables: encodings, manifests, typed tables, error logs, orphans,
loaded rules."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from triage import rules as R
from triage import ruleset
from triage.operators import alerts as AL
from triage.operators import detect_network as DN
from triage.operators import enrich as E
from triage.operators import profile as P
from triage.operators import typed as TY
from triage.operators import validate as V
from triage.plans import derive as D
from triage.plans import files as FP
from triage.session import shared_scratch
from triage.sources import files as S
from triage.sources import sinks as K

#: A rule file: other browsers and ports than the built-in ones.
CHANGED_RULES = {"BROWSERS": [*R.BROWSERS, "svchost.exe", "cmd.exe"], "WEB_PORTS": [80, 443, 8443], "WELL_KNOWN_PORT_CEILING": 4000}


def alerts_network_rules(spark, sf):
    """Network alerts under a loaded rule file (SRC-12)."""
    path = shared_scratch(spark, "rules")
    spark.createDataFrame([(json.dumps(CHANGED_RULES),)], "value string").write.text(path)
    with ruleset.using(ruleset.load_rules(spark, path)):
        return AL.public(DN.network_alerts(spark, D.net(spark, sf), D.process(spark, sf)), "network")


def encoding_fallback(spark, sf):
    """SRC-03: files in UTF-8 and in ISO-8859-1, each read in its encoding."""
    root = shared_scratch(spark, "encodings")
    k = F.col("c_custkey")
    rows = D.table(spark, sf, "customer").select(k, F.concat(F.lit("naïve é "), k.cast("string")).alias("name"))
    for enc, part in (("UTF-8", rows.where(k % 2 == 0)), ("ISO-8859-1", rows.where(k % 2 == 1))):
        part.write.options(**{**K.CSV_OPTIONS, "encoding": enc}).csv(f"{root}/{enc}")
    t = S.read_csv_any_encoding(spark, root).table
    return t.df.select(*(F.col(c).alias(h) for h, c in zip(t.headers, t.columns)))


def manifest_load(spark, sf):
    """SNK-04, SRC-14: inventory -> manifest file -> loaded manifest."""
    path = K.write_manifest(P.inventory(spark, FP.write_case_dir(spark, sf)), shared_scratch(spark, "manifest"))
    return S.load_manifest(spark, path).select("filename", "row_count")


def typed_sink(spark, sf):
    """SNK-06: a typed table written and read back."""
    t = TY.typed_frame(D.raw_orders(spark, sf), D.RAW_ORDERS_SPEC).withColumnRenamed("_row_index", "row_index").drop("_row_id")
    return spark.read.schema(t.schema).parquet(K.write_typed(t, shared_scratch(spark, "typed")))


def error_sink(spark, sf):
    """SNK-02: parse errors of two source files appended to one log."""
    errors, path = TY.parse_errors(D.raw_orders(spark, sf), D.RAW_ORDERS_SPEC), shared_scratch(spark, "errors")
    for source in ("a.csv", "b.csv"):
        K.write_parse_errors(errors, path, source)
    log = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    return log.groupBy("source_file", "column", "expected_type").agg(F.count(F.lit(1)).alias("errors"))


def alerts_written_order(spark, sf):
    """SRT-02: DNS alerts written in the order of their rows, each with the
    place that it has in the written files."""
    path = shared_scratch(spark, "ordered-alerts")
    AL.ordered(DN.dns_alerts(spark, D.dns(spark, sf), D.process(spark, sf)), "network").write.parquet(path)
    return K.read_in_order(spark, path)


#: Names under which the documents lie in a recovery folder, by id: both cases, and endings that only look alike.
RECOVERED_ENDINGS = [".exe", ".DLL", ".ps1", ".Bat", ".sys", ".txt", ".exe.txt", "exe"]


def recovered_artifacts(spark, sf):
    """SRC-11: statistics of the executable ones among the recovered files; the
    others are dropped by name, before a byte is hashed."""
    d = D.table(spark, sf, "documents")
    path = F.concat(F.lit("/recovered/"), F.col("doc_id").cast("string"), D.pick(RECOVERED_ENDINGS, F.col("doc_id")))
    return E.content_stats(S.recovered_files(d.select(path.alias("path"), F.encode("text", "UTF-8").alias("content"))))


def inventory_json(spark, sf):
    """SNK-03: the inventory written as nested JSON and read back."""
    entries = P.inventory(spark, FP.write_case_dir(spark, sf))
    path = K.write_inventory_json(entries, shared_scratch(spark, "inventory-json"))
    return FP._inventory_rows(spark.read.schema(entries.schema).json(path))


def orphan_pids(spark, sf):
    """Every connection PID that no process has, with its connections."""
    return V.orphans(D.process(spark, sf), D.net(spark, sf))
