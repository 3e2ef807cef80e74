"""PIPE-01: the whole run over a case directory — inventory, spec
scaffold, typed conversion, validation, detection — as one driver function
whose stages are Spark jobs.  Every table's work is distributed; the
driver only walks the (small) table list.

Converted tables are written once (Parquet under ``out_dir``) and the
later stages read them back, so no stage recomputes conversion and the
lineage is cut at each written table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triage import rules as R
from triage.operators import alerts as AL
from triage.operators import detect_injection as DI
from triage.operators import detect_lateral as DL
from triage.operators import detect_network as DN
from triage.operators import detect_persistence as DS
from triage.operators import detect_process as DP
from triage.operators import profile as P
from triage.operators import typed as TY
from triage.operators import validate as V
from triage.sources import csv as C
from triage.sources import sinks as K
from triage.table import ForensicTable

STATUS_OK, STATUS_WARN, STATUS_FAIL = 0, 1, 2


def _read_typed(spark: SparkSession, out_dir: str, name: str, headers: list[str], cols: list[str]):
    df = spark.read.parquet(f"{out_dir}/typed_{name}")
    return ForensicTable(df, headers, cols, name)


def run(spark: SparkSession, case_dir: str, out_dir: str, specs: dict[str, dict[str, str]] | None = None,
        memory_sources: tuple[str, ...] = ("findevil", "vad")) -> dict[str, DataFrame]:
    specs = dict(specs or {})
    entries = P.inventory(spark, case_dir)
    # every file is read once for the inventory; what follows reads the written entries
    entries = spark.read.schema(entries.schema).json(K.write_inventory_json(entries, f"{out_dir}/inventory"))
    K.write_manifest(entries, f"{out_dir}/manifest")
    scaffold = P.scaffold(entries, list(specs))
    listed = entries.select("filename", "filepath", "headers").collect()     # one row per table
    status_rows, typed = [], {}
    for e in listed:
        name = e["filename"].rsplit(".", 1)[0]
        if not e["headers"]:
            status_rows.append((name, "parse", STATUS_WARN, 0, "no headers"))
            continue
        spec = specs.get(name) or {h: "raw" for h in e["headers"]}
        r = C.read_csv_lossless(spark, f"{case_dir}/{e['filename']}", headers=list(e["headers"]), name=name)
        typed_df, errors = TY.parse_table(r.table, spec)
        typed_df.write.mode("overwrite").parquet(f"{out_dir}/typed_{name}")
        errors.withColumn("source_file", F.lit(e["filename"])).write.mode("overwrite").parquet(
            f"{out_dir}/parse_errors/table={name}")
        typed[name] = _read_typed(spark, out_dir, name, r.table.headers, r.table.columns)
        status_rows.append((name, "parse", STATUS_OK, typed[name].df.count(), "converted"))
    status = spark.createDataFrame(status_rows, "table string, stage string, status int, rows long, detail string")
    manifest = K.manifest_frame(entries).select("filename", F.col("row_count").cast("long").alias("row_count"))
    results = V.check_parity(spark, manifest, {k: t.df for k, t in typed.items()}) \
        .unionByName(V.check_constraints(spark, typed, specs)) \
        .unionByName(V.check_relations(spark, typed.get("process"), typed.get("net")))
    proc = typed.get("process")
    mem_name = next((m for m in memory_sources if m in typed), None)
    fams = []
    if "net" in typed:
        fams.append(("network", AL.ordered(DN.network_alerts(spark, typed["net"], proc), "network")))
    if "dns" in typed:
        fams.append(("network", AL.ordered(DN.dns_alerts(spark, typed["dns"], proc), "network")))
    if proc is not None:
        fams.append(("process", AL.ordered(DP.process_alerts(spark, proc), "process")))
        fams.append(("lateral", AL.ordered(DL.lateral_alerts(spark, proc), "lateral")))
    if mem_name:
        fams.append(("injection", AL.ordered(DI.injection_alerts(spark, typed[mem_name], proc, R.MEMORY_SOURCES.get(mem_name, f"typed_{mem_name}.csv")), "injection")))
    if any(k in typed for k in ("registry", "services", "tasks")):
        fams.append(("persistence", AL.ordered(DS.persistence_alerts(
            spark, typed.get("registry"), typed.get("services"), typed.get("tasks")), "persistence")))
    # sinks keep the deterministic order (SRT-02); alerts are a small fraction
    # of the input, sorted by range partitions.  A family is written whole, so
    # a second run replaces the first
    for fam in sorted({f for f, _ in fams}):
        reduce(DataFrame.unionByName, [df for f, df in fams if f == fam]).write.mode("overwrite").parquet(f"{out_dir}/alerts_{fam}")
    counts = [spark.read.parquet(f"{out_dir}/alerts_{fam}").groupBy("alert_type", "severity").count()
              .withColumn("family", F.lit(fam)) for fam in sorted({f for f, _ in fams})]
    summary = reduce(DataFrame.unionByName, counts) if counts else None
    return {"inventory": entries, "scaffold": scaffold, "status": status, "validation": results,
            "alert_counts": summary, "worst_status": status.agg(F.max("status").alias("worst"))}


def ingest_summary(status: DataFrame) -> DataFrame:
    """AGG-09: ok / failed table counts and total rows."""
    return status.agg(F.count_if(F.col("status") == STATUS_OK).alias("ok"),
                      F.count_if(F.col("status") != STATUS_OK).alias("failed"),
                      F.sum("rows").alias("total_rows"))
