"""Registered queries: name -> (spark, sf_dir) -> DataFrame, with matching
DuckDB oracle SQL.  Each query reads the given tables (or views Spark derives
from them) in full."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from triage import rules as R
from triage.operators import alerts as AL
from triage.operators import detect_injection as DI
from triage.operators import detect_lateral as DL
from triage.operators import detect_network as DN
from triage.operators import detect_persistence as DS
from triage.operators import detect_process as DP
from triage.plans import correlations as CR
from triage.plans import derive as D
from triage.plans import oracle as O
from triage.plans import validation as VP
from triage.plans import files as FP
from triage.plans import enrichq as EQ
from triage.plans import evidence as EV
from triage.operators import typed as TY
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def q_alerts_network(spark, sf):
    return AL.public(DN.network_alerts(spark, D.net(spark, sf), D.process(spark, sf)), "network")


def q_alerts_dns(spark, sf):
    return AL.public(DN.dns_alerts(spark, D.dns(spark, sf), D.process(spark, sf)), "network")


def q_alerts_process(spark, sf):
    return AL.public(DP.process_alerts(spark, D.process(spark, sf)), "process")


def q_alias_resolution(spark, sf):
    """Same process rows under another header dialect -> identical alerts."""
    return AL.public(DP.process_alerts(spark, D.process_camel(spark, sf)), "process")


def q_alerts_lateral(spark, sf):
    return AL.public(DL.lateral_alerts(spark, D.process(spark, sf)), "lateral")


def q_alerts_injection(spark, sf):
    return AL.public(DI.region_alerts(spark, D.memory(spark, sf), R.MEMORY_SOURCES["findevil"]), "injection")


def q_hidden_processes(spark, sf):
    return AL.public(DI.hidden_processes(spark, D.memory(spark, sf), D.process(spark, sf), R.MEMORY_SOURCES["findevil"]),
                     "injection")


def q_injection_counters(spark, sf):
    return DI.scan_counters(D.memory(spark, sf), R.MEMORY_SOURCES["findevil"])


def q_alerts_persistence(spark, sf):
    return AL.public(DS.persistence_alerts(spark, D.registry(spark, sf), D.services(spark, sf),
                                           D.tasks(spark, sf)), "persistence")


def _convert_one(col):
    def q(spark, sf):
        t = D.raw_orders(spark, sf)
        spec = {col: D.RAW_ORDERS_SPEC[col]}
        conv = TY.converted(t, spec)
        return conv.select(F.col("_row_index").alias("row_index"), F.col(col).alias("raw_value"),
                           F.col(f"{col}__cv.value").alias("value"), F.col(f"{col}__cv.error").alias("error"))
    return q


def q_typed_table(spark, sf):
    t = D.raw_orders(spark, sf)
    return TY.typed_frame(t, D.RAW_ORDERS_SPEC).withColumnRenamed("_row_index", "row_index").drop("_row_id")


def q_parse_errors(spark, sf):
    return TY.parse_errors(D.raw_orders(spark, sf), D.RAW_ORDERS_SPEC)


def q_process_lineage(spark, sf):
    from triage.operators.lookups import process_lineage
    return process_lineage(D.process(spark, sf)).drop("_row_id")


def q_connection_owner(spark, sf):
    from triage.operators.aliases import NET, resolve
    from triage.operators.lookups import pid_name_lookup, with_owner_name
    df, _ = resolve(D.net(spark, sf), NET)
    out = with_owner_name(df, pid_name_lookup(D.process(spark, sf)), out="process_name", default="")
    return out.select("pid", "process_name", "protocol", "state", "src_addr", "src_port", "dst_addr", "dst_port")


def all_alerts(spark, sf):
    """Every detector family over the derived tables, unioned by family."""
    proc = D.process(spark, sf)
    mem = D.memory(spark, sf)
    fams = [
        ("network", DN.network_alerts(spark, D.net(spark, sf), proc)),
        ("network", DN.dns_alerts(spark, D.dns(spark, sf), proc)),
        ("process", DP.process_alerts(spark, proc)),
        ("lateral", DL.lateral_alerts(spark, proc)),
        ("injection", DI.injection_alerts(spark, mem, proc, R.MEMORY_SOURCES["findevil"])),
        ("persistence", DS.persistence_alerts(spark, D.registry(spark, sf), D.services(spark, sf),
                                              D.tasks(spark, sf))),
    ]
    out = None
    for fam, df in fams:
        part = df.select(F.lit(fam).alias("family"), "alert_type", "severity")
        out = part if out is None else out.unionByName(part)
    return out


def q_alert_summary(spark, sf):
    return (all_alerts(spark, sf).groupBy("family", "alert_type", "severity")
            .agg(F.count(F.lit(1)).alias("alerts")))


QUERIES: dict[str, Query] = {
    "alerts_network": q_alerts_network,
    "alerts_dns": q_alerts_dns,
    "alerts_process": q_alerts_process,
    "alias_resolution": q_alias_resolution,
    "alerts_lateral": q_alerts_lateral,
    "alerts_injection": q_alerts_injection,
    "hidden_processes": q_hidden_processes,
    "alerts_persistence": q_alerts_persistence,
    "convert_int": _convert_one("o_custkey"),
    "convert_hex": _convert_one("o_address"),
    "convert_float": _convert_one("o_price"),
    "convert_bool": _convert_one("o_flag"),
    "convert_timestamp": _convert_one("o_time"),
    "typed_table": q_typed_table,
    "parse_errors": q_parse_errors,
    "validate_parity": VP.parity,
    "validate_constraints": VP.constraints,
    "validate_relations": VP.relations,
    "validate_report": VP.report,
    "validate_summary": VP.report_summary,
    "process_lineage": q_process_lineage,
    "connection_owner": q_connection_owner,
    "alert_summary": q_alert_summary,
    "csv_roundtrip": FP.roundtrip_process,
    "csv_malformed": FP.csv_malformed,
    "csv_ingest_errors": FP.csv_ingest_errors,
    "csv_linewise": FP.csv_linewise,
    "inventory": FP.inventory,
    "anomaly_summary": FP.anomaly_summary,
    "scaffold": FP.scaffold,
    "file_fingerprint": FP.file_fingerprint,
    "file_entropy": EQ.file_entropy,
    "path_resolution": EQ.path_resolution,
    "path_resolution_ids": EQ.path_resolution_ids,
    "lookup_part_files": FP.lookup_part_files,
    "enrichment_status": EQ.enrichment_status,
    "netstat_parse": EQ.netstat_parse,
    "flagged_ids": EQ.flagged_ids,
    "timeline_union": EQ.timeline_union,
    "pipeline_alerts": FP.pipeline_alerts,
    "alerts_network_rules": EV.alerts_network_rules,
    "encoding_fallback": EV.encoding_fallback,
    "manifest_load": EV.manifest_load,
    "typed_sink": EV.typed_sink,
    "error_sink": EV.error_sink,
    "orphan_pids": EV.orphan_pids,
    "alerts_written_order": EV.alerts_written_order,
    "recovered_artifacts": EV.recovered_artifacts,
    "inventory_json": EV.inventory_json,
    "inventory_faults": FP.inventory_faults,
    "entropy_join_back": EQ.entropy_join_back,
    "lossy_decode": EQ.lossy_decode,
    "injection_counters": q_injection_counters,
    **CR.QUERIES,
}

ORACLES: dict[str, Callable[[], str]] = {
    "alerts_network": O.alerts_network,
    "alerts_dns": O.alerts_dns,
    "alerts_process": O.alerts_process,
    "alias_resolution": O.alerts_process,
    "alerts_lateral": O.alerts_lateral,
    "alerts_injection": O.alerts_injection,
    "hidden_processes": O.hidden_processes,
    "alerts_persistence": O.alerts_persistence,
    "convert_int": lambda: O.convert_one("o_custkey"),
    "convert_hex": lambda: O.convert_one("o_address"),
    "convert_float": lambda: O.convert_one("o_price"),
    "convert_bool": lambda: O.convert_one("o_flag"),
    "convert_timestamp": lambda: O.convert_one("o_time"),
    "typed_table": O.typed_table,
    "parse_errors": O.parse_errors,
    "validate_parity": O.validate_parity,
    "validate_constraints": O.validate_constraints,
    "validate_relations": O.validate_relations,
    "validate_report": O.validate_report,
    "validate_summary": O.validate_summary,
    "process_lineage": O.process_lineage,
    "connection_owner": O.connection_owner,
    "alert_summary": O.alert_summary,
    "csv_roundtrip": O.csv_roundtrip,
    "csv_malformed": O.csv_malformed,
    "csv_ingest_errors": O.csv_ingest_errors,
    "csv_linewise": O.csv_linewise,
    "inventory": O.inventory,
    "anomaly_summary": O.anomaly_summary,
    "scaffold": O.scaffold,
    "file_entropy": O.file_entropy,
    "path_resolution": O.path_resolution,
    "path_resolution_ids": O.path_resolution_ids,
    "lookup_part_files": O.lookup_part_files,
    "file_fingerprint": O.file_fingerprint,
    "pipeline_alerts": O.alert_summary,
    "enrichment_status": O.enrichment_status,
    "netstat_parse": O.netstat_parse,
    "flagged_ids": O.flagged_ids,
    "timeline_union": O.timeline_union,
    "alerts_network_rules": O.alerts_network_rules,
    "encoding_fallback": O.encoding_fallback,
    "manifest_load": O.manifest_load,
    "typed_sink": O.typed_table,
    "error_sink": O.error_sink,
    "orphan_pids": O.orphan_pids,
    "alerts_written_order": O.alerts_written_order,
    "recovered_artifacts": O.recovered_artifacts,
    "inventory_json": O.inventory,
    "inventory_faults": O.inventory_faults,
    "entropy_join_back": O.entropy_join_back,
    "lossy_decode": O.lossy_decode,
    "injection_counters": O.injection_counters,
    **{name: (lambda body=body: CR.oracle(body)) for name, body in CR.ORACLES.items()},
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: f() for k, f in ORACLES.items() if k in QUERIES}
