"""Persistence detectors: SUSPICIOUS_RUN_KEY (registry), SERVICE_MASQUERADE
(services) and HIDDEN_SCHEDULED_TASK (scheduled tasks).  Each input is
optional; an absent input or absent key column skips its rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triage import rules as R
from triage.functions.cells import any_regex, first_contains, render
from triage.operators import aliases as A
from triage.operators.alerts import empty_alerts, explode_slots, rule_slot
from triage.table import ForensicTable

KIND = "persistence"


def run_key_alerts(spark: SparkSession, reg: ForensicTable) -> DataFrame:
    df, present = A.resolve(reg, A.REGISTRY)
    if not present["path"]:
        return empty_alerts(spark, KIND, df)
    path, name, data = F.col("path"), F.col("name"), F.col("data")
    hit = any_regex(path, R.RUN_KEY_PATTERNS) & first_contains(F.lower(data), R.SUSPICIOUS_RUN_PATHS).isNotNull()
    return explode_slots(df, [rule_slot(1, hit, KIND, {
        "alert_type": F.lit("SUSPICIOUS_RUN_KEY"), "severity": F.lit("HIGH"),
        "source_table": F.lit(R.PERSISTENCE_SOURCES["registry"]),
        "key_or_name": F.concat(path, F.lit(" :: "), name), "value_or_path": data,
        "description": render(R.MSG["SUSPICIOUS_RUN_KEY"], name=name, path=path, data=data)})])


def service_alerts(spark: SparkSession, svc: ForensicTable) -> DataFrame:
    df, present = A.resolve(svc, A.SERVICES)
    if not present["binary_path"]:
        return empty_alerts(spark, KIND, df)
    df = df.withColumn("_marker", first_contains(F.lower(F.col("binary_path")), R.SERVICE_SUSPICIOUS))
    name, path = F.col("name"), F.col("binary_path")
    return explode_slots(df, [rule_slot(2, F.col("_marker").isNotNull(), KIND, {
        "alert_type": F.lit("SERVICE_MASQUERADE"), "severity": F.lit("HIGH"),
        "source_table": F.lit(R.PERSISTENCE_SOURCES["services"]),
        "key_or_name": name, "value_or_path": path,
        "description": render(R.MSG["SERVICE_MASQUERADE"], name=name, path=path, marker=F.col("_marker"))})])


def task_alerts(spark: SparkSession, tasks: ForensicTable) -> DataFrame:
    df, present = A.resolve(tasks, A.TASKS)
    if not present["action"]:
        return empty_alerts(spark, KIND, df)
    name, action = F.col("name"), F.col("action")
    return explode_slots(df, [rule_slot(3, any_regex(action, R.TASK_SUSPICIOUS_PATTERNS), KIND, {
        "alert_type": F.lit("HIDDEN_SCHEDULED_TASK"), "severity": F.lit("MEDIUM"),
        "source_table": F.lit(R.PERSISTENCE_SOURCES["tasks"]),
        "key_or_name": name, "value_or_path": action,
        "description": render(R.MSG["HIDDEN_SCHEDULED_TASK"], name=name, action=action)})])


def persistence_alerts(spark: SparkSession, reg: ForensicTable | None, svc: ForensicTable | None,
                       tasks: ForensicTable | None) -> DataFrame:
    parts = []
    if reg is not None:
        parts.append(run_key_alerts(spark, reg))
    if svc is not None:
        parts.append(service_alerts(spark, svc))
    if tasks is not None:
        parts.append(task_alerts(spark, tasks))
    if not parts:
        return empty_alerts(spark, KIND)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
