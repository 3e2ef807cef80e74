"""Validation run over the derived tables: typed process / net / raw_orders /
tasks tables, a manifest of raw row counts (tasks deliberately missing),
and the three checks plus their roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from triage.operators import typed as TY
from triage.operators import validate as V
from triage.plans import derive as D
from triage.session import shared_scratch
from triage.table import ForensicTable


def _typed(spark: SparkSession, sf: str) -> tuple[dict[str, ForensicTable], dict[str, dict[str, str]], dict]:
    raw = {"process": D.process(spark, sf), "net": D.net(spark, sf),
           "raw_orders": D.raw_orders(spark, sf), "tasks": D.tasks(spark, sf)}
    specs = {"process": D.PROCESS_SPEC, "net": D.NET_SPEC, "raw_orders": D.RAW_ORDERS_SPEC,
             "tasks": D.TASKS_SPEC}
    typed = {k: ForensicTable(TY.typed_frame(t, specs[k]), t.headers, t.columns, k) for k, t in raw.items()}
    return typed, specs, raw


def manifest(raw: dict[str, ForensicTable]) -> DataFrame:
    listed = {k: t.df for k, t in raw.items() if k != "tasks"}
    return V.table_counts(listed).selectExpr("concat(table, '.csv') AS filename", "row_count")


def parity(spark, sf, inputs=None):
    typed, _, raw = inputs or _typed(spark, sf)
    return V.check_parity(spark, manifest(raw), {k: t.df for k, t in typed.items()})


def constraints(spark, sf, inputs=None):
    typed, specs, _ = inputs or _typed(spark, sf)
    return V.check_constraints(spark, typed, specs)


def relations(spark, sf, inputs=None):
    typed, _, _ = inputs or _typed(spark, sf)
    return V.check_relations(spark, typed["process"], typed["net"])


def report(spark, sf):
    """All checks over one set of typed inputs, converted once: the typed
    tables are written to the shared scratch folder and read by every check."""
    typed, specs, raw = _typed(spark, sf)
    for k, t in typed.items():
        path = shared_scratch(spark, f"typed-{k}")
        t.df.write.parquet(path)
        typed[k] = ForensicTable(spark.read.schema(t.df.schema).parquet(path), t.headers, t.columns, k)
    inputs = typed, specs, raw
    return (parity(spark, sf, inputs).unionByName(constraints(spark, sf, inputs))
            .unionByName(relations(spark, sf, inputs)))


def report_summary(spark, sf):
    return V.summary(report(spark, sf))
