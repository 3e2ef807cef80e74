"""Shared shape of every detector: one projection that builds an array of
optional alert structs per input row (one slot per rule), drops the empty
slots and explodes the rest with ``inline``.  One scan per table, no per-row
Python, and the rules stay in one whole-stage-codegen stage.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER_COLS = ["_row_id", "_rule"]

# FIXED VALUES: output columns of each alert table
SCHEMAS = {
    "network": ["alert_type", "severity", "pid", "process_name", "src_addr", "src_port",
                "dst_addr", "dst_port", "protocol", "state", "description"],
    "process": ["alert_type", "severity", "pid", "process_name", "process_path", "ppid",
                "parent_name", "user", "description"],
    "lateral": ["alert_type", "severity", "pid", "process_name", "ppid", "parent_name",
                "cmdline", "description"],
    "injection": ["alert_type", "severity", "pid", "process_name", "address", "size",
                  "protection", "backing_file", "source_table", "description"],
    "persistence": ["alert_type", "severity", "source_table", "key_or_name", "value_or_path",
                    "description"],
}


def schema_of(kind: str, with_order: bool = True) -> T.StructType:
    fields = [T.StructField(c, T.StringType(), False) for c in SCHEMAS[kind]]
    if with_order:
        fields = [T.StructField("_row_id", T.LongType(), True),
                  T.StructField("_rule", T.IntegerType(), False)] + fields
    return T.StructType(fields)


def empty_alerts(spark: SparkSession, kind: str, like: DataFrame | None = None) -> DataFrame:
    """Header-only result when an input or a required column of it is missing.

    ``like``: the table at hand, whose row ids (a number, or file and place)
    the other rules of the family carry, so that all can be unioned."""
    if like is None:
        return spark.createDataFrame([], schema_of(kind))
    return like.where(F.lit(False)).select("_row_id", F.lit(0).alias("_rule"), *(F.lit("").alias(c) for c in SCHEMAS[kind]))


def rule_slot(rule: int, cond: Column, kind: str, values: dict[str, Column]) -> Column:
    """Struct for one rule, NULL unless cond holds."""
    fields = [F.lit(rule).alias("_rule")]
    for c in SCHEMAS[kind]:
        fields.append(values[c].cast("string").alias(c))
    return F.when(cond, F.struct(*fields))


def explode_slots(df: DataFrame, slots: Sequence[Column], row_id: Column | None = None,
                  keep: Sequence[str] = ()) -> DataFrame:
    """One output row per non-NULL slot.  explode + filter keeps the whole
    projection in generated code (a lambda ``filter`` would force the
    interpreted path for every rule expression)."""
    rid = row_id if row_id is not None else F.col("_row_id")
    exploded = df.select(rid.alias("_row_id"), *keep, F.explode(F.array(*slots)).alias("_slot"))
    return exploded.where(F.col("_slot").isNotNull()).select("_row_id", *keep, "_slot.*")


def public(df: DataFrame, kind: str) -> DataFrame:
    """Drop ordering columns (unordered result, for joins/aggregations)."""
    return df.select(*SCHEMAS[kind])


def ordered(df: DataFrame, kind: str) -> DataFrame:
    """Deterministic sink order: input row, then rule; injection and
    persistence rules run one after another, each over all rows."""
    cols = ["_rule", "_row_id"] if kind in ("injection", "persistence") else ORDER_COLS
    return df.orderBy(*cols).select(*SCHEMAS[kind])
