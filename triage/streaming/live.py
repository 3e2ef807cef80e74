"""Per-row detectors on a file-source stream.

The reference tools wait for exported CSV files to appear and then scan
them; with Structured Streaming new files in a folder become micro-batches
and the row-local detectors (network rules without the PID lookup, process
masquerade rules that use the explicit parent column, memory-region rules,
persistence rules) run unchanged on each batch.  Rules needing state across
rows (recon escalation, hidden-process anti join, last-wins PID lookups)
stay batch operators.  Checkpoints go under spark.checkpoint.dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triage import rules as R
from triage.operators import alerts as AL
from triage.operators import detect_injection as DI
from triage.operators import detect_persistence as DS
from triage.session import shared_scratch
from triage.table import ForensicTable

DETECTORS = {
    "findevil": lambda spark, t: AL.public(DI.region_alerts(spark, t, R.MEMORY_SOURCES["findevil"]), "injection"),
    "services": lambda spark, t: AL.public(DS.service_alerts(spark, t), "persistence"),
    "tasks": lambda spark, t: AL.public(DS.task_alerts(spark, t), "persistence"),
    "registry": lambda spark, t: AL.public(DS.run_key_alerts(spark, t), "persistence"),
}


def stream_table(spark: SparkSession, folder: str, headers: list[str]) -> ForensicTable:
    """Streaming CSV source with an all-string schema named by headers."""
    schema = T.StructType([T.StructField(h, T.StringType()) for h in headers])
    df = (spark.readStream.schema(schema)
          .options(header=True, escape='"', multiLine=True, emptyValue="")
          .csv(folder)
          # row positions are not defined on a stream; per-row rules don't need them
          .withColumn("_row_id", F.lit(None).cast("long")))
    return ForensicTable(df, list(headers), list(headers))


def start_alert_stream(spark: SparkSession, kind: str, folder: str, headers: list[str], out: str,
                       available_now: bool = True):
    """Start a query writing alerts for new files of ``folder`` to ``out``."""
    alerts: DataFrame = DETECTORS[kind](spark, stream_table(spark, folder, headers))
    w = (alerts.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", shared_scratch(spark, f"stream-{kind}")))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
