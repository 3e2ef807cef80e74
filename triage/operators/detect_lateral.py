"""Lateral-movement detectors: CREDENTIAL_DUMP, RECON_COMMANDS (with
escalation of every recon alert of a parent that ran >= 3 distinct recon
commands) and REMOTE_EXECUTION.

Escalation plan: count distinct recon labels per parent key with a hash
aggregate (partial aggregation first, so a parent owning a third of all
rows collapses map-side), keep keys over the threshold, and left-join them
back.  Rows that are not recon alerts carry a per-row join key, so they
spread evenly instead of piling onto one NULL key; AQE broadcasts the
escalation table when its runtime size allows and splits skew otherwise.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triage import rules as R
from triage.functions.cells import first_regex, render
from triage.functions.memo import per_context
from triage.operators import aliases as A
from triage.operators.alerts import empty_alerts, explode_slots, rule_slot
from triage.operators.lookups import pid_name_lookup, with_parent_name
from triage.table import ForensicTable

KIND = "lateral"


def lateral_alerts(spark: SparkSession, proc: ForensicTable) -> DataFrame:
    df, present = A.resolve(proc, A.PROCESS_LATERAL)
    if not (present["pid"] and present["name"]):
        return empty_alerts(spark, KIND)
    pre, slots = _lateral_exprs()
    # the escalation aggregate needs only (parent key, recon label): it is
    # computed from the resolved rows, without the parent lookup or the
    # other rules, and joined back to the alert rows
    labels = df.select(pre["_pkey"].alias("_pkey"), pre["_recon"].alias("_recon"))
    own = {k: v for k, v in pre.items() if k != "_pl"}
    df = df.withColumns(own).where(F.col("_cred").isNotNull() | F.col("_recon").isNotNull()
                                   | F.lower(F.col("name")).isin(R.REMOTE_EXEC_CHILDREN))
    df = with_parent_name(df, pid_name_lookup(proc, A.PROCESS_LATERAL)).withColumn("_pl", pre["_pl"])
    alerts = explode_slots(df.withColumn("_esc", F.struct("_pkey", "_recon")), slots, keep=("_esc",))
    return escalate_recon(alerts, labels)


@per_context
def _lateral_exprs():
    name, pid, ppid, cmd = F.col("name"), F.col("pid"), F.col("ppid"), F.col("cmdline")
    parent = F.col("parent_name_resolved")
    labels = [lab for lab, _ in R.RECON_PATTERNS]
    pats = [p for _, p in R.RECON_PATTERNS]
    pre = {
        "_cred": F.when(cmd != "", first_regex(cmd, R.CRED_DUMP_PATTERNS)),
        "_recon": F.when(cmd != "", first_regex(cmd, pats, labels)),
        "_pkey": F.when(ppid != "", ppid).otherwise(pid),
        "_pl": F.lower(parent),
    }
    frameworks = F.create_map(*chain.from_iterable(
        (F.lit(k), F.lit(v)) for k, v in R.REMOTE_EXEC_PARENTS.items()))
    common = {"pid": pid, "process_name": name, "ppid": ppid, "parent_name": parent, "cmdline": cmd}
    slots = [
        rule_slot(1, F.col("_cred").isNotNull(), KIND, {
            **common, "alert_type": F.lit("CREDENTIAL_DUMP"), "severity": F.lit("CRITICAL"),
            "description": render(R.MSG["CREDENTIAL_DUMP"], name=name, pid=pid, pattern=F.col("_cred"))}),
        rule_slot(2, F.col("_recon").isNotNull(), KIND, {
            **common, "alert_type": F.lit("RECON_COMMANDS"), "severity": F.lit("LOW"),
            "description": render(R.MSG["RECON_COMMANDS"], label=F.col("_recon"), name=name, pid=pid)}),
        rule_slot(3, F.lower(name).isin(R.REMOTE_EXEC_CHILDREN)
                  & F.col("_pl").isin(list(R.REMOTE_EXEC_PARENTS)), KIND, {
            **common, "alert_type": F.lit("REMOTE_EXECUTION"), "severity": F.lit("HIGH"),
            "description": render(R.MSG["REMOTE_EXECUTION"], parent=parent, ppid=ppid,
                                  framework=F.element_at(frameworks, F.col("_pl")), name=name, pid=pid)}),
    ]
    return pre, slots


def escalate_recon(alerts: DataFrame, labels: DataFrame) -> DataFrame:
    """labels: (_pkey, _recon) per process row."""
    is_recon = F.col("_rule") == 2
    keyed = alerts.withColumn(
        "_jk", F.when(is_recon, F.concat(F.lit("r:"), F.col("_esc._pkey")))
                .otherwise(F.concat(F.lit("x:"), F.col("_row_id").cast("string"), F.lit(":"),
                                    F.col("_rule").cast("string"))))
    esc = (labels.where(F.col("_recon").isNotNull())
                 .groupBy(F.concat(F.lit("r:"), F.col("_pkey")).alias("_ek"))
                 .agg(F.count_distinct("_recon").alias("_n"))
                 .where(F.col("_n") >= R.RECON_ESCALATION_THRESHOLD))
    j = keyed.join(esc, keyed["_jk"] == esc["_ek"], "left")
    hit = is_recon & F.col("_n").isNotNull()
    suffix = render(R.MSG["RECON_ESCALATED_SUFFIX"], n=F.col("_n").cast("string"))
    return j.select(
        "_row_id", "_rule", "alert_type",
        F.when(hit, F.lit("HIGH")).otherwise(F.col("severity")).alias("severity"),
        "pid", "process_name", "ppid", "parent_name", "cmdline",
        F.when(hit, F.concat(F.col("description"), suffix)).otherwise(F.col("description")).alias("description"),
    )
