"""Injection / rootkit detectors over a memory-region table (findevil or
vad): RWX_UNBACKED, PROCESS_HOLLOWING, REFLECTIVE_DLL (per row) and
DKOM_HIDDEN_PROCESS (PIDs present in the region table but absent from the
process table).

DKOM plan: first-seen row per PID via a hash aggregate keyed on pid
(``min_by`` over the row order; partial aggregation collapses hot PIDs
before the shuffle), then a left-anti join against the distinct process
PIDs.  Both join sides are one row per PID, so neither side is skewed.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triage import rules as R
from triage.functions.cells import any_regex, render
from triage.functions.memo import per_context
from triage.operators import aliases as A
from triage.operators.alerts import empty_alerts, explode_slots, rule_slot
from triage.table import ForensicTable

KIND = "injection"


def _mz(c):
    """MZ/PE header heuristics on a lower-cased, stripped cell."""
    cond = F.lit(False)
    for p in R.MZ_PREFIXES:
        cond = cond | c.startswith(p)
    for s in R.MZ_SUBSTRINGS:
        cond = cond | c.contains(s)
    return (c != "") & cond


def _qm(c):
    return F.when(c == "", F.lit("?")).otherwise(c)


def _name_part(name):
    return F.when(name != "", F.concat(F.lit(" ("), name, F.lit(")"))).otherwise(F.lit(""))


def region_alerts(spark: SparkSession, mem: ForensicTable, source_name: str) -> DataFrame:
    """RWX_UNBACKED, PROCESS_HOLLOWING and REFLECTIVE_DLL in one scan."""
    df, present = A.resolve(mem, A.MEMORY)
    pre, slots = _region_exprs(source_name, present["protection"], present["name"])
    df = df.withColumns(pre)
    return explode_slots(df, slots)


@per_context
def _region_exprs(source_name: str, has_protection: bool, has_name: bool):
    pid, name, addr, size = F.col("pid"), F.col("name"), F.col("address"), F.col("size")
    prot, file, typ = F.col("protection"), F.col("file"), F.col("type")
    pre = {
        "_fl": F.lower(file), "_tl": F.lower(typ), "_nl": F.lower(name),
        "_rwx": (prot != "") & any_regex(prot, R.RWX_PATTERNS),
    }
    fl, tl, nl = F.col("_fl"), F.col("_tl"), F.col("_nl")
    unbacked = fl.isin(R.UNBACKED_SENTINELS)
    expected = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in R.EXPECTED_PATHS.items()))
    exp = F.coalesce(F.element_at(expected, nl), F.lit(""))
    mismatch = (exp != "") & (fl != "") & ~unbacked & ~F.startswith(fl, exp)
    src = F.lit(source_name)
    slots = []
    if has_protection:
        private = F.when(tl != "", tl.contains("private")).otherwise(F.lit(True))
        slots.append(rule_slot(1, F.col("_rwx") & (unbacked | private), KIND, {
            "alert_type": F.lit("RWX_UNBACKED"), "severity": F.lit("CRITICAL"), "pid": pid,
            "process_name": name, "address": addr, "size": size, "protection": prot,
            "backing_file": F.when(file != "", file).otherwise(F.lit("<none>")), "source_table": src,
            "description": render(R.MSG["RWX_UNBACKED"], address=_qm(addr), size=_qm(size),
                                  pid=_qm(pid), name_part=_name_part(name))}))
    if has_name:
        reason = F.when(unbacked, F.lit(R.MSG["HOLLOWING_REASON_EMPTY"])).otherwise(
            render(R.MSG["HOLLOWING_REASON_MISMATCH"], expected=exp, got=fl))
        slots.append(rule_slot(2, nl.isin(R.HOLLOWING_TARGETS) & ((tl == "") | tl.contains("image"))
                               & (unbacked | mismatch), KIND, {
            "alert_type": F.lit("PROCESS_HOLLOWING"), "severity": F.lit("CRITICAL"), "pid": pid,
            "process_name": name, "address": addr, "size": size, "protection": prot,
            "backing_file": F.when(fl != "", fl).otherwise(F.lit("<none>")), "source_table": src,
            "description": render(R.MSG["PROCESS_HOLLOWING"], name=name, pid=_qm(pid), reason=reason)}))
    slots.append(rule_slot(4, (_mz(tl) | _mz(fl)) & unbacked, KIND, {
        "alert_type": F.lit("REFLECTIVE_DLL"), "severity": F.lit("HIGH"), "pid": pid,
        "process_name": name, "address": addr, "size": size, "protection": prot,
        "backing_file": F.lit("<none>"), "source_table": src,
        "description": render(R.MSG["REFLECTIVE_DLL"], address=_qm(addr), pid=_qm(pid),
                              name_part=_name_part(name))}))
    return pre, slots


def hidden_processes(spark: SparkSession, mem: ForensicTable, proc: ForensicTable | None,
                     source_name: str) -> DataFrame:
    """DKOM_HIDDEN_PROCESS: one alert per PID seen in ``mem`` but not in ``proc``.

    PIDs are compared as text ("04" is not "4"); PIDs 0 and 4 are skipped.
    """
    mdf, mpresent = A.resolve(mem, A.MEMORY)
    if proc is None:
        return empty_alerts(spark, KIND, mdf)
    pdf, ppresent = A.resolve(proc, A.PROCESS_INJECTION)
    if not (ppresent["pid"] and mpresent["pid"]):
        return empty_alerts(spark, KIND, mdf)
    active = pdf.where(F.col("pid") != "").select("pid").distinct()
    first = (mdf.where((F.col("pid") != "") & ~F.col("pid").isin(R.DKOM_EXCLUDED_PIDS))
                .groupBy("pid")
                .agg(F.min_by(F.struct("_row_id", "name", "address"), "_row_id").alias("f")))
    hidden = first.join(active, "pid", "left_anti")
    name, pid = F.col("f.name"), F.col("pid")
    return hidden.select(
        F.col("f._row_id").alias("_row_id"), F.lit(3).alias("_rule"),
        F.lit("DKOM_HIDDEN_PROCESS").alias("alert_type"), F.lit("CRITICAL").alias("severity"),
        pid.alias("pid"),
        F.when(name != "", name).otherwise(F.lit("<hidden>")).alias("process_name"),
        F.col("f.address").alias("address"), F.lit("").alias("size"), F.lit("").alias("protection"),
        F.lit("").alias("backing_file"), F.lit(source_name).alias("source_table"),
        render(R.MSG["DKOM_HIDDEN_PROCESS"], pid=pid, name_part=_name_part(name),
               source=F.lit(source_name)).alias("description"),
    )


def injection_alerts(spark: SparkSession, mem: ForensicTable, proc: ForensicTable | None,
                     source_name: str) -> DataFrame:
    """All four rules (rule-major order at the sink: 1, 2, 3, 4)."""
    per_row = region_alerts(spark, mem, source_name)
    dkom = hidden_processes(spark, mem, proc, source_name)
    return per_row.unionByName(dkom.select(*per_row.columns))


def scan_counters(mem: ForensicTable, source_name: str) -> DataFrame:
    """AGG-12: what the region rules looked at: rows, rows with RWX protection, and those of them that alert."""
    df, present = A.resolve(mem, A.MEMORY)
    pre, slots = _region_exprs(source_name, present["protection"], present["name"])
    alerts = slots[0].isNotNull() if present["protection"] else F.lit(False)
    return df.withColumns(pre).agg(F.count("*").alias("rows"), F.count_if("_rwx").alias("rwx_rows"), F.count_if(alerts).alias("rwx_alerts")).select(
        F.lit(source_name).alias("source_table"), "rows", "rwx_rows", "rwx_alerts")
