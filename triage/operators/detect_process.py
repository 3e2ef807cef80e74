"""Process-masquerade detectors: PATH_MASQUERADE, PARENT_CHILD_MISMATCH
(rule table and Office->shell), TYPOSQUATTING, SID_MISMATCH.

Parent names come from the explicit column, else from the process whose PID
equals the row's PPID (self left join against a last-wins lookup).
Typosquatting tests the fixed critical-name list with the built-in
thresholded ``levenshtein`` inside a higher-order ``filter`` (no join).
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triage import rules as R
from triage.functions.cells import any_startswith, first_contains, py_list_repr, render
from triage.functions.memo import per_context
from triage.operators import aliases as A
from triage.operators.alerts import empty_alerts, explode_slots, rule_slot
from triage.operators.lookups import pid_name_lookup, with_parent_name
from triage.table import ForensicTable

KIND = "process"


def _lit_map(d: dict) -> F.Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in d.items()))


def process_alerts(spark: SparkSession, proc: ForensicTable) -> DataFrame:
    df, present = A.resolve(proc, A.PROCESS_MASQUERADE)
    if not (present["pid"] and present["name"]):
        return empty_alerts(spark, KIND)
    pre, pre2, slots = _process_exprs()
    own = {k: v for k, v in pre.items() if k != "_pl"}
    df = df.withColumns(own).withColumns(pre2)
    # every rule names its processes: only their rows need a parent's name
    names = sorted({*R.SYSTEM32_ONLY, *R.PARENT_RULES, *R.SHELL_CHILDREN, *R.SYSTEM_ONLY_PROCESSES})
    df = df.where(F.col("_nl").isin(names) | F.col("_typo").isNotNull())
    df = with_parent_name(df, pid_name_lookup(proc, A.PROCESS_MASQUERADE)).withColumn("_pl", pre["_pl"])
    return explode_slots(df, slots)


@per_context
def _process_exprs():
    name, pid, ppid = F.col("name"), F.col("pid"), F.col("ppid")
    parent = F.col("parent_name_resolved")
    pre = {
        "_nl": F.lower(name), "_pl": F.lower(parent), "_pathl": F.lower(F.col("path")),
        "_ul": F.lower(F.col("user")),
    }
    nl, pl = F.col("_nl"), F.col("_pl")
    critical = [c.lower() for c in R.CRITICAL_NAMES]
    typo = None
    for c in critical:
        hit = F.levenshtein(nl, F.lit(c), 1) == 1
        typo = F.when(hit, F.lit(c)) if typo is None else typo.when(hit, F.lit(c))
    pre2 = {"_typo": F.when(~nl.isin(critical), typo)}
    allowed = _lit_map({k: sorted(v) for k, v in R.PARENT_RULES.items()})
    expected_text = _lit_map({k: py_list_repr(sorted(v)) for k, v in R.PARENT_RULES.items()})
    common = {"pid": pid, "process_name": name, "process_path": F.col("path"), "ppid": ppid,
              "parent_name": parent, "user": F.col("user")}
    prefix_ok = any_startswith(F.col("_pathl"), R.SYSTEM32_PREFIXES)
    is_system_user = first_contains(F.col("_ul"), R.SYSTEM_USER_MARKERS).isNotNull()
    slots = [
        rule_slot(1, nl.isin(R.SYSTEM32_ONLY) & (F.col("path") != "") & ~prefix_ok, KIND, {
            **common, "alert_type": F.lit("PATH_MASQUERADE"), "severity": F.lit("HIGH"),
            "description": render(R.MSG["PATH_MASQUERADE"], name=name, pid=pid, path=F.col("path"))}),
        rule_slot(2, nl.isin(list(R.PARENT_RULES)) & (parent != "")
                  & ~F.array_contains(F.element_at(allowed, nl), pl), KIND, {
            **common, "alert_type": F.lit("PARENT_CHILD_MISMATCH"), "severity": F.lit("HIGH"),
            "description": render(R.MSG["PARENT_CHILD_MISMATCH_RULE"], name=name, pid=pid,
                                  parent=parent, ppid=ppid,
                                  expected=F.element_at(expected_text, nl))}),
        rule_slot(3, nl.isin(R.SHELL_CHILDREN) & pl.isin(R.OFFICE_PARENTS), KIND, {
            **common, "alert_type": F.lit("PARENT_CHILD_MISMATCH"), "severity": F.lit("HIGH"),
            "description": render(R.MSG["PARENT_CHILD_MISMATCH_OFFICE"], name=name, pid=pid,
                                  parent=parent, ppid=ppid)}),
        rule_slot(4, F.col("_typo").isNotNull(), KIND, {
            **common, "alert_type": F.lit("TYPOSQUATTING"), "severity": F.lit("MEDIUM"),
            "description": render(R.MSG["TYPOSQUATTING"], name=name, pid=pid,
                                  critical=F.col("_typo"), dist=F.lit("1"))}),
        rule_slot(5, nl.isin(R.SYSTEM_ONLY_PROCESSES) & (F.col("user") != "") & ~is_system_user, KIND, {
            **common, "alert_type": F.lit("SID_MISMATCH"), "severity": F.lit("HIGH"),
            "description": render(R.MSG["SID_MISMATCH"], name=name, pid=pid, user=F.col("user"))}),
    ]
    return pre, pre2, slots
