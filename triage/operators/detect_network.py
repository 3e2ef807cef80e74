"""Network detectors: PROCESS_PORT_MISMATCH, LISTENER_TRAP,
HIGH_PORT_EXTERNAL (connection table) and RARE_DNS_QUERY (DNS table).

Plan: resolve logical columns -> keep the rows that a rule can still hit ->
join the PID->name lookup (AQE picks broadcast or skew-split sort-merge at
runtime) -> one projection building the rule array -> explode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triage import rules as R
from triage.functions.cells import render
from triage.functions.memo import per_context
from triage.functions.netaddr import with_private_ip
from triage.functions.numbers import as_number, lenient_text
from triage.operators import aliases as A
from triage.operators.alerts import empty_alerts, explode_slots, rule_slot
from triage.operators.lookups import pid_name_lookup, with_owner_name
from triage.table import ForensicTable

KIND = "network"


def network_alerts(spark: SparkSession, net: ForensicTable, proc: ForensicTable | None) -> DataFrame:
    df, present = A.resolve(net, A.NET)
    if not present["pid"]:
        return empty_alerts(spark, KIND)
    df = df.withColumn("_dport_text", _dport()).withColumn("_dport", as_number(F.col("_dport_text")))
    # state, port and address decide most rows: only those that some rule can
    # still hit are joined with their owner's name
    web = F.coalesce(F.col("_dport").isin(R.WEB_PORTS), F.lit(False))
    listen = F.upper(F.col("state")).contains("LISTEN")
    high = F.coalesce(F.col("_dport") > R.WELL_KNOWN_PORT_CEILING, F.lit(False))
    df = with_private_ip(df.where(web | listen | high), "dst_addr", "_dst_private")
    df = df.where(web | listen | (high & ~F.col("_dst_private")))
    return explode_slots(with_owner_name(df, pid_name_lookup(proc)), _network_slots())


@per_context
def _dport():
    return lenient_text(F.col("dst_port"))


@per_context
def _network_slots():
    low = F.lower(F.col("proc_name"))
    dst_port = F.col("_dport")
    common = {
        "pid": F.col("pid"), "process_name": F.col("proc_name"),
        "src_addr": F.col("src_addr"), "src_port": F.col("src_port"),
        "dst_addr": F.col("dst_addr"), "dst_port": F.col("dst_port"),
        "protocol": F.col("protocol"), "state": F.col("state"),
    }
    port_text = F.col("_dport_text")
    listen_port = F.when(F.col("src_port") != "", F.col("src_port")).otherwise(F.col("dst_port"))
    slots = [
        rule_slot(1, dst_port.isin(R.WEB_PORTS) & ~low.isin(R.BROWSERS), KIND, {
            **common, "alert_type": F.lit("PROCESS_PORT_MISMATCH"), "severity": F.lit("MEDIUM"),
            "description": render(R.MSG["PROCESS_PORT_MISMATCH"], proc=F.col("proc_name"),
                                  pid=F.col("pid"), port=port_text)}),
        rule_slot(2, F.upper(F.col("state")).contains("LISTEN") & ~low.isin(R.APPROVED_LISTENERS), KIND, {
            **common, "alert_type": F.lit("LISTENER_TRAP"), "severity": F.lit("HIGH"),
            "description": render(R.MSG["LISTENER_TRAP"], proc=F.col("proc_name"),
                                  pid=F.col("pid"), port=listen_port)}),
        rule_slot(3, (dst_port > R.WELL_KNOWN_PORT_CEILING) & ~F.col("_dst_private"), KIND, {
            **common, "alert_type": F.lit("HIGH_PORT_EXTERNAL"), "severity": F.lit("MEDIUM"),
            "description": render(R.MSG["HIGH_PORT_EXTERNAL"], proc=F.col("proc_name"),
                                  pid=F.col("pid"), addr=F.col("dst_addr"), port=port_text)}),
    ]
    return slots


def dns_alerts(spark: SparkSession, dns: ForensicTable, proc: ForensicTable | None) -> DataFrame:
    df, _ = A.resolve(dns, A.DNS)
    df = df.where(F.col("query") != "")
    suspicious = lambda c: F.lower(F.col(c)).isin(R.SUSPICIOUS_DNS_RESOLVERS)
    # a row's own name decides; only nameless rows need the PID lookup, and
    # only its suspicious names can match
    named = df.where((F.col("name") != "") & suspicious("name")).withColumn("proc_name", F.col("name"))
    lookup = pid_name_lookup(proc)
    if lookup is not None:
        lookup = lookup.where(suspicious("name")).select(F.col("pid").alias("_lk_pid"), F.col("name").alias("proc_name"))
        nameless = df.where((F.col("name") == "") & (F.col("pid") != ""))
        named = named.unionByName(nameless.join(lookup, nameless["pid"] == lookup["_lk_pid"]).drop("_lk_pid"))
    df, cond = named, F.lit(True)
    slot = rule_slot(1, cond, KIND, {
        "alert_type": F.lit("RARE_DNS_QUERY"), "severity": F.lit("HIGH"),
        "pid": F.col("pid"), "process_name": F.col("proc_name"),
        "src_addr": F.lit(""), "src_port": F.lit(""), "dst_addr": F.col("query"),
        "dst_port": F.lit(""), "protocol": F.lit("DNS"), "state": F.lit(""),
        "description": render(R.MSG["RARE_DNS_QUERY"], proc=F.col("proc_name"),
                              pid=F.col("pid"), query=F.col("query"))})
    return explode_slots(df, [slot])
