"""Forensic tables derived from the driver's parquet tables.

Every view is a projection (plus one union for duplicate PIDs) of a given
table, so its size grows with the input and Catalyst prunes the parquet
scan to the key columns used.  ``_row_id`` is the source key, which makes
"first/last row wins" deterministic under any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triage.plans import fixtures as X
from triage.session import ship_package
from triage.table import ForensicTable

HIDDEN_PID_OFFSET = 100000
ORPHAN_PID_OFFSET = 1000000000
DUP_ROW_OFFSET = 1000000000000


def sql_str(v: str) -> str:
    """Spark SQL string literal (backslash escapes on)."""
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def pick(values: list[str], idx: Column) -> Column:
    """values[idx % len] as a literal-array lookup (1-based element_at);
    the literal array is one SQL expression, not one call per value."""
    arr = F.expr("array(" + ", ".join(sql_str(v) for v in values) + ")")
    return F.element_at(arr, (idx % len(values)).cast("int") + 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table (read-only input)."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(c: Column) -> Column:
    return c.cast("string")


def process(spark: SparkSession, sf_dir: str) -> ForensicTable:
    """pid, ppid, name, parent_name, path, user, cmdline (+ duplicate PIDs).

    A third of all processes are children of PID 4 (hot parent key).
    """
    k = F.col("c_custkey")
    base = table(spark, sf_dir, "customer").select(k.alias("k"))
    k = F.col("k")
    dup = base.where(k % 97 == 0).select(k, (k + DUP_ROW_OFFSET).alias("_row_id"), F.lit(5).alias("_shift"))
    rows = base.select(k, k.alias("_row_id"), F.lit(0).alias("_shift")).unionByName(dup)
    df = rows.select(
        "_row_id",
        _s(k).alias("pid"),
        _s(F.when(k % 3 == 0, F.lit(4)).otherwise(F.floor(k / 7))).alias("ppid"),
        pick(X.PROCESS_NAMES, k + F.col("_shift")).alias("name"),
        F.when(k % 2 == 1, F.lit("")).otherwise(pick(X.PARENT_NAMES, F.floor(k / 2))).alias("parent_name"),
        pick(X.PROCESS_PATHS, F.floor(k / 3)).alias("path"),
        pick(X.USERS, F.floor(k / 5)).alias("user"),
        pick(X.CMDLINES, F.floor(k / 2)).alias("cmdline"),
    )
    return ForensicTable.of(df, "process")


PROCESS_CAMEL = {"pid": "Process_ID", "ppid": "Parent_PID", "name": "ImageName",
                 "parent_name": "Parent", "path": "Image_Path", "user": "SID",
                 "cmdline": "CommandLine"}


def process_camel(spark: SparkSession, sf_dir: str) -> ForensicTable:
    """The same process rows under a second header dialect."""
    t = process(spark, sf_dir)
    df = t.df.select("_row_id", *[F.col(a).alias(b) for a, b in PROCESS_CAMEL.items()])
    return ForensicTable.of(df, "process")


def net(spark: SparkSession, sf_dir: str) -> ForensicTable:
    """pid, protocol, state, src/dst addr/port.  PID 4 owns a third of all
    connections (hot key); every 13th order points at a PID no process has."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    k, c = F.col("k"), F.col("c")
    pid = (F.when(k % 13 == 0, c + ORPHAN_PID_OFFSET)
            .when(k % 3 == 0, F.lit(4))
            .otherwise(c))
    df = o.select(
        k.alias("_row_id"),
        _s(pid).alias("pid"),
        pick(X.PROTOCOLS, k).alias("protocol"),
        pick(X.STATES, F.floor(k / 3)).alias("state"),
        pick(X.SRC_ADDRS, F.floor(k / 5)).alias("src-addr"),
        pick(X.SRC_PORTS, F.floor(k / 7)).alias("src-port"),
        pick(X.DST_ADDRS, F.floor(k / 11)).alias("dst-addr"),
        pick(X.DST_PORTS, k).alias("dst-port"),
    )
    return ForensicTable.of(df, "net")


def dns(spark: SparkSession, sf_dir: str) -> ForensicTable:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), F.col("user_id").alias("u"))
    k = F.col("k")
    df = e.select(
        k.alias("_row_id"),
        _s(F.col("u")).alias("pid"),
        F.when(k % 3 == 0, F.lit("")).otherwise(pick(X.DNS_NAMES, k)).alias("process"),
        pick(X.DNS_QUERIES, F.floor(k / 8)).alias("query"),
    )
    return ForensicTable.of(df, "dns")


def memory(spark: SparkSession, sf_dir: str) -> ForensicTable:
    """Memory-region findings from lineitem.  lineitem has no single key, so
    the row order is (l_orderkey, l_linenumber, l_partkey, l_suppkey)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    o, n, p, s = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    pid = (F.when(p % 101 == 1, F.lit("04"))
            .when(p % 17 == 0, _s(s + HIDDEN_PID_OFFSET))
            .when(o % 3 == 0, F.lit("4"))
            .otherwise(_s(s)))
    df = li.select(
        F.struct(o.alias("o"), n.alias("n"), p.alias("p"), s.alias("s")).alias("_row_id"),
        pid.alias("pid"),
        pick(X.MEM_PROCS, p).alias("process"),
        F.concat(F.lit("0x"), _s(o * 4096 + n)).alias("address"),
        F.when(p % 5 == 0, F.lit("")).otherwise(_s(p * 4096)).alias("size"),
        pick(X.MEM_PROTECTIONS, F.floor(p / 3) + n).alias("protection"),
        pick(X.MEM_FILES, s + n).alias("file"),
        pick(X.MEM_TYPES, o + p).alias("type"),
    )
    return ForensicTable.of(df, "findevil")


def registry(spark: SparkSession, sf_dir: str) -> ForensicTable:
    pt = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    k = F.col("k")
    df = pt.select(k.alias("_row_id"),
                   pick(X.REG_PATHS, k).alias("path"),
                   F.concat(F.lit("entry"), _s(k)).alias("name"),
                   pick(X.REG_DATA, F.floor(k / 7)).alias("data"))
    return ForensicTable.of(df, "registry")


def services(spark: SparkSession, sf_dir: str) -> ForensicTable:
    pt = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    k = F.col("k")
    df = pt.select(k.alias("_row_id"),
                   F.concat(F.lit("svc"), _s(k)).alias("service_name"),
                   pick(X.SVC_BINS, F.floor(k / 3)).alias("binary_path"))
    return ForensicTable.of(df, "services")


def tasks(spark: SparkSession, sf_dir: str) -> ForensicTable:
    pt = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    k = F.col("k")
    df = pt.select(k.alias("_row_id"),
                   F.concat(F.lit("\\Task"), _s(k)).alias("task_name"),
                   pick(X.TASK_ACTIONS, F.floor(k / 5)).alias("action"))
    return ForensicTable.of(df, "tasks")


RAW_ORDERS_SPEC = {
    "o_custkey": "int", "o_address": "hex_int", "o_price": "float", "o_flag": "bool",
    "o_time": "timestamp", "o_status": "raw", "o_note": "no_such_type",
}


def raw_orders(spark: SparkSession, sf_dir: str) -> ForensicTable:
    """Every column as text with dirt injected by key: blanks, padding,
    signs, underscores, hex, floats, epochs and nine date layouts."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    k, c = F.col("k"), _s(F.col("c"))
    m9 = k % 9
    cust = (F.when(k % 23 == 0, pick(X.WIDE_INTS, F.floor(k / 23))).when(m9 == 0, c).when(m9 == 1, F.concat(F.lit(" "), c, F.lit(" ")))
             .when(m9 == 2, F.concat(F.lit("+"), c)).when(m9 == 3, F.lit("BAD"))
             .when(m9 == 4, F.lit("")).when(m9 == 5, F.concat(c, F.lit("_000")))
             .when(m9 == 6, F.concat(c, F.lit(".5"))).when(m9 == 7, F.concat(F.lit("-"), c))
             .otherwise(F.concat(F.lit("0"), c)))
    price = F.when(k % 5 == 0, F.concat(_s(k), F.lit("."), _s(k % 100))).otherwise(
        pick(X.FLOAT_VALUES, F.floor(k / 5)))
    ts = F.when(k % 4 == 0, F.concat(
        F.lit("2024-"), F.lpad(_s(1 + k % 12), 2, "0"), F.lit("-"), F.lpad(_s(1 + k % 28), 2, "0"),
        F.lit(" 10:"), F.lpad(_s(k % 60), 2, "0"), F.lit(":00"))).otherwise(pick(X.TS_VALUES, F.floor(k / 4)))
    df = o.select(
        k.alias("_row_id"), k.alias("_row_index"),
        _s(k).alias("o_orderkey"), cust.alias("o_custkey"),
        pick(X.HEX_VALUES, k).alias("o_address"), price.alias("o_price"),
        pick(X.BOOL_VALUES, k).alias("o_flag"), ts.alias("o_time"),
        pick(X.STATUS_VALUES, k).alias("o_status"), F.concat(F.lit("n"), _s(k % 7)).alias("o_note"),
    )
    return ForensicTable.of(df, "raw_orders")


PROCESS_SPEC = {"pid": "int", "ppid": "int", "name": "raw", "parent_name": "string"}
NET_SPEC = {"pid": "int", "src-port": "int", "dst-port": "int", "state": "raw"}
TASKS_SPEC = {"task_name": "raw", "action": "raw"}
