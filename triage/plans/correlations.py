"""Correlation queries over tables derived from the given ones, with their
DuckDB oracles.

The derived views are one SELECT each, written once for both engines (``//``,
``hex10``, ``at`` and ``stamp`` are spelt per engine); the oracles restate the
semantics in plain SQL.  PID 4, one module name and one path hold a third of
the rows each."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triage import rules as R
from triage.operators import correlate as K
from triage.plans.derive import table
from triage.session import shared_scratch

NOW = 1_735_689_600          # end of the capture year, for stamps of the future

# name -> (given table, columns)
VIEWS = {
    "v_modules": ("orders", """
        CASE WHEN o_orderkey % 3 = 0 THEN '4' ELSE text(o_custkey % 200) END AS pid,
        CASE WHEN o_orderkey % 3 = 1 THEN 'NtDll.dll' ELSE 'mod' || text(o_orderkey % 40) || '.dll' END AS name,
        CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 17 = 0 THEN 'C:/Users/Public/m.dll' ELSE 'C:/Windows/System32/m' || text(o_orderkey % 3) || '.dll' END AS path,
        CASE WHEN o_orderkey % 41 = 0 THEN 'zz' WHEN o_orderkey % 3 = 0 THEN 'fffff8' || hex10(o_orderkey * 7919 % 30011 * 1048576) ELSE '0x00007f' || hex10(o_orderkey * 7919 % 30011 * 1048576) END AS base,
        CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 13 = 1 THEN '0' WHEN o_orderkey % 13 = 2 THEN '-4096' WHEN o_orderkey % 997 = 5 THEN '0x1000000000'
             WHEN o_orderkey % 1999 = 7 THEN '0xffffffffffffffffff' ELSE text((1 + o_orderkey % 500) * 4096) END AS size,
        CASE WHEN o_orderkey % 101 = 0 THEN '0' WHEN o_orderkey % 103 = 0 THEN '4102444800' WHEN o_orderkey % 107 = 0 THEN 'n/a' WHEN o_orderkey % 109 = 0 THEN text(700000000 + o_orderkey)
             ELSE text(1500000000 + o_orderkey * 7919 % 1000 * 86400) END AS stamp"""),
    "v_threads": ("lineitem", """
        CASE WHEN l_orderkey % 3 = 0 THEN '4' ELSE text(l_partkey % 200) END AS pid, text(l_orderkey * 8 + l_linenumber) AS tid,
        CASE WHEN l_partkey % 31 = 0 THEN '' WHEN l_partkey % 37 = 0 THEN '0xg1' WHEN l_orderkey % 3 = 0 THEN 'FFFFF8' ELSE '00007f' END
        || CASE WHEN l_partkey % 31 = 0 OR l_partkey % 37 = 0 THEN '' ELSE hex10(l_orderkey * 7919 % 30011 * 1048576 + l_partkey * 4096 % 2097152) END AS start"""),
    "v_findings": ("events", """
        CASE WHEN event_id % 3 = 0 THEN '4' ELSE text(user_id % 200) END AS pid, CASE WHEN event_id % 2 = 0 THEN 'PE_INJECT' ELSE 'PRIVATE_RX' END AS type,
        CASE WHEN event_id % 3 = 0 THEN 'fffff8' ELSE '00007f' END || hex10(event_id * 7919 % 30011 * 1048576 + event_id % 300 * 4096) AS address"""),
    "v_connections": ("events", """
        CASE WHEN event_id % 3 = 0 THEN '4' ELSE text(user_id) END AS pid,
        CASE WHEN event_id % 47 = 0 THEN '' WHEN user_id % 10 = 1 THEN at(event_id * 60) ELSE stamp(ts) END AS time,
        CASE WHEN event_id % 3 = 0 THEN '10.0.0.1' WHEN event_id % 29 = 0 THEN '' WHEN user_id % 10 = 1 THEN '10.9.9.9' ELSE '10.1.0.' || text(event_id % 2) END AS remote"""),
    "v_lifetimes": ("customer", """
        CASE WHEN c_custkey % 50 = 0 THEN '4' ELSE text(c_custkey % 300) END AS pid, text(c_custkey // 300 % 5) || '.exe' AS name,
        CASE WHEN c_custkey % 29 = 0 THEN '' WHEN c_custkey % 31 = 0 THEN 'bad' ELSE at(c_custkey // 300 % 5 * 518400 + c_custkey % 7 * 3600) END AS create_time,
        CASE WHEN c_custkey % 23 = 0 THEN '' ELSE at(c_custkey // 300 % 5 * 518400 + 432000 + c_custkey % 3 * 86400) END AS exit_time"""),
    "v_writes": ("orders", """
        text(o_custkey % 200) AS pid, CASE WHEN o_orderkey % 3 = 0 THEN 'C:/Temp/hot.exe' ELSE 'C:/Temp/f' || text(o_orderkey % 500) || '.exe' END AS path,
        CASE WHEN o_orderkey % 59 = 0 THEN 'never' ELSE at(o_orderkey * 7919 % 2592000 // 60 * 60) END AS time"""),
    "v_starts": ("events", """
        text(user_id) AS pid, CASE WHEN event_id % 3 = 0 THEN 'C:/Temp/hot.exe' ELSE 'C:/Temp/f' || text(event_id % 500) || '.exe' END AS path,
        CASE WHEN event_id % 5 = 0 THEN at(event_id * 7919 % 2592000 // 60 * 60) ELSE stamp(ts) END AS time"""),
    "v_handles": ("lineitem", """
        CASE WHEN l_orderkey % 3 = 0 THEN '4' ELSE text(l_suppkey) END AS pid, '0x' || hex10(l_orderkey * 8 + l_linenumber) AS handle,
        CASE WHEN l_partkey % 19 = 0 THEN '' WHEN l_partkey % 23 = 0 THEN 'rw' WHEN l_partkey % 29 = 0 THEN '0xabcdef0123456789' || hex10(l_partkey * 48611 % 2097152)
             ELSE '0x' || hex10(l_partkey * 48611 % 2097152) END AS access,
        CASE WHEN l_linenumber % 3 = 0 THEN 'File' ELSE 'Process' END AS type,
        CASE WHEN l_partkey % 7 = 0 THEN 'PID 612 LSASS.exe' ELSE 'PID ' || text(l_partkey) END AS detail"""),
    "v_processes": ("customer", """
        text(c_custkey) AS pid, CASE WHEN c_custkey % 3 = 0 THEN '4' WHEN c_custkey % 5 = 0 THEN text(c_custkey + 1000000000) ELSE text(c_custkey // 7) END AS ppid,
        'p' || text(c_custkey % 9) || '.exe' AS name, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'explorer.exe' END AS parent_name"""),
    "v_devices": ("part", """
        '\\Device\\d' || text(p_partkey) AS device, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE '\\SystemRoot\\D' || text(p_partkey % 150) || '.SYS' END AS driver_path"""),
    "v_drivers": ("supplier", "'\\systemroot\\d' || text(s_suppkey) || '.sys' AS path"),
}

SPELLING = {
    "spark": {"text": "cast({0} AS STRING)", "hex10": "lpad(lower(hex({0})), 10, '0')", "stamp": "date_format({0}, 'yyyy-MM-dd HH:mm:ss')",
              "at": "date_format(timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, {0}), 'yyyy-MM-dd HH:mm:ss')"},
    "duckdb": {"text": "CAST({0} AS VARCHAR)", "hex10": "lpad(printf('%x', {0}), 10, '0')", "stamp": "strftime({0}, '%Y-%m-%d %H:%M:%S')",
               "at": "strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds({0}), '%Y-%m-%d %H:%M:%S')"},
}


def columns(name: str, engine: str) -> str:
    sql = VIEWS[name][1]
    for word, form in SPELLING[engine].items():
        out, at = "", 0
        for m in re.finditer(rf"(?<!\w){word}\(", sql):
            if m.start() < at:
                continue
            depth, end = 1, m.end()
            while depth:
                depth += {"(": 1, ")": -1}.get(sql[end], 0)
                end += 1
            out += sql[at:m.start()] + form.replace("{0}", f"({sql[m.end():end - 1]})")
            at = end
        sql = out + sql[at:]
    return sql.replace("//", "div").replace("\\", "\\\\") if engine == "spark" else sql


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    source = table(spark, sf, VIEWS[name][0])
    return spark.sql(f"SELECT {columns(name, 'spark')} FROM {{given}}", given=source)


def oracle(body: str) -> str:
    """The views that a body names, then the body."""
    used = sorted({n for n in VIEWS if re.search(rf"\b{n}\b", body)})
    views = ", ".join(f"{n} AS (SELECT {columns(n, 'duckdb')} FROM {VIEWS[n][0]})" for n in used)
    return f"WITH {views}{', ' if not body.lstrip().upper().startswith('SELECT') else ' '}{body}"


# ---------------------------------------------------------------- queries

def threads_outside_modules(spark, sf):
    return K.threads_outside_modules(view(spark, sf, "v_threads"), view(spark, sf, "v_modules"))


def address_cross_reference(spark, sf):
    return K.address_cross_reference(view(spark, sf, "v_findings"), view(spark, sf, "v_modules"), view(spark, sf, "v_threads"))


def connection_lifetimes(spark, sf):
    return K.connection_lifetimes(view(spark, sf, "v_connections"), view(spark, sf, "v_lifetimes"))


def file_drops(spark, sf):
    return K.file_drops(view(spark, sf, "v_writes"), view(spark, sf, "v_starts"))


def beaconing(spark, sf):
    return K.beaconing(view(spark, sf, "v_connections"))


def dll_path_consensus(spark, sf):
    return K.path_consensus(view(spark, sf, "v_modules"))


def pe_stamp_outliers(spark, sf):
    return K.stamp_outliers(view(spark, sf, "v_modules"), NOW)


def process_handles(spark, sf):
    return K.process_handles(view(spark, sf, "v_handles"))


def orphan_processes(spark, sf):
    return K.orphan_processes(view(spark, sf, "v_processes"))


def unknown_drivers(spark, sf):
    return K.unknown_drivers(view(spark, sf, "v_devices"), view(spark, sf, "v_drivers"))


TIMELINE_TYPES = ["NET", "PROC"]


def attack_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """Writes the ordered timeline and reads it back with each row's position."""
    lives, net, files = (view(spark, sf, v) for v in ("v_lifetimes", "v_connections", "v_writes"))
    event = lambda df, time, kind, action, path: df.select(F.col(time).alias("time"), F.lit(kind).alias("type"), F.lit(action).alias("action"), "pid", F.col(path).alias("path"))
    parts = [event(lives, "create_time", "PROC", "Create", "name"), event(lives, "exit_time", "PROC", "Terminate", "name"),
             event(net, "time", "NET", "Connect", "remote"), event(files, "time", "NTFS", "Write", "path")]
    out = shared_scratch(spark, "timeline")
    K.timeline(parts, TIMELINE_TYPES).withColumn("_at", F.monotonically_increasing_id()).write.parquet(out)
    return K.numbered_timeline(spark.read.parquet(out))


QUERIES = {f.__name__: f for f in (threads_outside_modules, address_cross_reference, connection_lifetimes, file_drops, beaconing,
                                   dll_path_consensus, pe_stamp_outliers, process_handles, orphan_processes, unknown_drivers, attack_timeline)}

# ---------------------------------------------------------------- oracles

ADDRESS = "CASE WHEN regexp_full_match({0}, '(0[xX])?0*[0-9a-fA-F]{{1,16}}') THEN TRY_CAST('0x' || right('0000000000000000' || regexp_replace({0}, '^0[xX]', ''), 16) AS UBIGINT)::HUGEINT END"
SIZE = "CASE WHEN starts_with(size, '0x') THEN coalesce(TRY_CAST(size AS UBIGINT)::HUGEINT, 99999999999999999999::HUGEINT) ELSE TRY_CAST(size AS HUGEINT) END"
REGIONS = f"reg AS (SELECT DISTINCT pid, name, base, lo, lo + size - 1 AS last FROM (SELECT pid, name, base, {ADDRESS.format('base')} AS lo, {SIZE} AS size FROM v_modules) WHERE size > 0 AND lo IS NOT NULL AND pid <> '')"
THREADS = f"thr AS (SELECT *, {ADDRESS.format('start')} AS a FROM v_threads)"
TIME = "epoch(TRY_CAST({0} AS TIMESTAMP))::BIGINT"
RIGHTS = ", ".join(f"CASE WHEN m & {bit} = {bit} THEN '{name}' END" for name, bit in R.PROCESS_RIGHTS.items())
CONNECTED = f"con AS (SELECT *, {TIME.format('time')} AS a FROM v_connections)"

ORACLES = {
    "threads_outside_modules": f"""{REGIONS}, {THREADS}
        SELECT pid, tid, start, CAST(a AS VARCHAR) AS start_address, pid IN (SELECT pid FROM reg) AS has_modules FROM thr
        WHERE a IS NOT NULL AND pid <> '' AND NOT EXISTS (SELECT 1 FROM reg WHERE reg.pid = thr.pid AND thr.a BETWEEN reg.lo AND reg.last)""",
    "address_cross_reference": f"""{REGIONS}, {THREADS},
        fin AS (SELECT row_number() OVER () AS id, *, {ADDRESS.format('address')} AS a FROM v_findings),
        spots AS (SELECT pid, a FROM fin UNION SELECT pid, a FROM thr WHERE a IS NOT NULL),
        home AS (SELECT * FROM (SELECT s.pid, s.a, r.name, r.base, r.lo, r.last, row_number() OVER (PARTITION BY s.pid, s.a ORDER BY r.lo DESC, r.last, r.name, r.base) AS k
                 FROM spots s JOIN reg r ON r.pid = s.pid AND s.a BETWEEN r.lo AND r.last) WHERE k = 1),
        inside AS (SELECT h.pid, h.name, h.base, h.lo, h.last, count(*) AS n FROM thr t JOIN home h ON h.pid = t.pid AND h.a = t.a GROUP BY ALL),
        exact AS (SELECT pid, a, count(*) AS n FROM thr WHERE a IS NOT NULL GROUP BY ALL)
        SELECT f.pid, f.type, f.address, coalesce(h.name, '') AS module, coalesce(h.base, '') AS module_base, coalesce(i.n, 0) AS threads_in_module, coalesce(e.n, 0) AS threads_at_address
        FROM fin f LEFT JOIN home h ON h.pid = f.pid AND h.a = f.a
        LEFT JOIN inside i ON i.pid = h.pid AND i.name = h.name AND i.base = h.base AND i.lo = h.lo AND i.last = h.last LEFT JOIN exact e ON e.pid = f.pid AND e.a = f.a""",
    "connection_lifetimes": f"""{CONNECTED.replace("SELECT *", "SELECT row_number() OVER () AS id, *")},
        life AS (SELECT *, {TIME.format('create_time')} AS c, {TIME.format('exit_time')} AS e FROM v_lifetimes),
        hits AS (SELECT con.id, count(*) AS n, min((create_time, exit_time, name)) AS p FROM con JOIN life USING (pid)
                 WHERE (create_time = '' OR c <= a) AND (exit_time = '' OR a < e) AND a IS NOT NULL GROUP BY con.id)
        SELECT pid, time, remote, CASE WHEN n = 1 THEN 'one' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS lifetime,
               CASE WHEN n = 1 THEN p[3] ELSE '' END AS name, CASE WHEN n = 1 THEN p[1] ELSE '' END AS create_time, CASE WHEN n = 1 THEN p[2] ELSE '' END AS exit_time
        FROM con LEFT JOIN hits USING (id)""",
    "file_drops": f"""wr AS (SELECT path, {TIME.format('time')} AS a, min((length(pid), pid)) AS p, min(time) AS t FROM v_writes WHERE {TIME.format('time')} IS NOT NULL GROUP BY ALL),
        st AS (SELECT *, {TIME.format('time')} AS a FROM v_starts)
        SELECT st.pid, st.path, st.time, wr.t AS write_time, st.a - wr.a AS gap_seconds, wr.p[2] AS writer
        FROM st ASOF JOIN wr ON st.path = wr.path AND st.a >= wr.a WHERE st.a - wr.a <= 3600""",
    "beaconing": f"""{CONNECTED},
        g AS (SELECT pid, remote, a - lag(a) OVER (PARTITION BY pid, remote ORDER BY a) AS gap FROM con WHERE a IS NOT NULL AND remote <> ''),
        m AS (SELECT pid, remote, count(gap) AS gaps, median(gap) AS med FROM g GROUP BY ALL HAVING count(gap) > 0),
        d AS (SELECT pid, remote, gaps, med, median(abs(gap - med)) AS mad, count(*) FILTER (100 * abs(gap - med) <= 10 * med) AS near FROM g JOIN m USING (pid, remote) WHERE gap IS NOT NULL GROUP BY ALL)
        SELECT pid, remote, gaps + 1 AS events, med AS median_gap, mad AS mad_gap, near / gaps AS near_share, gaps >= 4 AND med > 0 AND 100 * near >= 70 * gaps AS beacon FROM d""",
    "dll_path_consensus": """m AS (SELECT lower(name) AS name, lower(path) AS path, count(*) AS rows, count(DISTINCT pid) AS processes FROM v_modules WHERE name <> '' GROUP BY ALL),
        u AS (SELECT name, sum(rows) AS total, (list(path ORDER BY rows DESC, path))[1] AS usual FROM m GROUP BY name)
        SELECT name, path, rows, processes, rows / total AS share, usual AS usual_path, path <> usual OR path = '' AS unexpected FROM m JOIN u USING (name)""",
    "pe_stamp_outliers": f"""m AS (SELECT pid, lower(name) AS name, stamp, TRY_CAST(stamp AS BIGINT) AS v FROM v_modules),
        o AS (SELECT name, v, row_number() OVER (PARTITION BY name ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY name) AS n FROM m WHERE v IS NOT NULL),
        q AS (SELECT name, max(v) FILTER (i = (n - 1) // 4) AS q1, max(v) FILTER (i = 3 * (n - 1) // 4) AS q3 FROM o GROUP BY name)
        SELECT pid, name, stamp, CASE WHEN v > {NOW} THEN 'future' WHEN v < 31536000 THEN 'epoch' WHEN v < q1 - 1.5 * (q3 - q1) THEN 'below fence' ELSE 'above fence' END AS reason
        FROM m JOIN q USING (name) WHERE v > {NOW} OR v < 31536000 OR v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)""",
    "process_handles": f"""h AS (SELECT *, CASE WHEN regexp_full_match(access, '(0[xX])?[0-9a-fA-F]+') THEN TRY_CAST('0x' || right(access[3:], 8) AS UBIGINT)::BIGINT END AS m FROM v_handles WHERE type = 'Process')
        SELECT pid, handle, access, array_to_string([x FOR x IN [{RIGHTS}] IF x IS NOT NULL], '|') AS rights, coalesce(m & 48 = 48, FALSE) AS reads_and_writes,
               contains(lower(detail), 'lsass.exe') AS lsass, contains(lower(detail), 'lsass.exe') AND coalesce(m & 16 = 16, FALSE) AS dumping FROM h""",
    "orphan_processes": """SELECT pid, ppid, name FROM v_processes WHERE pid <> '' AND parent_name = '' AND ppid NOT IN (SELECT pid FROM v_processes WHERE pid <> '')""",
    "unknown_drivers": """SELECT device, driver_path FROM v_devices WHERE lower(driver_path) NOT IN (SELECT lower(path) FROM v_drivers)""",
    "attack_timeline": f"""e AS (SELECT create_time AS time, 'PROC' AS type, 'Create' AS action, pid, name AS path FROM v_lifetimes UNION ALL SELECT exit_time, 'PROC', 'Terminate', pid, name FROM v_lifetimes
        UNION ALL SELECT time, 'NET', 'Connect', pid, remote FROM v_connections UNION ALL SELECT time, 'NTFS', 'Write', pid, path FROM v_writes)
        SELECT row_number() OVER (ORDER BY time, type, action, pid, path) - 1 AS position, * FROM e WHERE type IN ('NET', 'PROC') AND {TIME.format('time')} IS NOT NULL""",
}
