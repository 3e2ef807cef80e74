"""DuckDB SQL oracles: each query's expected result, written independently
of the Spark plan (plain SQL over the same parquet views).

Derived views are rebuilt with the same literal lists and integer
arithmetic as ``triage.plans.derive``; rule semantics are re-stated in SQL.
IP verdicts come from Python's ``ipaddress`` (the semantics the rules are
defined by), evaluated over the fixture address list.
"""

from __future__ import annotations

import ipaddress
import string

from triage import rules as R
from triage.plans import fixtures as X
from triage.plans.derive import DUP_ROW_OFFSET, HIDDEN_PID_OFFSET, ORPHAN_PID_OFFSET
from triage.plans.files import FILE_KEYS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def pick(values, idx: str) -> str:
    return f"({sql_list(values)})[(({idx}) % {len(values)}) + 1]"


def in_sql(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^\\s+|\\s+$', '', 'g')"


def render(template: str, **exprs: str) -> str:
    parts = []
    for literal, field, _s, _c in string.Formatter().parse(template):
        if literal:
            parts.append(q(literal))
        if field is not None:
            parts.append(f"({exprs[field]})")
    return " || ".join(parts)


def py_private(addr: str) -> bool:
    a = addr.strip()
    if a in R.PRIVATE_LITERAL_ADDRS:
        return True
    try:
        ip = ipaddress.ip_address(a)
    except ValueError:
        return False
    return ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved


def int_text(v: str) -> str:
    """Canonical decimal text: the digits without sign, underscores, leading zeros."""
    d = f"regexp_replace(regexp_replace({v}, '[+_-]', '', 'g'), '^0+([0-9])', '\\1')"
    return (f"CASE WHEN regexp_full_match({v}, '[+-]?[0-9]+(_[0-9]+)*') "
            f"THEN CASE WHEN starts_with({v}, '-') AND {d} <> '0' THEN '-' ELSE '' END || {d} END")


def hex_text(v: str) -> str:
    """Up to 16 hex digits by UBIGINT; the wider literals of the fixtures by
    their values, computed here with Python integers."""
    body = f"ltrim(regexp_replace(replace(regexp_replace({v}, '^[+-]', ''), '_', ''), '^0[xX]', ''), '0')"
    wide = {h.strip(): str(int(h.strip(), 16)) for h in [*X.HEX_VALUES, *X.DST_PORTS]
            if len(h) > 16 and set(h.strip().lower()) <= set("0123456789abcdefx_-")}
    known = " ".join(f"WHEN {q(h)} THEN {q(t)}" for h, t in wide.items())
    return (f"CASE {v} {known} ELSE CASE WHEN regexp_full_match({v}, '[+-]?(0[xX]_?)?[0-9a-fA-F]+(_[0-9a-fA-F]+)*') "
            f"AND length({body}) <= 16 THEN CASE WHEN starts_with({v}, '-') AND {body} <> '' THEN '-' ELSE '' END || "
            f"CASE WHEN {body} = '' THEN '0' ELSE CAST(TRY_CAST('0x' || {body} AS UBIGINT) AS VARCHAR) END END END")


def lenient_text(v: str) -> str:
    return f"coalesce({int_text(v)}, {hex_text(v)})"


def lenient_int(v: str) -> str:
    """For comparisons, saturated beyond 37 digits."""
    t = lenient_text(v)
    return (f"CASE WHEN length({t}) <= 37 THEN TRY_CAST({t} AS HUGEINT) WHEN starts_with({t}, '-') THEN -(10::HUGEINT ** 37)::HUGEINT "
            f"WHEN {t} IS NOT NULL THEN TRY_CAST('{'9' * 37}' AS HUGEINT) END")


# ---------------------------------------------------------------------------
# derived views
# ---------------------------------------------------------------------------

def v_process() -> str:
    return f"""
    p_base AS (SELECT c_custkey AS k FROM customer),
    p_rows AS (SELECT k, k AS _row_id, 0 AS _shift FROM p_base
               UNION ALL SELECT k, k + {DUP_ROW_OFFSET}, 5 FROM p_base WHERE k % 97 = 0),
    process_v AS (
      SELECT _row_id,
             CAST(k AS VARCHAR) AS pid,
             CAST(CASE WHEN k % 3 = 0 THEN 4 ELSE k // 7 END AS VARCHAR) AS ppid,
             {pick(X.PROCESS_NAMES, 'k + _shift')} AS name,
             CASE WHEN k % 2 = 1 THEN '' ELSE {pick(X.PARENT_NAMES, 'k // 2')} END AS parent_name,
             {pick(X.PROCESS_PATHS, 'k // 3')} AS path,
             {pick(X.USERS, 'k // 5')} AS "user",
             {pick(X.CMDLINES, 'k // 2')} AS cmdline
      FROM p_rows)"""


def v_net() -> str:
    return f"""
    net_v AS (
      SELECT o_orderkey AS _row_id,
             CAST(CASE WHEN o_orderkey % 13 = 0 THEN o_custkey + {ORPHAN_PID_OFFSET}
                       WHEN o_orderkey % 3 = 0 THEN 4 ELSE o_custkey END AS VARCHAR) AS pid,
             {pick(X.PROTOCOLS, 'o_orderkey')} AS protocol,
             {pick(X.STATES, 'o_orderkey // 3')} AS state,
             {pick(X.SRC_ADDRS, 'o_orderkey // 5')} AS src_addr,
             {pick(X.SRC_PORTS, 'o_orderkey // 7')} AS src_port,
             {pick(X.DST_ADDRS, 'o_orderkey // 11')} AS dst_addr,
             {pick(X.DST_PORTS, 'o_orderkey')} AS dst_port
      FROM orders)"""


def v_dns() -> str:
    return f"""
    dns_v AS (
      SELECT event_id AS _row_id, CAST(user_id AS VARCHAR) AS pid,
             CASE WHEN event_id % 3 = 0 THEN '' ELSE {pick(X.DNS_NAMES, 'event_id')} END AS process,
             {pick(X.DNS_QUERIES, 'event_id // 8')} AS query
      FROM events)"""


def v_memory() -> str:
    pid = (f"CASE WHEN l_partkey % 101 = 1 THEN '04' "
           f"WHEN l_partkey % 17 = 0 THEN CAST(l_suppkey + {HIDDEN_PID_OFFSET} AS VARCHAR) "
           f"WHEN l_orderkey % 3 = 0 THEN '4' ELSE CAST(l_suppkey AS VARCHAR) END")
    return f"""
    mem_v AS (
      SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey AS s,
             {pid} AS pid,
             {pick(X.MEM_PROCS, 'l_partkey')} AS process,
             '0x' || CAST(l_orderkey * 4096 + l_linenumber AS VARCHAR) AS address,
             CASE WHEN l_partkey % 5 = 0 THEN '' ELSE CAST(l_partkey * 4096 AS VARCHAR) END AS size,
             {pick(X.MEM_PROTECTIONS, 'l_partkey // 3 + l_linenumber')} AS protection,
             {pick(X.MEM_FILES, 'l_suppkey + l_linenumber')} AS file,
             {pick(X.MEM_TYPES, 'l_orderkey + l_partkey')} AS type
      FROM lineitem)"""


def v_registry() -> str:
    return f"""
    reg_v AS (SELECT p_partkey AS _row_id, {pick(X.REG_PATHS, 'p_partkey')} AS path,
                     'entry' || CAST(p_partkey AS VARCHAR) AS name,
                     {pick(X.REG_DATA, 'p_partkey // 7')} AS data FROM part),
    svc_v AS (SELECT p_partkey AS _row_id, 'svc' || CAST(p_partkey AS VARCHAR) AS name,
                     {pick(X.SVC_BINS, 'p_partkey // 3')} AS binary_path FROM part),
    task_v AS (SELECT p_partkey AS _row_id, '\\Task' || CAST(p_partkey AS VARCHAR) AS name,
                      {pick(X.TASK_ACTIONS, 'p_partkey // 5')} AS action FROM part)"""


def pid_lookup_cte() -> str:
    return f"""
    lk AS (SELECT pid, arg_max(name, _row_id) AS name
           FROM (SELECT _row_id, {strip('pid')} AS pid, {strip('name')} AS name FROM process_v)
           WHERE pid <> '' GROUP BY pid)"""


def ip_verdicts() -> str:
    rows = ", ".join(f"({q(a.strip())}, {str(py_private(a)).upper()})" for a in sorted(set(X.DST_ADDRS)))
    return f"ipv(addr, priv) AS (VALUES {rows})"


# ---------------------------------------------------------------------------
# network + dns
# ---------------------------------------------------------------------------

NET_COLS = ("pid, proc_name AS process_name, src_addr, src_port, dst_addr, dst_port, "
            "protocol, state")


def alerts_network() -> str:
    port = "dport_text"
    listen = "CASE WHEN src_port <> '' THEN src_port ELSE dst_port END"
    return f"""
    WITH {v_process()}, {v_net()}, {pid_lookup_cte()}, {ip_verdicts()},
    n AS (SELECT _row_id, {strip('pid')} AS pid, {strip('protocol')} AS protocol, {strip('state')} AS state,
                 {strip('src_addr')} AS src_addr, {strip('src_port')} AS src_port,
                 {strip('dst_addr')} AS dst_addr, {strip('dst_port')} AS dst_port FROM net_v),
    j AS (SELECT n.*, coalesce(lk.name, '<unknown>') AS proc_name,
                 {lenient_int('n.dst_port')} AS dport, {lenient_text('n.dst_port')} AS dport_text, coalesce(ipv.priv, FALSE) AS priv
          FROM n LEFT JOIN lk ON n.pid = lk.pid LEFT JOIN ipv ON n.dst_addr = ipv.addr)
    SELECT 'PROCESS_PORT_MISMATCH' AS alert_type, 'MEDIUM' AS severity, {NET_COLS},
           {render(R.MSG['PROCESS_PORT_MISMATCH'], proc='proc_name', pid='pid', port=port)} AS description
    FROM j WHERE dport IN ({', '.join(map(str, R.WEB_PORTS))}) AND lower(proc_name) NOT IN {in_sql(R.BROWSERS)}
    UNION ALL
    SELECT 'LISTENER_TRAP', 'HIGH', {NET_COLS},
           {render(R.MSG['LISTENER_TRAP'], proc='proc_name', pid='pid', port=listen)}
    FROM j WHERE contains(upper(state), 'LISTEN') AND lower(proc_name) NOT IN {in_sql(R.APPROVED_LISTENERS)}
    UNION ALL
    SELECT 'HIGH_PORT_EXTERNAL', 'MEDIUM', {NET_COLS},
           {render(R.MSG['HIGH_PORT_EXTERNAL'], proc='proc_name', pid='pid', addr='dst_addr', port=port)}
    FROM j WHERE dport > {R.WELL_KNOWN_PORT_CEILING} AND NOT priv
    """


def alerts_dns(more: str = "") -> str:
    """``more``: further output columns over _row_id."""
    return f"""
    WITH {v_process()}, {v_dns()}, {pid_lookup_cte()},
    d AS (SELECT _row_id, {strip('pid')} AS pid, {strip('process')} AS name, {strip('query')} AS query FROM dns_v),
    j AS (SELECT d.*, CASE WHEN d.name <> '' THEN d.name
                           WHEN d.pid <> '' THEN coalesce(lk.name, '<unknown>') ELSE '' END AS proc_name
          FROM d LEFT JOIN lk ON d.pid = lk.pid)
    SELECT 'RARE_DNS_QUERY' AS alert_type, 'HIGH' AS severity, pid, proc_name AS process_name,
           '' AS src_addr, '' AS src_port, query AS dst_addr, '' AS dst_port, 'DNS' AS protocol,
           '' AS state,
           {render(R.MSG['RARE_DNS_QUERY'], proc='proc_name', pid='pid', query='query')} AS description{more}
    FROM j WHERE lower(proc_name) IN {in_sql(R.SUSPICIOUS_DNS_RESOLVERS)} AND query <> ''
    """


# ---------------------------------------------------------------------------
# process + lateral
# ---------------------------------------------------------------------------

def _proc_resolved(extra_cols: str) -> str:
    return f"""
    pr AS (SELECT _row_id, {strip('pid')} AS pid, {strip('name')} AS name, {strip('ppid')} AS ppid,
                  {strip('parent_name')} AS parent_name {extra_cols} FROM process_v),
    lk2 AS (SELECT pid, arg_max(name, _row_id) AS name FROM pr WHERE pid <> '' GROUP BY pid),
    j AS (SELECT pr.*, CASE WHEN pr.parent_name <> '' THEN pr.parent_name ELSE coalesce(lk2.name, '') END AS par
          FROM pr LEFT JOIN lk2 ON pr.ppid = lk2.pid)"""


def _first_match(expr: str, patterns, labels=None, kind="regex") -> str:
    labels = labels or patterns
    whens = []
    for p, lab in zip(patterns, labels):
        test = f"regexp_matches({expr}, {q(p)}, 'i')" if kind == "regex" else f"contains({expr}, {q(p)})"
        whens.append(f"WHEN {test} THEN {q(lab)}")
    return "CASE " + " ".join(whens) + " END"


def alerts_process() -> str:
    crit = [c.lower() for c in R.CRITICAL_NAMES]
    typo = "CASE " + " ".join(f"WHEN levenshtein(nl, {q(c)}) = 1 THEN {q(c)}" for c in crit) + " END"
    allowed = "CASE nl " + " ".join(f"WHEN {q(k)} THEN pl IN {in_sql(v)}" for k, v in R.PARENT_RULES.items()) + " END"
    expected = "CASE nl " + " ".join(
        f"WHEN {q(k)} THEN {q('[' + ', '.join(repr(x) for x in sorted(v)) + ']')}"
        for k, v in R.PARENT_RULES.items()) + " END"
    prefixes = " OR ".join(f"starts_with(pathl, {q(p)})" for p in R.SYSTEM32_PREFIXES)
    markers = " OR ".join(f"contains(ul, {q(m)})" for m in R.SYSTEM_USER_MARKERS)
    cols = "pid, name AS process_name, path AS process_path, ppid, par AS parent_name, usr AS \"user\""
    return f"""
    WITH {v_process()}, {_proc_resolved(f", {strip('path')} AS path, {strip('\"user\"')} AS usr")},
    k AS (SELECT *, lower(name) AS nl, lower(par) AS pl, lower(path) AS pathl, lower(usr) AS ul FROM j),
    t AS (SELECT *, CASE WHEN nl NOT IN {in_sql(crit)} THEN {typo} END AS typo FROM k)
    SELECT 'PATH_MASQUERADE' AS alert_type, 'HIGH' AS severity, {cols},
           {render(R.MSG['PATH_MASQUERADE'], name='name', pid='pid', path='path')} AS description
    FROM t WHERE nl IN {in_sql(R.SYSTEM32_ONLY)} AND path <> '' AND NOT ({prefixes})
    UNION ALL
    SELECT 'PARENT_CHILD_MISMATCH', 'HIGH', {cols},
           {render(R.MSG['PARENT_CHILD_MISMATCH_RULE'], name='name', pid='pid', parent='par', ppid='ppid', expected=expected)}
    FROM t WHERE nl IN {in_sql(list(R.PARENT_RULES))} AND par <> '' AND NOT ({allowed})
    UNION ALL
    SELECT 'PARENT_CHILD_MISMATCH', 'HIGH', {cols},
           {render(R.MSG['PARENT_CHILD_MISMATCH_OFFICE'], name='name', pid='pid', parent='par', ppid='ppid')}
    FROM t WHERE nl IN {in_sql(R.SHELL_CHILDREN)} AND pl IN {in_sql(R.OFFICE_PARENTS)}
    UNION ALL
    SELECT 'TYPOSQUATTING', 'MEDIUM', {cols},
           {render(R.MSG['TYPOSQUATTING'], name='name', pid='pid', critical='typo', dist="'1'")}
    FROM t WHERE typo IS NOT NULL
    UNION ALL
    SELECT 'SID_MISMATCH', 'HIGH', {cols},
           {render(R.MSG['SID_MISMATCH'], name='name', pid='pid', user='usr')}
    FROM t WHERE nl IN {in_sql(R.SYSTEM_ONLY_PROCESSES)} AND usr <> '' AND NOT ({markers})
    """


def alerts_lateral() -> str:
    labels = [lab for lab, _ in R.RECON_PATTERNS]
    pats = [p for _, p in R.RECON_PATTERNS]
    fw = "CASE pl " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in R.REMOTE_EXEC_PARENTS.items()) + " END"
    cols = "pid, name AS process_name, ppid, par AS parent_name, cmd AS cmdline"
    suffix = render(R.MSG["RECON_ESCALATED_SUFFIX"], n="CAST(e.n AS VARCHAR)")
    return f"""
    WITH {v_process()}, {_proc_resolved(f", {strip('cmdline')} AS cmd")},
    k AS (SELECT *, lower(par) AS pl,
                 CASE WHEN cmd <> '' THEN {_first_match('cmd', R.CRED_DUMP_PATTERNS)} END AS cred,
                 CASE WHEN cmd <> '' THEN {_first_match('cmd', pats, labels)} END AS recon,
                 CASE WHEN ppid <> '' THEN ppid ELSE pid END AS pkey FROM j),
    e AS (SELECT pkey, count(DISTINCT recon) AS n FROM k WHERE recon IS NOT NULL GROUP BY pkey
          HAVING count(DISTINCT recon) >= {R.RECON_ESCALATION_THRESHOLD})
    SELECT 'CREDENTIAL_DUMP' AS alert_type, 'CRITICAL' AS severity, {cols},
           {render(R.MSG['CREDENTIAL_DUMP'], name='name', pid='pid', pattern='cred')} AS description
    FROM k WHERE cred IS NOT NULL
    UNION ALL
    SELECT 'RECON_COMMANDS', CASE WHEN e.n IS NOT NULL THEN 'HIGH' ELSE 'LOW' END, {cols},
           {render(R.MSG['RECON_COMMANDS'], label='recon', name='name', pid='pid')}
             || CASE WHEN e.n IS NOT NULL THEN {suffix} ELSE '' END
    FROM k LEFT JOIN e ON k.pkey = e.pkey WHERE recon IS NOT NULL
    UNION ALL
    SELECT 'REMOTE_EXECUTION', 'HIGH', {cols},
           {render(R.MSG['REMOTE_EXECUTION'], parent='par', ppid='ppid', framework=fw, name='name', pid='pid')}
    FROM k WHERE lower(name) IN {in_sql(R.REMOTE_EXEC_CHILDREN)} AND pl IN {in_sql(list(R.REMOTE_EXEC_PARENTS))}
    """


# ---------------------------------------------------------------------------
# injection / dkom / persistence
# ---------------------------------------------------------------------------

def _qm(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN '?' ELSE {x} END"


def _name_part(x: str) -> str:
    return f"CASE WHEN {x} <> '' THEN ' (' || {x} || ')' ELSE '' END"


def _mz(x: str) -> str:
    conds = [f"starts_with({x}, {q(p)})" for p in R.MZ_PREFIXES] + [f"contains({x}, {q(s)})" for s in R.MZ_SUBSTRINGS]
    return f"({x} <> '' AND ({' OR '.join(conds)}))"


def _mem_resolved() -> str:
    return f"""
    m AS (SELECT o, n, p, s, {strip('pid')} AS pid, {strip('process')} AS name, {strip('address')} AS address,
                 {strip('size')} AS size, {strip('protection')} AS prot, {strip('file')} AS file,
                 {strip('type')} AS typ FROM mem_v),
    mm AS (SELECT *, lower(file) AS fl, lower(typ) AS tl, lower(name) AS nl,
                  (prot <> '' AND ({' OR '.join(f"regexp_matches(prot, {q(p)}, 'i')" for p in R.RWX_PATTERNS)})) AS rwx,
                  lower(file) IN {in_sql(R.UNBACKED_SENTINELS)} AS unb,
                  coalesce(CASE lower(name) {' '.join(f"WHEN {q(k)} THEN {q(v)}" for k, v in R.EXPECTED_PATHS.items())} END, '') AS exp
           FROM m)"""


INJ_COLS = "pid, name AS process_name, address, size, prot AS protection"


def alerts_injection() -> str:
    src = q(R.MEMORY_SOURCES["findevil"])
    mismatch = "(exp <> '' AND fl <> '' AND NOT unb AND NOT starts_with(fl, exp))"
    reason = (f"CASE WHEN unb THEN {q(R.MSG['HOLLOWING_REASON_EMPTY'])} ELSE "
              f"{render(R.MSG['HOLLOWING_REASON_MISMATCH'], expected='exp', got='fl')} END")
    return f"""
    WITH {v_memory()}, {_mem_resolved()}
    SELECT 'RWX_UNBACKED' AS alert_type, 'CRITICAL' AS severity, {INJ_COLS},
           CASE WHEN file <> '' THEN file ELSE '<none>' END AS backing_file, {src} AS source_table,
           {render(R.MSG['RWX_UNBACKED'], address=_qm('address'), size=_qm('size'), pid=_qm('pid'), name_part=_name_part('name'))} AS description
    FROM mm WHERE rwx AND (unb OR (CASE WHEN tl <> '' THEN contains(tl, 'private') ELSE TRUE END))
    UNION ALL
    SELECT 'PROCESS_HOLLOWING', 'CRITICAL', {INJ_COLS},
           CASE WHEN fl <> '' THEN fl ELSE '<none>' END, {src},
           {render(R.MSG['PROCESS_HOLLOWING'], name='name', pid=_qm('pid'), reason=reason)}
    FROM mm WHERE nl IN {in_sql(R.HOLLOWING_TARGETS)} AND (tl = '' OR contains(tl, 'image')) AND (unb OR {mismatch})
    UNION ALL
    SELECT 'REFLECTIVE_DLL', 'HIGH', {INJ_COLS}, '<none>', {src},
           {render(R.MSG['REFLECTIVE_DLL'], address=_qm('address'), pid=_qm('pid'), name_part=_name_part('name'))}
    FROM mm WHERE ({_mz('tl')} OR {_mz('fl')}) AND unb
    """


def hidden_processes() -> str:
    src = R.MEMORY_SOURCES["findevil"]
    return f"""
    WITH {v_process()}, {v_memory()}, {_mem_resolved()},
    act AS (SELECT DISTINCT {strip('pid')} AS pid FROM process_v WHERE {strip('pid')} <> ''),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY o, n, p, s) AS rn FROM m
                         WHERE pid <> '' AND pid NOT IN {in_sql(R.DKOM_EXCLUDED_PIDS)}) WHERE rn = 1)
    SELECT 'DKOM_HIDDEN_PROCESS' AS alert_type, 'CRITICAL' AS severity, f.pid,
           CASE WHEN name <> '' THEN name ELSE '<hidden>' END AS process_name, address,
           '' AS size, '' AS protection, '' AS backing_file, {q(src)} AS source_table,
           {render(R.MSG['DKOM_HIDDEN_PROCESS'], pid='f.pid', name_part=_name_part('name'), source=q(src))} AS description
    FROM f WHERE f.pid NOT IN (SELECT pid FROM act)
    """


def alerts_persistence() -> str:
    runkey = " OR ".join(f"regexp_matches(path, {q(p)}, 'i')" for p in R.RUN_KEY_PATTERNS)
    runpath = " OR ".join(f"contains(lower(data), {q(m)})" for m in R.SUSPICIOUS_RUN_PATHS)
    marker = _first_match("lower(bin)", R.SERVICE_SUSPICIOUS, kind="contains")
    task = " OR ".join(f"regexp_matches(action, {q(p)}, 'i')" for p in R.TASK_SUSPICIOUS_PATTERNS)
    return f"""
    WITH {v_registry()},
    r AS (SELECT {strip('path')} AS path, {strip('name')} AS name, {strip('data')} AS data FROM reg_v),
    sv AS (SELECT {strip('name')} AS name, {strip('binary_path')} AS bin FROM svc_v),
    svm AS (SELECT *, {marker} AS marker FROM sv),
    tk AS (SELECT {strip('name')} AS name, {strip('action')} AS action FROM task_v)
    SELECT 'SUSPICIOUS_RUN_KEY' AS alert_type, 'HIGH' AS severity, {q(R.PERSISTENCE_SOURCES['registry'])} AS source_table,
           path || ' :: ' || name AS key_or_name, data AS value_or_path,
           {render(R.MSG['SUSPICIOUS_RUN_KEY'], name='name', path='path', data='data')} AS description
    FROM r WHERE ({runkey}) AND ({runpath})
    UNION ALL
    SELECT 'SERVICE_MASQUERADE', 'HIGH', {q(R.PERSISTENCE_SOURCES['services'])}, name, bin,
           {render(R.MSG['SERVICE_MASQUERADE'], name='name', path='bin', marker='marker')}
    FROM svm WHERE marker IS NOT NULL
    UNION ALL
    SELECT 'HIDDEN_SCHEDULED_TASK', 'MEDIUM', {q(R.PERSISTENCE_SOURCES['tasks'])}, name, action,
           {render(R.MSG['HIDDEN_SCHEDULED_TASK'], name='name', action='action')}
    FROM tk WHERE {task}
    """


# ---------------------------------------------------------------------------
# typed conversion
# ---------------------------------------------------------------------------

from triage.functions.convert import ERRORS as CONV_ERRORS  # noqa: E402
from triage.functions.convert import FALSY, TRUTHY, TIMESTAMP_FORMATS, strptime_regex  # noqa: E402
from triage.functions.convert import FLOAT_RE, FLOAT_SPECIAL_RE  # noqa: E402
from triage.plans.derive import RAW_ORDERS_SPEC  # noqa: E402


def py_repr(s: str) -> str:
    esc = f"replace({s}, '\\', '\\\\')"
    return (f"CASE WHEN contains({s}, '''') AND NOT contains({s}, '\"') THEN '\"' || {esc} || '\"' "
            f"ELSE '''' || replace({esc}, '''', '\\''') || '''' END")


def v_raw_orders() -> str:
    k, c = "o_orderkey", "CAST(o_custkey AS VARCHAR)"
    cust = (f"CASE WHEN {k} % 23 = 0 THEN {pick(X.WIDE_INTS, f'{k} // 23')} ELSE CASE {k} % 9 WHEN 0 THEN {c} WHEN 1 THEN ' ' || {c} || ' ' WHEN 2 THEN '+' || {c} "
            f"WHEN 3 THEN 'BAD' WHEN 4 THEN '' WHEN 5 THEN {c} || '_000' WHEN 6 THEN {c} || '.5' "
            f"WHEN 7 THEN '-' || {c} ELSE '0' || {c} END END")
    price = (f"CASE WHEN {k} % 5 = 0 THEN CAST({k} AS VARCHAR) || '.' || CAST({k} % 100 AS VARCHAR) "
             f"ELSE {pick(X.FLOAT_VALUES, f'{k} // 5')} END")
    ts = (f"CASE WHEN {k} % 4 = 0 THEN '2024-' || lpad(CAST(1 + {k} % 12 AS VARCHAR), 2, '0') || '-' || "
          f"lpad(CAST(1 + {k} % 28 AS VARCHAR), 2, '0') || ' 10:' || lpad(CAST({k} % 60 AS VARCHAR), 2, '0') "
          f"|| ':00' ELSE {pick(X.TS_VALUES, f'{k} // 4')} END")
    return f"""
    ro AS (SELECT {k} AS row_index, CAST({k} AS VARCHAR) AS o_orderkey, {cust} AS o_custkey,
                  {pick(X.HEX_VALUES, k)} AS o_address, {price} AS o_price,
                  {pick(X.BOOL_VALUES, k)} AS o_flag, {ts} AS o_time,
                  {pick(X.STATUS_VALUES, k)} AS o_status, 'n' || CAST({k} % 7 AS VARCHAR) AS o_note
           FROM orders)"""


def _float_sql(s: str) -> str:
    return (f"CASE WHEN regexp_full_match({s}, {q(FLOAT_SPECIAL_RE)}) THEN "
            f"(CASE WHEN lower({s}) IN ('inf', '+inf', 'infinity', '+infinity') THEN 'inf'::DOUBLE "
            f"WHEN lower({s}) IN ('-inf', '-infinity') THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END) "
            f"WHEN regexp_full_match({s}, {q(FLOAT_RE)}) THEN TRY_CAST(replace({s}, '_', '') AS DOUBLE) END")


def _fmt_sql(s: str, fmt: str) -> str:
    rx, fields = strptime_regex(fmt)
    g = {d: f"regexp_extract({s}, {q(rx)}, {i + 1})" for i, d in enumerate(fields)}
    num = {d: f"TRY_CAST(trim({g[d]}) AS INTEGER)" for d in g if d != "f"}
    frac = f"TRY_CAST(rpad({g['f']}, 6, '0') AS INTEGER)" if "f" in g else "0"
    sec = num.get("S", "0")
    text = (f"printf('%04d-%02d-%02d %02d:%02d:%02d.%06d', {num['Y']}, {num['m']}, {num['d']}, "
            f"{num.get('H', '0')}, {num.get('M', '0')}, {sec}, {frac})")
    return (f"CASE WHEN regexp_full_match({s}, {q(rx)}) AND {num['Y']} >= 1 AND {sec} < 60 "
            f"THEN TRY_CAST({text} AS TIMESTAMP) END")


def _epoch_sql(s: str) -> str:
    n = f"CASE WHEN length({int_text(s)}) <= 37 THEN TRY_CAST({int_text(s)} AS HUGEINT) END"
    return (f"(SELECT CASE WHEN x > 1000000000000 THEN (CASE WHEN x / 1000 BETWEEN -62135596800 AND 253402300799 "
            f"THEN make_timestamp(CAST(x AS BIGINT) * 1000) END) "
            f"WHEN x BETWEEN -62135596800 AND 253402300799 THEN make_timestamp(CAST(x AS BIGINT) * 1000000) END "
            f"FROM (SELECT {n} AS x))")


def _iso(ts: str) -> str:
    return (f"strftime({ts}, '%Y-%m-%dT%H:%M:%S') || "
            f"CASE WHEN strftime({ts}, '%f') <> '000000' THEN '.' || strftime({ts}, '%f') ELSE '' END")


def conversion_cte(src: str, spec: dict[str, str], cols: list[str]) -> str:
    """CTEs cv0..cv3 over ``src``: per converted column c -> c__v, c__e."""
    conv = {c: t for c, t in spec.items() if t in CONV_ERRORS}
    l1 = ", ".join([*cols, *[f"{strip(c)} AS {c}__s" for c in conv]])
    l2 = []
    for c, t in conv.items():
        s = f"{c}__s"
        if t == "int":
            l2.append(f"{int_text(s)} AS {c}__n")
        elif t == "hex_int":
            l2.append(f"{hex_text(s)} AS {c}__n")
        elif t == "float":
            l2.append(f"{_float_sql(s)} AS {c}__n")
        elif t == "bool":
            l2.append(f"CASE WHEN lower({s}) IN {in_sql(TRUTHY)} THEN TRUE WHEN lower({s}) IN {in_sql(FALSY)} "
                      f"THEN FALSE END AS {c}__n")
        else:
            l2.append(f"{_epoch_sql(s)} AS {c}__ep")
            l2.append("coalesce(" + ", ".join(_fmt_sql(s, f) for f in TIMESTAMP_FORMATS) + f") AS {c}__fm")
    l3 = []
    for c, t in conv.items():
        if t == "timestamp":
            l3.append(f"CASE WHEN {c}__ep IS NOT NULL THEN {_iso(c + '__ep')} || '+00:00' "
                      f"ELSE {_iso(c + '__fm')} END AS {c}__t")
            l3.append(f"coalesce(CAST({c}__ep AS VARCHAR), CAST({c}__fm AS VARCHAR)) AS {c}__n")
        elif t == "bool":
            l3.append(f"CASE WHEN {c}__n THEN 'True' WHEN NOT {c}__n THEN 'False' END AS {c}__t")
        else:
            l3.append(f"CAST({c}__n AS VARCHAR) AS {c}__t")
    l4 = [*cols]
    for c, t in spec.items():
        if t not in CONV_ERRORS:
            l4 += [f"{c} AS {c}__v", f"CAST(NULL AS VARCHAR) AS {c}__e"]
            continue
        s = f"{c}__s"
        failed = f"({s} <> '' AND {c}__n IS NULL)"
        shown = s if t in ("int", "hex_int", "float") else f"coalesce({c}, '')"
        l4.append(f"CASE WHEN {s} = '' OR {failed} THEN {c} ELSE {c}__t END AS {c}__v")
        l4.append(f"CASE WHEN {failed} THEN {q(CONV_ERRORS[t])} || {py_repr(shown)} END AS {c}__e")
    return f"""
    cv1 AS (SELECT {l1} FROM {src}),
    cv2 AS (SELECT *, {', '.join(l2)} FROM cv1),
    cv3 AS (SELECT *, {', '.join(l3)} FROM cv2),
    cv4 AS (SELECT {', '.join(l4)} FROM cv3)"""


RAW_COLS = ["row_index", "o_orderkey", "o_custkey", "o_address", "o_price", "o_flag", "o_time",
            "o_status", "o_note"]


def convert_one(col: str) -> str:
    return f"""
    WITH {v_raw_orders()}, {conversion_cte('ro', {col: RAW_ORDERS_SPEC[col]}, ['row_index', col])}
    SELECT row_index, {col} AS raw_value, {col}__v AS value, {col}__e AS error FROM cv4
    """


def typed_table() -> str:
    sel = ", ".join(["row_index", "o_orderkey"] + [f"{c}__v AS {c}" for c in RAW_ORDERS_SPEC])
    return f"""
    WITH {v_raw_orders()}, {conversion_cte('ro', RAW_ORDERS_SPEC, RAW_COLS)}
    SELECT {sel} FROM cv4
    """


def parse_errors() -> str:
    parts = [f"SELECT row_index, {q(c)} AS \"column\", {c} AS raw_value, {q(t)} AS expected_type, "
             f"{c}__e AS error FROM cv4 WHERE {c}__e IS NOT NULL" for c, t in RAW_ORDERS_SPEC.items()]
    return f"""
    WITH {v_raw_orders()}, {conversion_cte('ro', RAW_ORDERS_SPEC, RAW_COLS)}
    {' UNION ALL '.join(parts)}
    """


# ---------------------------------------------------------------------------
# validation
# ---------------------------------------------------------------------------

from triage.plans.derive import NET_SPEC, PROCESS_SPEC, TASKS_SPEC  # noqa: E402


def _val_views() -> str:
    return f"""{v_process()}, {v_net()}, {v_registry()},
    cnt AS (SELECT 'process' AS t, count(*) AS n FROM process_v UNION ALL SELECT 'net', count(*) FROM net_v
            UNION ALL SELECT 'raw_orders', count(*) FROM orders UNION ALL SELECT 'tasks', count(*) FROM task_v),
    man AS (SELECT t || '.csv' AS f, n FROM cnt WHERE t <> 'tasks')"""


def validate_parity() -> str:
    return f"""
    WITH {_val_views()}
    SELECT c.t || '.csv' AS "table", 'parity' AS "check",
           CASE WHEN m.n IS NULL OR m.n <> c.n THEN 'FAIL' ELSE 'PASS' END AS status,
           CASE WHEN m.n IS NULL THEN 'No manifest entry for ''' || c.t || '.csv''. typed_' || c.t || '.csv has '
                                      || CAST(c.n AS VARCHAR) || ' rows.'
                WHEN m.n = c.n THEN 'raw=' || CAST(m.n AS VARCHAR) || ', typed=' || CAST(c.n AS VARCHAR)
                ELSE 'ROW MISMATCH — raw=' || CAST(m.n AS VARCHAR) || ', typed=' || CAST(c.n AS VARCHAR) END AS detail
    FROM cnt c LEFT JOIN man m ON m.f = c.t || '.csv'
    """


def _constraint_sql(label: str, src: str, spec: dict[str, str], cols_sql: dict[str, str]) -> str:
    req = sorted(h for h, ty in spec.items() if ty not in ("raw", "string"))
    if not req:
        return (f"SELECT {q(label)} AS \"table\", 'constraint' AS \"check\", 'PASS' AS status, "
                f"'No typed (non-raw/string) columns to check.' AS detail")
    counts = ", ".join(f"count(*) FILTER (WHERE {strip(cols_sql[h])} = '') AS c{i}" for i, h in enumerate(req))
    parts = " || ".join(
        f"CASE WHEN c{i} > 0 THEN {q(h + ': ')} || CAST(c{i} AS VARCHAR) || ' null(s)' || '\x1f' ELSE '' END"
        for i, h in enumerate(req))
    anybad = " OR ".join(f"c{i} > 0" for i in range(len(req)))
    return f"""
    SELECT {q(label)} AS "table", 'constraint' AS "check",
           CASE WHEN {anybad} THEN 'FAIL' ELSE 'PASS' END AS status,
           CASE WHEN {anybad} THEN 'Null values in typed columns — ' || replace(rtrim({parts}, '\x1f'), '\x1f', '; ')
                ELSE 'All {len(req)} typed column(s) have non-null values across ' || CAST(n AS VARCHAR) || ' rows.' END AS detail
    FROM (SELECT count(*) AS n, {counts} FROM {src})"""


def validate_constraints() -> str:
    ro_cols = {c: c for c in RAW_ORDERS_SPEC}
    return f"""
    WITH {_val_views()}, {v_raw_orders()}
    {_constraint_sql('process.csv', 'process_v', PROCESS_SPEC, {'pid': 'pid', 'ppid': 'ppid'})}
    UNION ALL {_constraint_sql('net.csv', 'net_v', NET_SPEC, {'pid': 'pid', 'src-port': 'src_port', 'dst-port': 'dst_port'})}
    UNION ALL {_constraint_sql('raw_orders.csv', 'ro', RAW_ORDERS_SPEC, ro_cols)}
    UNION ALL {_constraint_sql('tasks.csv', 'task_v', TASKS_SPEC, {})}
    """


def validate_relations() -> str:
    return f"""
    WITH {_val_views()},
    pp AS (SELECT DISTINCT {strip('pid')} AS k FROM process_v WHERE {strip('pid')} <> ''),
    orph AS (SELECT DISTINCT {strip('pid')} AS k FROM net_v WHERE {strip('pid')} <> ''
             AND {strip('pid')} NOT IN (SELECT k FROM pp)),
    st AS (SELECT (SELECT count(*) FROM orph) AS n,
                  (SELECT string_agg(k, ', ' ORDER BY k) FROM (SELECT k FROM orph ORDER BY k LIMIT 20)) AS top,
                  (SELECT n FROM cnt WHERE t = 'net') AS net_rows, (SELECT n FROM cnt WHERE t = 'process') AS proc_rows)
    SELECT 'net.csv → process.csv' AS "table", 'relation' AS "check",
           CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status,
           CASE WHEN n = 0 THEN 'All PIDs in net.csv (' || CAST(net_rows AS VARCHAR) || ' rows) exist in process.csv ('
                                || CAST(proc_rows AS VARCHAR) || ' rows).'
                ELSE CAST(n AS VARCHAR) || ' orphan PID(s) in net.csv not in process.csv: ' || top
                     || CASE WHEN n > 20 THEN ' …' ELSE '' END END AS detail
    FROM st
    """


def validate_report() -> str:
    return (f"SELECT * FROM ({validate_parity()}) UNION ALL SELECT * FROM ({validate_constraints()}) "
            f"UNION ALL SELECT * FROM ({validate_relations()})")


def validate_summary() -> str:
    return f"""
    SELECT count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'FAIL') AS failed,
           count(*) AS total, CASE WHEN count(*) FILTER (WHERE status = 'FAIL') = 0 THEN 'PASS' ELSE 'FAIL' END AS overall
    FROM ({validate_report()})
    """


# ---------------------------------------------------------------------------
# enrichment + summary
# ---------------------------------------------------------------------------

def process_lineage() -> str:
    return f"""
    WITH {v_process()},
    pr AS (SELECT _row_id, {strip('pid')} AS pid, {strip('ppid')} AS ppid, {strip('name')} AS name FROM process_v),
    info AS (SELECT pid, arg_max(name, _row_id) AS name, arg_max(ppid, _row_id) AS ppid FROM pr
             WHERE pid <> '' GROUP BY pid)
    SELECT pr.pid, pr.ppid, coalesce(p.ppid, '') AS pppid, pr.name, coalesce(p.name, '') AS parent_name,
           CASE WHEN p.pid IS NOT NULL THEN coalesce(g.name, '') ELSE '' END AS grandparent_name
    FROM pr LEFT JOIN info p ON pr.ppid = p.pid LEFT JOIN info g ON p.ppid = g.pid
    """


def connection_owner() -> str:
    return f"""
    WITH {v_process()}, {v_net()}, {pid_lookup_cte()}
    SELECT n.pid, coalesce(lk.name, '') AS process_name, n.protocol, n.state, n.src_addr, n.src_port,
           n.dst_addr, n.dst_port
    FROM (SELECT {strip('pid')} AS pid, {strip('protocol')} AS protocol, {strip('state')} AS state,
                 {strip('src_addr')} AS src_addr, {strip('src_port')} AS src_port,
                 {strip('dst_addr')} AS dst_addr, {strip('dst_port')} AS dst_port FROM net_v) n
    LEFT JOIN lk ON n.pid = lk.pid
    """


def alert_summary() -> str:
    fams = [("network", alerts_network()), ("network", alerts_dns()), ("process", alerts_process()),
            ("lateral", alerts_lateral()), ("injection", alerts_injection()), ("injection", hidden_processes()),
            ("persistence", alerts_persistence())]
    u = " UNION ALL ".join(f"SELECT {q(f)} AS family, alert_type, severity FROM ({s})" for f, s in fams)
    return f"SELECT family, alert_type, severity, count(*) AS alerts FROM ({u}) GROUP BY ALL"


# ---------------------------------------------------------------------------
# CSV sources
# ---------------------------------------------------------------------------

def csv_roundtrip() -> str:
    return f"""WITH {v_process()}
    SELECT pid, ppid, name, parent_name, path, "user", cmdline FROM process_v"""


def _malformed_rows() -> str:
    return f"""
    mal AS (SELECT o_orderkey AS k, o_orderkey // {FILE_KEYS} AS f,
                   CASE WHEN o_orderkey % 5 = 0 THEN 'short' WHEN o_orderkey % 7 = 0 THEN 'long'
                        WHEN o_orderkey % 11 = 0 THEN 'first' WHEN o_orderkey % 17 = 0 THEN 'firstlong'
                        WHEN o_orderkey % 13 = 0 THEN 'multi' ELSE 'plain' END AS kind FROM orders)"""


def csv_malformed() -> str:
    return f"""WITH {_malformed_rows()}
    SELECT CASE WHEN kind IN ('first', 'firstlong') THEN '' ELSE CAST(k AS VARCHAR) END AS a,
           CASE kind WHEN 'multi' THEN 'multi' || chr(10) || 'line "q"' ELSE 'x' END AS b,
           CASE kind WHEN 'short' THEN '' ELSE 'y' END AS c
    FROM mal"""


def csv_ingest_errors() -> str:
    return f"""WITH {_malformed_rows()},
    pos AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY k) - 1 AS idx FROM mal)
    SELECT idx + 2 AS line_number,
           CASE kind WHEN 'long' THEN CAST(k AS VARCHAR) || ',x,y,"z,1"' ELSE ',x,y,' || CAST(k AS VARCHAR) END AS raw_line,
           'Extra columns: expected 3, got 4' AS error
    FROM pos WHERE kind IN ('long', 'firstlong')"""


def csv_linewise() -> str:
    # each physical line on its own: the two halves of a quoted multi-line
    # record are unparsable lines and are dropped
    return f"""WITH {_malformed_rows()}
    SELECT CASE WHEN kind IN ('first', 'firstlong') THEN '' ELSE CAST(k AS VARCHAR) END AS a, 'x' AS b,
           CASE kind WHEN 'short' THEN '' ELSE 'y' END AS c
    FROM mal WHERE kind <> 'multi'"""


def file_fingerprint() -> str:
    return f"""
    SELECT 'f=' || f AS entry, CAST(octet_length(encode(body)) AS BIGINT) AS size, sha256(body) AS sha256, md5(body) AS md5
    FROM (SELECT o_orderkey // {FILE_KEYS} AS f, string_agg(o_orderkey || ',' || o_custkey, chr(10) ORDER BY o_orderkey) || chr(10) AS body
          FROM orders GROUP BY 1)"""


def lookup_part_files() -> str:
    return "SELECT CAST(c_custkey AS VARCHAR) AS pid, 'p' || (c_custkey % 7) AS name FROM customer"


# ---------------------------------------------------------------------------
# inventory / scaffold
# ---------------------------------------------------------------------------

CASE_HEADERS = {
    "process.csv": ["pid", "ppid", "name", "parent_name", "path", "user", "cmdline"],
    "net.csv": ["pid", "protocol", "state", "src-addr", "src-port", "dst-addr", "dst-port"],
    "dup.csv": ["X", "Y", "X"],
    "empty_data.csv": ["A", "B", "C"],
    "empty.csv": [],
}


def _inventory_sql() -> str:
    rows = {
        "process.csv": ("(SELECT count(*) FROM process_v)", "0", ""),
        "net.csv": ("(SELECT count(*) FROM net_v)", "0", ""),
        "dup.csv": ("(SELECT count(*) FROM part)", "(SELECT count(*) FROM part WHERE p_partkey % 10 = 9)",
                    "duplicate_header: X"),
        "empty_data.csv": ("0", "0", "empty_data"),
        "empty.csv": ("0", "0", "empty_file"),
    }
    parts = [f"SELECT {q(f)} AS filename, {len(h)} AS header_count, {q('|'.join(h))} AS headers, "
             f"CAST({rows[f][0]} AS BIGINT) AS row_count, CAST({rows[f][1]} AS BIGINT) AS ingest_errors, "
             f"{q(rows[f][2])} AS anomalies" for f, h in CASE_HEADERS.items()]
    return f"WITH {v_process()}, {v_net()} " + " UNION ALL ".join(parts)


def inventory() -> str:
    return _inventory_sql()


def anomaly_summary() -> str:
    return ("SELECT CAST(5 AS BIGINT) AS total_files, 'dup.csv' AS duplicate_headers, "
            "'empty.csv, empty_data.csv' AS empty_files, '' AS locked_files, '' AS read_errors "
            f"FROM (SELECT count(*) FROM ({_inventory_sql()}))")


def _yaml_spec(filename: str, headers: list[str]) -> str:
    from triage.operators.profile import YAML_SPECIAL
    lines = [f"table: {filename}", "columns:"]
    if headers:
        for h in headers:
            name = f'"{h}"' if any(ch in h for ch in YAML_SPECIAL) else h
            lines.append(f'  {name}: {{ type: "raw" }}  # To be filled later')
    else:
        lines.append("  {}  # No headers detected")
    lines += ["validations: []", ""]
    return "\n".join(lines)


def scaffold() -> str:
    parts = []
    for f, h in CASE_HEADERS.items():
        table = f.rsplit(".", 1)[0]
        if not h:
            action, spec = "skipped_no_headers", "NULL"
        elif table == "process":
            action, spec = "skipped", "NULL"
        else:
            action, spec = "created", q(_yaml_spec(f, h))
        parts.append(f"SELECT {q(table)} AS \"table\", {q(action)} AS action, CAST({spec} AS VARCHAR) AS spec")
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE (SELECT count(*) FROM part) >= 0"


# ---------------------------------------------------------------------------
# enrichment, text sources, timeline
# ---------------------------------------------------------------------------

def _doc_stats() -> str:
    return """
    dd AS (SELECT doc_id, lang, text FROM documents),
    byt AS (SELECT doc_id, unnest(regexp_extract_all(hex(text), '..')) AS b FROM dd),
    bc AS (SELECT doc_id, b, count(*) AS n FROM byt GROUP BY ALL),
    bt AS (SELECT doc_id, sum(n) AS total FROM bc GROUP BY doc_id),
    ent AS (SELECT bc.doc_id, round(-sum((n / total) * log2(n / total)), 6) AS e FROM bc JOIN bt USING (doc_id)
            GROUP BY bc.doc_id),
    ds AS (SELECT dd.doc_id, dd.lang, printf('%.6f', coalesce(ent.e, 0.0)) AS entropy, md5(text) AS md5,
                  sha256(text) AS sha256, CAST(octet_length(encode(text)) AS VARCHAR) AS file_size
           FROM dd LEFT JOIN ent USING (doc_id))"""


def file_entropy() -> str:
    return f"WITH {_doc_stats()} SELECT doc_id, entropy, md5, sha256, file_size FROM ds"


def _resolution() -> str:
    rel = ("CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) || '.txt' "
           "ELSE lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' END")
    path = (f"CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 3 = 0 THEN '/forensic/0.txt' "
            f"WHEN doc_id % 5 = 0 THEN '/forensic/' || {rel} WHEN doc_id % 5 = 1 THEN {rel} "
            f"WHEN doc_id % 5 = 2 THEN 'C:/' || {rel} "
            f"WHEN doc_id % 5 = 3 THEN '/elsewhere/dir/' || CAST(doc_id AS VARCHAR) || '.txt' "
            f"ELSE 'missing/' || CAST(doc_id AS VARCHAR) || '.bin' END")
    return f"""{_doc_stats()},
    store AS (SELECT '/forensic/' || {rel} AS path, entropy, md5, sha256, file_size FROM ds),
    fl AS (SELECT {path} AS file_path, 'F' || CAST(doc_id AS VARCHAR) AS file_id FROM documents),
    fk AS (SELECT *, file_path AS k1, '/forensic/' || file_path AS k2,
                  '/forensic/' || (CASE WHEN substr(ltrim(file_path, '/'), 2, 1) = ':'
                                        THEN ltrim(substr(ltrim(file_path, '/'), 3), '/')
                                        ELSE ltrim(file_path, '/') END) AS k3,
                  '/forensic/' || regexp_extract(file_path, '([^/\\\\]*)$', 1) AS k4 FROM fl),
    res AS (SELECT fk.file_path, fk.file_id,
                   CASE WHEN fk.file_path = '' THEN NULL
                        ELSE coalesce(s1.path, s2.path, s3.path, s4.path) END AS hit
            FROM fk LEFT JOIN store s1 ON s1.path = fk.k1 LEFT JOIN store s2 ON s2.path = fk.k2
                    LEFT JOIN store s3 ON s3.path = fk.k3 LEFT JOIN store s4 ON s4.path = fk.k4),
    out AS (SELECT res.file_path, res.file_id, coalesce(s.entropy, '') AS entropy, coalesce(s.md5, '') AS md5,
                   coalesce(s.sha256, '') AS sha256, coalesce(s.file_size, '') AS file_size,
                   CASE WHEN s.path IS NULL THEN 'not_found' ELSE 'ok' END AS status
            FROM res LEFT JOIN store s ON s.path = res.hit)"""


def path_resolution() -> str:
    return f"WITH {_resolution()} SELECT * FROM out"


def path_resolution_ids() -> str:
    return f"""WITH {_resolution()}
    SELECT out.file_path, source || ':' || n_chars AS file_id, entropy, md5, sha256, file_size, status
    FROM out JOIN documents ON out.file_id = 'F' || doc_id"""


def enrichment_status() -> str:
    return f"""WITH {_resolution()}
    SELECT count(*) AS processed, count(*) FILTER (WHERE status = 'ok') AS found,
           count(*) FILTER (WHERE status <> 'ok') AS not_found,
           CASE WHEN count(*) FILTER (WHERE status <> 'ok') > 0 THEN 'partial' ELSE 'ok' END AS status FROM out"""


def netstat_parse() -> str:
    k = "o_orderkey"
    return f"""
    WITH {v_process()}, {pid_lookup_cte()},
    nl AS (SELECT {k} % 11 AS m, {pick(X.PROTOCOLS, k)} AS proto, {pick(X.NETSTAT_LOCAL, k)} AS loc,
                  {pick(X.NETSTAT_REMOTE, f'{k} // 3')} AS rem, {pick(X.NETSTAT_STATES, f'{k} // 5')} AS st,
                  CASE WHEN {k} % 4 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS pid FROM orders),
    r AS (SELECT pid, proto, st,
                 CASE WHEN contains(loc, ':') THEN regexp_extract(loc, '^(.*):[^:]*$', 1) ELSE loc END AS sa,
                 CASE WHEN contains(loc, ':') THEN regexp_extract(loc, ':([^:]*)$', 1) ELSE '' END AS sp,
                 CASE WHEN contains(rem, ':') THEN regexp_extract(rem, '^(.*):[^:]*$', 1) ELSE rem END AS da,
                 CASE WHEN contains(rem, ':') THEN regexp_extract(rem, ':([^:]*)$', 1) ELSE '' END AS dp
          FROM nl WHERE m >= 4)
    SELECT r.pid, coalesce(lk.name, '') AS process_name, proto AS protocol, st AS state, sa AS "src-addr",
           sp AS "src-port", da AS "dst-addr", dp AS "dst-port"
    FROM r LEFT JOIN lk ON r.pid = lk.pid
    """


def flagged_ids() -> str:
    return f"""
    WITH {v_process()},
    ev AS (SELECT event_id % 6 AS m, CAST(user_id AS VARCHAR) AS u FROM events)
    SELECT DISTINCT pid FROM (
      SELECT u AS pid FROM ev WHERE m IN (0, 2)
      UNION ALL SELECT '77' FROM ev WHERE m = 4
      UNION ALL SELECT {strip('pid')} FROM process_v WHERE lower({strip('name')}) = 'lsass.exe'
                                                    AND regexp_full_match({strip('pid')}, '[0-9]+'))
    """


def timeline_union() -> str:
    return """
    SELECT 'timeline_' || event_type || '.csv' AS source, count(*) AS "rows" FROM events GROUP BY 1
    UNION ALL SELECT 'timeline_all.csv', count(*) FROM events
    """


# ---------------------------------------------------------------------------
# rule files, encodings, sinks
# ---------------------------------------------------------------------------

def alerts_network_rules() -> str:
    from triage import ruleset
    from triage.plans.evidence import CHANGED_RULES
    with ruleset.using(CHANGED_RULES):
        return alerts_network()


def encoding_fallback() -> str:
    return "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, 'naïve é ' || c_custkey AS name FROM customer"


def manifest_load() -> str:
    return f"SELECT filename, row_count FROM ({_inventory_sql()})"


def error_sink() -> str:
    return f"""SELECT source_file, "column", expected_type, count(*) AS errors
    FROM ({parse_errors()}), (SELECT unnest(['a.csv', 'b.csv']) AS source_file) GROUP BY ALL"""


def alerts_written_order() -> str:
    return alerts_dns(", row_number() OVER (ORDER BY _row_id) AS place")


def recovered_artifacts() -> str:
    from triage.plans.evidence import RECOVERED_ENDINGS
    ending = f"[{', '.join(map(q, RECOVERED_ENDINGS))}][CAST(doc_id % {len(RECOVERED_ENDINGS)} AS INTEGER) + 1]"
    return f"""WITH {_doc_stats()}, r AS (SELECT '/recovered/' || doc_id || {ending} AS path, entropy, md5, sha256, file_size FROM ds)
    SELECT * FROM r WHERE right(lower(path), 4) IN ('.exe', '.dll', '.ps1', '.bat', '.sys')"""


def orphan_pids() -> str:
    return f"""WITH {v_process()}, {v_net()}
    SELECT pid, count(*) AS "rows" FROM (SELECT {strip('pid')} AS pid FROM net_v)
    WHERE pid <> '' AND pid NOT IN (SELECT {strip('pid')} FROM process_v) GROUP BY pid"""


# ---------------------------------------------------------------------------
# faults, join-back, lossy text, counters
# ---------------------------------------------------------------------------

def inventory_faults() -> str:
    from triage.operators.profile import LOCKED, UNREADABLE
    faults = " UNION ALL ".join(f"SELECT {q(f)}, 0, '', 0, 0, {q('read_error: ' + why)}" for f, why in (("locked.csv", LOCKED), ("vanished.csv", UNREADABLE)))
    return f"SELECT * FROM ({_inventory_sql()}) UNION ALL {faults}"


def entropy_join_back() -> str:
    cols = "entropy", "md5", "sha256", "file_size"
    return f"""WITH {_resolution()},
    s AS (SELECT DISTINCT file_path, {', '.join(cols)} FROM out WHERE status = 'ok')
    SELECT fl.file_path, fl.file_id, {', '.join(f"coalesce(s.{c}, '') AS {c}" for c in cols)} FROM fl LEFT JOIN s ON s.file_path = fl.file_path"""


def lossy_decode() -> str:
    return "SELECT doc_id, left(text, 5) || CASE WHEN doc_id % 4 = 3 THEN '' ELSE chr(65533) END || substr(text, 6) AS text FROM documents"


def injection_counters() -> str:
    return f"""WITH {v_memory()}, {_mem_resolved()}
    SELECT {q(R.MEMORY_SOURCES["findevil"])} AS source_table, count(*) AS rows, count(*) FILTER (rwx) AS rwx_rows,
           count(*) FILTER (rwx AND (unb OR (CASE WHEN tl <> '' THEN contains(tl, 'private') ELSE TRUE END))) AS rwx_alerts FROM mm"""
