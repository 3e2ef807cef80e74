"""PIPE-01 end to end on a small case directory."""

import os

from triage.plans import pipeline as PL

from helpers import tmpdir, write


def test_pipeline_end_to_end(spark):
    case = tmpdir()
    write(case, "process.csv", "pid,ppid,name,path,user,cmdline\n"
                               "4,0,System,,NT AUTHORITY\\SYSTEM,\n"
                               "100,4,svchost.exe,C:\\Users\\x\\svchost.exe,NT AUTHORITY\\SYSTEM,\n"
                               "200,100,cmd.exe,,bob,whoami /all\n")
    write(case, "net.csv", "pid,state,src-addr,src-port,dst-addr,dst-port\n"
                           "100,ESTABLISHED,10.0.0.5,5000,8.8.8.8,443\n999,LISTENING,0.0.0.0,4444,,\n")
    write(case, "empty.csv", "")
    out = os.path.join(tmpdir(), "out")
    res = PL.run(spark, case, out, {"process": {"pid": "int", "ppid": "int"}})
    st = {(r.table, r.stage): r.status for r in res["status"].collect()}
    assert st[("process", "parse")] == PL.STATUS_OK and st[("empty", "parse")] == PL.STATUS_WARN
    val = {(r.table, r.check): r.status for r in res["validation"].collect()}
    assert val[("process.csv", "parity")] == "PASS" and val[("net.csv → process.csv", "relation")] == "FAIL"
    alerts = {(r.family, r.alert_type) for r in res["alert_counts"].collect()}
    assert ("network", "PROCESS_PORT_MISMATCH") in alerts and ("network", "LISTENER_TRAP") in alerts
    assert ("process", "PATH_MASQUERADE") in alerts and ("lateral", "RECON_COMMANDS") in alerts
    assert res["worst_status"].first().worst == PL.STATUS_WARN
    assert PL.ingest_summary(res["status"]).first().ok == 2


def test_inventory_is_taken_once(spark):
    """What the pipeline gives does not read the case again: a table that is gone since stays in it."""
    case = tmpdir()
    for name in ("process", "other"):
        write(case, f"{name}.csv", "pid,name\n4,System\n5,a,b,c\n6\n")
    res = PL.run(spark, case, os.path.join(tmpdir(), "out"), {"process": {"pid": "int"}})
    write(case, "other.csv", "x\n")
    got = {r.filename: (r.headers, r.row_count, r.ingest_errors, r.anomalies) for r in res["inventory"].collect()}
    assert got == {f"{name}.csv": (["pid", "name"], 3, 1, []) for name in ("process", "other")}
