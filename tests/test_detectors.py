"""Detector behaviour on small inline tables (one rule at a time)."""

from triage.operators import alerts as AL
from triage.operators import detect_injection as DI
from triage.operators import detect_lateral as DL
from triage.operators import detect_network as DN
from triage.operators import detect_persistence as DS
from triage.operators import detect_process as DP

from helpers import table


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_network_rules(spark):
    proc = table(spark, ["PID", "Name"], [["10", "evil.exe"], ["20", "chrome.exe"], ["10", "svchost.exe"]])
    net = table(spark, ["pid", "State", "src-addr", "src-port", "dst-addr", "dst-port"], [
        ["10", "ESTABLISHED", "10.0.0.5", "49708", "40.67.254.36", "443"],   # non-browser on 443
        ["20", "ESTABLISHED", "10.0.0.5", "49709", "40.67.254.36", "443"],   # browser: fine
        ["30", "LISTENING", "0.0.0.0", "", "0.0.0.0", "4444"],              # unknown listener
        ["20", "ESTABLISHED", "10.0.0.5", "1", "8.8.8.8", "1f90"],           # hex 8080, external
        ["20", "ESTABLISHED", "10.0.0.5", "1", "10.1.1.1", "8080"],          # private
        ["20", "ESTABLISHED", "10.0.0.5", "1", "2001:4860::8888", "9999"],   # external v6
    ])
    out = AL.public(DN.network_alerts(spark, net, proc), "network")
    got = rows(out, "alert_type", "pid", "process_name", "dst_port")
    assert ("PROCESS_PORT_MISMATCH", "10", "svchost.exe", "443") in got        # last row wins
    assert ("LISTENER_TRAP", "30", "<unknown>", "4444") in got
    assert ("HIGH_PORT_EXTERNAL", "20", "chrome.exe", "1f90") in got
    assert ("HIGH_PORT_EXTERNAL", "20", "chrome.exe", "9999") in got
    assert not any(a == "HIGH_PORT_EXTERNAL" and p == "8080" for a, _, _, p in got)
    desc = [r.description for r in out.collect() if r.alert_type == "HIGH_PORT_EXTERNAL" and r.dst_port == "1f90"]
    assert "on high port 8080." in desc[0]


def test_network_without_pid_column_is_empty(spark):
    net = table(spark, ["state"], [["LISTENING"]])
    assert DN.network_alerts(spark, net, None).count() == 0


def test_dns_prefers_own_name(spark):
    proc = table(spark, ["pid", "name"], [["7", "powershell.exe"]])
    dns = table(spark, ["pid", "process", "query"], [["7", "", "evil.example"], ["7", "chrome.exe", "x.example"],
                                                     ["", "", "y.example"]])
    out = AL.public(DN.dns_alerts(spark, dns, proc), "network")
    assert rows(out, "process_name", "dst_addr", "protocol") == [("powershell.exe", "evil.example", "DNS")]


def test_process_rules(spark):
    proc = table(spark, ["pid", "ppid", "name", "path", "user", "parent_name"], [
        ["1", "0", "svchost.exe", "C:\\Users\\x\\svchost.exe", "NT AUTHORITY\\SYSTEM", ""],
        ["2", "5", "cmd.exe", "", "", "WINWORD.EXE"],
        ["3", "9", "svch0st.exe", "", "", ""],
        ["4", "9", "scvhost.exe", "", "", ""],
        ["5", "9", "lsass.exe", "c:\\windows\\system32\\lsass.exe", "DESKTOP\\bob", "explorer.exe"],
    ])
    out = AL.public(DP.process_alerts(spark, proc), "process")
    got = rows(out, "alert_type", "pid")
    assert ("PATH_MASQUERADE", "1") in got
    assert ("PARENT_CHILD_MISMATCH", "2") in got
    assert ("TYPOSQUATTING", "3") in got
    assert ("TYPOSQUATTING", "4") not in got          # distance 2
    assert ("SID_MISMATCH", "5") in got
    assert ("PARENT_CHILD_MISMATCH", "5") in got
    d = [r.description for r in out.collect() if r.pid == "5" and r.alert_type == "PARENT_CHILD_MISMATCH"][0]
    assert d.endswith("expected ['wininit.exe'].")


def test_parent_name_from_ppid_lookup(spark):
    proc = table(spark, ["pid", "ppid", "name"], [["100", "4", "svchost.exe"], ["4", "0", "explorer.exe"]])
    out = AL.public(DP.process_alerts(spark, proc), "process")
    assert rows(out, "alert_type", "parent_name") == [("PARENT_CHILD_MISMATCH", "explorer.exe")]


def test_lateral_escalation(spark):
    proc = table(spark, ["pid", "ppid", "name", "cmdline", "parent_name"], [
        ["11", "10", "cmd.exe", "whoami /all", ""],
        ["12", "10", "cmd.exe", "net user bob", ""],
        ["13", "10", "cmd.exe", "ipconfig /all", ""],
        ["21", "20", "cmd.exe", "whoami", ""],
        ["31", "30", "powershell.exe", "Invoke-Mimikatz -DumpCreds", "wmiprvse.exe"],
    ])
    out = AL.public(DL.lateral_alerts(spark, proc), "lateral")
    sev = {r.pid: r.severity for r in out.collect() if r.alert_type == "RECON_COMMANDS"}
    assert sev == {"11": "HIGH", "12": "HIGH", "13": "HIGH", "21": "LOW"}
    got = rows(out, "alert_type", "pid")
    assert ("CREDENTIAL_DUMP", "31") in got and ("REMOTE_EXECUTION", "31") in got
    d = [r.description for r in out.collect() if r.alert_type == "CREDENTIAL_DUMP"][0]
    assert d.endswith("matches 'mimikatz'.")


def test_injection_rules_and_dkom(spark):
    mem = table(spark, ["pid", "process", "address", "protection", "file", "type"], [
        ["8", "evil.exe", "0x1000", "PAGE_EXECUTE_READWRITE", "", "Private"],
        ["9", "svchost.exe", "0x2000", "r-x", "C:\\Temp\\svchost.exe", "Image"],
        ["9", "svchost.exe", "0x3000", "r-x", "c:\\windows\\system32\\svchost.exe", "Image"],
        ["77", "", "0x4000", "r--", "", "MZ"],
        ["77", "x", "0x5000", "r--", "", ""],
        ["04", "", "0x6000", "", "n/a", "Mapped"],
        ["4", "", "0x7000", "", "n/a", "Mapped"],
    ])
    proc = table(spark, ["pid", "name"], [["8", "evil.exe"], ["9", "svchost.exe"], ["4", "System"]])
    out = AL.public(DI.injection_alerts(spark, mem, proc, "findevil"), "injection")
    got = rows(out, "alert_type", "pid", "address")
    assert ("RWX_UNBACKED", "8", "0x1000") in got
    assert ("PROCESS_HOLLOWING", "9", "0x2000") in got
    assert ("PROCESS_HOLLOWING", "9", "0x3000") not in got
    assert ("REFLECTIVE_DLL", "77", "0x4000") in got
    assert ("DKOM_HIDDEN_PROCESS", "77", "0x4000") in got     # first row of the PID
    assert ("DKOM_HIDDEN_PROCESS", "04", "0x6000") in got     # text comparison
    assert not any(a == "DKOM_HIDDEN_PROCESS" and p == "4" for a, p, _ in got)


def test_persistence_rules(spark):
    reg = table(spark, ["key", "value_name", "data"], [
        ["HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\Run", "upd", "C:\\Users\\b\\AppData\\u.exe"],
        ["HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\Run", "ok", "C:\\Program Files\\a.exe"],
    ])
    svc = table(spark, ["service_name", "binary_path"], [["evil", "cmd.exe /c x"], ["good", "C:\\a.exe"]])
    tasks = table(spark, ["task_name", "action"], [["t1", "powershell -w hidden -enc AAA"], ["t2", "notepad"]])
    out = AL.public(DS.persistence_alerts(spark, reg, svc, tasks), "persistence")
    got = rows(out, "alert_type", "key_or_name")
    assert got == [("HIDDEN_SCHEDULED_TASK", "t1"), ("SERVICE_MASQUERADE", "evil"),
                   ("SUSPICIOUS_RUN_KEY", "HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\Run :: upd")]
