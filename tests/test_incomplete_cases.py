"""Cases that lack tables or columns, read through the CSV source, and the
library without its optional parts."""

import os
import shutil
import subprocess
import sys

import pytest

from triage.operators import alerts as AL
from triage.operators import detect_injection as DI
from triage.operators import detect_persistence as DS
from triage.plans import pipeline as PL
from triage.sources.csv import read_csv_lossless

from helpers import tmpdir, write

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = {
    "process": "pid,ppid,name,path,user,cmdline\n4,0,System,,SYSTEM,\n100,4,svchost.exe,C:\\Users\\x\\svchost.exe,SYSTEM,\n",
    "findevil": "pid,process,address,size,protection,file,type\n100,svchost.exe,0x1000,16,PAGE_EXECUTE_READWRITE,,Private\n777,ghost.exe,0x2000,16,r,,x\n",
    "services": "service_name,binary_path\nevil,cmd.exe /c x\n",
    "registry": "path,name,data\nHKLM\\Software\\Microsoft\\Windows\\CurrentVersion\\Run,a,C:\\Users\\Public\\a.exe\n",
    "tasks": "task_name,action\nt,powershell -enc AAAA\n",
    "net": "pid,state,src-addr,src-port,dst-addr,dst-port\n100,ESTABLISHED,10.0.0.5,5000,8.8.8.8,443\n",
    "dns": "pid,process,query\n100,svchost.exe,example.com\n",
}


def case(names, **changed):
    folder = tmpdir()
    for n in names:
        write(folder, f"{n}.csv", changed.get(n, TABLES[n]))
    return folder


def found(res):
    return {(r.family, r.alert_type) for r in res["alert_counts"].collect()} if res["alert_counts"] is not None else set()


@pytest.mark.parametrize("missing", ["process", "findevil", "registry", "net"])
def test_a_case_without_one_table(spark, missing):
    out = os.path.join(tmpdir(), "out")
    got = found(PL.run(spark, case([t for t in TABLES if t != missing]), out))
    assert (("injection", "RWX_UNBACKED") in got) == (missing != "findevil")
    assert (("injection", "DKOM_HIDDEN_PROCESS") in got) == (missing not in ("findevil", "process"))
    assert (("persistence", "SUSPICIOUS_RUN_KEY") in got) == (missing != "registry")
    assert ("persistence", "SERVICE_MASQUERADE") in got
    assert (("process", "PATH_MASQUERADE") in got) == (missing != "process")
    if missing != "findevil":
        rows = spark.read.parquet(f"{out}/alerts_injection").collect()
        assert {r.source_table for r in rows} == {"typed_findevil.csv"}


@pytest.mark.parametrize("table,header", [("registry", "x,name,data"), ("services", "service_name,y"), ("tasks", "task_name,z"),
                                          ("process", "nopid,ppid,name,path,user,cmdline"), ("findevil", "nopid,process,address,size,protection,file,type"),
                                          ("findevil", "pid,process,address,size,nothing,file,type"), ("net", "nopid,a,b,c,d,e"), ("dns", "a,b,c")])
def test_a_table_without_its_column(spark, table, header):
    body = TABLES[table].split("\n", 1)[1]
    PL.run(spark, case({table, "process", "services"}, **{table: f"{header}\n{body}"}), os.path.join(tmpdir(), "out"))


def test_families_over_csv_tables(spark):
    folder = case(TABLES, registry="x,y\n1,2\n")
    t = {n: read_csv_lossless(spark, f"{folder}/{n}.csv", name=n).table for n in TABLES}
    inj = AL.public(DI.injection_alerts(spark, t["findevil"], None, "typed_findevil.csv"), "injection").collect()
    assert {r.alert_type for r in inj} == {"RWX_UNBACKED"}
    hidden = AL.public(DI.injection_alerts(spark, t["findevil"], t["process"], "typed_findevil.csv"), "injection").collect()
    assert [r.description for r in hidden if r.alert_type == "DKOM_HIDDEN_PROCESS" and "typed_findevil.csv" in r.description]
    per = AL.public(DS.persistence_alerts(spark, t["registry"], t["services"], t["tasks"]), "persistence").collect()
    assert {r.alert_type for r in per} == {"SERVICE_MASQUERADE", "HIDDEN_SCHEDULED_TASK"}


@pytest.mark.parametrize("gone", [["triage/llm", "tests/llm"], ["triage/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
@pytest.mark.parametrize("leave_folder", [False, True])
def test_entry_without_optional_parts(gone, leave_folder):
    copy = os.path.join(tmpdir(), "repo")
    drop = {os.path.join(HERE, g) for g in gone}
    shutil.copytree(HERE, copy, ignore=lambda d, names: [n for n in names if n in (".git", "__pycache__") or os.path.join(d, n) in drop])
    if leave_folder and "triage/llm" in gone:
        os.makedirs(os.path.join(copy, "triage/llm/__pycache__"))
    code = "import __spark_entry__ as E; q = E.queries(); s = E.oracle_sql(); print(len(q), 'pipeline' in q, any(k.startswith('op') and k[2].isdigit() for k in q), 'alerts_network' in s)"
    got = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr
    here = os.path.isdir(os.path.join(HERE, "triage/llm")) and "triage/llm" not in gone
    assert got.stdout.split()[1:] == ["False", str(here), "True"]
