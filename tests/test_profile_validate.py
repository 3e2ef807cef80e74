"""Inventory / anomalies / scaffold, validation checks, entropy and path resolution."""

import math

from pyspark.sql import functions as F

from triage.operators import enrich as E
from triage.operators import profile as P
from triage.operators import validate as V

from helpers import table, tmpdir, write


def test_inventory_anomalies(spark):
    d = tmpdir()
    write(d, "good.csv", "A,B\n1,2\n3,4\n")
    write(d, "empty.csv", "")
    write(d, "header_only.csv", "A,B,C\n")
    write(d, "dup.csv", "X,Y,X\n1,2,3\n")
    write(d, "notes.txt", "hello\n")
    write(d, "typed_good.csv", "A,B\n1,2\n")
    inv = {r.filename: r for r in P.inventory(spark, d).collect()}
    assert set(inv) == {"good.csv", "empty.csv", "header_only.csv", "dup.csv"}
    assert inv["good.csv"].row_count == 2 and inv["good.csv"].anomalies == []
    assert inv["empty.csv"].anomalies == ["empty_file"] and inv["empty.csv"].headers == []
    assert inv["header_only.csv"].anomalies == ["empty_data"]
    assert inv["dup.csv"].anomalies == ["duplicate_header: X"]
    summ = P.anomaly_summary(P.inventory(spark, d)).first()
    assert summ.duplicate_headers == ["dup.csv"] and summ.empty_files == ["empty.csv", "header_only.csv"]
    sc = {r.table: r for r in P.scaffold(P.inventory(spark, d), ["good"]).collect()}
    assert sc["good"].action == "skipped" and sc["empty"].action == "skipped_no_headers"
    assert sc["dup"].spec.startswith("table: dup.csv\ncolumns:\n  X: { type: \"raw\" }")


def test_yaml_quoting(spark):
    df = spark.createDataFrame([("has:colon",), ("plain",)], "h string")
    got = [r.n for r in df.select(P.yaml_name(F.col("h")).alias("n")).collect()]
    assert got == ['"has:colon"', "plain"]


def test_parity(spark):
    manifest = spark.createDataFrame([("a.csv", 3), ("b.csv", 5)], "filename string, row_count long")
    typed = {"a": spark.range(3).toDF("x"), "b": spark.range(2).toDF("x"), "c": spark.range(1).toDF("x")}
    res = {r.table: (r.status, r.detail) for r in V.check_parity(spark, manifest, typed).collect()}
    assert res["a.csv"] == ("PASS", "raw=3, typed=3")
    assert res["b.csv"] == ("FAIL", "ROW MISMATCH — raw=5, typed=2")
    assert res["c.csv"][0] == "FAIL" and res["c.csv"][1].startswith("No manifest entry for 'c.csv'.")


def test_constraints(spark):
    t = table(spark, ["pid", "name"], [["", "explorer.exe"], ["4", "System"]])
    res = V.check_constraints(spark, {"process": t}, {"process": {"pid": "int", "name": "string"}}).first()
    assert res.status == "FAIL" and res.detail == "Null values in typed columns — pid: 1 null(s)"


def test_relations(spark):
    proc = table(spark, ["pid", "name"], [["1", "a"], ["2", "b"]])
    net = table(spark, ["pid", "port"], [["1", "80"], ["999", "443"], ["", "1"]])
    r = V.check_relations(spark, proc, net).first()
    assert r.status == "FAIL" and r.detail == "1 orphan PID(s) in net.csv not in process.csv: 999"
    assert V.check_relations(spark, proc, table(spark, ["PID"], [["1"]])).count() == 0


def test_entropy_values(spark):
    data = [(0, b""), (1, b"aaaa"), (2, b"abab"), (3, bytes(range(256)))]
    df = spark.createDataFrame(data, "k long, content binary")
    got = {r.k: r.e for r in df.select("k", E.byte_entropy(F.col("content")).alias("e")).collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 1.0, 3: 8.0}


def test_path_resolution_priority(spark):
    store = spark.createDataFrame([("/f/docs/a.txt", b"AB"), ("/f/b.txt", b"BBBB"), ("/f/c.txt", b"C")],
                                  "path string, content binary")
    stats = E.content_stats(store)
    files = spark.createDataFrame([("/f/docs/a.txt", "1"), ("docs/a.txt", "2"), ("C:/b.txt", "3"),
                                   ("/x/y/c.txt", "4"), ("missing.bin", "5"), ("", "6")],
                                  "file_path string, file_id string")
    out = {r.file_id: (r.status, r.file_size) for r in E.enrich_files(files, stats, "/f").collect()}
    assert out == {"1": ("ok", "2"), "2": ("ok", "2"), "3": ("ok", "4"), "4": ("ok", "1"),
                   "5": ("not_found", ""), "6": ("not_found", "")}


def test_spec_roundtrip_from_scaffold(spark):
    from triage.sources.specs import load_spec_text
    d = tmpdir()
    write(d, "weird.csv", 'pid,"has:colon",name\n1,2,3\n')
    spec = P.scaffold(P.inventory(spark, d), []).first().spec
    table_name, cols = load_spec_text(spec)
    assert table_name == "weird.csv" and cols == {"pid": "raw", "has:colon": "raw", "name": "raw"}
    counts = {r.action: r.tables for r in P.scaffold_counts(P.scaffold(P.inventory(spark, d), [])).collect()}
    assert counts == {"created": 1}


def test_report_markdown(spark):
    res = spark.createDataFrame([("a.csv", "parity", "PASS", "raw=1, typed=1"),
                                 ("b.csv", "constraint", "FAIL", "x|y")], "table string, check string, status string, detail string")
    md = V.report_markdown(res)
    assert "**Overall: FAIL** (1 passed, 1 failed)" in md and "x\\|y" in md


def test_file_table_column_resolution(spark):
    from helpers import table
    store = spark.createDataFrame([("/f/a.txt", b"A")], "path string, content binary")
    stats = E.content_stats(store)
    t = table(spark, ["Path", "x", "PATH", "ID"], [["nope", "", "a.txt", "7"]])
    r = E.enrich_file_table(t, stats, "/f").first()
    assert (r.file_path, r.file_id, r.status) == ("a.txt", "7", "ok")          # last 'path' wins
    t2 = table(spark, ["weird"], [["/f/a.txt"]])
    assert E.enrich_file_table(t2, stats, "/f").first().status == "ok"        # first-column fallback
