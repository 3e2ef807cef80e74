"""Lossless CSV ingest, encodings, fingerprints, text sources, sinks."""

import hashlib
import os

from pyspark.sql import functions as F

from triage.sources import csv as C
from triage.sources import files as FS
from triage.sources import sinks as K
from triage.sources import text as TX

from helpers import tmpdir, write


def cells(r):
    t = r.table
    return sorted(tuple(row[c] for c in t.columns) for row in t.df.collect())


def test_well_formed_roundtrip(spark):
    d = tmpdir()
    p = write(d, "a.csv", "Name,Age,City\nAlice,30,Zürich\nBob,25,\"New York, NY\"\n")
    r = C.read_csv_lossless(spark, p)
    assert r.table.headers == ["Name", "Age", "City"]
    assert cells(r) == [("Alice", "30", "Zürich"), ("Bob", "25", "New York, NY")]
    out = K.write_quoted_csv(r.table, os.path.join(d, "out"))
    back = C.read_csv_lossless(spark, out + "/*.csv")
    assert cells(back) == cells(r)
    text = open([os.path.join(out, f) for f in os.listdir(out) if f.endswith(".csv")][0]).read()
    assert text.startswith('"Name","Age","City"')


def test_short_row_padded_long_row_truncated(spark):
    d = tmpdir()
    p = write(d, "s.csv", "A,B,C\n1,2\n4,5,6\n7,8,9,EXTRA\n")
    r = C.read_csv_lossless(spark, p)
    assert cells(r) == [("1", "2", ""), ("4", "5", "6"), ("7", "8", "9")]
    errs = r.errors.collect()
    assert len(errs) == 1 and errs[0].line_number == 4
    assert errs[0].error == "Extra columns: expected 3, got 4"
    assert errs[0].raw_line == "7,8,9,EXTRA"


def test_blank_lines_skipped_and_quoted_newline_kept(spark):
    d = tmpdir()
    p = write(d, "b.csv", 'Name,Bio\n\nAlice,"Line1\nLine2"\n\n\nBob,x\n')
    r = C.read_csv_lossless(spark, p)
    assert cells(r) == [("Alice", "Line1\nLine2"), ("Bob", "x")]


def test_duplicate_headers_kept(spark):
    d = tmpdir()
    p = write(d, "d.csv", "X,Y,X\n1,2,3\n")
    r = C.read_csv_lossless(spark, p)
    assert r.table.headers == ["X", "Y", "X"] and cells(r) == [("1", "2", "3")]


def test_encodings(spark):
    d = tmpdir()
    write(d, "u.csv", "\ufeffName\nCafé\n")
    write(d, "l.csv", "Name\nM\xfcnchen\n".encode("latin-1"), mode="wb")
    enc = {os.path.basename(r.path): r.encoding for r in FS.detect_encoding(spark, d).collect()}
    assert enc == {"u.csv": "UTF-8", "l.csv": "ISO-8859-1"}
    r = FS.read_csv_any_encoding(spark, d)
    assert r.table.headers == ["Name"]
    assert sorted(x[r.table.columns[0]] for x in r.table.df.collect()) == ["Café", "München"]


def test_linewise_reader(spark):
    d = tmpdir()
    p = write(d, "w.csv", 'A,B\n1,2\n\n"bad\n3,4,5\n')
    r = C.read_csv_linewise(spark, p)
    assert cells(r) == [("1", "2"), ("3", "4")]
    errs = sorted((e.line_number, e.error) for e in r.errors.collect())
    assert errs == [(4, "unparsable CSV line"), (5, "Extra columns: expected 2, got 3")]


def test_netstat_text(spark):
    lines = spark.createDataFrame([(x,) for x in [
        "Proto Local Foreign State PID", "# comment", "", "TCP 10.0.0.5:49708 40.67.254.36:443 ESTABLISHED 4528",
        "TCP [::]:445 [::]:0 LISTENING", "UDP 1.2.3.4:53"]], "value string")
    got = [tuple(r) for r in TX.parse_netstat(lines).collect()]
    assert ("4528", "TCP", "ESTABLISHED", "10.0.0.5", "49708", "40.67.254.36", "443") in got
    assert ("", "TCP", "LISTENING", "[::]", "445", "[::]", "0") in got
    assert len(got) == 2


def test_flagged_ids(spark):
    lines = spark.createDataFrame([(x,) for x in [
        "CRITICAL | 4321 | injected", "info 99", "high,proc7,88,x", "Alert: none"]], "value string")
    assert sorted(r.pid for r in TX.flagged_ids(lines).collect()) == ["4321", "88"]


def test_fingerprint_matches_hashlib(spark):
    from triage.operators import profile as P
    d = tmpdir()
    write(d, "a.csv", "A\n1\n")
    r = P.fingerprints(spark, d).collect()[0]
    assert r.sha256 == hashlib.sha256(b"A\n1\n").hexdigest() and r.size == 4


def test_select_tables():
    sel, unknown = FS.select_tables(["process", "net", "dlls"], only="process,net,bogus", exclude="net")
    assert sel == ["process"] and unknown == ["bogus"]


def test_manifest_last_wins(spark):
    d = tmpdir()
    p = write(d, "m.csv", "filename,row_count,sha256,header_count,anomalies\nprocess.csv,42,abc,5,\n"
                          "net.csv,x,def,3,\nprocess.csv,43,abd,5,\n")
    m = {r.filename: r.row_count for r in FS.load_manifest(spark, p).collect()}
    assert m == {"process.csv": 43, "net.csv": 0}


def test_written_order_over_several_files(spark):
    path = os.path.join(tmpdir(), "ordered")
    df = spark.range(1000).repartitionByRange(7, "id").sortWithinPartitions("id")
    df.write.option("maxRecordsPerFile", 40).parquet(path)
    got = K.read_in_order(spark, path)
    assert got.columns == ["id", "place"]
    assert [(r.id, r.place) for r in got.orderBy("place").collect()] == [(i, i + 1) for i in range(1000)]
    empty = os.path.join(tmpdir(), "none")
    spark.range(0).write.parquet(empty)
    assert K.read_in_order(spark, empty).count() == 0


def test_recovered_files_by_ending(spark):
    names = ["a.exe", "b.DLL", "c.exe.txt", "exe", "d.bat ", "e.sys", "f.ps1x", "", None]
    rows = spark.createDataFrame([(n,) for n in names], "path string")
    assert sorted(r.path for r in FS.recovered_files(rows).collect()) == ["a.exe", "b.DLL", "e.sys"]
