"""Files that cannot be read, bytes that are no text, join-back, counters."""

import os
import random

from pyspark.sql import functions as F

from triage.operators import detect_injection as DI
from triage.operators import enrich as E
from triage.operators import profile as P
from triage.sources.text import lossy_text

from helpers import table, tmpdir, write


def test_one_faulty_file_costs_only_itself(spark, monkeypatch):
    case = tmpdir()
    write(case, "ok.csv", "a,b\n1,2\n3,4,5\n")
    write(case, "locked.csv", "a\n1\n")
    os.chmod(f"{case}/locked.csv", 0)
    write(case, "huge.csv", "a\n" + "1\n" * 2000)
    write(case, "empty.csv", "")
    write(case, "vanished.csv", "a\n1\n")
    os.mkdir(f"{case}/parts.csv")
    write(f"{case}/parts.csv", "part-0", "x\n1\n")
    write(f"{case}/parts.csv", "part-1", "x\n2\n")
    os.chmod(f"{case}/parts.csv/part-1", 0)
    monkeypatch.setattr(P, "LARGEST", 1000)
    files = P.listing(spark, case)
    os.remove(f"{case}/vanished.csv")
    entries = P.inventory(spark, case, files=files)
    got = {r.filename: r for r in entries.collect()}
    assert got["ok.csv"].row_count == 2 and got["ok.csv"].ingest_errors == 1 and got["ok.csv"].anomalies == [] and len(got["ok.csv"].sha256) == 64
    assert got["empty.csv"].anomalies == ["empty_file"]
    for name, why in (("locked.csv", P.LOCKED), ("huge.csv", P.TOO_LARGE), ("vanished.csv", P.UNREADABLE), ("parts.csv", P.LOCKED)):
        r = got[name]
        assert (r.anomalies, list(r.headers), r.row_count, r.ingest_errors, r.sha256) == ([f"read_error: {why}"], [], 0, 0, "")
    s = P.anomaly_summary(entries).first()
    assert s.total_files == 6 and list(s.locked_files) == ["locked.csv", "parts.csv"] and list(s.read_errors) == ["huge.csv", "locked.csv", "parts.csv", "vanished.csv"]


def test_lossy_text_equals_replacing_decode(spark):
    rng = random.Random(2)
    pieces = [b"a", "é".encode(), "日".encode(), "😀".encode(), b"\xff", b"\xc3", b"\xe2\x82", b"\xf0\x9f\x98", b"\x80", b"\xc0\xaf", b"\xed\xa0\x80", b"\xf5", b"\x00"]
    rows = [(b"".join(rng.choice(pieces) for _ in range(rng.randrange(12))),) for _ in range(400)] + [(None,)]
    for r in spark.createDataFrame(rows, "b binary").select("b", lossy_text(F.col("b")).alias("t")).collect():
        assert r.t == (None if r.b is None else bytes(r.b).decode(errors="replace")), bytes(r.b)


def test_join_back_multiplies_nothing(spark):
    files = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), ("", "4"), (None, "5")], "file_path string, file_id string")
    found = spark.createDataFrame([("a", "1", "1.0", "m", "s", "9", "ok"), ("a", "2", "1.0", "m", "s", "9", "ok"), ("b", "3", "", "", "", "", "not_found"), ("", "4", "2.0", "x", "x", "x", "ok")],
                                  "file_path string, file_id string, entropy string, md5 string, sha256 string, file_size string, status string")
    got = sorted((tuple(r) for r in E.join_back(files, found, "file_path").collect()), key=str)
    assert got == sorted([("a", "1", "1.0", "m", "s", "9"), ("a", "2", "1.0", "m", "s", "9"), ("b", "3", "", "", "", ""), ("", "4", "", "", "", ""), (None, "5", "", "", "", "")], key=str)


def test_counters_without_a_protection_column(spark):
    t = table(spark, ["pid", "address"], [("1", "0x1"), ("2", "0x2")], "findevil")
    assert tuple(DI.scan_counters(t, "s").first()) == ("s", 2, 0, 0)
