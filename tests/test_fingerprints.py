"""Hashes of files that are not held as one value; roots with and without authority."""

import gzip
import hashlib
import os
import random

import pytest

from triage.operators import profile as P
from triage.sources import csv as C

from helpers import tmpdir, write

PIECES = [b"a,b\r\n", b"\n", b"\xff\xfe\x00", b"line of text", b"\r", "é日".encode(), b"\n\n"]


@pytest.mark.parametrize("split", ["128m", "300"])
def test_large_files_are_hashed_in_pieces(spark, monkeypatch, split):
    monkeypatch.setattr(P, "WHOLE", 200, raising=False)
    monkeypatch.setattr(P, "PIECE", 64, raising=False)
    rng, case, mark = random.Random(1), tmpdir(), b"\xef\xbb\xbf"
    body = lambda n: b"".join(rng.choice(PIECES) for _ in range(n))
    files = {"feed.csv": body(900) + b"\n", "none.csv": body(700) + b"x", "mark.csv": mark + body(500) + b"\n", "mark none.csv": mark + body(500) + b"x",
             "marks.csv": mark * 2 + body(300), "a+b%20 é.csv": body(400) + b"z", "feeds.csv": b"\n" * 3000, "one.csv": b"q" * 5000, "small.csv": b"a\n",
             "packed.csv.gz": gzip.compress(b"a" * 5000)}
    for name, content in files.items():
        write(case, name, content, "wb")
    assert len(files["packed.csv.gz"]) < 200 < min(len(c) for n, c in files.items() if n not in ("small.csv", "packed.csv.gz"))
    conf = {"spark.sql.sources.binaryFile.maxLength": "200", "spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {os.path.basename(r.path): (r.entry, r.size, r.sha256, r.md5) for r in P.fingerprints(spark, case).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {n: (n, len(c), hashlib.sha256(c).hexdigest(), hashlib.md5(c).hexdigest()) for n, c in files.items()}


def test_packed_file_of_any_size_is_hashed_as_it_lies(spark, monkeypatch):
    monkeypatch.setattr(P, "WHOLE", 20, raising=False)
    case, content = tmpdir(), gzip.compress(bytes(random.Random(2).randrange(256) for _ in range(500)))
    write(case, "packed.csv.gz", content, "wb")
    assert [r.sha256 for r in P.fingerprints(spark, case).collect()] == [hashlib.sha256(content).hexdigest()]


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_inventory_of_a_root_with_a_scheme(spark, scheme):
    case = tmpdir()
    write(case, "t.csv", "a,b\n1,2\n")
    got = P.inventory(spark, scheme + case).collect()
    assert [(r.filename, list(r.headers), r.row_count) for r in got] == [("t.csv", ["a", "b"], 1)]


def test_row_places_need_no_shuffle_of_the_table(spark):
    case = tmpdir()
    for i in range(3):
        write(case, f"{i}.csv", "a\n" + "".join(f"{i}{k}\n" for k in range(5)))
    df, most = C.read_csv_lossless(spark, case, headers=["a"]).table.df, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")     # as for a large table
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted((r._c0, r._row_index) for r in df.collect()) == [(f"{i}{k}", k) for i in range(3) for k in range(5)]
