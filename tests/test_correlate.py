"""Correlation operators against brute force on small tables, edge cases first."""

import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from triage.operators import correlate as K
from triage.plans import correlations as CR

from conftest import SF001
from helpers import tmpdir


def frame(spark, columns, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns.split()))


def stamp(seconds):
    return (datetime(2024, 1, 1) + timedelta(seconds=seconds)).strftime("%Y-%m-%d %H:%M:%S")


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_addresses_are_unsigned(spark):
    texts = ["0x0", "7fffffffffffffff", "0x8000000000000000", "FFFFFFFFFFFFFFFF", "00000000000000000000ff", "", "0x", "0xg", "1ffffffffffffffff", None, "-1"]
    rows = frame(spark, "t", [(t,) for t in texts]).select("t", K.address_at(F.col("t")).alias("a")).select("t", "a", K.address_text(F.col("a")).alias("u")).collect()
    assert [r.u for r in rows] == ["0", str(2 ** 63 - 1), str(2 ** 63), str(2 ** 64 - 1), "255", None, None, None, None, None, None]
    known = [r.a for r in rows if r.a is not None]
    assert known[:4] == sorted(known[:4]) and len(set(known)) == 5


def test_regions_of_any_size(spark):
    sizes = {"16": 16, "0x10": 16, "": 0, "0": 0, "-5": 0, "x": 0, "0000000000000000000000007": 7, "99999999999999999999999": 2 ** 64, "0xffffffffffffffffff": 2 ** 64, "18446744073709551615": 2 ** 64 - 1}
    mods = frame(spark, "pid name base size", [("1", f"m{i}", "0xfffffffffffffff0" if i % 2 else "0x20", s) for i, s in enumerate(sizes)])
    got = {r.module: (r.lo + 2 ** 63, r.last + 2 ** 63) for r in K.regions(mods).collect()}
    want = {}
    for i, n in enumerate(sizes.values()):
        base = 2 ** 64 - 16 if i % 2 else 32
        if n:
            want[f"m{i}"] = (base, min(base + n - 1, 2 ** 64 - 1))
    assert got == want


def test_points_in_intervals_by_brute_force(spark):
    rng = random.Random(3)
    spread = lambda: rng.choice([0, 1, 15, 16, 17, 255, 4096, 10 ** 6, 2 ** 40, 2 ** 63])
    intervals = []
    for i in range(300):
        lo = rng.choice([rng.randrange(-2 ** 63, 2 ** 63), rng.randrange(0, 5000)])
        intervals.append((rng.choice("ab"), lo, min(2 ** 63 - 1, lo + spread()), i))
    intervals += [("a", 5, 4, 900), ("a", -2 ** 63, 2 ** 63 - 1, 901)]
    points = [(rng.choice("abc"), rng.choice([rng.randrange(0, 6000), rng.randrange(-2 ** 63, 2 ** 63), rng.choice(intervals)[1], rng.choice(intervals)[2]])) for _ in range(400)] + [("a", None)]
    got = K.held_by(spark.createDataFrame(points, "pid string, at long"), spark.createDataFrame(intervals, "pid string, lo long, last long, i int"), ["pid"])
    want = {(p, at, i) for p, at in points if at is not None for q, lo, last, i in intervals if p == q and lo <= at <= last}
    rows = [(r.pid, r.at, r.i) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_intervals_take_few_buckets(spark):
    rows = [("p", 1000, 1000 + 2 ** k + d, k) for k in range(0, 62) for d in (-1, 0, 1)]
    df = spark.createDataFrame(rows, "pid string, lo long, last long, k int").where("lo <= last").withColumn("_s", K._shift(F.col("lo"), F.col("last")))
    most = df.select(F.expr("shiftright(last, _s) - shiftright(lo, _s) + 1").alias("n"), "_s").agg(F.max("n"), F.countDistinct("_s")).first()
    assert most[0] <= 17 and most[1] <= 16
    assert K.held_by(spark.createDataFrame([("p", 1)], "pid string, at long"), df.drop("_s").where("k > 99"), ["pid"]).count() == 0


def test_threads_outside(spark):
    mods = frame(spark, "pid name base size", [("4", "a", "0xfffff80000001000", "0x1000"), ("4", "over", "0xfffff80000001800", "4096"), ("4", "zero", "0xfffff80000009000", "0"),
                                               ("4", "none", "0xfffff8000000a000", None), ("7", "b", "0x1000", "16"), (None, "x", "0x1", "5")])
    threads = frame(spark, "pid tid start", [("4", "1", "0xFFFFF80000001000"), ("4", "2", "0xfffff80000000fff"), ("4", "3", "0xfffff800000027ff"), ("4", "4", "0xfffff80000002800"),
                                             ("4", "5", "0xfffff80000009000"), ("4", "6", "0xfffff8000000a000"), ("7", "7", "100f"), ("7", "8", "1010"), ("8", "9", "0x1000"),
                                             ("4", "10", ""), ("4", "11", None), ("4", "12", "zz"), (None, "13", "0x1"), ("7", "8", "1010")])
    rows = K.threads_outside_modules(threads, mods).collect()
    assert sorted((r.tid, r.has_modules) for r in rows) == sorted([("2", True), ("4", True), ("5", True), ("6", True), ("8", True), ("8", True), ("9", False)])
    assert {r.start_address for r in rows if r.tid == "2"} == {str(0xfffff80000000fff)}
    assert K.threads_outside_modules(threads, mods.limit(0)).count() == 10 and K.threads_outside_modules(threads.limit(0), mods).count() == 0


def test_cross_reference_takes_the_innermost_module(spark):
    mods = frame(spark, "pid name base size", [("1", "outer", "0x0", "0x10000"), ("1", "inner", "0x1000", "0x1000"), ("1", "twin", "0x1000", "0x1000"), ("1", "short", "0x1000", "0x10")])
    threads = frame(spark, "pid tid start", [("1", "1", "0x1004"), ("1", "2", "0x1005"), ("1", "3", "0x1800"), ("1", "4", "0x9000"), ("2", "5", "0x1004")])
    find = frame(spark, "pid type address", [("1", "t", "0x1004"), ("1", "t", "0x1900"), ("1", "t", "0x9000"), ("1", "t", "0x20000"), ("2", "t", "0x1004"), ("1", "t", "?"), ("1", "t", None)])
    got = plain(K.address_cross_reference(find, mods, threads))
    assert got == sorted([("1", "t", "0x1004", "short", "0x1000", 2, 1), ("1", "t", "0x1900", "inner", "0x1000", 1, 0), ("1", "t", "0x9000", "outer", "0x0", 1, 1),
                          ("1", "t", "0x20000", "", "", 0, 0), ("2", "t", "0x1004", "", "", 0, 1), ("1", "t", "?", "", "", 0, 0), ("1", "t", None, "", "", 0, 0)], key=str)


def test_lifetimes_of_a_reused_pid(spark):
    lives = [("4", "sys", "", ""), ("9", "first", stamp(100), stamp(200)), ("9", "second", stamp(200), stamp(300)), ("9", "third", stamp(250), ""), ("8", "bad", "when", stamp(500)),
             ("7", "empty", stamp(50), stamp(50)), ("6", "open start", "", stamp(10))]
    con = [("4", stamp(0)), ("9", stamp(99)), ("9", stamp(100)), ("9", stamp(199)), ("9", stamp(200)), ("9", stamp(250)), ("9", stamp(300)), ("9", stamp(10 ** 7)), ("8", stamp(100)),
           ("7", stamp(50)), ("6", stamp(9)), ("6", stamp(10)), ("5", stamp(0)), ("9", ""), ("9", None)]
    got = {(r.pid, r.time): (r.lifetime, r.name) for r in K.connection_lifetimes(frame(spark, "pid time remote", [(*c, "r") for c in con]), frame(spark, "pid name create_time exit_time", lives)).collect()}
    want = ["one sys", "none ", "one first", "one first", "one second", "ambiguous ", "one third", "one third", "none ", "none ", "one open start", "none ", "none ", "none ", "none "]
    assert [" ".join(got[c]) for c in con] == want


def crowded(rng, n):
    """Intervals and points of two processes; many around every point, equal ones, equal ends, points at ends."""
    some = lambda: rng.choice([rng.randrange(0, 400), rng.randrange(0, 40) * 10])
    spans = [(rng.choice("aab"), lo, lo + rng.choice([0, 3, 10, 10, 60, 250])) for lo in (some() for _ in range(n))] + [("a", 0, 600), ("a", 0, 600), ("a", 120, 560)]
    points = [(rng.choice("aabc"), rng.choice([some(), 50, rng.choice(spans)[1], rng.choice(spans)[2], rng.choice(spans)[2] + 1])) for _ in range(2 * n)]
    return spans, points


@pytest.mark.parametrize("size", [7, 40, 10 ** 6])
def test_crowded_regions_by_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(K, "RANGE", size)
    monkeypatch.setattr(K, "held_by", None)           # no pairs are formed
    rng = random.Random(size)
    spans, points = crowded(rng, 150)
    mods = [(p, rng.choice(["m", "k", None]), hex(lo), str(last - lo + 1)) for p, lo, last in spans]
    threads = [(p, str(i), hex(at)) for i, (p, at) in enumerate(points)]
    finds = [(p, str(i), hex(at)) for i, (p, at) in enumerate(points[::2])] + [(None, "x", "0x5"), ("a", "x", "zz")]
    m, t = frame(spark, "pid name base size", mods), frame(spark, "pid tid start", threads)
    held = {(p, at): sorted(((-lo, last, (n is not None, n or "")) for (q, n, _, _), (_, lo, last) in zip(mods, spans) if p == q and lo <= at <= last)) for p, at in points}
    assert sorted(int(r.tid) for r in K.threads_outside_modules(t, m).collect()) == [i for i, x in enumerate(points) if not held[x]]
    home = {x: h[0] if h else None for x, h in held.items()}
    want = []
    for p, i, a in finds:
        x = (p, int(a, 16)) if p and a != "zz" else None
        h = home.get(x)
        inside = sum(q == p and home[q, at] == h for q, at in points) if h and h[2][0] else 0
        want.append((p, i, a, h[2][1] if h else "", hex(-h[0]) if h else "", inside, points.count(x)))
    assert plain(K.address_cross_reference(frame(spark, "pid type address", finds), m, t)) == sorted(want, key=str)


@pytest.mark.parametrize("size", [7, 40, 10 ** 6])
def test_crowded_lifetimes_by_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(K, "RANGE", size)
    monkeypatch.setattr(K, "held_by", None)
    rng = random.Random(size + 1)
    spans, points = crowded(rng, 60)
    spans = [(p, lo, hi) for p, lo, hi in spans if hi - lo < 20] + [("b", 0, 900)]
    lives = [(p, f"n{i}", "" if i % 23 == 0 else stamp(lo), "" if i % 29 == 0 else stamp(hi + 1)) for i, (p, lo, hi) in enumerate(spans)]
    con = [(p, stamp(at), str(i)) for i, (p, at) in enumerate(points)] + [("a", "", "x"), (None, stamp(3), "y")]
    want = []
    for (p, t, i), at in zip(con, [at for _, at in points] + [None, None]):
        hits = [v for v, (q, lo, hi) in zip(lives, spans) if at is not None and p == q and (v[2] == "" or lo <= at) and (v[3] == "" or at <= hi)]
        want.append((p, t, i, "one", *(hits[0][k] for k in (1, 2, 3))) if len(hits) == 1 else (p, t, i, "ambiguous" if hits else "none", "", "", ""))
    assert {w[3] for w in want} == {"one", "none", "ambiguous"}
    assert plain(K.connection_lifetimes(frame(spark, "pid time remote", con), frame(spark, "pid name create_time exit_time", lives))) == sorted(want, key=str)


def test_file_drops_across_buckets(spark):
    rng = random.Random(8)
    writes = [(str(rng.randrange(200)), rng.choice("ab"), stamp(rng.randrange(0, 40_000))) for _ in range(250)] + [("5", "a", stamp(7200)), ("11", "a", stamp(7200)), ("1", "", stamp(1)), ("1", "a", "x")]
    starts = [(str(i), rng.choice("abc"), stamp(rng.randrange(0, 45_000))) for i in range(250)] + [("s", "a", stamp(7200)), ("s", "a", stamp(7199 + 3600)), ("s", "", stamp(1)), ("s", "a", None)]
    at = lambda t: int((datetime.strptime(t, "%Y-%m-%d %H:%M:%S") - datetime(2024, 1, 1)).total_seconds())
    for within in (3600, 60):
        want = []
        for pid, path, t in starts:
            before = [(at(u), w) for w, p, u in writes if p == path != "" and t and u != "x" and 0 <= at(t) - at(u) <= within]
            if before:
                last = max(b for b, _ in before)
                want.append((pid, path, t, stamp(last), at(t) - last, min((len(w), w) for b, w in before if b == last)[1]))
        assert plain(K.file_drops(frame(spark, "pid path time", writes), frame(spark, "pid path time", starts), within)) == sorted(want, key=str)


def test_beaconing_by_brute_force(spark):
    rng = random.Random(4)
    rows = [("1", stamp(i * 3600 + rng.randrange(3)), "beacon") for i in range(60)] + [("1", stamp(rng.randrange(10 ** 6)), "noise") for _ in range(61)]
    rows += [("2", stamp(5), "once"), ("3", stamp(5), "same"), ("3", stamp(5), "same"), ("3", stamp(5), "same"), ("4", stamp(0), "far"), ("4", stamp(86_400 * 9), "far"), ("4", stamp(86_400 * 9 + 1), "far"), ("5", "", "blank"), ("6", stamp(1), "")]
    by = {}
    for pid, t, remote in rows:
        if t and remote:
            by.setdefault((pid, remote), []).append(datetime.strptime(t, "%Y-%m-%d %H:%M:%S"))
    want = []
    for key, ts in by.items():
        ts.sort()
        gap = [int((y - x).total_seconds()) for x, y in zip(ts, ts[1:])]
        if gap:
            med = statistics.median(gap)
            near = sum(100 * abs(g - med) <= 10 * med for g in gap)
            want.append((*key, len(ts), float(med), float(statistics.median([abs(g - med) for g in gap])), near / len(gap), len(gap) >= 4 and med > 0 and near >= 0.7 * len(gap)))
    got = plain(K.beaconing(frame(spark, "pid time remote", rows)))
    assert got == sorted(want, key=str) and [r[1] for r in got if r[-1]] == ["beacon"]


def test_consensus_of_paths(spark):
    rows = [(str(i % 7), "NTDLL.dll", "C:/Sys/ntdll.dll") for i in range(30)] + [("1", "ntdll.dll", "c:/temp/ntdll.dll"), ("2", "ntdll.dll", ""), ("2", "ntdll.dll", ""), ("1", "tie.dll", "b"), ("1", "tie.dll", "a"), ("1", "", "x")]
    got = {(r.name, r.path): (r.rows, r.processes, r.unexpected) for r in K.path_consensus(frame(spark, "pid name path", rows)).collect()}
    assert got == {("ntdll.dll", "c:/sys/ntdll.dll"): (30, 7, False), ("ntdll.dll", "c:/temp/ntdll.dll"): (1, 1, True), ("ntdll.dll", ""): (2, 1, True),
                   ("tie.dll", "a"): (1, 1, False), ("tie.dll", "b"): (1, 1, True)}


def test_exact_quantiles_beyond_the_summary(spark):
    rng = random.Random(6)
    values = {"hot": [rng.randrange(10 ** 6) for _ in range(30_000)], "ties": [rng.choice([1, 1, 1, 5, 9]) for _ in range(5_000)], "small": [3, 1, 2], "one": [7]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v long").repartition(6)
    shares = [(1, 4), (1, 2), (3, 4), (0, 1), (1, 1)]
    for r in K.exact_quantiles(df, "g", "v", shares).collect():
        s = sorted(values[r.g])
        assert [r[f"q{i}"] for i in range(5)] == [s[(len(s) - 1) * a // b] for a, b in shares]


def test_stamp_outliers(spark):
    rows = [("1", "a.dll", str(1_600_000_000 + i)) for i in range(100)] + [("1", "a.dll", "0"), ("2", "A.dll", "4102444800"), ("3", "a.dll", "1500000000"), ("4", "a.dll", "1700000000"), ("5", "a.dll", "?"), ("6", "b.dll", "5")]
    got = sorted((r.pid, r.reason) for r in K.stamp_outliers(frame(spark, "pid name stamp", rows), CR.NOW).collect())
    assert got == [("1", "epoch"), ("2", "future"), ("3", "below fence"), ("4", "above fence"), ("6", "epoch")]


def test_handle_rights(spark):
    rows = [("1", "0x4", "0x1f01ff", "Process", "PID 612 lsass.exe"), ("1", "0x8", "0x30", "process", "x"), ("1", "0xc", "10", "Process", "LSASS.EXE"), ("1", "0x10", "", "Process", "lsass.exe"),
            ("1", "0x14", "zz", "Process", None), ("1", "0x18", "0xffffffffffffffff00000020", "Process", ""), ("1", "0x1c", "0x30", "File", "lsass.exe")]
    got = {r.handle: (r.rights, r.reads_and_writes, r.lsass, r.dumping) for r in K.process_handles(frame(spark, "pid handle access type detail", rows)).collect()}
    assert got["0x4"][1:] == (True, True, True) and got["0x4"][0].startswith("TERMINATE|CREATE_THREAD") and got["0x4"][0].endswith("WRITE_OWNER|SYNCHRONIZE")
    assert got["0x8"] == ("VM_READ|VM_WRITE", True, False, False) and got["0xc"] == ("VM_READ", False, True, True)
    assert got["0x10"] == ("", False, True, False) and got["0x14"][:2] == ("", False) and got["0x18"][0] == "VM_WRITE" and "0x1c" not in got


def test_orphans_and_unknown_drivers(spark):
    procs = frame(spark, "pid ppid name parent_name", [("4", "0", "System", ""), ("9", "4", "a", ""), ("10", "77", "b", ""), ("11", "77", "c", "gone.exe"), ("", "1", "d", "")])
    assert plain(K.orphan_processes(procs)) == [("10", "77", "b"), ("4", "0", "System")]
    got = plain(K.unknown_drivers(frame(spark, "device driver_path", [("a", "\\X\\Y.SYS"), ("b", "\\x\\z.sys"), ("c", "")]), frame(spark, "path", [("\\x\\y.sys",)])))
    assert got == [("b", "\\x\\z.sys"), ("c", "")]


def test_timeline_partitions_do_not_overlap(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = K.timeline([CR.view(spark, SF001, "v_connections").select("time", F.lit("NET").alias("type"), F.lit("Connect").alias("action"), "pid", F.col("remote").alias("path"))], ["NET"])
        out = f"{tmpdir()}/timeline"
        df.withColumn("_at", F.monotonically_increasing_id()).write.parquet(out)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = spark.read.parquet(out).orderBy("_at").collect()
    events = [tuple(r[c] for c in K.EVENT) for r in rows]
    assert events == sorted(events) and len({r._at >> 33 for r in rows}) > 2 and all(e[0] for e in events)
    edges = {}
    for r in rows:
        edges.setdefault(r._at >> 33, []).append(tuple(r[c] for c in K.EVENT))
    parts = [edges[k] for k in sorted(edges)]
    assert all(a[-1] <= b[0] and (a[-1] < b[0]) for a, b in zip(parts, parts[1:]))
    ordered = K.numbered_timeline(spark.read.parquet(out)).orderBy("position").collect()
    assert [r.position for r in ordered] == list(range(len(rows))) and [tuple(r[c] for c in K.EVENT) for r in ordered] == events


@pytest.mark.parametrize("name", sorted(CR.QUERIES))
def test_queries_over_nothing(spark, name, tmp_path):
    for t in {v[0] for v in CR.VIEWS.values()}:
        spark.read.parquet(f"{SF001}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert CR.QUERIES[name](spark, str(tmp_path)).count() == 0
