"""Cross-table correlation of forensic tables: point-in-interval joins,
as-of joins, inter-arrival statistics, consensus and outlier reports, and the
merged timeline.

All of them are equi joins and aggregates on bounded keys:

* ``held_by`` finds the intervals that hold a point.  Intervals are filed
  under the buckets they cover, at a width that follows their own length (17
  buckets at most), and points look once at every width in use (16 at most):
  a hot process is split by bucket, and no pair is formed that does not share
  one.  It gives every pair, which may be many times the input.
* ``running`` answers a question about all the intervals around a point (how
  far they reach, how many there are, which is innermost) by aggregates that
  run along the positions of a key, points and interval ends together: no pair
  is formed.  A key of many rows is cut into ranges of positions (``cuts``);
  each range starts from the aggregate of those before it.
* Coordinates are signed longs.  Addresses are unsigned 64-bit numbers; their
  order is kept by flipping the top bit.

Cells are text.  Blank or malformed numbers and times are unknown: an unknown
address or time matches nothing, an unknown or zero size holds nothing.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triage import rules as R
from triage.session import ship_package

LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
HEX64 = r"^(?:0[xX])?0*([0-9a-fA-F]{1,16})$"
#: Rows of one key that are swept in one piece.
RANGE = 1_000_000


# ---------------------------------------------------------------- coordinates

def address_at(text: Column) -> Column:
    """Coordinate of a hexadecimal 64-bit address; NULL when it is none."""
    signed = F.conv(F.regexp_extract(text, HEX64, 1), 16, -10).cast("long")             # no match: '', of which conv is NULL
    return signed.bitwiseXOR(F.lit(LOWEST))


def address_text(at: Column) -> Column:
    """Unsigned decimal text of a coordinate."""
    return (at.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string")


def time_at(text: Column) -> Column:
    """Seconds since the epoch of 'yyyy-MM-dd HH:mm:ss' text (UTC); NULL when it is none."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$"), F.try_to_timestamp(F.concat(text, F.lit("+00:00")), F.lit("yyyy-MM-dd HH:mm:ssXXX")).cast("long"))


def size_of(text: Column) -> Column:
    """A region's size from decimal or 0x-hexadecimal text, 2^64 for any more; NULL when it is neither."""
    digits = F.regexp_replace(text, "^(0[xX])?0*(?=.)", "")
    most, kind = F.lit(str(1 << 64)).cast("decimal(38,0)"), "decimal(38,0)"
    return (F.when(text.rlike(r"^[0-9]+$"), F.when(F.length(digits) <= 19, digits.try_cast(kind)).otherwise(most))
             .when(text.rlike(r"^0[xX][0-9a-fA-F]+$"), F.when(F.length(digits) <= 16, F.conv(digits, 16, 10).try_cast(kind)).otherwise(most)))


def span_of(base: Column, size_text: Column) -> tuple[Column, Column]:
    """(first, last) coordinates of a region; NULL for an unknown or empty one; a region ends at the highest address."""
    size = size_of(size_text)
    last = F.least(base.cast("decimal(38,0)") + size - 1, F.lit(HIGHEST).cast("decimal(38,0)"))
    return F.when(size > 0, base), F.when(size > 0, last.cast("long"))


# ---------------------------------------------------------------- points in intervals

def _shift(lo: Column, last: Column) -> Column:
    """Bits below an interval's bucket number: its length is under 16 buckets."""
    return 4 * (F.length(F.hex(F.coalesce(F.try_subtract(last, lo), F.lit(-1).cast("long")))) - 1)


def held_by(points: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """points(keys, at) x intervals(keys, lo, last, more columns): every
    distinct (keys, at) with each interval of its keys that holds it."""
    filed = intervals.where("lo <= last").withColumn("_s", _shift(F.col("lo"), F.col("last")))
    widths = sorted(r._s for r in filed.select("_s").distinct().collect())            # 16 at most
    filed = filed.withColumn("_b", F.explode(F.sequence(F.expr("shiftright(lo, _s)"), F.expr("shiftright(last, _s)"))))
    asked = (points.where("at is not null").select(*keys, "at").distinct()
             .withColumn("_s", F.explode(F.array(*map(F.lit, widths)).cast("array<int>"))).withColumn("_b", F.expr("shiftright(at, _s)")))
    return asked.join(filed, [*keys, "_s", "_b"]).where("at between lo and last").drop("_s", "_b")


# ---------------------------------------------------------------- aggregates along positions

def cuts(spots: DataFrame, keys: list[str]) -> DataFrame | None:
    """keys, _cuts for the keys of more than RANGE of the spots(keys, at):
    ascending positions that cut them into ranges of about RANGE spots.  They
    are fixed by the time it returns (one number per RANGE spots on the
    driver).  None if there is no such key."""
    most = spots.groupBy(*keys).agg(F.count("*").alias("_n")).where(f"_n > {RANGE}")
    kind, hot = most.schema, most.collect()
    if not hot:
        return None
    spark, parts = spots.sparkSession, -(-max(r["_n"] for r in hot) // RANGE)
    ranges = f"((_n + {RANGE - 1}) div {RANGE})"
    found = (spots.join(F.broadcast(spark.createDataFrame(hot, kind)), keys).groupBy(*keys, "_n")
             .agg(F.percentile_approx("at", [i / parts for i in range(1, parts)]).alias("_q"))
             .select(*keys, F.expr(f"transform(sequence(1L, {ranges} - 1), i -> _q[cast(i * {parts} div {ranges} as int) - 1])").alias("_cuts")))
    return spark.createDataFrame(found.collect(), found.schema)


def _below(at: Column, same: bool = False) -> Column:
    """How many of _cuts lie below a position (or at it)."""
    return F.size(F.filter("_cuts", lambda x: x <= at if same else x < at))


def running(rows: DataFrame, keys: list[str], aggs: dict, hot: DataFrame | None) -> DataFrame:
    """rows(keys, at, point, columns to aggregate, more columns) with the
    aggregates (name -> aggregate that may be applied to its own results) over
    the rows of the keys up to ``at``.  Points come last of a position and
    hold NULL in the aggregated columns.  hot: from ``cuts``; the points of
    one position that it cuts out more than once are spread over the ranges."""
    order = Window.partitionBy(*keys, "_r").orderBy(F.col("at").asc_nulls_first(), "point").rowsBetween(Window.unboundedPreceding, 0)
    if hot is None:
        dealt = rows.withColumn("_r", F.lit(0))
    else:
        low, more = _below(F.col("at")), [c for c in rows.columns if c not in (*keys, "at", "point")]
        spread = F.when(F.col("point"), F.pmod(F.xxhash64(*more), _below(F.col("at"), True) - low + 1)).otherwise(0)
        dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_r", F.when(F.col("_cuts").isNull(), 0).otherwise(low + spread).cast("int"))
        totals = dealt.where("not point and _cuts is not null").groupBy(*keys, "_r").agg(*(f(c).alias(c) for c, f in aggs.items()))
        ranges = hot.select(*keys, F.explode(F.sequence(F.lit(0), F.size("_cuts"))).alias("_r"))
        before = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
        carry = ranges.join(totals, [*keys, "_r"], "left").select(*keys, "_r", F.lit(False).alias("point"), *(f(c).over(before).alias(c) for c, f in aggs.items()))
        dealt = dealt.drop("_cuts").unionByName(carry, allowMissingColumns=True)
    return dealt.withColumns({c: f(c).over(order) for c, f in aggs.items()}).where("at is not null").drop("_r")


def _seen(keys: list[str], more: list[str], schema):
    """Intervals sorted by piece (keys and range), start and descending end ->
    keys, at, interval: the interval that is innermost from ``at`` on, unless
    it ends.  Holds the intervals around a position that may be seen yet."""

    def run(batches):
        out, around, piece, stop = [], [], None, 0      # around: each interval ends before the one below it

        def show(at):
            if out and out[-1][:2] == (piece, at):
                out.pop()
            out.append((piece, at, around[-1]))

        def advance(to):
            while around and around[-1][1] < to:
                after = around.pop()[1] + 1
                if around and after < to:
                    show(after)

        def given(rows):
            cols = [*([r[0][i] for r in rows] for i in range(len(keys))), [r[1] for r in rows], *([r[2][i] for r in rows] for i in range(2 + len(more)))]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        for b in batches:
            col = lambda c: b.column(c).to_pylist()
            for p, begin, end, item in zip(zip(*map(col, [*keys, "_r"])), col("_begin"), col("_end"), zip(*map(col, ["lo", "last", *more]))):
                if p != piece:
                    advance(stop + 1)
                    around.clear()
                    piece, stop = p, end
                at = max(item[0], begin)
                advance(at)
                while around and around[-1][1] <= item[1]:
                    around.pop()
                around.append(item)
                show(at)
            if len(out) > 1:
                yield given(out[:-1])
                del out[:-1]
        advance(stop + 1)
        yield given(out)

    return run


def innermost(intervals: DataFrame, keys: list[str], hot: DataFrame | None) -> DataFrame:
    """intervals(keys, lo, last, more columns), (keys, lo, last) being unique
    -> keys, at, lo, last, more: the interval that begins last, of those the
    shortest, of all that hold the positions from ``at`` to the next such row
    (or to the end of the interval; none of them holds what follows it).  At
    most two rows for an interval and one for a range.

    An interval is filed under the ranges in which it starts and ends; of all
    that hold a range whole, the innermost one is."""
    from pyspark.sql.pandas.types import to_arrow_schema

    intervals = intervals.where("lo <= last")
    more = [c for c in intervals.columns if c not in (*keys, "lo", "last")]
    if hot is None:
        filed = intervals.withColumns({"_r": F.lit(0), "_begin": F.lit(LOWEST), "_end": F.lit(HIGHEST)})
    else:
        cut = intervals.join(F.broadcast(hot.withColumn("_cuts", F.array_distinct("_cuts"))), keys, "left")
        cut = cut.withColumns({k: F.when(F.col("_cuts").isNull(), 0).otherwise(_below(F.col(c))) for k, c in (("_i", "lo"), ("_j", "last"))})
        item = F.struct("lo", F.expr("~last").alias("_l"), F.struct("last", *more, "_cuts").alias("_m"))
        whole = (cut.where("_j - _i > 1").groupBy(*keys, "_i", "_j").agg(F.max(item).alias("_x"))
                 .withColumn("_r", F.explode(F.expr("sequence(_i + 1, _j - 1)"))).groupBy(*keys, "_r").agg(F.max("_x").alias("_x"))
                 .select(*keys, "_r", "_x.lo", "_x._m.*"))
        filed = reduce(DataFrame.unionByName, [cut.withColumn("_r", F.col("_i")).drop("_i", "_j"), cut.where("_j > _i").withColumn("_r", F.col("_j")).drop("_i", "_j"), whole])
        filed = filed.withColumns({"_begin": F.when(F.coalesce(F.col("_r") == 0, F.lit(True)), F.lit(LOWEST)).otherwise(F.expr("_cuts[_r - 1] + 1")),
                                   "_end": F.when(F.col("_cuts").isNull() | (F.col("_r") == F.size("_cuts")), F.lit(HIGHEST)).otherwise(F.expr("_cuts[_r]"))}).drop("_cuts")
    ship_package(intervals.sparkSession)
    shape = intervals.select(*keys, F.lit(0).cast("long").alias("at"), "lo", "last", *more).schema
    return (filed.repartition(*keys, "_r").sortWithinPartitions(*keys, "_r", "lo", F.desc("last"))
            .mapInArrow(_seen(keys, more, to_arrow_schema(shape)), shape))


# ---------------------------------------------------------------- modules, threads and lifetimes

def regions(modules: DataFrame) -> DataFrame:
    """modules(pid, name, base, size) as text -> pid, module, base, lo, last."""
    lo, last = span_of(address_at(F.col("base")), F.col("size"))
    # as results of an aggregate they are worked out once, not again in every later filter
    read = modules.groupBy("pid", "name", "base", "size").agg(F.min(lo).alias("lo"), F.min(last).alias("last"))
    return read.where("lo is not null and pid <> ''").select("pid", F.col("name").alias("module"), "base", "lo", "last").distinct()


def threads_outside_modules(threads: DataFrame, modules: DataFrame) -> DataFrame:
    """DOC-05.  threads(pid, tid, start) whose start lies in no module of
    their process: pid, tid, start, start_address (unsigned decimal),
    has_modules (the process lists any)."""
    t = threads.withColumn("at", address_at(F.col("start"))).where("at is not null and pid <> ''").select("pid", "tid", "start", "at", F.lit(True).alias("point"))
    r = regions(modules)
    reach = r.where("lo <= last").groupBy("pid", F.col("lo").alias("at")).agg(F.max("last").alias("reach")).withColumn("point", F.lit(False))
    hot = cuts(t.select("pid", "at").union(reach.select("pid", "at")), ["pid"])
    outside = running(t.unionByName(reach, allowMissingColumns=True), ["pid"], {"reach": F.max}, hot).where("point and (reach is null or reach < at)")
    listed = r.select("pid").distinct().withColumn("_m", F.lit(True))
    return (outside.join(listed, "pid", "left")
            .select("pid", "tid", "start", address_text(F.col("at")).alias("start_address"), F.coalesce("_m", F.lit(False)).alias("has_modules")))


def address_cross_reference(findings: DataFrame, modules: DataFrame, threads: DataFrame) -> DataFrame:
    """DOC-06.  findings(pid, type, address): the module that holds each
    address (the one that begins last, of those the shortest, then by name),
    the threads that start in that module, and those that start at the very
    address.  Findings and thread starts are located over one set of regions."""
    f = findings.withColumn("at", address_at(F.col("address")))
    t = threads.withColumn("at", address_at(F.col("start"))).groupBy("pid", "at").agg(F.count("*").alias("n")).where("at is not null")
    r = regions(modules).groupBy("pid", "lo", "last").agg(F.min(F.struct("module", "base")).alias("_m")).select("pid", "lo", "last", "_m.module", "_m.base")
    known = f.where("pid is not null and at is not null")
    hot = cuts(reduce(DataFrame.union, [known.select("pid", "at"), t.where("pid is not null").select("pid", "at"), r.select("pid", "lo")]), ["pid"])
    seen = innermost(r, ["pid"], hot)
    # the module is the last one seen at or before an address, unless it ends before
    last, ended = F.struct(F.col("at").alias("since"), "lo", "last", "module", "base"), F.col("m.last") < F.col("at")
    steps = seen.select("pid", "at", F.lit(False).alias("point"), last.alias("m"))
    point = lambda df: df.where("pid is not null").withColumn("point", F.lit(True))
    home = running(point(t).unionByName(steps, allowMissingColumns=True), ["pid"], {"m": F.max}, hot).where("point").where(~ended)
    inside = home.groupBy("pid", "m.lo", "m.last", "m.module", "m.base").agg(F.sum("n").alias("threads_in_module"))
    placed = running(point(known).unionByName(steps, allowMissingColumns=True), ["pid"], {"m": F.max}, hot).where("point").drop("point")
    placed = placed.select("pid", "type", "address", "at", *(F.when(~ended, F.col("m")[c]).alias(c) for c in ("lo", "last", "module", "base")))
    placed = placed.join(inside, ["pid", "lo", "last", "module", "base"], "left").unionByName(f.where("pid is null or at is null"), allowMissingColumns=True)
    return (placed.join(t.withColumnRenamed("n", "threads_at_address"), ["pid", "at"], "left")
            .select("pid", "type", "address", F.coalesce("module", F.lit("")).alias("module"), F.coalesce("base", F.lit("")).alias("module_base"),
                    F.coalesce("threads_in_module", F.lit(0)).alias("threads_in_module"), F.coalesce("threads_at_address", F.lit(0)).alias("threads_at_address")))


def connection_lifetimes(connections: DataFrame, processes: DataFrame) -> DataFrame:
    """DOC-02.  connections(pid, time, remote) with the one lifetime of their
    PID that holds the time: create <= time < exit, a blank create or exit
    being open.  lifetime: 'one', 'none' or 'ambiguous' (several); name,
    create_time and exit_time are given for 'one'."""
    c = connections.withColumn("at", time_at(F.col("time")))
    edge = c.agg(F.min("at").alias("a"), F.max("at").alias("b")).first()                # open ends need not reach beyond the connections
    low, high = (edge["a"], edge["b"]) if edge["a"] is not None else (0, -1)
    start, end = time_at(F.col("create_time")), time_at(F.col("exit_time"))
    lives = processes.select(
        "pid", "name", "create_time", "exit_time",
        F.when(F.col("create_time") == "", F.lit(low)).otherwise(F.greatest(start, F.lit(low))).cast("long").alias("lo"),
        F.when(F.col("exit_time") == "", F.lit(high)).otherwise(F.least(end - 1, F.lit(high))).cast("long").alias("last"),
    ).where(((F.col("create_time") == "") | start.isNotNull()) & ((F.col("exit_time") == "") | end.isNotNull()))
    lives = lives.where("pid is not null and lo <= last")
    # from every begin or end of a lifetime on: how many hold, and lo and last of one that does alone
    edges = (lives.select("pid", F.col("lo").alias("at"), F.lit(1).alias("n"), "lo", "last").unionAll(lives.select("pid", F.col("last") + 1, F.lit(-1), "lo", "last"))
             .groupBy("pid", "at").agg(F.sum("n").alias("n"), F.bit_xor("lo").alias("lo"), F.bit_xor("last").alias("last")).withColumn("point", F.lit(False)))
    known = c.where("pid is not null and at is not null").withColumn("point", F.lit(True))
    hot = cuts(known.select("pid", "at").union(edges.select("pid", "at")), ["pid"])
    steps = running(edges, ["pid"], {"n": F.sum, "lo": F.bit_xor, "last": F.bit_xor}, hot)
    named = lives.groupBy("pid", "lo", "last").agg(F.min(F.struct("create_time", "exit_time", "name")).alias("p"))
    steps = steps.join(named, ["pid", "lo", "last"], "left").select("pid", "at", "point", F.struct(F.col("at").alias("since"), "n", "p").alias("m"))
    found = running(known.unionByName(steps, allowMissingColumns=True), ["pid"], {"m": F.max}, hot).where("point").drop("point")
    found = found.unionByName(c.where("pid is null or at is null"), allowMissingColumns=True)
    one = F.col("m.n") == 1
    return found.select(
        "pid", "time", "remote", F.when(one, "one").when(F.col("m.n") > 1, "ambiguous").otherwise("none").alias("lifetime"),
        *(F.when(one, F.col("m.p")[k]).otherwise("").alias(k) for k in ("name", "create_time", "exit_time")))


# ---------------------------------------------------------------- as-of join

def file_drops(writes: DataFrame, starts: DataFrame, within: int = 3600) -> DataFrame:
    """DOC-09c.  starts(pid, path, time) whose file was written at or at most
    ``within`` seconds before: pid, path, time, write_time, gap_seconds,
    writer (the smallest PID of those that wrote at that time), by the last
    such write.

    Time is cut into buckets of ``within`` seconds.  The write sought lies in
    a start's bucket or is the last of the bucket before, which is carried
    over: windows are of one path and one bucket, whatever a path's history."""
    bucket = F.floor(F.col("at") / within)
    keyed = lambda df: df.withColumn("at", time_at(F.col("time"))).where("at is not null and path <> ''").withColumn("b", bucket)
    w = (keyed(writes).groupBy("path", "b", "at").agg(F.min(F.struct(F.length("pid").alias("l"), "pid")).alias("p"), F.first("time").alias("t"))
         .select("path", "b", "at", F.col("p.pid").alias("writer"), "t"))
    carry = w.groupBy("path", "b").agg(F.max(F.struct("at", "writer", "t")).alias("m")).select("path", (F.col("b") + 1).alias("b"), "m.at", "m.writer", "m.t")
    known = w.unionByName(carry).select("path", "b", "at", F.lit(0).alias("side"), F.struct("at", "writer", "t").alias("write"), F.lit(None).cast("string").alias("pid"), F.lit(None).cast("string").alias("time"))
    none = F.lit(None).cast("struct<at: bigint, writer: string, t: string>")
    asked = keyed(starts).select("path", "b", "at", F.lit(1).alias("side"), none.alias("write"), "pid", "time")
    # a write of the same second counts as before
    last = F.last("write", ignorenulls=True).over(Window.partitionBy("path", "b").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0))
    out = known.unionByName(asked).withColumn("last", last).where("side = 1").withColumn("gap_seconds", F.col("at") - F.col("last.at"))
    return out.where(F.col("gap_seconds") <= within).select(
        "pid", "path", "time", F.col("last.t").alias("write_time"), "gap_seconds", F.col("last.writer").alias("writer"))


# ---------------------------------------------------------------- beaconing

def gaps(events: DataFrame, keys: list[str], width: int = 86_400) -> DataFrame:
    """keys, gap, n: the seconds between neighbouring events of a key and how
    often each occurs.  A key's events are ordered within ranges of ``width``
    seconds; the last event of the range before is carried over its edge."""
    e = events.where("at is not null").groupBy(*keys, "at").agg(F.count("*").alias("n")).withColumn("b", F.floor(F.col("at") / width))
    ranges = e.groupBy(*keys, "b").agg(F.max("at").alias("last"))
    edge = ranges.withColumn("before", F.lag("last").over(Window.partitionBy(*keys).orderBy("b"))).select(*keys, "b", "before")
    inner = e.withColumn("prev", F.lag("at").over(Window.partitionBy(*keys, "b").orderBy("at"))).join(edge, [*keys, "b"])
    between = inner.select(*keys, (F.col("at") - F.coalesce("prev", "before")).alias("gap"), F.lit(1).cast("long").alias("n")).where("gap is not null")
    same = inner.where("n > 1").select(*keys, F.lit(0).cast("long").alias("gap"), (F.col("n") - 1).alias("n"))      # events of one second
    return between.unionByName(same).groupBy(*keys, "gap").agg(F.sum("n").alias("n"))


def weighted_median(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """keys, out: twice the median of the values, each n times (the sum of the two in the middle)."""
    w = Window.partitionBy(*keys)
    placed = rows.withColumn("_c", F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("n").over(w))
    low, high = F.expr("(_n + 1) div 2"), F.expr("_n div 2 + 1")
    hit = lambda at: (F.col("_c") >= at) & (F.col("_c") - F.col("n") < at)
    return placed.groupBy(*keys).agg((F.max(F.when(hit(low), F.col(value))) + F.max(F.when(hit(high), F.col(value)))).alias(out))


def beaconing(connections: DataFrame, least: int = 4, near: int = 10, share: int = 70) -> DataFrame:
    """DOC-09b.  connections(pid, time, remote) -> per process and remote
    address: events, median_gap and mad_gap (seconds), near_share (of the gaps,
    those within ``near`` percent of the median), beacon (``least`` gaps,
    ``share`` percent of them near, the median over zero)."""
    keys = ["pid", "remote"]
    c = connections.withColumn("at", time_at(F.col("time"))).where("at is not null and remote <> ''")
    g = gaps(c, keys)
    middle = weighted_median(g, keys, "gap", "_m2")
    dev = g.join(middle, keys).withColumn("_d", F.abs(2 * F.col("gap") - F.col("_m2")))
    mad = weighted_median(dev.groupBy(*keys, "_d").agg(F.sum("n").alias("n")), keys, "_d", "_d2")
    counts = dev.groupBy(*keys).agg(F.sum("n").alias("gaps"), F.sum(F.when(100 * F.col("_d") <= near * F.col("_m2"), F.col("n")).otherwise(0)).alias("_near"), F.first("_m2").alias("_m2"))
    return counts.join(mad, keys).select(
        *keys, (F.col("gaps") + 1).alias("events"), (F.col("_m2") / 2.0).alias("median_gap"), (F.col("_d2") / 4.0).alias("mad_gap"),
        (F.col("_near") / F.col("gaps")).alias("near_share"),
        ((F.col("gaps") >= least) & (F.col("_m2") > 0) & (100 * F.col("_near") >= share * F.col("gaps"))).alias("beacon"))


# ---------------------------------------------------------------- consensus and outliers

def path_consensus(modules: DataFrame) -> DataFrame:
    """DOC-03.  modules(pid, name, path): per module name (without case) and
    path: rows, processes, share of the name's rows, the path that most rows
    have (ties: the first by text; an empty path is a class of its own), and
    ``unexpected``: another path than that, or an empty one.

    Rows are added up by (name, path, pid) before a name's paths meet, so a
    name that holds a third of all rows is as small as its paths."""
    m = modules.where("name <> ''").select(F.lower("name").alias("name"), F.lower("path").alias("path"), "pid")
    per = m.groupBy("name", "path", "pid").agg(F.count("*").alias("n")).groupBy("name", "path").agg(F.sum("n").alias("rows"), F.count("*").alias("processes"))
    total = per.groupBy("name").agg(F.sum("rows").alias("_all"), F.max("rows").alias("_most"))
    usual = per.join(total, "name").where("rows = _most").groupBy("name").agg(F.min("path").alias("usual_path"), F.first("_all").alias("_all"))
    return per.join(usual, "name").select("name", "path", "rows", "processes", (F.col("rows") / F.col("_all")).alias("share"), "usual_path",
                                          ((F.col("path") != F.col("usual_path")) | (F.col("path") == "")).alias("unexpected"))


def exact_quantiles(rows: DataFrame, group: str, value: str, shares: list[tuple[int, int]], whole: int = 2_000) -> DataFrame:
    """group, n, q0, q1, ...: the element number floor((n - 1) * a / b) (from
    0, in order) for each share a/b.  A mergeable summary brackets each element
    within half a percent of the ranks, and one more pass counts what lies
    below and orders only what lies inside; groups up to ``whole`` rows are
    ordered whole."""
    accuracy, slack = 1_000, 0.005
    at = [max(0.0, a / b - slack) for a, b in shares] + [min(1.0, a / b + slack) for a, b in shares]
    summary = rows.groupBy(group).agg(F.count("*").alias("n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"),
                                      F.percentile_approx(value, F.array(*map(F.lit, at)), F.lit(accuracy)).alias("_q"))
    k = len(shares)
    out = summary.select(group, "n")
    for i, (a, b) in enumerate(shares):
        small = F.col("n") <= whole
        brackets = summary.select(group, F.expr(f"((n - 1) * {a}) div {b}").alias("_rank"),
                                  F.when(small, F.col("_lo")).otherwise(F.col("_q")[i]).alias("_from"), F.when(small, F.col("_hi")).otherwise(F.col("_q")[k + i]).alias("_to"))
        counted = rows.join(brackets, group).where(F.col(value) <= F.col("_to")).groupBy(
            group, "_rank", F.when(F.col(value) >= F.col("_from"), F.col(value)).alias("_v")).agg(F.count("*").alias("_n"))
        w = Window.partitionBy(group).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
        found = counted.withColumn("_c", F.sum("_n").over(w)).where("_v is not null and _c > _rank and _c - _n <= _rank")
        out = out.join(found.select(group, F.col("_v").alias(f"q{i}")), group)
    return out


def stamp_outliers(modules: DataFrame, now: int) -> DataFrame:
    """DOC-04.  modules(pid, name, stamp): compile times that are in the
    future (after ``now``), at the epoch (1970), or beyond the fences (1.5
    interquartile ranges outside the quartiles of the stamps of that name):
    pid, name, stamp, reason (in that order)."""
    m = modules.select("pid", F.lower("name").alias("name"), F.col("stamp"), F.col("stamp").try_cast("long").alias("v")).where("v is not null")
    q = exact_quantiles(m.select("name", "v"), "name", "v", [(1, 4), (3, 4)])
    low, high = 5 * F.col("q0") - 3 * F.col("q1"), 5 * F.col("q1") - 3 * F.col("q0")      # twice the fences
    reason = (F.when(F.col("v") > now, "future").when(F.col("v") < 31_536_000, "epoch")
              .when(2 * F.col("v") < low, "below fence").when(2 * F.col("v") > high, "above fence"))
    return m.join(q, "name").withColumn("reason", reason).where("reason is not null").select("pid", "name", "stamp", "reason")


# ---------------------------------------------------------------- access masks

def mask_of(text: Column) -> Column:
    """The lower 32 bits of a hexadecimal mask of any width; NULL when it is none."""
    digits = F.regexp_replace(text, "^0[xX]", "")
    return F.when(text.rlike(r"^(0[xX])?[0-9a-fA-F]+$"), F.conv(F.right(digits, F.lit(8)), 16, 10).cast("long"))


def rights_of(mask: Column, table: dict[str, int]) -> Column:
    """Names of the rights in a mask, in the table's order."""
    return F.array_join(F.filter(F.array(*(F.when(mask.bitwiseAND(bit) == bit, F.lit(name)) for name, bit in table.items())), lambda x: x.isNotNull()), "|")


def process_handles(handles: DataFrame) -> DataFrame:
    """DOC-07.  handles(pid, handle, access, type, detail) of type Process:
    rights by name, reads_and_writes (both memory rights), lsass (the detail
    names it), dumping (a memory-reading handle to it held by another)."""
    mask = mask_of(F.col("access"))
    need = R.PROCESS_RIGHTS["VM_READ"] | R.PROCESS_RIGHTS["VM_WRITE"]
    lsass = F.lower("detail").contains("lsass.exe")
    reads = F.coalesce(mask.bitwiseAND(R.PROCESS_RIGHTS["VM_READ"]) != 0, F.lit(False))
    return handles.where(F.lower("type") == "process").select(
        "pid", "handle", "access", F.coalesce(rights_of(mask, R.PROCESS_RIGHTS), F.lit("")).alias("rights"),
        F.coalesce(mask.bitwiseAND(need) == need, F.lit(False)).alias("reads_and_writes"), lsass.alias("lsass"), (lsass & reads).alias("dumping"))


# ---------------------------------------------------------------- anti joins

def orphan_processes(processes: DataFrame) -> DataFrame:
    """DOC-01.  processes(pid, ppid, name, parent_name) with a PID and without
    a parent: no parent name of their own, and no process with their parent's PID."""
    p = processes.where("pid <> '' and parent_name = ''")
    known = processes.where("pid <> ''").select(F.col("pid").alias("ppid")).distinct()
    return p.join(known, "ppid", "left_anti").select("pid", "ppid", "name")


def unknown_drivers(devices: DataFrame, drivers: DataFrame) -> DataFrame:
    """DOC-08.  devices(device, driver_path) whose driver is not listed (paths without case)."""
    listed = drivers.select(F.lower("path").alias("_p")).distinct()
    d = devices.withColumn("_p", F.lower("driver_path"))
    return d.join(listed, "_p", "left_anti").select("device", "driver_path")


# ---------------------------------------------------------------- timeline

EVENT = ["time", "type", "action", "pid", "path"]


def timeline(parts: list[DataFrame], types: list[str] | None = None) -> DataFrame:
    """DOC-09a.  Events of all sources in one schema (time, type, action, pid,
    path), those of unknown time left out, filtered by type, in order of all
    columns: the partitions are ranges of it."""
    all_ = reduce(DataFrame.unionByName, [p.select(*EVENT) for p in parts]).where(time_at(F.col("time")).isNotNull())
    chosen = all_.where(F.col("type").isin(types)) if types else all_
    return chosen.repartitionByRange(*EVENT).sortWithinPartitions(*EVENT)


def numbered_timeline(written: DataFrame) -> DataFrame:
    """position (from 0) of each row of a written ``timeline`` whose ``_at`` is
    its partition (upper bits) and row (lower 33)."""
    part = F.shiftright("_at", 33)
    sizes = written.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_base"))       # a row for each written partition
    return written.withColumn("_p", part).join(F.broadcast(before), "_p").select(
        (F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias("position"), *EVENT)
