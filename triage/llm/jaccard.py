"""Operator 5, n-gram Jaccard join: multiple-global-order filtering.

Documents link if the Jaccard similarity of their sets of distinct k-word
shingles reaches a threshold.  Documents with equal sets form one class; only
classes are compared.

A class x of n shingles can miss at most a = n - ceil(threshold * n) of them
in any partner, and at most b = n - ceil(2 * threshold * n / (1 + threshold))
in a partner of n shingles or more; for two sizes, both must share the
overlap o = ceil(threshold * (n + m) / (1 + threshold)).  Steps:

1. Every class gives its shingles whose hash lies under ``tau`` (somewhat more
   than a of them on average) as rows (shingle, class), dealt by shingle and
   sorted.  A shingle that no other class has is in no partner.  A class with
   more than a such shingles has no partner at all, and nearly all classes
   without near copies end here.  (The few classes with at most a shingles
   under tau give all their shingles at a second level, where they meet each
   other; against other classes the first level suffices, since one side there
   has more than a shingles.)
2. The remaining classes give all their shingles, again dealt and sorted.  Of u
   shingles that no other one has, and with the number of rows of a shared one
   (which stops at ``COUNTED``) as its rarity: of the shared shingles under any
   global order, a class's first b - u + 1 and a partner's of its size or more
   first a - u + 1 have one in common.  Three orders are used: rarity then
   hash, and two independent hashes.  Pairs come from a common shingle under
   the first order; their sizes and unshared shingles must leave room for the
   overlap, and they must share a prefix shingle under each further order,
   before they are verified on the whole sets.
3. First every class is compared with the class of fewest unshared shingles in
   each of its groups (a star, linear in the group), and linked classes get a
   common label; then only pairs of a group that have different labels are
   compared.  Groups of near copies are thus not expanded into all pairs, and
   no link between different components is lost.  Rows of such a group are dealt
   by its shingle and a class of sizes, and those that even the group's smallest
   set of the other side leaves no room for go; a group of more than ``GROUP_PAIRS``
   possible pairs is dealt anew by (its shingle, a prefix shingle under the next
   order), so that the filters intersect in the key of the shuffle, unless these
   rows would be more than its pairs.  What is still large is joined in cells of
   about ``CELL_ROWS`` rows a side, each a key of its own.

Sets are identified by a 64-bit hash of their content, shingles by 64-bit
hashes: the chance that any two of n different sets collide is below
n^2 / 2^65.  Null and empty texts have no shingles and are linked with nothing.
Repeated rows are one class.  Null doc_ids take part and are ignored in the
smallest id.  Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage.llm import common as C

COUNTED = 4096
GROUP_PAIRS, CELL_ROWS = 1 << 16, 1 << 12
BROADCAST_ROWS = 500_000


def _sets(buf, lo, hi, k: int):
    """(distinct shingles, their rows, number of rows), sorted by row and hash."""
    buf = C.LOWER[buf]
    ws, we, first = C.word_spans(buf, lo, hi, C.SPACE_WORDS)
    h, rows = C.shingles(C.span_hashes(buf, ws, we), first, k)
    return C.distinct_per_row(h, rows)


def _keys(h: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Order-free 64-bit key of each row's set."""
    acc = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(C.mix(h ^ C.MIX1), out=acc[1:])
    n = np.diff(edges)
    return C.mix((acc[edges[1:]] - acc[edges[:-1]]) ^ n.astype(np.uint64) * C.MIX2)


def missing(n, percent: int):
    """Most shingles of a set of n that a partner may lack."""
    return n - (percent * n + 99) // 100


class Jaccard:
    def __init__(self, words: int, percent: int):
        self.words, self.percent = words, percent
        self.tau = min(1.0, 1.6 * (1 - percent / 100) + 0.01)

    # ------------------------------------------------------------ scans

    def sets(self, docs: DataFrame, carry: list[str]) -> DataFrame:
        """The carried columns (among doc_id, text, lang, source, n_chars),
        _key (null without shingles), _n, _low (shingles under tau)."""
        words, limit, text = self.words, np.uint64(int(self.tau * (2 ** 64 - 1))), C.text_name(carry)

        @C.tidy
        def run(batches):
            for b in batches:
                size = b.num_rows
                key, n, low = np.zeros(size, np.uint64), np.zeros(size, np.int64), np.zeros(size, np.int64)
                for rows, buf, lo, hi in C.slices(b.column(text)):
                    h, row = _sets(buf, lo, hi, words)
                    edges = np.searchsorted(row, np.arange(len(rows) + 1))
                    key[rows], n[rows] = _keys(h, edges), np.diff(edges)
                    low[rows] = np.bincount(row[h < limit], minlength=len(rows))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(f"_in_{c}") for c in carry), pa.array(key.view(np.int64), mask=n == 0), pa.array(n), pa.array(low)],
                    [*carry, "_key", "_n", "_low"])

        given = C.sent(docs, carry)
        kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
        return given.mapInArrow(run, f"{kinds}, _key long, _n long, _low long")

    def shingle_rows(self, docs: DataFrame) -> DataFrame:
        """(t, key): shingles under tau of every class, and at the second
        level (lowest bit 1) all of those with too few under tau.  A task
        gives a class once."""
        words, percent, limit = self.words, self.percent, np.uint64(int(self.tau * (2 ** 64 - 1)))

        @C.tidy
        def run(batches):
            seen: set[int] = set()
            for b in batches:
                for rows, buf, lo, hi in C.slices(b.column("text")):
                    h, row = _sets(buf, lo, hi, words)
                    edges = np.searchsorted(row, np.arange(len(rows) + 1))
                    key, n = _keys(h, edges), np.diff(edges)
                    new = n > 0
                    for r in np.flatnonzero(new).tolist():
                        new[r] = key[r] not in seen
                        seen.add(key[r])
                    if len(seen) > 2_000_000:
                        seen.clear()
                    under = h < limit
                    few = np.bincount(row[under], minlength=len(rows)) <= missing(n, percent)
                    one, two = under & new[row], few[row] & new[row]
                    t = np.concatenate([h[one] & ~np.uint64(1), C.mix(h[two]) | np.uint64(1)])
                    yield pa.RecordBatch.from_arrays([C.as_long(t), C.as_long(key[np.concatenate([row[one], row[two]])])], ["t", "key"])

        return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "t long, key long")

    def whole_sets(self, docs: DataFrame, keys: DataFrame) -> DataFrame:
        """(key, h): the shingle hashes, packed, of the classes in ``keys``.
        A bit map of bounded size keeps most other classes out of the shuffle."""
        words = self.words
        shared = docs.sparkSession.sparkContext.broadcast(C.bitmap(keys, "key"))

        @C.tidy
        def run(batches):
            bits, seen = shared.value, set()
            for b in batches:
                for rows, buf, lo, hi in C.slices(b.column("text")):
                    h, row = _sets(buf, lo, hi, words)
                    edges = np.searchsorted(row, np.arange(len(rows) + 1))
                    key = _keys(h, edges)
                    want = C.in_bitmap(bits, key) & (np.diff(edges) > 0)
                    out = []
                    for r in np.flatnonzero(want).tolist():
                        if key[r] not in seen:
                            out.append(r)
                            seen.add(key[r])
                    if len(seen) > 2_000_000:
                        seen.clear()
                    yield pa.RecordBatch.from_arrays([C.as_long(key[out]), pa.array([h[edges[r]:edges[r + 1]].tobytes() for r in out], pa.binary())], ["key", "h"])

        texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
        return (texts.mapInArrow(run, "key long, h binary").join(keys, "key", "left_semi")
                .groupBy("key").agg(F.first("h").alias("h")))

    # ------------------------------------------------------------ candidates

    def remaining(self, docs: DataFrame, classes: DataFrame) -> DataFrame:
        """key, n of the classes with at most a unshared shingles (step 1)."""
        shared = _dealt(self.shingle_rows(docs))
        rows = (shared.groupBy("key", F.col("t").bitwiseAND(1).alias("level")).agg(F.count_distinct("t").alias("k"))
                .join(classes.select("key", "n", "low"), "key"))
        unshared = F.when(F.col("level") == 0, F.col("low")).otherwise(F.col("n")) - F.col("k")
        return rows.where(unshared <= F.expr(self.a)).select("key", "n").distinct()

    @property
    def a(self) -> str:
        return f"n - (({self.percent} * n + 99) div 100)"

    @property
    def b(self) -> str:
        return f"n - ((2 * {self.percent} * n + {99 + self.percent}) div {100 + self.percent})"

    def prefixes(self, whole: DataFrame) -> DataFrame:
        """(key, n, u, rb, p1, p2, p3): the shared shingles that come first
        under each order, a - u + 1 of them; the first rb = b - u + 1 are the
        prefix against partners of n shingles or more (step 2)."""
        size = F.expr("octet_length(h) div 8").cast("long")

        def run(batches):
            for b in batches:
                for k, h in zip(b.column("key").to_pylist(), b.column("h")):
                    t = np.frombuffer(h.as_py(), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.full(len(t), k, np.int64))], ["t", "key"])

        shared = _dealt(whole.select("key", "h").mapInArrow(run, "t long, key long"))
        rows = (shared.groupBy("key").agg(F.collect_list(F.struct("c", "t")).alias("s"))
                .join(whole.select("key", size.alias("n")), "key").withColumn("u", F.col("n") - F.size("s"))
                .withColumn("ra", F.expr(f"cast({self.a} - u + 1 as int)")).withColumn("rb", F.expr(f"cast({self.b} - u + 1 as int)"))
                .where("ra > 0"))

        def first(order):
            return F.slice(F.array_sort(F.transform("s", order)), F.lit(1), F.col("ra"))["t"]

        return rows.select("key", "n", "u", F.greatest("rb", F.lit(0)).alias("rb"),
                           first(lambda x: F.struct(x["c"], F.xxhash64(x["t"]), x["t"].alias("t"))).alias("p1"),
                           first(lambda x: F.struct(F.xxhash64(x["t"], F.lit(2)), x["t"].alias("t"))).alias("p2"),
                           first(lambda x: F.struct(F.xxhash64(x["t"], F.lit(3)), x["t"].alias("t"))).alias("p3"))

    def overlap(self, x: str, y: str) -> str:
        """Shingles that two classes of these sizes must share (SQL)."""
        return f"(({self.percent} * (n_{x} + n_{y}) + {99 + self.percent}) div {100 + self.percent})"

    def room(self, x: str, y: str, at: str = "0 * n") -> str:
        """Sizes, unshared shingles and those before the common one leave room for the overlap (SQL)."""
        return " and ".join(f"{at}_{z} + u_{z} + {self.overlap(x, y)} <= n_{z}" for z in (x, y))

    def filtered(self, pairs: DataFrame, pre: DataFrame) -> DataFrame:
        """Distinct (a, b) that share a prefix shingle under the further orders
        too; a prefix is as long as the two sizes need it."""
        side = lambda x: pre.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("u").alias(f"u_{x}"),
                                    F.col("p2").alias(f"p2_{x}"), F.col("p3").alias(f"p3_{x}"))
        part = lambda p, x: F.expr(f"slice({p}_{x}, 1, cast(n_{x} - u_{x} - {self.overlap('a', 'b')} + 1 as int))")
        return (pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(self.room("a", "b"))
                .where(F.arrays_overlap(part("p2", "a"), part("p2", "b")) & F.arrays_overlap(part("p3", "a"), part("p3", "b"))).select("a", "b"))

    def sided(self, open_: DataFrame) -> DataFrame:
        """Rows of mixed groups by (shingle, class of sizes): each class of sets
        as the larger one of a pair in its own class of sizes, and as the
        smaller one (small) in all that its partners may be in."""
        width = max(math.log(100 / self.percent), 0.01)
        of = lambda n: F.floor(F.log(F.expr(n)) / F.lit(width))  # noqa: E731  never falls as n grows
        cols = ["t", "key", "n", "u", "rb", "at", "r", "label"]
        # a larger partner leaves room for the overlap after ``at`` shared and u unshared shingles
        most = f"(({100 + self.percent} * (n - u - at)) div {self.percent} - n + 1)"
        small = open_.where("at < rb").select(*cols, F.lit(True).alias("small"), F.explode(F.sequence(of("n"), of(f"greatest(n, {most})"))).alias("s"))
        large = open_.select(*cols, F.lit(False).alias("small"), of("n").alias("s"))
        return small.union(large).select(F.xxhash64("t", "s").alias("g"), *cols[1:], "small")

    def reachable(self, rows: DataFrame) -> DataFrame:
        """Rows whose size, unshared shingles and place leave room for the overlap
        with the group's smallest set of the other side: every set that a row may
        be paired with is as large, and needs as large an overlap, or larger."""
        least = rows.groupBy("g").agg(F.min(F.when(F.col("small"), F.col("n"))).alias("lo_s"), F.min(F.when(~F.col("small"), F.col("n"))).alias("lo_l"))
        least = least.where("lo_s is not null and lo_l is not null").withColumnRenamed("g", "_g")
        other = "if(small, greatest(n, lo_l), lo_s)"
        need = f"(({self.percent} * (n + {other}) + {99 + self.percent}) div {100 + self.percent})"
        return rows.join(least, F.col("g") == F.col("_g")).where(f"at + u + {need} <= n").drop("_g", "lo_s", "lo_l")

    def facing(self, rows: DataFrame, sizes: DataFrame) -> DataFrame:
        """Rows with their group's sizes; those of its most frequent label only
        if the other side holds another label."""
        some = F.expr("label <> top or if(small, other_l, other_s) > 0")
        return rows.join(sizes.withColumnRenamed("g", "_g"), (F.col("g") == F.col("_g")) & some).drop("_g")

    def cross_pairs(self, open_: DataFrame, pre: DataFrame) -> DataFrame:
        """(a, b), with repeats: classes of different labels with a common
        prefix shingle (step 3)."""
        rows, parts = C.saved(self.reachable(self.sided(open_)), "jaccard-sides"), []

        def groups(r: DataFrame) -> DataFrame:
            """Of each group with two labels: smaller sides (s) and larger sides
            (l) of all labels, of its most frequent one (top) and of the others."""
            by = r.groupBy("g", "label").agg(F.count_if("small").alias("s"), F.count_if(~F.col("small")).alias("l"), F.sum("r").alias("e"))
            by = by.groupBy("g").agg(F.sum("s").alias("s"), F.sum("l").alias("l"), F.sum("e").alias("e"), F.count("*").alias("labels"),
                                     F.max(F.struct((F.col("s") + F.col("l")).alias("k"), "label", "s", "l")).alias("top"))
            return by.where("labels > 1 and s > 0 and l > 0").select(
                "g", "e", F.col("top.label").alias("top"), F.col("top.s").alias("top_s"), F.expr("s - top.s").alias("other_s"),
                F.expr("l - top.l").alias("other_l"), "l")

        for order in ("p2", "p3"):
            sizes = C.saved(groups(rows), "jaccard-groups")
            pairs = "(cast(other_s as double) * l + cast(top_s as double) * other_l)"
            many = f"{pairs} > {GROUP_PAIRS} and e < {pairs}"
            parts.append(self.facing(rows, sizes.where(f"not ({many})").drop("e")))
            if sizes.where(many).isEmpty():
                break
            next_ = pre.select("key", F.posexplode(order).alias("at2", "t2"))
            rows = (rows.join(sizes.where(many).select("g"), "g").join(next_, "key").where("not small or at2 < rb")
                    .select(F.xxhash64("g", "t2").alias("g"), "key", "n", "u", "rb", F.greatest("at", "at2").alias("at"), "r", "label", "small"))
            rows = C.saved(self.reachable(rows), "jaccard-sides")
        else:
            parts.append(self.facing(rows, groups(rows).drop("e")))
        dealt = reduce(DataFrame.unionByName, parts)

        def side(x: str, rows: DataFrame, own: str, other: str) -> DataFrame:
            """``own`` and ``other``: how many rows the two sides have."""
            mine = F.pmod(F.xxhash64("key"), F.expr(f"{own} div {CELL_ROWS} + 1"))
            cells = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"{other} div {CELL_ROWS}")))
            return rows.where(f"{other} > 0").select(
                "g", "tag", mine.alias(f"cell_{x}"), cells.alias(f"cell_{'y' if x == 'x' else 'x'}"),
                *(F.col(c).alias(f"{c}_{x}") for c in ("key", "n", "u", "rb", "at", "label")))

        # tag 1: a smaller side of another label with any larger side; tag 2: one of the top label with one of another label
        tags = F.expr("if(label <> top, if(small, array(1), array(1, 2)), if(small, array(2), array(1)))")
        dealt = dealt.withColumn("tag", F.explode(tags))
        small, large = "if(tag = 1, other_s, top_s)", "if(tag = 1, l, other_l)"
        return (side("x", dealt.where("small"), small, large).join(side("y", dealt.where("not small"), large, small), ["g", "tag", "cell_x", "cell_y"])
                .where(f"label_x <> label_y and (n_x < n_y or n_x = n_y and key_x < key_y and at_y < rb_y) and {self.room('x', 'y', 'at')}")
                .select(F.least("key_x", "key_y").alias("a"), F.greatest("key_x", "key_y").alias("b")))

    def verified(self, pairs: DataFrame, whole: DataFrame) -> DataFrame:
        """The pairs that link, by their whole sets."""
        percent = self.percent

        def run(batches):
            for b in batches:
                keep = []
                for x, y in zip(b.column("h_a"), b.column("h_b")):
                    x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], ["a", "b"])

        joined = (pairs.join(whole.select(F.col("key").alias("a"), F.col("h").alias("h_a")), "a")
                  .join(whole.select(F.col("key").alias("b"), F.col("h").alias("h_b")), "b"))
        return joined.select("a", "b", "h_a", "h_b").mapInArrow(run, "a long, b long")

    # ------------------------------------------------------------ links

    def links(self, docs: DataFrame, classes: DataFrame) -> DataFrame:
        """(a, b): links that connect exactly the linked classes."""
        left = C.saved(self.remaining(docs, classes), "jaccard-remaining")
        whole = C.saved(self.whole_sets(docs, left.select("key")), "jaccard-sets")
        pre = C.saved(self.prefixes(whole), "jaccard-prefixes")
        rows = C.saved(pre.select("key", "n", "u", "rb", F.size("p1").alias("r"), F.posexplode("p1").alias("at", "t")), "jaccard-rows")
        centre = rows.groupBy("t").agg(F.min(F.struct("u", "key")).alias("c"), F.min("key").alias("x"), F.max("key").alias("z"))
        centre = centre.where("x < z").select("t", F.col("c.key").alias("c"))
        stars = rows.join(centre, "t").where("key <> c").select(F.least("key", "c").alias("a"), F.greatest("key", "c").alias("b"))
        one = C.saved(self.filtered(stars, pre), "jaccard-stars")
        linked = C.saved(self.verified(one, whole), "jaccard-links")
        label = components(linked)
        known = rows.join(label.select(F.col("v").alias("key"), "label"), "key", "left").withColumn("label", F.coalesce("label", "key"))
        mixed = known.groupBy("t").agg(F.min("label").alias("x"), F.max("label").alias("z")).where("x < z").select("t")
        open_ = C.saved(known.join(mixed, "t", "left_semi"), "jaccard-open")
        cross = self.cross_pairs(open_, pre).distinct().join(one, ["a", "b"], "left_anti")
        more = self.verified(C.saved(self.filtered(cross, pre), "jaccard-cross"), whole)
        return C.saved(linked.union(more), "jaccard-links")

    def documents(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_shingles, component_id and _key, _rep: the smallest
        (doc_id, key) of the component."""
        sets = C.saved(self.sets(docs, ["doc_id"]), "jaccard-docs")
        classes = C.saved(sets.where("_key is not null").groupBy(F.col("_key").alias("key"))
                          .agg(F.first("_n").alias("n"), F.first("_low").alias("low"), F.min("doc_id").alias("least")), "jaccard-classes")
        label = components(self.links(docs, classes))
        named = (classes.join(label.select(F.col("v").alias("key"), "label"), "key", "left")
                 .withColumn("label", F.coalesce("label", "key")))
        rep = named.groupBy("label").agg(F.min("least").alias("component_id"),
                                         F.min(F.struct(F.coalesce("least", F.lit(2 ** 63 - 1)).alias("doc_id"), "key")).alias("_rep"))
        out = named.join(rep, "label").select(F.col("key").alias("_key"), "component_id", "_rep")
        return (sets.join(out, "_key", "left")
                .select("doc_id", F.col("_n").alias("n_shingles"),
                        F.when(F.col("_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "_key", "_rep"))

    def representatives(self, docs: DataFrame, columns: list[str]) -> DataFrame:
        """Documents with one of each component (its smallest doc_id); those
        without shingles all stay.  Of equal rows one stays."""
        judged = C.saved(self.documents(docs), "jaccard-judged")
        gone = judged.where(F.col("_key").isNotNull() & ((F.coalesce("doc_id", F.lit(2 ** 63 - 1)) != F.col("_rep.doc_id")) | (F.col("_key") != F.col("_rep.key"))))
        gone = C.saved(gone.select("doc_id", F.col("_key").alias("key")).distinct(), "jaccard-gone")
        gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
        twice = (judged.where("_key is not null").groupBy("doc_id", "_key").count().where("count > 1")
                 .select("doc_id", F.col("_key").alias("key")))
        rows = self.sets(docs, columns)
        match = rows["doc_id"].eqNullSafe(gone["doc_id"]) & (rows["_key"] == gone["key"])
        kept = rows.join(gone, match, "left_anti")
        if twice.isEmpty():
            return kept.select(*columns)
        same = kept["doc_id"].eqNullSafe(twice["doc_id"]) & (kept["_key"] == twice["key"])
        return kept.join(twice, same, "left_anti").select(*columns).union(
            kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", "_key"]).select(*columns))


def _dealt(rows: DataFrame) -> DataFrame:
    """(t, key, c): rows (t, key) of shingles that two classes have."""
    return rows.repartition("t").sortWithinPartitions("t").mapInArrow(_shared, "t long, key long, c int")


def _shared(batches):
    """From rows sorted by t: those whose t has two different keys, with the
    number of its rows, which stops at COUNTED.  Holds one group's rows up to
    that number; larger groups pass through."""
    t_open, keys, flowing = None, [], False

    def group(keys):
        k = np.concatenate(keys)
        return k if (k != k[0]).any() else None

    out_t, out_k, out_c = [], [], []

    def emit(t, k, c):
        out_t.append(np.full(len(k), t, np.int64))
        out_k.append(k)
        out_c.append(np.full(len(k), c, np.int32))

    def flush():
        rb = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_t, out_k, out_c)], ["t", "key", "c"])
        for x in (out_t, out_k, out_c):
            x.clear()
        return rb

    for b in batches:
        t, k = b.column("t").to_numpy(), b.column("key").to_numpy()
        if not len(t):
            continue
        starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        ends = np.append(starts[1:], len(t))
        # whole groups inside the batch at once; the first and the last may go on in other batches
        inner = (np.arange(len(starts)) > 0) & (np.arange(len(starts)) < len(starts) - 1)
        low, high = np.minimum.reduceat(k, starts), np.maximum.reduceat(k, starts)
        size = ends - starts
        good = inner & (low < high)
        pick = np.repeat(good, size)
        out_t.append(t[pick])
        out_k.append(k[pick])
        out_c.append(np.repeat(np.minimum(size[good], COUNTED), size[good]).astype(np.int32))
        for g in dict.fromkeys((0, len(starts) - 1)):
            part = k[starts[g]:ends[g]]
            if t[starts[g]] != t_open:
                if keys and not flowing and (whole := group(keys)) is not None:
                    emit(t_open, whole, min(len(whole), COUNTED))
                t_open, keys, flowing = t[starts[g]], [], False
            if flowing:
                emit(t_open, part, COUNTED)
            else:
                keys.append(part)
                if sum(map(len, keys)) >= COUNTED and (whole := group(keys)) is not None:
                    emit(t_open, whole, COUNTED)
                    keys, flowing = [], True
        if out_t:
            yield flush()
    if keys and not flowing and (whole := group(keys)) is not None:
        emit(t_open, whole, min(len(whole), COUNTED))
    if out_t:
        yield flush()


def components(links: DataFrame) -> DataFrame:
    """(v, label) of every linked vertex: the smallest vertex of its
    component, by neighbours' minima and pointer jumping."""
    both = C.saved(links.select(F.col("a").alias("v"), F.col("b").alias("u"))
                   .union(links.select(F.col("b").alias("v"), F.col("a").alias("u"))).distinct(), "links")
    label = C.saved(both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("label")), "labels")
    while True:
        near = both.join(label.select(F.col("v").alias("u"), F.col("label").alias("lu")), "u").groupBy("v").agg(F.min("lu").alias("lu"))
        step = label.join(near, "v").select("v", "label", F.least("label", "lu").alias("next"))
        # the label's own label
        jump = step.join(label.select(F.col("v").alias("next"), F.col("label").alias("far")), "next").select(
            "v", F.col("label").alias("old"), F.least("next", "far").alias("label"))
        jump = C.saved(jump, "labels")
        moved = jump.where("label <> old").isEmpty()
        label = jump.select("v", "label")
        if moved:
            return label
