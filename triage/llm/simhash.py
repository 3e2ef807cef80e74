"""Operator 11, SimHash near-duplicates: generalised pigeonhole.

A text's fingerprint has bit i set if over half of the 64-bit hashes of its
word shingles (repeats included) have it set.  Fingerprints link at
``distance`` or fewer differing bits (two, the only value that the two-sided
probe below is written for); texts of one fingerprint are one class, and only
distinct fingerprints are compared.

If the 64 bits are cut into parts and a pair differs in at most 2 bits, then
for any budgets e_1 + e_2 + ... = 3 there is a part i in which the two differ
in fewer than e_i bits: a part without budget need not be looked at, one with
budget 1 is probed for the equal value, one with budget 2 for all values at
distance 1 as well, and so on.  Each fingerprint is free in its choice,
since every partner within the distance is found by its own probes.

1. The parts: bits that are correlated over all distinct fingerprints are
   grouped, so that what is common to many texts falls into few parts and the
   others tell them apart.
2. The budgets: exact counts of every part's values (one number for each
   value, a table of fixed size) give the candidates of every budget, and a
   dynamic program over the parts picks the split of 3 with the fewest probes
   and candidates for each fingerprint.
3. Where even the best split costs more than ``WHOLE_COST``, all the budget
   goes to one part of all 64 bits, probed from both sides: every such
   fingerprint is dealt to the 65 values at distance 0 and 1, and two of them
   within distance 2 meet in one.  A value has 65 such neighbours at most, so
   these groups are bounded whatever the corpus.  A pair of which only one
   side does so is found by the other side's probes.
4. Part values held by more than ``WHOLE_COST`` fingerprints are in no chosen
   probe, and leave the index: no key of the join is hot.  Candidates are
   verified on all 64 bits, and links become components.

Groups of near copies thus cost a bounded number of rows a fingerprint, and
no link is lost.  There are four parts up to 2^20 distinct fingerprints and
three beyond (tables of 1 MB and 32 MB).

Texts without words (null, empty, blank) have fingerprint zero and are linked
like any other; fewer words than a shingle are one shingle.  Repeated rows are
one class.  Null doc_ids take part and are ignored in the smallest id.  Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage.llm import common as C
from triage.llm.jaccard import components

BITS = 64
DISTANCE = 2
SEED = 42
#: Rows of the two-sided probe of all bits: 65 of each side.
WHOLE_COST = 2 * (BITS + 1)
#: Distinct fingerprints up to which there are four parts of 16 bits.
FOUR_PARTS = 1 << 20
CELL = 1024
#: Hashes whose bits are counted at once.
HASHES_AT_ONCE = 1 << 16


# ---------------------------------------------------------------- fingerprints

def fingerprint(text: bytes, words: int = 3) -> int:
    w = text.lower().split()          # bytes: lower() changes A-Z alone, split() knows the six ASCII spaces
    n = max(1, len(w) - words + 1)
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.append(0, ends[:-1] + 1)[:n].tolist()
    ends = ends[min(words, len(w)) - 1:].tolist()
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, HASHES_AT_ONCE):
        to = min(n, at + HASHES_AT_ONCE)
        h = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[at:to], ends[at:to])), np.uint64, to - at)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp (the 64 bits as a long)."""

    def run(batches):
        for b in batches:
            fp = np.zeros(b.num_rows, np.uint64)
            for rows, buf, lo, hi in C.slices(b.column("_text")):
                data = buf.tobytes()
                for r, s, e in zip(rows.tolist(), lo.tolist(), hi.tolist()):
                    fp[r] = fingerprint(data[s:e], words)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), C.as_long(fp)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).mapInArrow(run, f"doc_id {kind}, fp long")


# ---------------------------------------------------------------- parts

def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.view(np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlation(classes: DataFrame) -> np.ndarray:
    """64 x 64 correlations of the bits over all distinct fingerprints."""

    def count(batches):
        both, n = np.zeros((BITS, BITS), np.int64), 0
        for b in batches:
            x = _bits(b.column("fp").to_numpy()).astype(np.float32)     # sums of a batch stay exact below 2^24 rows
            both += (x.T @ x).astype(np.int64)
            n += len(x)
        cells = np.append(both.ravel(), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "n"])

    got = classes.select("fp").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    cells = np.zeros(BITS * BITS + 1)
    cells[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    n = max(cells[-1], 1)
    both = cells[:-1].reshape(BITS, BITS) / n
    mean = np.diag(both)
    dev = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    return (both - np.outer(mean, mean)) / np.outer(dev, dev)


def grouped_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups: each begins with the most correlated pair that
    is left and takes the bit with the largest sum of correlations to it."""
    strength, left, out = np.abs(corr), list(range(BITS)), []
    for p in range(parts):
        size = BITS * (p + 1) // parts - BITS * p // parts
        group = list(max(combinations(left, 2), key=lambda ij: (strength[ij], -ij[0], -ij[1])))
        while len(group) < size:
            group.append(max((i for i in left if i not in group), key=lambda i: (strength[i, group].sum(), -i)))
        out.append(sorted(group))
        left = [i for i in left if i not in group]
    return out


def part_values(fp: np.ndarray, groups: list[list[int]]) -> list[np.ndarray]:
    fp = fp.view(np.uint64)
    out = []
    for g in groups:
        v = np.zeros(len(fp), np.uint64)
        for k, bit in enumerate(g):
            v |= (fp >> np.uint64(bit) & np.uint64(1)) << np.uint64(k)
        out.append(v.astype(np.int64))
    return out


def value_counts(classes: DataFrame, groups: list[list[int]]) -> list[np.ndarray]:
    """Fingerprints with each value of each part, as dense arrays."""

    def rows(batches):
        for b in batches:
            v = part_values(b.column("fp").to_numpy(), groups)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(v), dtype=np.int32), b.num_rows)), pa.array(np.concatenate(v))], ["part", "value"])

    def packed(batches):
        for b in batches:
            cells = []
            for at, n in zip(b.column("at").to_pylist(), b.column("n").to_pylist()):
                c = np.zeros(CELL, "<u4")
                c[at] = n
                cells.append(c.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("cell"), pa.array(cells, pa.binary())], ["part", "cell", "counts"])

    counted = classes.select("fp").mapInArrow(rows, "part int, value long").groupBy("part", "value").agg(F.count("*").alias("n"))
    cells = (counted.groupBy("part", F.expr(f"value div {CELL}").alias("cell"))
             .agg(F.collect_list(F.struct((F.col("value") % CELL).alias("at"), "n")).alias("s"))
             .select("part", "cell", F.col("s.at").alias("at"), F.col("s.n").alias("n"))
             .mapInArrow(packed, "part int, cell long, counts binary"))
    tables = [np.zeros(1 << len(g), np.uint32) for g in groups]
    for r in cells.collect():          # at most 2^16 * 4 or 2^23 counts of 4 bytes
        tables[r["part"]][r["cell"] * CELL:(r["cell"] + 1) * CELL] = np.frombuffer(r["counts"], "<u4")
    return tables


# ---------------------------------------------------------------- budgets

def flips(width: int, most: int) -> np.ndarray:
    """The xor masks of at most ``most`` bits."""
    return np.array([sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(width), k)], np.int64)


def part_costs(values: list[np.ndarray], counts: list[np.ndarray]) -> np.ndarray:
    """(part, budget, row) probes and candidates of budgets 0..DISTANCE + 1; probes alone beyond WHOLE_COST are infinite."""
    cost = np.full((len(values), DISTANCE + 2, len(values[0])), np.inf)
    for p, (v, c) in enumerate(zip(values, counts)):
        cost[p, 0] = 0
        for budget in range(1, DISTANCE + 2):
            masks = flips(len(c).bit_length() - 1, budget - 1)
            if len(masks) > WHOLE_COST:
                break
            total = np.zeros(len(v), np.int64)
            for m in masks.tolist():
                total += c[v ^ m]
            cost[p, budget] = total + len(masks)
    return cost


def allocated(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(budget of each part and row, least cost of each row), by dynamic
    programming over the parts; the budgets of a row add up to DISTANCE + 1."""
    parts, budgets, n = cost.shape
    best = np.full((parts + 1, budgets, n), np.inf)
    best[0, 0] = 0
    pick = np.zeros((parts, budgets, n), np.int8)
    for p in range(parts):
        for total in range(budgets):
            options = np.stack([best[p, total - e] + cost[p, e] for e in range(total + 1)])
            pick[p, total] = options.argmin(axis=0)
            best[p + 1, total] = options.min(axis=0)
    left, out = np.full(n, budgets - 1), np.zeros((parts, n), np.int64)
    for p in range(parts - 1, -1, -1):
        out[p] = pick[p, left, np.arange(n)]
        left = left - out[p]
    return out, best[parts, budgets - 1]


def links(classes: DataFrame) -> DataFrame:
    """fp of all distinct fingerprints -> (a, b): links that connect exactly
    the fingerprints within the distance."""
    spark, n = classes.sparkSession, classes.count()
    groups = grouped_bits(correlation(classes), 4 if n <= FOUR_PARTS else 3)
    parts = len(groups)
    table = spark.sparkContext.broadcast(value_counts(classes, groups))

    def indexed(batches):
        counts = table.value
        for b in batches:
            fp = b.column("fp").to_numpy()
            part, value, key = [], [], []
            for p, v in enumerate(part_values(fp, groups)):
                cool = counts[p][v] <= WHOLE_COST
                part.append(np.full(int(cool.sum()), p, np.int32))
                value.append(v[cool])
                key.append(fp[cool])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (part, value, key)], ["part", "value", "y"])

    def probed(batches):
        counts = table.value
        ball = np.append(0, np.uint64(1) << np.arange(BITS, dtype=np.uint64)).astype(np.uint64)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                fp = b.column("fp").slice(at, 4096).to_numpy()
                values = part_values(fp, groups)
                budget, cost = allocated(part_costs(values, counts))
                split = cost <= WHOLE_COST
                part, value, key = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for p, v in enumerate(values):
                    for e in range(1, DISTANCE + 2):
                        rows = np.flatnonzero(split & (budget[p] == e))
                        if len(rows):
                            masks = flips(len(groups[p]), e - 1)
                            part.append(np.full(len(rows) * len(masks), p, np.int32))
                            value.append((v[rows][:, None] ^ masks).ravel())
                            key.append(np.repeat(fp[rows], len(masks)))
                whole = fp[~split]
                part.append(np.full(len(whole) * len(ball), parts, np.int32))
                value.append((whole.view(np.uint64)[:, None] ^ ball).ravel().view(np.int64))
                key.append(np.repeat(whole, len(ball)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (part, value, key)], ["part", "value", "x"])

    index = classes.select("fp").mapInArrow(indexed, "part int, value long, y long")
    probes = C.saved(classes.select("fp").mapInArrow(probed, "part int, value long, x long"), "simhash-probes")
    found = (probes.where(F.col("part") < parts).join(index, ["part", "value"])
             .where((F.col("x") != F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= DISTANCE))
             .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    met = (probes.where(F.col("part") == parts).groupBy("value").agg(F.collect_list("x").alias("s"))     # 65 at most
           .where(F.size("s") > 1).select(F.array_min("s").alias("a"), F.explode("s").alias("b")).where("a <> b"))
    return C.saved(found.union(met).distinct(), "simhash-links")


# ---------------------------------------------------------------- documents

def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fingerprint (16 hex digits), component_id
    (the smallest doc_id that is reachable by links)."""
    rows = C.saved(fingerprints(docs, words), "simhash-docs")
    classes = C.saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    label = components(links(classes.select("fp")))
    named = classes.join(label.select(F.col("v").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    out = named.join(least, "label").select("fp", "component_id")
    return rows.join(out, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
