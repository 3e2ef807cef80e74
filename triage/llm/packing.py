"""Operator 8, best-fit packing: sum-of-squares rule.

Documents become token ids and one end id; those longer than a sequence are
cut into whole sequences, the last piece may be shorter.  A piece goes to the
open bin (or a new one) for which the sum over residual gaps g of N(g)^2 is
smallest afterwards, N(g) being the number of open bins with gap g; ties go
to the smallest remaining gap.

Pieces get a row number when they are written to the shared scratch folder
and are dealt by its hash to shards of about ``SHARD_PIECES`` pieces, each
packed by one task over its own bins, in hash order (on 40,000 pieces with
the sizes of real documents the rule needs 0.1 % more bins than the sum of
lengths in that order, 0.3 % longest first, 16 % shortest first).  A shard
leaves part-filled bins behind once, a few in some ten thousand.
The memory of a task is bounded by the shard size whatever the input.

Null and empty texts are one piece, the end id alone.  Repeated rows are
packed as often as they occur; null doc_ids stay null.  Other columns are
ignored.  An empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage.llm.common import saved, tidy
from triage.llm.word_ids import word_ids

CAPACITY = 4096
END_ID = 1
SHARD_PIECES = 40_000


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
           with_ids: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece, start, length, ids_crc32 (and ids,
    little-endian unsigned 32-bit, if asked for)."""

    def cut(batches):
        table = word_ids(tokenizer)
        for b in batches:
            for rows, ids, edges in table.encoded(b.column("text"), end_id):
                n = np.diff(edges)
                count = -(-n // capacity)                                   # a text has its end id at least
                row = np.repeat(np.arange(len(rows)), count)
                piece = np.arange(len(row)) - np.repeat(count.cumsum() - count, count)
                start = piece * capacity
                lo, hi = edges[row] + start, np.minimum(edges[row] + start + capacity, edges[row + 1])
                raw = ids.astype("<u4", copy=False).tobytes()
                parts = [raw[p:q] for p, q in zip((4 * lo).tolist(), (4 * hi).tolist())]
                out = [b.column("doc_id").take(pa.array(rows[row])), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(hi - lo, pa.int64()), pa.array(list(map(zlib.crc32, parts)), pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out, names = [*out, pa.array(parts, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        tidy(cut, keep=True), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each length in the order given, and the number of bins."""
    count = np.zeros(capacity + 1, np.int64)          # open bins by gap; gap 0 is closed and never counted
    stacks: dict[int, list[int]] = {}
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        rest = capacity - size
        # change of the sum / 2, for a bin of gap g = size..capacity-1: -N(g) + N(g - size) + 1; a new bin: N(rest) + 1/2
        best, gap = count[rest] + 0.5 if rest else 0.0, -1
        if size < capacity:
            new = count[:capacity - size] - count[size:capacity] + 1.0
            new[0] -= 0.5                              # a bin that becomes full leaves the sum
            new[count[size:capacity] == 0] = np.inf
            k = int(np.argmin(new))
            if new[k] <= best:
                gap = k + size
        if gap < 0:
            at, made, gap = made, made + 1, capacity
        else:
            at = stacks[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = at, capacity - gap
        left = gap - size
        if left:
            count[left] += 1
            stacks.setdefault(left, []).append(at)
    return bins, offsets, made


def pack(cut: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` column."""
    rows = saved(cut.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-rows.count() // shard_pieces))
    names = cut.columns
    dealt = (rows.withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards)))
             .repartition(shards, "_shard")
             .sortWithinPartitions("_shard", F.xxhash64("_row", F.lit(1)), "_row"))

    def place(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        shard = t.column("_shard").to_numpy()
        length = t.column("length").to_numpy()
        for s in np.unique(shard):
            at = np.flatnonzero(shard == s)
            bins, offsets, _ = sum_of_squares(length[at], capacity)
            part = t.take(pa.array(at)).select(names)
            part = part.append_column("sequence_id", pa.array(bins + (int(s) << 32), pa.int64()))
            part = part.append_column("offset", pa.array(offsets, pa.int64()))
            yield from part.combine_chunks().to_batches()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return dealt.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def packed_sequences(docs: DataFrame, tokenizer: str, **kw) -> DataFrame:
    """The sequences themselves: sequence_id, n_ids, ids (binary, little-endian
    unsigned 32-bit), doc_ids.  A sequence holds at most CAPACITY pieces, so
    the groups are bounded."""
    cut = saved(pieces(docs, tokenizer, with_ids=True).withColumn("_piece", F.monotonically_increasing_id()), "pieces-ids")
    placed = pack(cut.select("_piece", "length"), **kw).join(cut.drop("length"), "_piece")     # a shard's task holds lengths alone
    ordered = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return (placed.groupBy("sequence_id").agg(ordered.alias("p"))
            .select("sequence_id", F.aggregate("p.length", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_ids"),
                    F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"),
                    F.col("p.doc_id").alias("doc_ids")))
