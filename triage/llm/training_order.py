"""Operator 9, training-order materialisation.

Texts become sequences of at most ``SEQUENCE`` token ids (and an end id).  The
sequences of a store are numbered 0..N-1, and a keyed Feistel network over the
smallest even number of bits that holds N, walked along its cycle until the
value is below N, gives each its global slot: a permutation that needs no sort
and no memory and can be computed (and inverted) for any single sequence.

A shard holds ``SHARD`` slots in order, each a record of one fixed stride, so
that slot s lies in shard s div SHARD at byte (s mod SHARD) * stride.  Range
partitions by shard write them; a row of the output is a run of ``RUN``
records.  A reader that has seen k slots goes on at slot k with the shards
that are left: ``read_from`` prunes the earlier ones and skips inside the
first.

Record: doc_id (8 bytes, signed), flags (2: bit 0 null doc_id), number of ids
(2), part of the text (4), ids (2 each, 0 behind the last); little-endian.

Null and empty texts are the end id alone; repeated rows are sequences of
their own; other columns are ignored; an empty table gives no shards.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage.llm.common import mix, saved
from triage.llm.word_ids import word_ids

SEQUENCE = 512
HEADER = np.dtype([("doc_id", "<i8"), ("null", "<u2"), ("n", "<u2"), ("part", "<u4")])
HEAD = HEADER.itemsize
STRIDE = HEAD + 2 * SEQUENCE
SHARD = 8_192
RUN = 512
KEY = 20_240_601
ROUNDS = 4


def feistel(x: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Keyed permutation of 0..n-1 (cycle-walking)."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))

    def once(v):
        left, right = v >> shift, v & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (mix(left ^ k) & mask), left
            else:
                left, right = right, left ^ (mix(right ^ k) & mask)
        return left << shift | right

    out = once(x.astype(np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def sequences(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """record: the sequences of every text, laid out as above."""

    def cut(batches):
        table = word_ids(tokenizer)
        for b in batches:
            doc_id = b.column("doc_id")
            null = doc_id.is_null().to_numpy(zero_copy_only=False)
            doc_id = doc_id.fill_null(0).to_numpy(zero_copy_only=False)
            for rows, ids, edges in table.encoded(b.column("text"), end_id):
                n = np.diff(edges)
                count = -(-n // SEQUENCE)
                first = np.append(0, count.cumsum())
                row = np.repeat(np.arange(len(rows)), count)
                records = np.zeros((len(row), STRIDE), np.uint8)
                head = records[:, :HEAD].view(HEADER).reshape(-1)
                part = np.arange(len(row)) - first[row]
                head["doc_id"], head["null"], head["part"] = doc_id[rows[row]], null[rows[row]], part
                head["n"] = np.minimum(SEQUENCE, n[row] - part * SEQUENCE)
                at = np.arange(len(ids)) - np.repeat(edges[:-1], n)
                records[:, HEAD:].view("<u2")[np.repeat(first[:-1], n) + at // SEQUENCE, at % SEQUENCE] = ids
                size = np.arange(len(row) + 1, dtype=np.int32) * STRIDE
                yield pa.RecordBatch.from_arrays([pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(size), pa.py_buffer(records)])], ["record"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "record binary")


def numbered(store: DataFrame) -> tuple[DataFrame, int]:
    """The store's rows with ``index`` 0..N-1, and N.  ``_id`` is a written
    monotonically increasing id: partition in the upper bits, row in the lower 33."""
    part = F.shiftright("_id", 33)
    sizes = store.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).toPandas().sort_values("_part")
    sizes["_base"] = sizes["_n"].cumsum() - sizes["_n"]
    n = int(sizes["_n"].sum())
    if not n:
        return store.withColumn("index", F.lit(0).cast("long")), 0
    bases = store.sparkSession.createDataFrame(sizes[["_part", "_base"]].astype("int64"))   # a row for each write task
    rows = store.withColumn("_part", part).join(F.broadcast(bases) if len(sizes) <= 100_000 else bases, "_part")
    return rows.withColumn("index", F.col("_base") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_part", "_base"), n


def materialised(docs: DataFrame, tokenizer: str, key: int = KEY, shard: int = SHARD) -> DataFrame:
    """shard, first_slot, n, payload: runs of records in training order."""
    store = saved(sequences(docs, tokenizer).withColumn("_id", F.monotonically_increasing_id()), "order-store")
    rows, n = numbered(store)

    @F.pandas_udf("long")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(feistel(index.to_numpy(), n, key))

    shards = max(1, -(-n // shard))
    placed = (rows.select(slot("index").alias("slot"), "record").withColumn("shard", F.expr(f"slot div {shard}"))
              .repartitionByRange(shards, "shard").sortWithinPartitions("slot"))

    def runs(batches):
        open_, first, last = [], None, None
        def emit():
            return pa.RecordBatch.from_arrays([pa.array([first // shard]), pa.array([first]), pa.array([len(open_)]), pa.array([b"".join(open_)], pa.binary())],
                                              ["shard", "first_slot", "n", "payload"])
        for b in batches:
            for s, r in zip(b.column("slot").to_pylist(), b.column("record").to_pylist()):
                if open_ and (s != last + 1 or len(open_) == RUN or s % shard == 0):
                    yield emit()
                    open_ = []
                if not open_:
                    first = s
                open_.append(r)
                last = s
        if open_:
            yield emit()

    return placed.mapInArrow(runs, "shard long, first_slot long, n long, payload binary")


def read_from(shards: DataFrame, slot: int = 0, shard: int = SHARD) -> DataFrame:
    """The records from a slot on: slot, shard, byte, doc_id, part, n_ids, ids
    (binary, unsigned 16-bit), ids_crc32."""

    def run(batches):
        for b in batches:
            for first, n, payload in zip(b.column("first_slot").to_pylist(), b.column("n").to_pylist(), b.column("payload")):
                skip = max(0, slot - first)
                records = np.frombuffer(payload.as_buffer(), np.uint8).reshape(n, STRIDE)[skip:]
                head = records[:, :HEAD].copy().view(HEADER).reshape(-1)
                at = first + skip + np.arange(len(records))
                ids = [r[HEAD:HEAD + 2 * size].tobytes() for r, size in zip(records, head["n"].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at), pa.array(at // shard), pa.array(at % shard * STRIDE), pa.array(head["doc_id"], mask=head["null"] & 1 == 1),
                     *(pa.array(head[c].astype(np.int64)) for c in ("part", "n")), pa.array(ids, pa.binary()), pa.array(list(map(zlib.crc32, ids)), pa.int64())],
                    ["slot", "shard", "byte", "doc_id", "part", "n_ids", "ids", "ids_crc32"])

    left = shards.where((F.col("shard") >= slot // shard) & (F.col("first_slot") + F.col("n") > slot))
    return left.select("first_slot", "n", "payload").mapInArrow(run, "slot long, shard long, byte long, doc_id long, part long, n_ids long, ids binary, ids_crc32 long")
