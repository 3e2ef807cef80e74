"""Helpers shared by the operators: table access, shared scratch tables and
vectorised word / line hashing over Arrow text buffers."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triage.session import shared_scratch, ship_package

U64 = np.uint64
MIX1, MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: Odd base of the polynomial word hash and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
#: Texts are worked through in slices of about so many bytes.
SLICE_BYTES = 1 << 20
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Texts go to Python workers in batches of BATCH_BYTES: ten thousand rows
    (Spark's own bound) can be any amount of memory."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Functions that empty the caches that an operator keeps in worker processes.
WORKER_CACHES: list = []


def tidy(run, keep: bool = False):
    """Around the function of a mapInArrow: a task begins without the worker
    caches of other operators (unless it is to ``keep`` them), and what it has
    freed goes back to the system at its end, so that workers that live on
    hold nothing of an earlier stage."""

    def around(batches):
        if not keep:
            for empty in WORKER_CACHES:
                empty()
        try:
            yield from run(batches)
        finally:
            _powers[:] = [np.ones(1, U64), np.ones(1, U64)]
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return around


def text_name(carry: list[str]) -> str:
    """The column that a task reads texts from: the carried one, sent once, or its own."""
    return "_in_text" if "text" in carry else "_text"


def sent(docs: DataFrame, carry: list[str], *more) -> DataFrame:
    """What goes to a task: the text under ``text_name`` and the carried columns as _in_<name>."""
    own = [] if "text" in carry else [F.coalesce("text", F.lit("")).alias("_text")]
    return docs.select(*own, *more, *(F.col(c).alias(f"_in_{c}") for c in carry))


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: cuts lineage, and
    what later jobs read stays the same if executors are lost."""
    spark = df.sparkSession
    path = shared_scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bitmap(df: DataFrame, column: str, most: int = 1 << 28) -> np.ndarray:
    """Bit map of a column of mixed longs, 16 to 32 bits a row as far as ``most``
    bits: a filter of bounded size, after which an exact test follows."""
    bits = min(most, 1 << max(16, (16 * df.count()).bit_length()))
    bit = F.col(column).bitwiseAND(bits - 1)
    cells = df.select(bit.alias("b")).groupBy(F.shiftright("b", 5).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(b & 31 as int))")).alias("v")).toPandas()
    out = np.zeros(bits // 32, np.uint32)
    out[cells["w"].to_numpy(np.int64)] = cells["v"].to_numpy(np.int64).astype(np.uint32)
    return out


def in_bitmap(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h & U64(32 * len(bits) - 1)).astype(np.int64)
    return (bits[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective)."""
    h = h ^ (h >> U64(30))
    h = h * MIX1
    h = h ^ (h >> U64(27))
    h = h * MIX2
    return h ^ (h >> U64(31))


#: A fixed odd 64-bit value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Words [^\x20\x09-\x0D]+: every byte that is not ASCII white space.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True

_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n, grown by doubling and kept per process."""
    for k, b in enumerate((BASE, BASE_INV)):
        p = _powers[k]
        while len(p) < n:
            p = np.concatenate([p, p * U64(pow(b, len(p), 1 << 64))])
        _powers[k] = p
    return _powers[0][:n], _powers[1][:n]


def span_hashes(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span [lo, hi) of buf."""
    up, down = _power(len(buf) + 1)
    acc = np.zeros(len(buf) + 1, U64)
    np.cumsum(BYTE_VALUES[buf] * up[:-1], out=acc[1:])
    return mix((acc[hi] - acc[lo]) * down[lo] ^ (hi - lo).astype(U64) * MIX2)


def slices(col: pa.Array):
    """(row numbers, bytes, starts, ends) for runs of rows of about
    SLICE_BYTES; starts / ends index the bytes; null texts are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if not n:
        return
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo, hi = off[:-1], off[1:].copy()
    if col.null_count:
        gone = np.asarray(col.is_null().to_numpy(zero_copy_only=False), bool)
        hi[gone] = lo[gone]
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + SLICE_BYTES, "right")) - 1)
        to = min(to, n)
        yield np.arange(at, to), data[off[at]:off[to]], lo[at:to] - off[at], hi[at:to] - off[at]
        at = to


def word_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, is_word: np.ndarray):
    """(word starts, word ends, first word of each row); first word has one
    more entry than there are rows, so row r has words first[r]:first[r+1]."""
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = is_word[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[starts] = True
    cut[ends] = True
    begin = inside[1:] & (~inside[:-1] | cut)
    end = inside[:-1] & (~inside[1:] | cut)
    ws, we = np.flatnonzero(begin[:len(buf)]), np.flatnonzero(end)
    first = np.empty(len(starts) + 1, np.int64)
    first[:-1] = np.searchsorted(ws, starts)
    first[-1] = np.searchsorted(ws, ends[-1]) if len(ends) else 0
    return ws, we, first


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(h: np.ndarray, first: np.ndarray, k: int, short: bool = True):
    """Hashes of the k-word shingles of every row and their rows.  With
    ``short``, a row of fewer words (but one at least) has its whole word
    sequence as its one shingle."""
    n, counts = len(h), np.diff(first)
    rows = row_of(first)
    m = max(0, n - k + 1)
    acc = np.zeros(m, U64)
    for j in range(k):
        acc += h[j:j + m] * U64((BASE * (2 * j + 3)) & (2 ** 64 - 1))
    whole = rows[:m] == rows[n - m:] if m else np.zeros(0, bool)
    out, out_rows = mix(acc[whole]), rows[:m][whole]
    if short:
        few = np.flatnonzero((counts > 0) & (counts < k))
        if len(few):
            part = np.zeros(len(few), U64)
            for j in range(k - 1):
                has = counts[few] > j
                part[has] += h[first[few[has]] + j] * U64((BASE * (2 * j + 3)) & (2 ** 64 - 1))
            part = mix(part ^ counts[few].astype(U64) * MIX1)
            out, out_rows = np.concatenate([out, part]), np.concatenate([out_rows, few])
    return out, out_rows


def distinct_per_row(h: np.ndarray, rows: np.ndarray):
    """Distinct (row, hash), sorted by row and hash."""
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    return h[keep], rows[keep]


def as_long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))
