"""Operator 12, periodic runs of words: online sparse diagonal DP.

A run is a stretch of consecutive words with smallest period q (words q apart
are equal) and a length of max(MIN_LENGTH, MIN_REPEATS * q) at least that no
neighbouring word extends keeping period q.

A word's earlier occurrence d words back lies on the diagonal of lag d, and
the length of the match along a diagonal is one more than at the word before.
Following every earlier occurrence is quadratic in a frequent word, so an
occurrence counts here only with its context: for k = 1, 2, 4, ... the k words
that begin at a word are looked up as a block, and the block's latest earlier
occurrence, d words back, increments the active lag d if k / 2 < d <= k.
Inside a run of period q (and k its power of two) that lag is q at each place
from the run's second period until its last block, since the q-word blocks of
one primitive period are all different; before and behind, it is not.  Thus a
diagonal active from word i to word j stands for exactly the stretch from
i - q to j + k, with q its smallest period, and it is emitted as soon as the
next word does not continue it, if it is long enough.  A word increments at
most one lag a level, and a level's blocks are sought only where both their
halves were seen twice: the work is n log n whatever words repeat.

Words and blocks are compared by 64-bit hashes.  A text is one task's work,
whole, however long it is; the memory of a task is bounded by its slice of
about SLICE_BYTES or its longest text.

Null, empty and blank texts have no words and no runs.  Repeated rows each
give a row; null doc_ids stay null.  Other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage.llm import common as C

MIN_LENGTH, MIN_REPEATS = 6, 4
RUN = "struct<start: long, length: long, period: long>"

#: (doc_id, number of words) -> the place of the word that stands at each place, or None for the text as it is.
Rewrite = Callable[[int, int], "np.ndarray | None"]


def earlier_blocks(ids: np.ndarray, row: np.ndarray):
    """(place, lag, block length) of every earlier occurrence that counts:
    the latest one of the block at a place, in its text, k / 2 < lag <= k."""
    at, code, k = np.arange(len(ids)), C.mix(ids ^ C.mix(row.astype(np.uint64) * C.BYTE_VALUES[7] + C.MIX1)), 1
    out = []
    while len(at):
        order = np.argsort(code, kind="stable")          # by block, then by place
        same = code[order][1:] == code[order][:-1]
        here, before = order[1:][same], order[:-1][same]
        lag = at[here] - at[before]
        fits = (2 * lag > k) & (lag <= k)
        out.append((at[here[fits]], lag[fits], np.full(int(fits.sum()), k)))
        # blocks of 2k words: both halves must occur twice
        twice = np.zeros(len(at), bool)
        twice[here] = twice[before] = True
        at, code = at[twice], code[twice]
        right = np.searchsorted(at, at + k)
        right[right == len(at)] = 0
        whole = at[right] == at + k
        whole &= row[at[right]] == row[at]
        code = C.mix(code[whole] * np.uint64(C.BASE) + code[right[whole]])
        at, k = at[whole], 2 * k
    place, lag, size = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int),) * 3
    order = np.argsort(place, kind="stable")
    return place[order], lag[order], size[order]


def diagonals(place: list[int], lag: list[int], size: list[int], min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS):
    """The online pass over the words that have earlier occurrences: yields
    (start, length, period) of each run when its diagonal ends."""
    active: dict[tuple[int, int], int] = {}              # (lag, block length) -> words matched up to the last place

    def ended(keys, last):
        for q, k in keys:
            length = active[q, k] + k - 1 + q
            if length >= max(min_length, min_repeats * q):
                yield last + k - length, length, q

    last, n, i = -2, len(place), 0
    while i < n:
        p = place[i]
        now: dict[tuple[int, int], int] = {}
        while i < n and place[i] == p:
            key = lag[i], size[i]
            now[key] = active.get(key, 0) + 1 if p == last + 1 else 1
            i += 1
        if active:
            yield from ended(active if p != last + 1 else [x for x in active if x not in now], last)
        active, last = now, p
    yield from ended(active, last)


def runs_of(ids: np.ndarray, row: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) over the words of some texts, by start, then period."""
    place, lag, size = earlier_blocks(ids, row)
    return sorted(diagonals(place.tolist(), lag.tolist(), size.tolist()))


def collapsed(words: list[bytes], runs) -> bytes:
    """The words outside every run and those of each run's first period that no other run drops."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period:start + length] = False
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, runs (array of start, length, period),
    collapsed (the text without the words that runs repeat, joined by spaces).
    ``rewrite`` may put words of a text elsewhere before runs are sought."""

    def run(batches):
        for b in batches:
            found, texts, ids = [], [], b.column("doc_id").to_pylist() if rewrite else []
            for rows, buf, lo, hi in C.slices(b.column("_text")):
                ws, we, first = C.word_spans(buf, lo, hi, C.SPACE_WORDS)
                h, row = C.span_hashes(buf, ws, we), C.row_of(first)
                data, moved = buf.tobytes(), {}
                for r in range(len(rows)) if rewrite else ():
                    src = rewrite(ids[rows[r]], int(first[r + 1] - first[r]))
                    if src is not None:
                        moved[r] = src
                        h[first[r]:first[r + 1]] = h[first[r]:first[r + 1]][src]
                runs, at = runs_of(h, row), 0
                for r in range(len(rows)):
                    own = []
                    while at < len(runs) and runs[at][0] < first[r + 1]:
                        own.append((runs[at][0] - int(first[r]), *runs[at][1:]))
                        at += 1
                    words = data[lo[r]:hi[r]].split()        # bytes.split() knows exactly the six ASCII spaces
                    if r in moved:
                        words = [words[i] for i in moved[r].tolist()]
                    texts.append(collapsed(words, own))
                    found.append([{"start": s, "length": n, "period": q} for s, n, q in own])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, kind), pa.array(texts, pa.binary())],
                                             ["doc_id", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    return given.mapInArrow(run, f"doc_id {kind}, runs array<{RUN}>, collapsed binary").withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Of every tenth document (by crc32 of its id): the words from a on repeat with a period p."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    src = np.arange(n)
    src[a:] = a + (src[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return src


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run and the checksums of all runs and of the collapsed text."""
    line = lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n"))
    longest = F.array_min(F.transform("runs", lambda x: F.struct((-x["length"]).alias("l"), x["start"].alias("start"), x["period"].alias("period"))))
    rows = found.select("doc_id", "runs", "collapsed", longest.alias("_m"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_m.start").alias("start"), (-F.col("_m.l")).alias("length"),
        F.col("_m.period").alias("period"), F.expr("(-1000 * _m.l) div _m.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", line)), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
