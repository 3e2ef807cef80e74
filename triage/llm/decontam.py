"""Operator 4, benchmark decontamination: prefix-filtered set join.

An item's windows are its runs of ``WINDOW`` words (the whole item, if it has
fewer).  A window is the set of its shingles of up to ``SHINGLE`` words, and a
document contains it if all of them occur in sequence.  Containment of all n
shingles needs a prefix of n - n + 1 = 1 shingle, the rarest: shingles are
ordered by how often they occur in all documents, each window is filed under
its rarest one, and a document position joins the windows filed under the
shingle that begins there.  The position bound (the shingle's offset in the
window gives the only possible start) and the length bound (the window must
end inside the document) come before the comparison of the whole window.

Windows, their shingles and the counts are Spark rows, for a benchmark of any
size.  Tasks get two bit maps of bounded size (shingles that a window is filed
under, windows) and read all documents once to count and once to match; the
document windows that pass both maps, nearly all of them true, join the windows
by Spark.  A document is not shuffled, only the places of its hits, whatever
the hot groups.

Words are compared by 64-bit hashes of their bytes, windows by two such hashes
of their words.  Null and empty texts have no words; items without words or
without an item_id match nothing; equal item_ids count once; null doc_ids stay
null; repeated rows each give a row; other columns are ignored; an empty
benchmark or document table is fine.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage.llm import common as C

WINDOW = 10
SHINGLE = 3
#: Rows of a table that may be broadcast.
BROADCAST_ROWS = 500_000
#: A task hands on its counts of shingles when it holds so many.
HELD = 400_000
#: Windows of an item that are held at once.
PART = 1 << 16


def _document():
    """Identity of a document, beside its doc_id: equal rows share their hits."""
    return F.xxhash64("doc_id", "text").alias("_d")


def _words(buf, lo, hi):
    buf = C.LOWER[buf]
    ws, we, first = C.word_spans(buf, lo, hi, C.ALNUM_WORDS)
    return C.span_hashes(buf, ws, we), first


def _shingle(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on."""
    m = max(0, len(h) - k + 1)
    acc = np.zeros(m, np.uint64)
    for j in range(k):
        acc += h[j:j + m] * np.uint64((C.BASE * (2 * j + 3)) & (2 ** 64 - 1))
    return C.mix(acc + np.uint64(k))


def _window(h: np.ndarray, start: np.ndarray, size: int):
    """Two hashes of the ``size`` words from each start on."""
    one, two = np.full(len(start), size, np.uint64), np.zeros(len(start), np.uint64)
    for j in range(size):
        w = h[start + j]
        one += w * np.uint64((C.BASE * (2 * j + 5)) & (2 ** 64 - 1))
        two += C.mix(w + np.uint64(j + 1) * C.MIX2)
    return C.mix(one), C.mix(two)


# -------------------------------------------------------------------- windows

def windows(bench: DataFrame) -> DataFrame:
    """(w1, w2, size, item, sh): the windows of all items, each with its
    shingles in order."""

    def run(batches):
        for b in batches:
            for rows, buf, lo, hi in C.slices(b.column("text")):
                h, first = _words(buf, lo, hi)
                n = np.diff(first)
                size = np.minimum(WINDOW, n)
                count = np.where(n > 0, n - size + 1, 0)
                row = np.repeat(np.arange(len(n)), count)
                start = first[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                for s in np.unique(size[row]).tolist():
                    k, mine = min(SHINGLE, s), np.flatnonzero(size[row] == s)
                    of = _shingle(h, k)
                    for at in np.array_split(mine, -(-len(mine) // PART)):
                        w1, w2 = _window(h, start[at], s)
                        sh = of[start[at][:, None] + np.arange(s - k + 1)]
                        edges = pa.array(np.arange(0, sh.size + 1, s - k + 1, dtype=np.int32))
                        yield pa.RecordBatch.from_arrays(
                            [C.as_long(w1), C.as_long(w2), pa.array(np.full(len(at), s, np.int32)), b.column("item").take(pa.array(rows[row[at]])),
                             pa.ListArray.from_arrays(edges, C.as_long(sh.ravel()))], ["w1", "w2", "size", "item", "sh"])

    items = bench.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    return items.mapInArrow(run, "w1 long, w2 long, size int, item string, sh array<long>")


def _added(h: np.ndarray, n: np.ndarray):
    u, back = np.unique(h, return_inverse=True)
    return u, np.bincount(back, n, len(u)).astype(np.int64)


def shingle_counts(docs: DataFrame, shingles: DataFrame, sizes: list[int]) -> DataFrame:
    """(sh, n): how often shingles occur in all documents, those of the table
    ``shingles`` (sh) and some others."""
    shared = docs.sparkSession.sparkContext.broadcast(C.bitmap(shingles, "sh"))

    @C.tidy
    def run(batches):
        bits = shared.value
        h_all, n_all = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            for _, buf, lo, hi in C.slices(b.column("text")):
                h, _ = _words(buf, lo, hi)
                s = np.concatenate([x[C.in_bitmap(bits, x)] for x in (_shingle(h, k) for k in sizes)])
                h_all, n_all = _added(np.concatenate([h_all, s]), np.concatenate([n_all, np.ones(len(s), np.int64)]))
                if len(h_all) > HELD:
                    yield pa.RecordBatch.from_arrays([C.as_long(h_all), pa.array(n_all)], ["sh", "n"])
                    h_all, n_all = h_all[:0], n_all[:0]
        yield pa.RecordBatch.from_arrays([C.as_long(h_all), pa.array(n_all)], ["sh", "n"])

    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, "sh long, n long").groupBy("sh").agg(F.sum("n").alias("n"))


def filed(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(w1, w2, size, key, off): each distinct window under its rarest shingle,
    which begins ``off`` words after the window."""
    own = C.saved(found.groupBy("w1", "w2").agg(F.first("size").alias("size"), F.first("sh").alias("sh")), "decon-distinct")
    rows = own.select("w1", "w2", "size", F.posexplode("sh").alias("off", "sh"))
    sizes = [r[0] for r in own.select(F.least("size", F.lit(SHINGLE))).distinct().collect()]     # 1, 2 and 3 at most
    if not sizes:
        return rows.select("w1", "w2", "size", F.col("sh").alias("key"), "off")
    counts = shingle_counts(docs, C.saved(rows.select("sh").distinct(), "decon-shingles"), sorted(sizes))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("sh").alias("key"), "off"))
    out = rows.join(counts, "sh", "left").groupBy("w1", "w2", "size").agg(rarest.alias("r"))
    return C.saved(out.select("w1", "w2", "size", "r.key", "r.off"), "decon-filed")


# -------------------------------------------------------------------- matches

def hits(docs: DataFrame, file: DataFrame) -> DataFrame:
    """(_d, _doc, m): of each document that holds a window the places (start,
    end, w1, w2) of all it holds."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    shapes = sorted((r.size, r.off) for r in file.select("size", "off").distinct().collect())     # WINDOW ** 2 at most
    shared = spark.sparkContext.broadcast((C.bitmap(file, "key"), C.bitmap(file, "w1")))

    @C.tidy
    def run(batches):
        keys, whole = shared.value
        for b in batches:
            for rows, buf, lo, hi in C.slices(b.column("text")):
                h, first = _words(buf, lo, hi)
                for k in sorted({min(SHINGLE, size) for size, _ in shapes}):
                    at = np.flatnonzero(C.in_bitmap(keys, _shingle(h, k)))
                    row = np.searchsorted(first, at, "right") - 1
                    for size, off in shapes:
                        if min(SHINGLE, size) != k:
                            continue
                        start = at - off
                        ok = (start >= first[row]) & (start + size <= first[row + 1])
                        start, r = start[ok], row[ok]
                        w1, w2 = _window(h, start, size)
                        ok = C.in_bitmap(whole, w1)
                        if ok.any():
                            of, place = pa.array(rows[r[ok]]), start[ok] - first[r[ok]]
                            yield pa.RecordBatch.from_arrays(
                                [b.column("_d").take(of), b.column("_doc").take(of), C.as_long(w1[ok]), C.as_long(w2[ok]), pa.array(place), pa.array(place + size)],
                                ["_d", "_doc", "w1", "w2", "start", "end"])

    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), _document(), F.col("doc_id").alias("_doc"))
    near = texts.mapInArrow(run, f"_d long, _doc {kind}, w1 long, w2 long, start long, end long")
    file = file.select("w1", "w2")
    true = near.join(F.broadcast(file) if file.count() <= BROADCAST_ROWS else file, ["w1", "w2"])
    return C.saved(true.groupBy("_d", "_doc").agg(F.sort_array(F.collect_list(F.struct("start", "end", "w1", "w2"))).alias("m")), "decon-hits")


def _merged(batches):
    """(_d, _doc, m) -> (_d, _doc, spans): unions of the places as flat lists."""
    for b in batches:
        col = b.column("m")
        n = col.value_lengths().to_numpy().astype(np.int64)
        places = col.flatten()
        lo, hi = (places.field(x).to_numpy() for x in ("start", "end"))
        row = np.repeat(np.arange(len(n)), n)
        wide = (hi.max() + 2) if len(hi) else 1
        reach = np.maximum.accumulate(hi + row * wide)
        new = np.ones(len(lo), bool)
        new[1:] = lo[1:] + row[1:] * wide > reach[:-1]      # spans that touch are one
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(lo)) - 1
        flat = np.stack([lo[begin], reach[last] - row[last] * wide], 1).ravel() if len(lo) else lo
        edges = np.concatenate([[0], np.cumsum(2 * np.bincount(row[begin], minlength=len(n)))]).astype(np.int32)
        spans = pa.ListArray.from_arrays(pa.array(edges), pa.array(flat.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([b.column("_d"), b.column("_doc"), spans], ["_d", "_doc", "spans"])


def _all_hits(docs: DataFrame, bench: DataFrame):
    """(hits, windows of all items)."""
    found = C.saved(windows(bench), "decon-windows")
    return hits(docs, filed(docs, found)), found


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def _word_counts(df: DataFrame, kinds: str, text: str) -> DataFrame:
    @C.tidy
    def run(batches):
        for b in batches:
            n = [np.diff(_words(buf, lo, hi)[1]) for _, buf, lo, hi in C.slices(b.column(text))]
            n = np.concatenate(n) if n else np.zeros(0, np.int64)
            cols = [c for c in b.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(n)], [*cols, "n_words"])

    return df.mapInArrow(run, f"{kinds}, n_words long")


def _found(docs: DataFrame, table: DataFrame, how: str):
    """docs with _d joined with a table by document."""
    doc = "_in_doc_id" if "_in_doc_id" in docs.columns else "doc_id"
    return docs.join(table, (docs["_d"] == table["_d"]) & docs[doc].eqNullSafe(table["_doc"]), how)


def decontaminated(docs: DataFrame, bench: DataFrame, carry: list[str], count_words: bool = True) -> DataFrame:
    """The carried columns (doc_id among doc_id, text, lang, source, n_chars),
    spans (flat list of starts and ends of hit words), items (sorted item_ids
    as strings), and n_words if asked for."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    hit, found = _all_hits(docs, bench)
    spans = hit.mapInArrow(_merged, f"_d long, _doc {kind}, spans array<int>")
    held = hit.select("_d", "_doc", F.explode(F.array_distinct(F.transform("m", lambda x: F.struct(x["w1"], x["w2"])))).alias("w"))
    items = (held.select("_d", "_doc", "w.w1", "w.w2").join(found.select("w1", "w2", "item").distinct(), ["w1", "w2"])
             .groupBy("_d", "_doc").agg(F.sort_array(F.collect_set("item")).alias("items")))
    same = (spans["_d"] == items["_d"]) & spans["_doc"].eqNullSafe(items["_doc"])
    each = C.saved(spans.join(items, same).select(spans["_d"], spans["_doc"], "spans", "items"), "decon-documents")
    given = C.sent(docs, carry, _document())
    if count_words:
        kinds = ", ".join(["_d long", *(f"`_in_{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)])
        given = _word_counts(given, kinds, C.text_name(carry))
    out = _found(given, _small(each, BROADCAST_ROWS // 5), "left")
    return out.select(*(F.col(f"_in_{c}").alias(c) for c in carry), *(["n_words"] if count_words else []),
                      F.coalesce("spans", F.array().cast("array<int>")).alias("spans"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, bench: DataFrame, columns: list[str]) -> DataFrame:
    """The columns (doc_id among them) of the documents that hold no window of an item."""
    hit = _all_hits(docs, bench)[0].select("_d", "_doc")
    return _found(docs.select(*columns, _document()), _small(hit, BROADCAST_ROWS), "left_anti").select(*columns)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.expr("aggregate(sequence(0, greatest(size(spans) div 2 - 1, 0)), 0L,"
                   " (a, i) -> a + if(size(spans) = 0, 0L, cast(spans[2 * i + 1] - spans[2 * i] as long)))")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


#: Kept for tests: the digest of no items.
NO_ITEMS = hashlib.sha256(b"").hexdigest()
