"""Operator 13, cross-tokenizer alignment: whitespace-token anchors.

Every text is tokenised whole by two vocabularies, A (byte-level BPE, given a
space in front) and B (sentencepiece, which adds one itself).  Tokens are
byte strings, and a text counts only if both sequences spell exactly the space
and the text.  A byte offset at which tokens of both sides end and whose next
tokens both begin with a space is an anchor; anchors cut the two sequences
into windows.  A window's alignment depends on its token ids alone: it is
worked out once per worker and kept in a bounded memo under the tuple of both
id sequences (``MEMO_ENTRIES`` windows, two generations, the older one is
dropped).  An alignment holds

* the groups: the window cut at every offset where both sides' tokens end;
* the links: all pairs of tokens whose byte ranges overlap.

``aligned`` writes a row for each text with its groups and the distinct
linked id pairs with their numbers.  ``pair_counts`` adds up the pairs of the
whole corpus (added up in each task before the shuffle) and marks those that
are most frequent for their B id.  ``weighed`` carries both back to the texts:
the ``TABLE_PAIRS`` most frequent pairs go to every task as one sorted array
(17 bytes each), all others are joined by pair, so a pair's rows are few and
no table that grows with the corpus is broadcast.

Null and empty texts, and those that do not spell (among them every text with
U+2581, which B reads as a space), have no tokens: zeros and empty groups.
Repeated rows each give a row and count each; null doc_ids stay null.  Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage.llm import common as C

MEMO_ENTRIES = 150_000
TABLE_PAIRS = 1_000_000
#: Texts are aligned a few at a time: about so many characters.
CHARS_AT_ONCE = 1_000_000
#: Pairs are added up in a task when so many are held.
HELD_PAIRS = 4_000_000
#: A pair is one long: A id above, B id in the lower 32 bits.
SHIFT = 32
#: Longer texts are left to the slower library.
LONGEST = 50_000
MARK = "▁"
# FIXED VALUE: how a byte-level vocabulary of this kind cuts a text before its merges
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins of a byte-level vocabulary: printable Latin-1
    bytes stand for themselves, the others follow from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Tokens:
    """One vocabulary: ids of texts and the bytes of each id."""

    def __init__(self, path: str):
        self.bytes: list[bytes] = []
        if path.endswith(".json"):
            self.byte_level(path)
        else:
            import sentencepiece
            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            for i in range(sp.get_piece_size()):
                piece = sp.id_to_piece(i)
                self.bytes.append(bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else piece.replace(MARK, " ").encode())
            self.ids = lambda texts: sp.encode(list(texts), num_threads=1)
        self.length = np.array([len(x) for x in self.bytes], np.int64)
        self.spaced = np.array([x[:1] == b" " for x in self.bytes])

        self.start = np.append(0, self.length.cumsum())
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)

    def byte_level(self, path: str) -> None:
        """A byte-level BPE: `tiktoken` with the file's own vocabulary, whose ids
        follow the order of the merges, takes a quarter of the time of
        `tokenizers` for the same ids (the tests compare both on every code
        point).  Its pattern search gives up on endless runs of spaces, so very
        long texts go to `tokenizers`."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True              # their strings inside texts are plain text
        back, special = byte_of_char(), tok.get_added_tokens_decoder()
        for i in range(tok.get_vocab_size(with_added_tokens=True)):
            piece = tok.id_to_token(i) or ""
            self.bytes.append(piece.encode() if i in special else bytes(back[c] for c in piece))
        quick = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, special_tokens={},
                                  mergeable_ranks={x: i for i, x in enumerate(self.bytes) if i not in special}).encode_ordinary
        self.ids = lambda texts: [quick(" " + t) if len(t) <= LONGEST else tok.encode(" " + t, add_special_tokens=False).ids for t in texts]

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a sequence of ids."""
        return self.blob[_indices(self.start[ids], self.start[ids.astype(np.int64) + 1])]


_tokens: dict[str, Tokens] = {}
_windows: dict[tuple[str, str], "Windows"] = {}


def tokens(path: str) -> Tokens:
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def _indices(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """lo[0], ..., hi[0] - 1, lo[1], ..., hi[1] - 1, ..."""
    n = hi - lo
    return np.arange(int(n.sum())) + np.repeat(lo - (n.cumsum() - n), n)


class Windows:
    """Alignments of windows (A ids, B ids): groups as text, their number, and
    the linked pairs (8 bytes each), kept in a memo of two generations."""

    def __init__(self, a: Tokens, b: Tokens):
        self.a, self.b = a, b
        self.young: dict[bytes, tuple[str, int, bytes]] = {}
        self.old: dict[bytes, tuple[str, int, bytes]] = {}
        # an id's text inside a group, and at the end of its group's side
        self.text = [np.array([f"{i}," for i in range(len(t.bytes))] + [f"{i}{end}" for i in range(len(t.bytes))], object) for t, end in ((a, "|"), (b, ";"))]
        self.size = [np.array([len(x) for x in t], np.int64) for t in self.text]

    def __call__(self, ids_a: np.ndarray, cut_a: np.ndarray, ids_b: np.ndarray, cut_b: np.ndarray, which: np.ndarray) -> list[tuple[str, int, bytes]]:
        """The alignments of the windows numbered ``which``: window w has the
        ids cut_a[w]:cut_a[w + 1] of A and cut_b[w]:cut_b[w + 1] of B."""
        # the tuple of both sequences, packed: number of A ids, A ids, B ids, 4 bytes each
        n_a, n_b = cut_a[which + 1] - cut_a[which], cut_b[which + 1] - cut_b[which]
        edge = np.append(0, (1 + n_a + n_b).cumsum())
        packed = np.empty(edge[-1], np.uint32)
        packed[edge[:-1]] = n_a
        packed[_indices(edge[:-1] + 1, edge[:-1] + 1 + n_a)] = ids_a[_indices(cut_a[which], cut_a[which + 1])]
        packed[_indices(edge[1:] - n_b, edge[1:])] = ids_b[_indices(cut_b[which], cut_b[which + 1])]
        raw, edge = packed.tobytes(), (4 * edge).tolist()
        keys = [raw[p:q] for p, q in zip(edge, edge[1:])]
        found, missing = list(map(self.young.get, keys)), []
        for i in [i for i, x in enumerate(found) if x is None]:
            found[i] = self.old.get(keys[i])
            if found[i] is None:
                missing.append(i)
        missing = np.array(missing, np.int64)
        if len(missing):
            w = which[missing]
            for i, x in zip(missing.tolist(), self.worked_out(ids_a, cut_a[w], cut_a[w + 1], ids_b, cut_b[w], cut_b[w + 1])):
                found[i] = x
        if len(self.young) + len(keys) > MEMO_ENTRIES:
            self.old, self.young = self.young, {}
        self.young.update(zip(keys[:MEMO_ENTRIES], found))
        return found

    def worked_out(self, ids_a, lo_a, hi_a, ids_b, lo_b, hi_b):
        """The alignments of some windows, all at once: as both sides of each
        spell the same bytes, offsets over all windows in a row agree."""
        a, b = ids_a[_indices(lo_a, hi_a)].astype(np.int64), ids_b[_indices(lo_b, hi_b)].astype(np.int64)
        ends_a, ends_b = self.a.length[a].cumsum(), self.b.length[b].cumsum()
        edge_a, edge_b = np.append(0, (hi_a - lo_a).cumsum()), np.append(0, (hi_b - lo_b).cumsum())
        # groups end where both sides do
        last_a, last_b = ends_b[np.searchsorted(ends_b, ends_a)] == ends_a, ends_a[np.searchsorted(ends_a, ends_b)] == ends_b
        # each stretch between two neighbouring ends of either side is the overlap of one pair
        ends = np.sort(np.concatenate([ends_a, ends_b[~last_b]]), kind="stable")
        links = a[np.searchsorted(ends_a, ends)] << SHIFT | b[np.searchsorted(ends_b, ends)]
        edge = np.searchsorted(ends, np.append(0, ends_a[edge_a[1:] - 1]), "right").tolist()
        group_a, group_b = last_a.cumsum() - last_a, last_b.cumsum() - last_b
        end_of_a, start_of_b = np.flatnonzero(last_a) + 1, np.append(0, np.flatnonzero(last_b) + 1)
        n = np.append(0, last_a.cumsum())
        groups = n[edge_a].tolist()
        place_a, place_b = np.arange(len(a)) + start_of_b[group_a], np.arange(len(b)) + end_of_a[group_b]
        part, size = np.empty(len(a) + len(b), object), np.zeros(len(a) + len(b) + 1, np.int64)
        for side, ids, last, place in ((0, a, last_a, place_a), (1, b, last_b, place_b)):
            code = ids + len(self.size[side]) // 2 * last
            part[place], size[place + 1] = self.text[side][code], self.size[side][code]
        text, at = "".join(part.tolist()), size.cumsum()[edge_a + edge_b].tolist()
        raw = links.tobytes()
        for w in range(len(lo_a)):
            yield text[at[w]:at[w + 1] - 1], groups[w + 1] - groups[w], raw[8 * edge[w]:8 * edge[w + 1]]


def _span_keys(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit hashes of the id spans first[i]:first[i + 1]."""
    up, down = C._power(len(ids) + 1)
    acc = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(C.mix(ids.astype(np.uint64) + np.uint64(1)) * up[:-1], out=acc[1:])
    return C.mix((acc[first[1:]] - acc[first[:-1]]) * down[first[:-1]] ^ np.diff(first).astype(np.uint64) * C.MIX2)


def _flat(ids: list[list[int]]) -> np.ndarray:
    out = array("I")
    for x in ids:
        out.extend(x)
    return np.frombuffer(out, np.uint32) if out else np.zeros(0, np.uint32)


def misspelt(flat: np.ndarray, n: np.ndarray, vocab: Tokens, given: list[bytes]) -> np.ndarray:
    """The texts whose ids (n of each, in a row) do not spell the given bytes."""
    size = np.diff(np.append(0, vocab.length[flat].cumsum())[np.append(0, n.cumsum())])
    want = np.array([len(x) for x in given])
    fits = np.flatnonzero(size == want)
    if len(fits) < len(given):
        flat, given = flat[np.repeat(size == want, n)], [given[t] for t in fits.tolist()]
    differ = np.flatnonzero(vocab.spell(flat) != np.frombuffer(b"".join(given), np.uint8))
    wrong = size != want
    wrong[fits[np.searchsorted(want[fits].cumsum(), differ, "right")]] = True
    return np.flatnonzero(wrong)


def align(texts: list[str], a: Tokens, b: Tokens, windows: Windows):
    """For some texts: n_a, n_b, n_groups, n_links (arrays), groups (bytes of
    each) and (text, pair, number) of the distinct linked pairs."""
    size, ids_a, ids_b = len(texts), [], []
    for lo, hi in _few(texts, CHARS_AT_ONCE // 4):       # a tokenizer's own results take many times their ids
        ids_a += a.ids(texts[lo:hi])
        ids_b += b.ids(texts[lo:hi])
    given = [b" " + t.encode() if t else b"" for t in texts]
    n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
    flat_a, flat_b = _flat(ids_a), _flat(ids_b)
    wrong = np.union1d(misspelt(flat_a, n_a, a, given), misspelt(flat_b, n_b, b, given))
    wrong = np.union1d(wrong, np.flatnonzero([not x for x in given]))
    if len(wrong):
        right = np.ones(size, bool)
        right[wrong] = False
        flat_a, flat_b = flat_a[np.repeat(right, n_a)], flat_b[np.repeat(right, n_b)]
        n_a, n_b = n_a * right, n_b * right
    n_groups, n_links, groups = np.zeros(size, np.int64), np.zeros(size, np.int64), [b""] * size
    if not len(flat_a):
        return n_a, n_b, n_groups, n_links, groups, (np.zeros(0, np.int64),) * 3
    # both sides spell the same bytes text by text, so offsets over all of them agree
    ends_a, ends_b = a.length[flat_a].cumsum(), b.length[flat_b].cumsum()
    at = np.searchsorted(ends_b, ends_a)
    shared = ends_b[at] == ends_a
    text_a = np.repeat(np.arange(size), n_a)
    last_a = np.append(text_a[1:] != text_a[:-1], True)
    follow_a, follow_b = np.append(a.spaced[flat_a][1:], False), np.append(b.spaced[flat_b][1:], False)
    anchor = shared & (last_a | follow_a & follow_b[at])
    cut_a = np.append(0, np.flatnonzero(anchor) + 1)
    cut_b = np.append(0, at[anchor] + 1)
    text_w = text_a[cut_a[:-1]]
    key = C.mix(_span_keys(flat_a, cut_a) ^ _span_keys(flat_b, cut_b) * C.MIX1)
    _, one, which = np.unique(key, return_index=True, return_inverse=True)
    found = windows(flat_a, cut_a, flat_b, cut_b, one)
    names = [x[0] for x in found]
    g, m = np.array([x[1] for x in found]), np.array([len(x[2]) // 8 for x in found])
    edge = np.searchsorted(text_w, np.arange(size + 1)).tolist()
    which_list = which.tolist()
    for t in np.unique(text_w).tolist():
        groups[t] = ";".join([names[w] for w in which_list[edge[t]:edge[t + 1]]]).encode()
    links, base = np.frombuffer(b"".join([x[2] for x in found]), np.int64), np.append(0, m.cumsum())
    n_groups = np.bincount(text_w, g[which], size).astype(np.int64)
    n_links = np.bincount(text_w, m[which], size).astype(np.int64)
    # all links of all windows in one number: text, A id, B id
    low, high = len(b.bytes).bit_length(), len(a.bytes).bit_length()
    pair = links[_indices(base[which], base[which + 1])]
    code = np.sort(np.repeat(np.arange(size), n_links) << low + high | pair >> SHIFT << low | pair & (1 << SHIFT) - 1)
    new = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    one = code[new]
    pair = (one >> low & (1 << high) - 1) << SHIFT | one & (1 << low) - 1
    return n_a, n_b, n_groups, n_links, groups, (one >> low + high, pair, np.diff(np.append(new, len(code))))


def _few(texts: list[str | None], chars: int):
    """Runs of texts of about so many characters: (first, behind the last)."""
    at = 0
    while at < len(texts):
        to, held = at, 0
        while to < len(texts) and (to == at or held + len(texts[to] or "") <= chars):
            held += len(texts[to] or "")
            to += 1
        yield at, to
        at = to


def aligned(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = True) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, groups (or
    groups_sha256), pairs (linked id pairs, 8 bytes each) and times (4 bytes each)."""

    def run(batches):
        a, b = tokens(path_a), tokens(path_b)
        if (path_a, path_b) not in _windows:
            _windows[path_a, path_b] = Windows(a, b)
        windows = _windows[path_a, path_b]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in _few(texts, CHARS_AT_ONCE):
                n_a, n_b, n_groups, n_links, groups, (owner, pair, times) = align([t or "" for t in texts[lo:hi]], a, b, windows)
                edge = np.searchsorted(owner, np.arange(hi - lo + 1)).tolist()
                raw, num = pair.tobytes(), times.astype("<u4").tobytes()
                out = [g.decode() if keep_groups else hashlib.sha256(g).hexdigest() if g else "" for g in groups]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), *(pa.array(x) for x in (n_a, n_b, n_groups, n_links)), pa.array(out, pa.string()),
                     pa.array([raw[8 * p:8 * q] for p, q in zip(edge, edge[1:])], pa.binary()),
                     pa.array([num[4 * p:4 * q] for p, q in zip(edge, edge[1:])], pa.binary())],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary")
    return out if keep_groups else out.withColumnRenamed("groups", "groups_sha256")


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, n (its links in the corpus), best (no pair of its B id has more)."""

    def add(batches):
        held, size = [], 0

        def flush():
            pair, n = (np.concatenate(x) for x in zip(*held))
            one, which = np.unique(pair, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(one), pa.array(np.bincount(which, n, len(one)).astype(np.int64))], ["pair", "n"])

        for b in batches:
            pair = np.frombuffer(b"".join(b.column("pairs").to_pylist()), np.int64)
            held.append((pair, np.frombuffer(b"".join(b.column("times").to_pylist()), "<u4").astype(np.int64)))
            size += len(pair)
            if size >= HELD_PAIRS:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    total = C.saved(found.select("pairs", "times").mapInArrow(add, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    b_id = F.col("pair").bitwiseAND((1 << SHIFT) - 1)
    most = total.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))          # at most one row for each id of B
    return (total.withColumn("b", b_id).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def weighed(found: DataFrame, counts: DataFrame, table_pairs: int = TABLE_PAIRS) -> DataFrame:
    """Adds n_best (links that are most frequent for their B id) and count_sum
    (the corpus counts of a text's links, summed) to rows of ``aligned``."""
    found = C.saved(found.withColumn("_row", F.monotonically_increasing_id()), "aligned") if "_row" not in found.columns else found
    top = counts.orderBy(F.desc("n"), "pair").limit(table_pairs).toPandas().sort_values("pair")
    table = found.sparkSession.sparkContext.broadcast(tuple(top[c].to_numpy() for c in ("pair", "n", "best")))

    def run(batches):
        known, n, best = table.value
        for b in batches:
            pairs = b.column("pairs").to_pylist()
            pair = np.frombuffer(b"".join(pairs), np.int64)
            times = np.frombuffer(b"".join(b.column("times").to_pylist()), "<u4").astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), [len(x) // 8 for x in pairs])
            at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            hit = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            sums, bests = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            np.add.at(sums, row[hit], times[hit] * n[at[hit]])
            np.add.at(bests, row[hit], times[hit] * best[at[hit]])
            edge = np.searchsorted(row[~hit], np.arange(b.num_rows + 1))
            lists = lambda v: pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(v, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(bests), pa.array(sums), lists(pair[~hit]), lists(times[~hit])],
                                             ["_row", "_best", "_sum", "_rare", "_times"])

    part = C.saved(found.select("_row", "pairs", "times").mapInArrow(run, "_row long, _best long, _sum long, _rare array<long>, _times array<long>"), "aligned-sums")
    rare = part.where(F.size("_rare") > 0).select("_row", F.inline(F.arrays_zip(F.col("_rare").alias("pair"), F.col("_times").alias("t"))).alias("pair", "t"))
    rest = (rare.join(counts, "pair").groupBy("_row")
            .agg(F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("_b"), F.sum(F.col("t") * F.col("n")).alias("_s")))
    sums = part.select("_row", "_best", "_sum").join(rest, "_row", "left").select(
        "_row", (F.col("_best") + F.coalesce("_b", F.lit(0))).alias("n_best"), (F.col("_sum") + F.coalesce("_s", F.lit(0))).alias("count_sum"))
    return found.drop("pairs", "times").join(sums, "_row").drop("_row")


def alignment(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = True, table_pairs: int = TABLE_PAIRS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, groups (or
    groups_sha256), n_best, count_sum."""
    found = C.saved(aligned(docs, path_a, path_b, keep_groups).withColumn("_row", F.monotonically_increasing_id()), "aligned")
    counts = C.saved(pair_counts(found), "pair-best")
    return weighed(found, counts, table_pairs)
