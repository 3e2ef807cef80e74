"""Operator 6, token counts: map-side two-tier lookup.

A text's token count under a sentencepiece BPE model is the sum of the counts
of its pre-tokens: no piece of the vocabulary crosses a line break or the
beginning of a run of spaces, so merges never do.  Tier one is a compact
table of frequent pre-tokens and their lengths, broadcast to every worker
(at most ``TABLE_ENTRIES`` entries of at most ``ENTRY_CHARS`` characters).
Tier two encodes the misses and keeps them in a cache of the worker process
(at most ``CACHE_ENTRIES``).  Pre-tokens are never shuffled; the plan is one
scan.

The table is only a starting state of the cache and decides no count, so it
is taken from a bounded sample (``SAMPLE_DOCS`` documents by hash of doc_id).

Null and empty texts have no bytes and no tokens.  Texts that hold U+2581
(the model's own space mark) are encoded whole.  Repeated rows each give a
row; null doc_ids stay null.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS = 2_000
TABLE_ENTRIES = 65_536
ENTRY_CHARS = 64
CACHE_ENTRIES = 400_000
MARK = "▁"
#: A pre-token: a line break and what follows it, or a run of spaces and what follows it.
UNITS = re.compile(r"\n[^ \n]*| +[^ \n]*")

_caches: dict[str, "Lengths"] = {}


class Lengths(dict):
    """Pre-token -> number of tokens; misses are encoded and kept."""

    def __init__(self, model: str):
        import sentencepiece
        super().__init__()
        self.encode = sentencepiece.SentencePieceProcessor(model_file=model).encode
        self.seed: dict[str, int] = {}

    def start_from(self, seed: dict[str, int]) -> None:
        if self.seed is not seed:
            self.seed = seed
            self.update(seed)

    def __missing__(self, unit: str) -> int:
        if unit[0] == "\n":      # encoded alone it gets a space mark in front, which is one token
            n = len(self.encode(unit)) - 1
        else:                    # the mark in front stands for the first space
            n = len(self.encode(unit[1:])) if unit != " " else 1
        if len(unit) <= ENTRY_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
                self.update(self.seed)
            self[unit] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if MARK in text:
            return len(self.encode(text))
        return sum(map(self.__getitem__, UNITS.findall(" " + text)))


def _lengths(model: str) -> Lengths:
    if model not in _caches:
        _caches[model] = Lengths(model)
    return _caches[model]


def frequent_pretokens(docs: DataFrame, sample_docs: int = SAMPLE_DOCS,
                       entries: int = TABLE_ENTRIES) -> list[str]:
    """The most frequent short pre-tokens of a bounded sample of documents."""
    ids = (docs.select("doc_id").where("doc_id is not null").distinct()
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs))

    def count(batches):
        for b in batches:
            c: Counter = Counter()
            for t in b.column("text").to_pylist():
                if t and MARK not in t:
                    c.update(u for u in UNITS.findall(" " + t) if len(u) <= ENTRY_CHARS)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["unit", "n"])

    units = (docs.join(ids, "doc_id", "left_semi").select("text").mapInArrow(count, "unit string, n long")
             .groupBy("unit").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit").limit(entries))
    return [r.unit for r in units.select("unit").collect()]


def token_counts(docs: DataFrame, model: str, **sample) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_tokens."""
    docs = docs.select("doc_id", "text")
    local = _lengths(model)
    units = frequent_pretokens(docs, **sample)
    seed = docs.sparkSession.sparkContext.broadcast({u: local[u] for u in units})

    def count(batches):
        lengths = _lengths(model)
        lengths.start_from(seed.value)
        for b in batches:
            text = b.column("text")
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pc.fill_null(pc.binary_length(text), 0).cast(pa.int64()),
                 pa.array([lengths.count(t.as_py()) for t in text], pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
