"""Operator 3, language ID: a byte convolutional network.

Bytes map to 64 symbols; filters of widths 2, 3 and 4 slide over windows of
``WINDOW`` bytes, the largest response of each filter over the window is
rectified and a softmax layer turns them into languages.  Trained in numpy
(Adam, seeded) on windows of a bounded sample of the labelled training rows:
about ``SAMPLE_DOCS`` documents a language by hash of doc_id,
``SAMPLE_WINDOWS`` windows a document, spread over its whole text, and at
most ``MAX_WINDOWS`` windows in all.

Prediction covers every byte of every text: fixed-length windows in batches,
each batch three table look-ups a position; a text's probabilities are the
mean of its windows' weighted by their bytes.  The model is some 2 MB.

Texts that are null or have no letter are ``und`` with score 0.  Without any
labelled row (an empty table) everything is ``und``.  Null doc_ids are never
held out and never learned from; repeated rows each give a row; other columns
are ignored, and lang is read for training rows only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage.llm import common as C

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
SAMPLE_DOCS = 500
SAMPLE_WINDOWS = 6
MAX_WINDOWS = 24_000
EPOCHS = 4
BATCH = 128
SEED = 11
WINDOWS_AT_ONCE = 2048

#: Byte -> symbol: 0 padding, letters 1-26 without case, white space 27, digits 28, other ASCII 29,
#: lead byte 0xC3 30, other lead bytes 31, continuation bytes 32-63 by their low five bits.
SYMBOL = np.full(256, 29, np.uint8)
SYMBOL[0x61:0x7B] = SYMBOL[0x41:0x5B] = np.arange(1, 27)
SYMBOL[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 27
SYMBOL[0x30:0x3A] = 28
SYMBOL[0xC0:] = 31
SYMBOL[0xC3] = 30
SYMBOL[0x80:0xC0] = 32 + (np.arange(64) & 31)


def windows(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(symbols of all windows of the texts, row of each window, its bytes)."""
    n = ends - starts
    per = -(-n // WINDOW)
    base = np.concatenate([[0], np.cumsum(per)])
    out = np.zeros(base[-1] * WINDOW, np.uint8)
    src = np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    dst = np.repeat(base[:-1] * WINDOW - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    out[dst] = SYMBOL[buf[src]]
    row = np.repeat(np.arange(len(n)), per)
    size = np.minimum(WINDOW, n[row] - (np.arange(base[-1]) - base[row]) * WINDOW)
    return out.reshape(-1, WINDOW), row, size


class Network:
    """tables[w]: (w, 64, FILTERS), one weight for each offset, symbol and filter."""

    def __init__(self, classes: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.params = [rng.normal(0, 0.3, (w, 64, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.params += [np.zeros(len(WIDTHS) * FILTERS, np.float32),
                        rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, classes)).astype(np.float32), np.zeros(classes, np.float32)]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> "Network":
        rng = np.random.default_rng(SEED)
        m, v, t = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params], 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                pick = order[at:at + BATCH]
                t += 1
                rate = 0.02 * (1 - (epoch * len(x) + at) / (epochs * len(x)))
                for k, g in enumerate(self.gradient(x[pick], y[pick])):
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.params[k] -= rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
        return self

    def gradient(self, x, y):
        tables, (bias, dense, out) = self.params[:len(WIDTHS)], self.params[len(WIDTHS):]
        tops, places = [], []
        for w, table in zip(WIDTHS, tables):
            z = sum(table[j][x[:, j:x.shape[1] - w + 1 + j]] for j in range(w))
            places.append(z.argmax(1))
            tops.append(z.max(1))
        top = np.concatenate(tops, 1) + bias
        feat = np.maximum(top, 0)
        p = _softmax(feat @ dense + out)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        back = (p @ dense.T) * (top > 0)
        grads, rows = [], np.arange(len(x))[:, None]
        for k, (w, place) in enumerate(zip(WIDTHS, places)):
            g = back[:, k * FILTERS:(k + 1) * FILTERS]
            cell = np.arange(FILTERS)
            grads.append(np.stack([np.bincount((x[rows, place + j].astype(np.int64) * FILTERS + cell).ravel(), g.ravel(), 64 * FILTERS)
                                   .reshape(64, FILTERS) for j in range(w)]).astype(np.float32))
        return [*grads, back.sum(0), feat.T @ p, p.sum(0)]

    def compiled(self):
        """Look-up tables over symbol pairs (widths 2 and 4) and triples (width 3)."""
        a, b, c = self.params[:3]
        pair = (a[0][:, None] + a[1][None]).reshape(-1, FILTERS)
        triple = (b[0][:, None, None] + b[1][None, :, None] + b[2][None, None]).reshape(-1, FILTERS)
        left, right = ((c[j][:, None] + c[j + 1][None]).reshape(-1, FILTERS) for j in (0, 2))
        return [np.ascontiguousarray(t, np.float32) for t in (pair, triple, left, right)]


def _softmax(z):
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def probabilities(net: Network, tables, x: np.ndarray) -> np.ndarray:
    pair, triple, left, right = tables
    bias, dense, out = net.params[3:]
    parts = []
    for at in range(0, len(x), WINDOWS_AT_ONCE):
        s = x[at:at + WINDOWS_AT_ONCE].astype(np.int32)
        two = s[:, :-1] * 64 + s[:, 1:]
        top = np.concatenate([pair[two].max(1), triple[two[:, :-1] * 64 + s[:, 2:]].max(1),
                              (left[two[:, :-2]] + right[two[:, 2:]]).max(1)], 1) + bias
        parts.append(_softmax(np.maximum(top, 0) @ dense + out))
    return np.concatenate(parts) if parts else np.zeros((0, len(out)), np.float32)


def training_rows(docs: DataFrame) -> DataFrame:
    """The labelled rows that may be learned from: (doc_id, text, lang)."""
    return docs.select("doc_id", "text", "lang").where(
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))


def sample_windows(train: DataFrame) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Symbols, class numbers and languages of a bounded sample."""
    sizes = train.groupBy("lang").agg(F.count("*").alias("n"))
    sizes = F.broadcast(sizes) if sizes.count() <= 10_000 else sizes
    share = F.lit(float(SAMPLE_DOCS)) / F.col("n")
    unit = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = train.join(sizes, "lang").where(unit < share).select("doc_id", "lang", "text")

    def cut(batches):
        for b in batches:
            ids, langs, out = [], [], []
            for rows, buf, lo, hi in C.slices(b.column("text")):
                x, row, _ = windows(buf, lo, hi)
                count = np.bincount(row, minlength=len(rows))
                rank = np.arange(len(row)) - np.concatenate([[0], np.cumsum(count)[:-1]])[row]
                # evenly over the text, the last (padded) window included
                keep = (count[row] <= SAMPLE_WINDOWS) | ((rank + 1) * SAMPLE_WINDOWS // count[row] > rank * SAMPLE_WINDOWS // count[row])
                out += [w.tobytes() for w in x[keep]]
                at = pa.array(rows[row[keep]])
                ids += b.column("doc_id").take(at).to_pylist()
                langs += b.column("lang").take(at).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(out, pa.binary())],
                                             ["doc_id", "lang", "x"])

    got = (chosen.withColumn("doc_id", F.xxhash64("doc_id")).mapInArrow(cut, "doc_id long, lang string, x binary")
           .orderBy("doc_id", "lang", "x").limit(MAX_WINDOWS).toPandas())
    langs = sorted(got["lang"].unique())
    y = got["lang"].map({v: k for k, v in enumerate(langs)}).to_numpy(np.int64)
    x = np.frombuffer(b"".join(got["x"]), np.uint8).reshape(-1, WINDOW)
    return x, y, langs


def train(docs: DataFrame) -> tuple[Network, list[str]]:
    x, y, langs = sample_windows(training_rows(docs))
    net = Network(max(1, len(langs)))
    return (net.fit(x, y) if len(langs) > 1 else net), langs


def predict(docs: DataFrame, model: tuple[Network, list[str]], carry: list[str]) -> DataFrame:
    """The carried columns (among doc_id, text, lang, source, n_chars),
    lang_pred and score; one scan."""
    net, langs = model
    shared, text = docs.sparkSession.sparkContext.broadcast((net, langs)), C.text_name(carry)

    @C.tidy
    def run(batches):
        net, langs = shared.value
        tables = net.compiled()
        for b in batches:
            n, k = b.num_rows, max(1, len(langs))
            best, score = np.zeros(n, np.int64), np.zeros(n)
            for rows, buf, lo, hi in C.slices(b.column(text)):
                x, row, size = windows(buf, lo, hi)
                p = probabilities(net, tables, x) * size[:, None]
                total = np.stack([np.bincount(row, p[:, j], len(rows)) for j in range(k)], 1)
                total /= np.maximum(np.bincount(row, size, len(rows)), 1)[:, None]
                best[rows], score[rows] = total.argmax(1), np.clip(total.max(1), 0, 1)
            letter = b.column("_letter").to_numpy(zero_copy_only=False).astype(bool) & bool(langs)
            names = np.array([*langs, "und"], object)
            pred = np.where(letter, names[np.where(letter, best, len(langs))], "und")
            yield pa.RecordBatch.from_arrays(
                [*(b.column(f"_in_{c}") for c in carry), pa.array(pred.tolist(), pa.string()), pa.array(np.where(letter, score, 0.0))],
                [*carry, "lang_pred", "score"])

    given = C.sent(docs, carry, F.coalesce("text", F.lit("")).rlike(r"\p{L}").alias("_letter"))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return given.mapInArrow(run, f"{kinds}, lang_pred string, score double")
