"""Operator 7, quality rules: robust multivariate outliers.

Each document becomes a vector of transformed statistics (``FEATURES``).  Per
language and source a minimum-covariance-determinant estimate of centre and
spread is found by concentration steps: keep the ``CORE`` share of rows with
the smallest Mahalanobis distances, take their mean and covariance, and repeat
until the determinant stops falling.  Three starts, all at the coordinate-wise
medians, take the spread from the median absolute deviations, from the
correlations of the spatial signs, and from ``FLOORS`` alone; the estimate of
the smallest determinant is kept, and the mean and covariance of the rows
inside its chi-square quantile ``REWEIGHT`` are the final estimate.  A document
is rejected if its squared distance exceeds the chi-square quantile ``TAIL``.

A step is one aggregate over the statistics table for all starts that still
fall: rows fall into bins of their distance, each bin holds counts and sums
(combined before the shuffle, so a hot source is no single task's load), and
the bins that make up the core give the next estimate, the last of them
weighted by the share that is still needed.  The estimates use all documents.

Up to half of a group may be junk far away.  Copies of one row have no spread
of their own: if they are over a quarter and stand near (some ten standard
deviations where the good rows' spread is well above ``FLOORS``), a core around
them can have the smaller determinant.

* ``FLOORS`` is the least spread of each statistic that is taken as real; its
  square is added to the variances.  Without it a statistic that is nearly
  always 0 (symbols, repeated lines) has no spread and no distance.
* Groups of under ``MIN_GROUP`` eligible rows are pooled by language, then
  all together; a pool of fewer rows than ``MIN_FIT`` rejects nothing.
* Rows that fail the base rules are rejected and left out of the estimates.

Null texts have no words and fail the base rules; a null language or source
is a group of its own; null doc_ids stay null; repeated rows are judged one by
one; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from triage.llm import common as C

FEATURES = ["log_word_chars", "sqrt_symbols", "dup_lines", "repeat_words", "upper_share"]
FLOORS = [0.08, 0.08, 0.10, 0.10, 0.025]
CORE = 0.5
REWEIGHT = 0.975
#: A step goes on if the logarithm of the determinant fell by more.
FALL = 1e-3
TAIL = 0.9999
MIN_GROUP = 100
MIN_FIT = 30
MIN_WORDS = 50

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
NO_CONTINUATION = (np.arange(256) & 0xC0) != 0x80
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]


def _per_row(flags: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    acc = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=acc[1:])
    return acc[hi] - acc[lo]


def _repeated_words(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words of each row inside 3-word windows that the row holds twice or more."""
    rows, n = C.row_of(first), len(h)
    if n < 3:
        return np.zeros(len(first) - 1, np.int64)
    at = np.flatnonzero(rows[:-2] == rows[2:])
    w = C.mix(h[at] * np.uint64(3) + C.mix(h[at + 1] * np.uint64(5)) + C.mix(h[at + 2] * np.uint64(7) + np.uint64(1)))
    order = np.lexsort((w, rows[at]))
    ws, rs = w[order], rows[at][order]
    same = (ws[1:] == ws[:-1]) & (rs[1:] == rs[:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = at[order[twice]]
    inside = np.zeros(n, bool)
    for j in range(3):
        inside[hit + j] = True
    return _per_row(inside, first[:-1], first[1:])


def _duplicate_lines(buf, starts, ends, words):
    """(lines with a word, those of them equal to an earlier one) of each row."""
    breaks = np.flatnonzero(buf == 10)
    lo = np.concatenate([starts, breaks + 1])
    row = np.concatenate([np.arange(len(starts)), np.searchsorted(starts, breaks, "right") - 1])
    order = np.argsort(lo, kind="stable")
    order = order[lo[order] <= ends[row[order]]]
    lo, row = lo[order], row[order]
    nxt = np.searchsorted(breaks, lo)
    hi = np.minimum(np.append(breaks, len(buf))[nxt], ends[row])
    acc = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(words, out=acc[1:])
    has = acc[hi] > acc[lo]
    lo, hi, row = lo[has], hi[has], row[has]
    _, different = C.distinct_per_row(C.span_hashes(buf, lo, hi), row)
    n = np.bincount(row, minlength=len(starts))
    return n, n - np.bincount(different, minlength=len(starts))


def slice_statistics(buf, starts, ends) -> np.ndarray:
    """One row of STATS for each text of a slice."""
    inside = C.SPACE_WORDS[buf]
    ws, we, first = C.word_spans(buf, starts, ends, C.SPACE_WORDS)
    h = C.span_hashes(buf, ws, we)
    lines, dups = _duplicate_lines(buf, starts, ends, inside)
    return np.stack([np.diff(first), _per_row(inside & NO_CONTINUATION[buf], starts, ends),
                     _per_row(SYMBOLS[buf], starts, ends), dups, _repeated_words(h, first), lines,
                     _per_row(UPPER[buf], starts, ends)], 1)


def features(s: np.ndarray) -> np.ndarray:
    s = s.astype(float)
    words, chars, lines = np.maximum(s[:, 0], 1), np.maximum(s[:, 1], 1), np.maximum(s[:, 5], 1)
    return np.stack([np.log(chars / words), np.sqrt(s[:, 2] / words), s[:, 3] / lines, s[:, 4] / words, s[:, 6] / chars], 1)


def with_statistics(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The carried columns (among doc_id, text, lang, source, n_chars), the
    statistics, base_failed, and the feature vector ``_x``; one scan."""
    fields, text = [docs.schema[c] for c in carry], C.text_name(carry)

    @C.tidy
    def run(batches):
        for b in batches:
            parts = [slice_statistics(buf, lo, hi) for _, buf, lo, hi in C.slices(b.column(text))]
            s = np.concatenate(parts) if parts else np.zeros((0, len(STATS)), np.int64)
            x = features(s)
            failed = (s[:, 0] < MIN_WORDS) | (100 * s[:, 4] > 50 * s[:, 0])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(f"_in_{c}") for c in carry), *(pa.array(s[:, i]) for i in range(5)), pa.array(failed),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))],
                [*(f"_in_{c}" for c in carry), *STATS[:5], "base_failed", "_x"])

    given = C.sent(docs, carry)
    kinds = [f"_in_{f.name} {f.dataType.simpleString()}" for f in fields] + [f"{c} long" for c in STATS[:5]]
    out = given.mapInArrow(run, ", ".join(kinds) + ", base_failed boolean, _x array<double>")
    return out


def chi2_cdf(x: float, p: int) -> float:
    """Chi-square distribution function by the series of the incomplete gamma function."""
    a, x = p / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= x / k
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_quantile(q: float, p: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, p) < q else (lo, mid)
    return (lo + hi) / 2


P = len(FEATURES)
CUT = chi2_quantile(TAIL, P)
INSIDE = chi2_quantile(REWEIGHT, P)


def consistency(share: float) -> float:
    """Makes the covariance of the nearest ``share`` of rows consistent for normal data."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2)


PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def _distance(x: str, centre: str, precision: str):
    """Squared Mahalanobis distance as a Column; precision holds the upper
    triangle with doubled off-diagonal entries."""
    diff = [F.col(x)[i] - F.col(centre)[i] for i in range(P)]
    return sum((F.col(precision)[k] * diff[i] * diff[j] for k, (i, j) in enumerate(PAIRS)), F.lit(0.0))


ESTIMATE = "grp string, start int, centre array<double>, precision array<double>, log_det double"


def _estimate(grp, start: int, centre: np.ndarray, cov: np.ndarray) -> tuple:
    """A row of ESTIMATE; the floors are added to the variances."""
    cov = cov + np.diag(np.square(FLOORS))
    inv = np.linalg.inv(cov)
    return grp, start, centre.tolist(), [float(inv[i, j]) * (1 + (i != j)) for i, j in PAIRS], float(np.linalg.slogdet(cov)[1])


def _symmetric(upper) -> np.ndarray:
    out = np.zeros((P, P))
    for k, (i, j) in enumerate(PAIRS):
        out[i, j] = out[j, i] = upper[k]
    return out


def _estimates_of(share: float):
    """Sums of the nearest ``share`` of rows -> ESTIMATE."""
    factor = consistency(share)

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                m = np.asarray(r.s1) / r.n
                out.append(_estimate(r.grp, r.start, m, (_symmetric(np.asarray(r.s2) / r.n) - np.outer(m, m)) * factor))
            yield pd.DataFrame(out, columns=["grp", "start", "centre", "precision", "log_det"])

    return run


def _starts(batches):
    """Medians, scales and sums of the products of spatial signs -> ESTIMATE of each start."""
    for b in batches:
        out = []
        for r in b.itertuples(index=False):
            m, scale, signs = np.asarray(r.centre), np.asarray(r.scale), _symmetric(r.signs)
            size = np.sqrt(np.diag(signs)) + 1e-9
            signs = signs / np.outer(size, size)
            np.fill_diagonal(signs, 1.0)
            out += [_estimate(r.grp, 0, m, np.diag(np.square(scale))), _estimate(r.grp, 1, m, signs * np.outer(scale, scale)),
                    _estimate(r.grp, 2, m, np.zeros((P, P)))]
        yield pd.DataFrame(out, columns=["grp", "start", "centre", "precision", "log_det"])


def _sums():
    return (F.array(*(F.sum(F.col("_x")[i]) for i in range(P))).alias("s1"),
            F.array(*(F.sum(F.col("_x")[i] * F.col("_x")[j]) for i, j in PAIRS)).alias("s2"))


def _with(rows: DataFrame, est: DataFrame) -> DataFrame:
    """Rows with their group's estimate.  The estimates have one row per
    group and start; they are broadcast only if they were counted to be few."""
    est = F.broadcast(est) if est.count() <= 20_000 else est
    return rows.join(est, "grp", "left")


def group_name(lang: str, source: str):
    """Name of a language's and source's own group, nulls kept apart from all values."""
    return F.concat(F.lit("own "), F.to_json(F.struct(F.col(lang).alias("l"), F.col(source).alias("s")), {"ignoreNullFields": "false"}))


def pool_name(lang: str):
    """Name of the pool of a language's small groups, which no group of its own has."""
    return F.concat(F.lit("pool "), F.to_json(F.struct(F.col(lang).alias("l")), {"ignoreNullFields": "false"}))


def grouped(stats: DataFrame, lang: str, source: str) -> DataFrame:
    """Adds ``grp``: language and source, or the pool that it belongs to."""
    own, by_lang = group_name(lang, source), pool_name(lang)
    keyed = stats.withColumn("_own", own).withColumn("_lang", by_lang)
    sizes = (keyed.where("not base_failed").groupBy("_own", "_lang").agg(F.count("*").alias("_n"))
             .withColumn("_small", F.col("_n") < MIN_GROUP))
    pools = sizes.where("_small").groupBy("_lang").agg(F.sum("_n").alias("_pool"))
    names = (sizes.join(pools, "_lang", "left")
             .select("_own", F.when(~F.col("_small"), F.col("_own")).when(F.col("_pool") >= MIN_GROUP, F.col("_lang"))
                     .otherwise(F.lit("*")).alias("grp")))
    names = C.saved(names, "quality-groups")
    names = F.broadcast(names) if names.count() <= 20_000 else names
    return keyed.join(names, "_own", "left").withColumn("grp", F.coalesce("grp", F.lit("*"))).drop("_own", "_lang")


def starts(rows: DataFrame) -> DataFrame:
    """grp, _x of eligible rows -> ESTIMATE, three rows a group."""
    medians = lambda x: F.array(*(F.percentile_approx(x(i), 0.5, 2000) for i in range(P)))
    centres = (rows.groupBy("grp").agg(F.count("*").alias("n"), medians(lambda i: F.col("_x")[i]).alias("centre"))
               .where(F.col("n") >= MIN_FIT).drop("n"))
    centres = C.saved(centres, "quality-medians")
    scales = (_with(rows, centres).where("centre is not null").groupBy("grp")
              .agg(medians(lambda i: F.abs(F.col("_x")[i] - F.col("centre")[i])).alias("mad"), F.first("centre").alias("centre"))
              .select("grp", "centre", F.array(*(1.4826 * F.col("mad")[i] for i in range(P))).alias("scale")))
    scales = C.saved(scales, "quality-scales")
    z = [(F.col("_x")[i] - F.col("centre")[i]) / F.sqrt(F.col("scale")[i] * F.col("scale")[i] + FLOORS[i] ** 2) for i in range(P)]
    signs = (_with(rows, scales).where("centre is not null").select("grp", "centre", "scale", F.array(*z).alias("_z"))
             .withColumn("_l", sum((F.col("_z")[i] * F.col("_z")[i] for i in range(P)), F.lit(0.0))).where("_l > 0")
             .groupBy("grp").agg(F.array(*(F.sum(F.col("_z")[i] * F.col("_z")[j] / F.col("_l")) for i, j in PAIRS)).alias("signs")))
    none = F.array(*(F.lit(0.0) for _ in PAIRS))
    given = scales.join(signs, "grp", "left").withColumn("signs", F.coalesce("signs", none))
    return C.saved(given.mapInPandas(_starts, ESTIMATE), "quality-starts")


def concentrated(rows: DataFrame, est: DataFrame) -> DataFrame:
    """One concentration step from each estimate."""
    near = _with(rows, est).where("centre is not null").withColumn("_d", _distance("_x", "centre", "precision"))
    # bins of 1/16 octave of the squared distance; the core is the nearest bins that together hold its share
    bins = near.groupBy("grp", "start", F.floor(16 * F.log2(F.col("_d") + 1e-6)).alias("bin")).agg(F.count("*").alias("n"), *_sums())
    w = Window.partitionBy("grp", "start").orderBy("bin")
    need = CORE * F.col("all") - F.col("before")
    core = (bins.withColumn("before", F.sum("n").over(w) - F.col("n"))
            .withColumn("all", F.sum("n").over(Window.partitionBy("grp", "start")))
            .where(need > 0).withColumn("_w", F.least(need / F.col("n"), F.lit(1.0)))
            .groupBy("grp", "start").agg(F.sum(F.col("_w") * F.col("n")).alias("n"),
                                         F.array(*(F.sum(F.col("_w") * F.col("s1")[i]) for i in range(P))).alias("s1"),
                                         F.array(*(F.sum(F.col("_w") * F.col("s2")[k]) for k in range(len(PAIRS)))).alias("s2")))
    return core.mapInPandas(_estimates_of(CORE), ESTIMATE)


def estimates(rows: DataFrame) -> DataFrame:
    """grp, _x of eligible rows -> grp, centre, precision."""
    est, best, step = C.saved(concentrated(rows, starts(rows)), "quality-step0"), None, 0
    while True:   # ends: a determinant that goes on falls by FALL and has the floors below it
        step += 1
        new = C.saved(concentrated(rows, est).join(est.select("grp", "start", F.col("log_det").alias("_was")), ["grp", "start"]), f"quality-step{step}")
        falls = F.col("log_det") < F.col("_was") - FALL
        ended = est.join(new.where(~falls).select("grp", "start"), ["grp", "start"], "left_semi")
        best = ended if best is None else best.unionByName(ended)
        est = new.where(falls).drop("_was")
        if est.isEmpty():
            break
    least = best.groupBy("grp").agg(F.min_by(F.struct("centre", "precision"), F.struct("log_det", "start")).alias("e"))
    least = C.saved(least.select("grp", F.lit(0).alias("start"), "e.centre", "e.precision"), "quality-least")
    inside = (_with(rows, least).where("centre is not null").where(_distance("_x", "centre", "precision") <= INSIDE)
              .groupBy("grp", "start").agg(F.count("*").alias("n"), *_sums()))
    return C.saved(inside.mapInPandas(_estimates_of(REWEIGHT), ESTIMATE).select("grp", "centre", "precision"), "quality-final")


def judged(docs: DataFrame, carry: list[str], keep_text: bool = False) -> DataFrame:
    """The carried columns, STATS[:5], base_failed, distance (null without an
    estimate) and kept."""
    cols = list(dict.fromkeys([*carry, "lang", "source"]))
    stats = with_statistics(docs, cols)
    if not keep_text:
        stats = C.saved(stats, "quality-stats")
        rows = grouped(stats, "_in_lang", "_in_source")
        small = rows
    else:   # the texts stay in the scan: the estimates read a table of the vectors alone
        small = grouped(C.saved(with_statistics(docs, ["lang", "source"]), "quality-stats"), "_in_lang", "_in_source")
        rows = grouped_like(stats, small)
    est = estimates(small.where("not base_failed").select("grp", "_x"))
    out = _with(rows, est).withColumn("distance", F.sqrt(F.greatest(_distance("_x", "centre", "precision"), F.lit(0.0))))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= math.sqrt(CUT), F.lit(True))
    return out.select(*(F.col(f"_in_{c}").alias(c) for c in carry), *STATS[:5], "base_failed", "distance", kept.alias("kept"))


def grouped_like(stats: DataFrame, small: DataFrame) -> DataFrame:
    """Gives rows that still hold their texts the group that ``small`` (their
    vectors alone) found for their language and source."""
    names = C.saved(small.select("_in_lang", "_in_source", "grp").distinct(), "quality-names")
    key = group_name("_in_lang", "_in_source")
    names = names.select(key.alias("_own"), "grp")
    names = F.broadcast(names) if names.count() <= 20_000 else names
    return stats.withColumn("_own", key).join(names, "_own", "left").withColumn("grp", F.coalesce("grp", F.lit("*"))).drop("_own")
