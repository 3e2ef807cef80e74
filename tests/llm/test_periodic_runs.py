"""Periodic runs against the definition, word by word."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from triage.llm import periodic_runs as R
from triage.llm.queries import QUERIES

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w):
    """Maximal stretches by every period, those with a smaller period left out."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            s = i
            while i < n and w[i] == w[i - q]:
                i += 1
            start, length = s - q, i - s + q
            if length >= max(6, 4 * q) and not any(all(w[x] == w[x - p] for x in range(start + p, start + length)) for p in range(1, q)):
                out.append((start, length, q))
    return sorted(out)


def brute_row(doc_id, text):
    w = SPACE.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, n_, q in runs for i in range(s + q, s + n_)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), best[0], best[1], best[2], 1000 * best[1] // best[2] if runs else None,
            sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"))
                   for r in df.collect()), key=str)


def test_random_words_of_few_letters():
    rng = random.Random(5)
    for trial in range(1500):
        letters, n = rng.choice(["a", "ab", "abc", "abcdefgh"]), rng.randrange(0, 90)
        w = [rng.choice(letters) for _ in range(n)]
        if trial % 3 and n:
            a, p = rng.randrange(n), rng.randrange(1, 20)
            w = w[:a] + [w[a + i % min(p, n - a)] for i in range(n - a)]
        ids = np.array([ord(c) for c in w], np.uint64)
        cut = rng.randrange(0, n + 1)                     # two texts in one slice never share a run
        row = np.array([0] * cut + [1] * (n - cut))
        want = brute_runs(w[:cut]) + [(s + cut, m, q) for s, m, q in brute_runs(w[cut:])]
        assert R.runs_of(ids, row) == sorted(want), w


def test_work_is_not_quadratic_in_a_repeated_word():
    for ids in (np.zeros(300_000, np.uint64), np.arange(300_000, dtype=np.uint64) % np.uint64(2)):
        place, _, _ = R.earlier_blocks(ids, np.zeros(len(ids), int))
        assert len(place) <= len(ids)
        period = int(len(set(ids[:2].tolist())))
        assert R.runs_of(ids, np.zeros(len(ids), int)) == [(0, len(ids), period)]


@pytest.mark.parametrize("which", ["odd_docs", "docs"])
def test_query_rows_by_definition(which, request):
    df = request.getfixturevalue(which)
    short = df.where("length(text) < 6000 or text is null")
    want = sorted((brute_row(r.doc_id, r.text) for r in short.collect()), key=str)
    assert got(R.digest(R.periodic_runs(short, R.planted))) == want


def test_long_text_of_one_phrase(odd_docs):
    row = [r for r in R.periodic_runs(odd_docs).collect() if r.collapsed == "long word list"]
    assert [tuple(x) for r in row for x in r.runs] == [(0, 12_000, 3)]


def test_nothing_given(no_docs):
    assert R.digest(R.periodic_runs(no_docs, R.planted)).count() == 0


def test_registered_query(spark):
    rows = QUERIES["op12_periodic_runs"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert sum(r.n_runs > 0 for r in rows) >= 5
