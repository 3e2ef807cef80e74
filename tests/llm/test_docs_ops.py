"""Language ID, decontamination and quality rules: brute force, held-out
accuracy and odd inputs."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from conftest import SF01
from triage.llm import decontam, langid, quality
from triage.llm.queries import QUERIES

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def key(r):
    return tuple(str(x) for x in r)


# ---------------------------------------------------------------- quality

def base_statistics(text):
    w = SPACE.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    c = Counter(zip(w, w[1:], w[2:]))
    hit = set()
    for i in range(len(w) - 2):
        if c[(w[i], w[i + 1], w[i + 2])] > 1:
            hit |= {i, i + 1, i + 2}
    return (len(w), sum(map(len, w)), sum((text or "").count(x) for x in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))


@pytest.mark.parametrize("which", ["odd_docs", "docs"])
def test_quality_base_statistics(which, request):
    df = request.getfixturevalue(which)
    want = sorted(key((r.doc_id, *base_statistics(r.text))) for r in df.collect())
    rows = quality.judged(df, ["doc_id"]).collect()
    got = sorted(key((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in rows)
    assert got == want
    assert not any(r.base_failed and r.kept for r in rows)


def test_own_groups_and_pools_have_names_of_their_own(spark):
    rows = [("en", None)] * 150 + [("en", "a")] * 60 + [("en", "b")] * 60 + [(None, None)] * 150 + [(None, "c")] * 60 + [(None, "d")] * 60
    stats = spark.createDataFrame([(*r, False) for r in rows], "lang string, source string, base_failed boolean")
    by = {}
    for r in quality.grouped(stats, "lang", "source").collect():
        by.setdefault(r.grp, set()).add((r.lang, r.source))
    assert sorted(by.values(), key=str) == sorted([{("en", None)}, {("en", "a"), ("en", "b")}, {(None, None)}, {(None, "c"), (None, "d")}], key=str)


def test_quality_verdicts_follow_labels(spark):
    kept = {r.doc_id: r for r in QUERIES["op7_quality"](spark, SF01).collect()}
    labels = spark.read.parquet(f"{SF01}/labels.parquet").collect()
    good = [kept[r.doc_id] for r in labels if r.quality == 1 and not kept[r.doc_id].base_failed]
    bad = [kept[r.doc_id] for r in labels if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    assert sum(not r.kept for r in bad) >= 0.8 * len(bad)


def test_concentration_finds_the_clean_centre(spark):
    rng = np.random.default_rng(1)
    clean = rng.normal(1, 0.3, (4000, 5))
    dirt = rng.normal(4, 0.1, (700, 5))
    rows = spark.createDataFrame([("g", x.tolist()) for x in np.concatenate([clean, dirt])], "grp string, _x array<double>")
    est = quality.estimates(rows).collect()[0]
    assert np.abs(np.array(est.centre) - 1).max() < 0.05


@pytest.mark.parametrize("share", [0.27, 0.33])
@pytest.mark.parametrize("spread", [0.02, 0.06])
def test_copies_of_a_third_are_rejected(spark, share, spread):
    rng, n = np.random.default_rng(2), 3000
    x = rng.normal(0.5, spread, (n, 5))
    junk = int(share * n)
    x[:junk] = 0.5 + 5 * np.sqrt(np.square(quality.FLOORS) + spread ** 2)
    rows = spark.createDataFrame([("g", r.tolist()) for r in x], "grp string, _x array<double>")
    e = quality.estimates(rows).collect()[0]
    inv = np.zeros((5, 5))
    for v, (i, j) in zip(e.precision, quality.PAIRS):
        inv[i, j] += v / 2
        inv[j, i] += v / 2
    far = np.einsum("ij,jk,ik->i", x - e.centre, inv, x - e.centre) > quality.CUT
    assert far[:junk].all() and far[junk:].mean() < 0.01


def test_chi2_quantiles():
    assert abs(quality.chi2_quantile(0.95, 1) - 3.841459) < 1e-4
    assert abs(quality.chi2_quantile(0.99, 5) - 15.08627) < 1e-4


# ---------------------------------------------------------------- language ID

def test_langid_held_out_accuracy(spark):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    rows = QUERIES["op3_langid"](spark, SF01).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in held) >= 0.97 * len(held)


def test_langid_odd_rows(odd_docs, no_docs, docs):
    model = langid.train(docs)
    rows = langid.predict(odd_docs, model, ["doc_id", "text"]).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert (r.lang_pred == "und") == (not any(ch.isalpha() for ch in r.text or ""))
    assert langid.predict(no_docs, model, ["doc_id"]).count() == 0
    empty = langid.train(no_docs)
    assert {r.lang_pred for r in langid.predict(odd_docs, empty, ["doc_id"]).collect()} == {"und"}


def test_network_gradient():
    rng = np.random.default_rng(0)
    net = langid.Network(3)
    x, y = rng.integers(0, 64, (6, 20)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])

    def loss():
        top = np.concatenate([sum(t[j].astype(float)[x[:, j:20 - w + 1 + j]] for j in range(w)).max(1)
                              for w, t in zip(langid.WIDTHS, net.params)], 1) + net.params[3]
        p = langid._softmax(np.maximum(top, 0) @ net.params[4] + net.params[5])
        return -np.log(p[np.arange(6), y]).mean()

    grads = net.gradient(x, y)
    for k, at in ((0, (1, int(x[0, 3]), 2)), (2, (3, int(x[2, 9]), 1)), (4, (5, 1)), (5, (2,))):
        base = net.params[k][at]
        net.params[k][at] = base + 1e-3
        up = loss()
        net.params[k][at] = base - 1e-3
        down = loss()
        net.params[k][at] = base
        assert abs((up - down) / 2e-3 - grads[k][at]) < 2e-3


def test_compiled_tables_equal_the_network():
    net = langid.Network(3)
    x = np.random.default_rng(0).integers(0, 64, (5, langid.WINDOW)).astype(np.uint8)
    top = np.concatenate([sum(t[j][x[:, j:langid.WINDOW - w + 1 + j]] for j in range(w)).max(1)
                          for w, t in zip(langid.WIDTHS, net.params)], 1) + net.params[3]
    want = langid._softmax(np.maximum(top, 0) @ net.params[4] + net.params[5])
    assert np.allclose(langid.probabilities(net, net.compiled(), x), want, atol=1e-5)


# ---------------------------------------------------------------- decontamination

def brute_hits(text, items):
    w = ALNUM.findall((text or "").translate(AZ))
    hit, found = set(), set()
    where = {}
    for n in {min(10, len(i)) for _, i in items if i}:
        where[n] = {}
        for s in range(len(w) - n + 1):
            where[n].setdefault(tuple(w[s:s + n]), []).append(s)
    for item_id, i in items:
        n = min(10, len(i))
        for s in range(len(i) - n + 1 if n else 0):
            for a in where[n].get(tuple(i[s:s + n]), ()):
                hit |= set(range(a, a + n))
                found.add(str(item_id))
    ids = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("which,rows", [("odd_docs", 500_000), ("odd_docs", 0), ("docs", 500_000), ("docs", 0)])
def test_decontamination(spark, which, rows, request, monkeypatch):
    """rows: 0 joins windows and hits without a broadcast."""
    df = request.getfixturevalue(which)
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(decontam, "HELD", 50)
    monkeypatch.setattr(decontam, "PART", 7)
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    odd = [(100, "One"), (101, "WORD list long"), (102, ""), (103, None), (None, "one"), (104, "a b"), (100, "two"),
           (105, "repeat me repeat me repeat me"), (106, "long word list " * 5), (106, "long word list " * 5)]
    bench = bench.select("item_id", "text").union(spark.createDataFrame(odd, "item_id long, text string"))
    items = [(r.item_id, ALNUM.findall(r.text.translate(AZ))) for r in bench.collect() if r.item_id is not None and r.text]
    want = sorted(key((r.doc_id, *brute_hits(r.text, items))) for r in df.collect())
    got = sorted(key(r) for r in decontam.digest(decontam.decontaminated(df, bench, ["doc_id"])).collect())
    assert got == want
    kept = decontam.clean(df, bench, ["doc_id", "text"])
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(r[0] for r in want if r[-1] == "False")


def test_decontamination_by_many_items_of_a_passage(spark):
    """A passage that half of the items and a third of the documents share."""
    rng = np.random.default_rng(3)
    word = lambda n: [f"v{i}" for i in rng.integers(0, 500, n)]
    passage = word(14)
    bench = [(i, " ".join(word(3) + passage + word(2) if i % 2 else word(int(rng.integers(1, 25))))) for i in range(60)]
    texts = [(i, " ".join(word(30) + (passage[:11] if i % 3 == 0 else []) + word(20) + (bench[i % 60][1].split() if i % 5 == 0 else []))) for i in range(90)]
    items = [(i, t.split()) for i, t in bench]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = decontam.digest(decontam.decontaminated(df, spark.createDataFrame(bench, "item_id long, text string"), ["doc_id"]))
    assert sorted(key(r) for r in got.collect()) == sorted(key((d, *brute_hits(t, items))) for d, t in texts)


def test_decontamination_without_items_or_documents(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = decontam.digest(decontam.decontaminated(odd_docs, none, ["doc_id"])).collect()
    assert len(rows) == odd_docs.count() and {r.items_sha256 for r in rows} == {decontam.NO_ITEMS}
    bench = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert decontam.decontaminated(no_docs, bench, ["doc_id"]).count() == 0
    assert decontam.clean(odd_docs, none, ["doc_id"]).count() == odd_docs.count() and decontam.clean(no_docs, bench, ["doc_id"]).count() == 0
