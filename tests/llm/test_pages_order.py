"""Merkle audit, URL verdicts and training order."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import SF001, SF01
from triage.llm import merkle, training_order, url_trees
from triage.llm.common import saved
from triage.llm.queries import QUERIES, SQL

WB = public_tokenizers.path("word_bpe_49k.json")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(tuple(str(r[c]) for c in cols) for r in df.collect())


# ---------------------------------------------------------------- Merkle

def test_audit_equals_its_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF01}/pages.parquet')")
    got = QUERIES["op1_merkle_audit"](spark, SF01)
    want = con.execute(SQL["op1_merkle_audit"]).df()
    assert len(want) and rows_of(got) == sorted(tuple(str(v) for v in r) for r in want[sorted(got.columns)].itertuples(index=False))


def test_audit_finds_exactly_the_damage(spark):
    a = [(i, f"u{i}", f"<p>{i}</p>") for i in range(20_000)] + [(None, "u", None), (7, "u7", "<p>7</p>"), (30_000, None, "")]
    b = [r for r in a if r[0] not in (5, 17_000)] + [(19_999, "extra", "x"), (40_000, "new", "file")]
    b[100] = (b[100][0], b[100][1], b[100][2] + " ")
    b[-3] = (30_000, "", "")       # null and empty fields differ
    schema = "page_id long, url string, html string"
    ra, rb = (merkle.records(spark.createDataFrame(x, schema).withColumn("node", merkle.F.lit(1)).repartition(7), "page_id", ["url", "html"]) for x in (a, b))
    digest = lambda r: hashlib.sha256("\x1f".join([str(-1 if r[0] is None else r[0]), *("n" if v is None else f"{len(v.encode())}:{v}" for v in r[1:])]).encode()).hexdigest()
    ca, cb = Counter((-1 if r[0] is None else r[0], digest(r)) for r in a), Counter((-1 if r[0] is None else r[0], digest(r)) for r in b)
    want = sorted((*k, ca[k], cb[k]) for k in {*ca, *cb} if ca[k] != cb[k])
    assert sorted((r.record, r.digest, r.n_a, r.n_b) for r in merkle.audit(ra, rb).collect()) == want
    assert merkle.audit(ra, ra).count() == 0
    none = ra.limit(0)
    assert merkle.audit(none, none).count() == 0
    assert merkle.audit(ra, none).count() == len(ca)


def test_audit_sees_a_moved_field_border(spark):
    schema = "page_id long, url string, html string"
    pairs = [(("a\x1fvb", "c"), ("a", "b\x1fvc")), (("a\x1f1:b", "c"), ("a", "b\x1f1:c")), (("n", None), (None, "n")), (("", "x"), ("x", "")), (("é", "1:e"), ("é1", ":e"))]
    for left, right in pairs:
        ra, rb = (merkle.records(spark.createDataFrame([(1, *x)], schema), "page_id", ["url", "html"]) for x in (left, right))
        assert merkle.audit(ra, rb).count() == 2, (left, right)


# ---------------------------------------------------------------- URLs

def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.translate(AZ)
    fits = [(len(h + p), h + p, v) for v, h, p in url_trees.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


ODD_URLS = [None, "", "no scheme", "http://", "http://EXAMPLE.org/es/x", "http://example.org/en/12?x=1", "http://example.org", "http://org/", "x://a.org?q/",
            "http://notexample.org/es/1", "ftp://a.b.com/de/", "http://a.com/DE/1", "http://ünï.com/fr/é", "://b.com/fr/", "http://a.net/" + "y" * 5000,
            "http://a.com#/fr/", "http://a.com/fr", "http://a.com:80/fr/", "a://b://c.com/de/", "http://a.com/de/\nx"]


def test_rules_and_verdicts(spark):
    pages = spark.read.parquet(f"{SF01}/pages.parquet").select("page_id", "url")
    odd = spark.createDataFrame([(None if i == 3 else 10_000 + i, u) for i, u in enumerate([*ODD_URLS, ODD_URLS[4]])], "page_id long, url string")
    df = pages.union(odd).withColumn("host", merkle.F.lit("clash")).withColumn("_y", merkle.F.lit(1))
    given = sorted((str(r.page_id), *map(str, brute_rule(r.url)[:3])) for r in df.collect())
    rows = url_trees.verdicts(df).collect()
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule)) for r in rows) == given
    verdict = {h + p: v for v, h, p in url_trees.RULES}
    assert all(r.verdict == verdict[r.rule] if r.rule else r.verdict in ("allow", "block") for r in rows)


def test_trees_learn_held_out_labels(spark):
    """Labels of the rules, a fifth of them held out."""
    df = url_trees.with_features(url_trees.with_rule(url_trees.parts(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"))))
    df = df.where("decided is not null").withColumn("label", merkle.F.col("decided"))
    model = url_trees.UrlTrees(df.where("page_id % 5 <> 1"))
    rows = model.judged(df.where("page_id % 5 = 1")).select("label", "learned").collect()
    right = sum(r.label == r.learned for r in rows) / len(rows)
    base = max(Counter(r.label for r in rows).values()) / len(rows)
    assert right > base + 0.5 * (1 - base)


def test_trees_without_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id long, url string")
    assert [r.verdict for r in url_trees.verdicts(pages).collect()] == ["allow", "allow"]
    assert url_trees.verdicts(pages.limit(0)).count() == 0


def test_url_plan_is_native(spark):
    plan = QUERIES["op10_url_trees"](spark, SF001)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_splits(data, nodes, margin):
    """Best split of each node by trying all of them on the rows."""
    p = 1 / (1 + np.exp(-margin))
    out = {}
    for node in set(nodes):
        at = [i for i, n in enumerate(nodes) if n == node]
        best = None
        for f in range(len(url_trees.FEATURES)):
            for b in sorted({data[i][f] for i in at})[:-1]:
                gain = 0.0
                for side in ([i for i in at if data[i][f] <= b], [i for i in at if data[i][f] > b]):
                    g, h = sum(data[i][-1] - p[i] for i in side), sum(p[i] * (1 - p[i]) for i in side)
                    gain += g * g / (h + url_trees.RIDGE)
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, f, b)
        out[node] = best and best[1:]
    return out


def test_first_tree_equals_brute_force(spark):
    df = url_trees.with_features(url_trees.with_rule(url_trees.parts(spark.read.parquet(f"{SF01}/pages.parquet"))))
    df = df.where("decided is not null").withColumn("label", merkle.F.col("decided"))
    model = url_trees.UrlTrees(df)
    rows = model.with_bins(model.with_statistics(df)).collect()
    data = [[*(r[f"b{k}"] for k in range(len(url_trees.FEATURES))), float(r.label == "block")] for r in rows]
    nodes, margin = [0] * len(data), np.full(len(data), model.base)
    for level in model.trees[0]:
        for node, split in brute_splits(data, nodes, margin).items():
            if split:
                assert level[node][:2] == split
        nodes = [2 * n if data[i][level[n][0]] <= level[n][1] else 2 * n + 1 for i, n in enumerate(nodes)]


# ---------------------------------------------------------------- training order

@pytest.mark.parametrize("n", [1, 2, 3, 5, 100, 1000, 4097])
def test_feistel_is_a_permutation(n):
    x = np.arange(n)
    y = training_order.feistel(x, n, 5)
    assert sorted(y.tolist()) == list(range(n))
    assert (training_order.feistel(y, n, 5, inverse=True) == x).all()
    if n >= 100:
        assert (training_order.feistel(x, n, 6) != y).mean() > 0.9


@pytest.mark.parametrize("which", ["odd_docs", "docs"])
def test_materialised_order(which, request):
    df = request.getfixturevalue(which)
    tok, want = Tokenizer.from_file(WB), []
    for r in df.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [1]
        for p in range(0, len(ids), training_order.SEQUENCE):
            part = np.array(ids[p:p + training_order.SEQUENCE], "<u2").tobytes()
            want.append((str(r.doc_id), p // training_order.SEQUENCE, len(part) // 2, zlib.crc32(part)))
    shard = 100
    shards = saved(training_order.materialised(df, WB, shard=shard), "test-order")
    rows = training_order.read_from(shards, shard=shard).collect()
    assert sorted((str(r.doc_id), r.part, r.n_ids, r.ids_crc32) for r in rows) == sorted(want)
    assert sorted(r.slot for r in rows) == list(range(len(want)))
    for r in shards.collect():
        assert len(r.payload) == r.n * training_order.STRIDE and r.first_slot // shard == (r.first_slot + r.n - 1) // shard == r.shard
    late = training_order.read_from(shards, len(want) // 2 + 1, shard).collect()
    assert sorted(r.slot for r in late) == list(range(len(want) // 2 + 1, len(want)))
    # neighbours in a text are not neighbours in training order
    by = defaultdict(dict)
    for r in rows:
        by[r.doc_id][r.part] = r.slot
    steps = [abs(s[p + 1] - s[p]) for s in by.values() for p in s if p + 1 in s]
    assert np.mean(steps) > len(want) / 10


def test_no_documents(no_docs):
    assert training_order.materialised(no_docs, WB).count() == 0
