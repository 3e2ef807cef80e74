"""The pipeline's stages against brute force on their own inputs."""

import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from conftest import SF001
from test_docs_ops import ALNUM, AZ, SPACE, base_statistics, brute_hits
from triage.llm import langid, quality
from triage.llm.common import saved


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF001}/documents.parquet"), []
    for name, f in P.STAGES:
        given = docs
        docs = saved(f(spark, docs, SF001), f"test-{name}")
        out.append((given, docs))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_return_the_columns_of_documents(stages, spark):
    want = spark.read.parquet(f"{SF001}/documents.parquet").schema
    for given, kept in stages[:-1]:
        assert kept.columns == want.names and [f.dataType for f in kept.schema] == [f.dataType for f in want]
        before = {tuple(r) for r in given.collect()}
        assert {tuple(r) for r in kept.collect()} <= before


def test_language_stage(stages):
    given, kept = stages[0]
    pred = {r.doc_id: r for r in langid.predict(given, langid.train(given), ["doc_id"]).collect()}
    assert set(rows(kept)) == {d for d, r in pred.items() if r.lang_pred != "und" and r.score >= 0.5}
    assert kept.count() >= 0.95 * given.count()


def test_quality_stage(stages):
    given, kept = stages[1]
    judged = {r.doc_id: r for r in quality.judged(given, ["doc_id"]).collect()}
    assert set(rows(kept)) == {d for d, r in judged.items() if r.kept}
    assert not any(base_statistics(r.text)[-1] for r in kept.collect())


def shingle_set(text):
    w = SPACE.findall(text.translate(AZ))
    return frozenset(zip(*(w[i:] for i in range(5))))


def test_near_duplicate_stage(stages):
    given, kept = stages[2]
    sets = {d: shingle_set(r.text) for d, r in rows(given).items()}
    up = {d: d for d in sets}

    def find(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    assert set(rows(kept)) == {find(d) for d in ids}


def test_decontamination_stage(stages, spark):
    given, kept = stages[3]
    items = [(r.item_id, ALNUM.findall(r.text.translate(AZ))) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    assert set(rows(kept)) == {d for d, r in rows(given).items() if not brute_hits(r.text, items)[-1]}


def test_packing_stage(stages):
    given, packed = stages[4]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = {d: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for d, r in rows(given).items()}
    got = {}
    for r in packed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == total


def test_run_equals_its_stages(stages, spark):
    a, b = P.run(spark, SF001), stages[-1][1]
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))


def test_odd_and_empty_documents(spark, odd_docs, no_docs):
    odd = odd_docs.select(*P.COLUMNS)
    for given in (odd, odd.limit(0)):
        docs = given
        for name, f in P.STAGES:
            docs = saved(f(spark, docs, SF001), f"test-odd-{name}")
        docs.count()
