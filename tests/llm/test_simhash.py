"""SimHash fingerprints and links against their definitions."""

import re

import numpy as np
import pytest
import xxhash

from triage.llm import simhash as S
from triage.llm.jaccard import components
from triage.llm.queries import QUERIES

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF001 = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    w = SPACE.findall((text or "").translate(AZ))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def brute_components(fps):
    """fp -> smallest member's place, by comparing all pairs."""
    fps = sorted(set(fps))
    x = np.array(fps, np.uint64)
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1:] ^ x[i]) <= 2).tolist():
            a, b = root(i), root(i + 1 + j)
            label[max(a, b)] = min(a, b)
    return {f: root(i) for i, f in enumerate(fps)}


def brute(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = brute_components(fps)
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[comp[f]] = min(least.get(comp[f], i), i)
    return sorted(((i, f"{f:016x}", least.get(comp[f])) for (i, _), f in zip(rows, fps)), key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


@pytest.mark.parametrize("which", ["odd_docs", "docs"])
def test_rows_by_definition(which, request):
    df = request.getfixturevalue(which)
    assert rows_of(S.near_duplicates(df)) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_registered_query(spark, no_docs):
    df = spark.read.parquet(f"{SF001}/documents.parquet")
    assert rows_of(QUERIES["op11_simhash"](spark, SF001)) == brute([(r.doc_id, r.text) for r in df.collect()])
    assert S.near_duplicates(no_docs).count() == 0


def balls(rng, centres, size, most):
    """Fingerprints around centres, each with up to ``most`` bits changed."""
    out = []
    for _ in range(centres):
        c = int(rng.integers(0, 2 ** 63)) * 2 + int(rng.integers(0, 2))
        out.append(c)
        for _ in range(size):
            out.append(c ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, most + 1)), replace=False)))
    return out


def linked(spark, fps):
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in set(fps)], "fp long").repartition(3)
    link = S.links(df)
    label = {r.v: r.label for r in components(link).collect()}
    for r in link.collect():
        assert ((r.a ^ r.b) & (2 ** 64 - 1)).bit_count() <= 2
    got = {}
    for f in set(fps):
        v = int(np.uint64(f).view(np.int64))
        got.setdefault(label.get(v, v), set()).add(f)
    return got, link


@pytest.mark.parametrize("parts", [4, 3])
@pytest.mark.parametrize("whole_cost", [130, 10])
def test_links_keep_every_component(spark, monkeypatch, parts, whole_cost):
    monkeypatch.setattr(S, "WHOLE_COST", whole_cost)
    if parts == 3:
        monkeypatch.setattr(S, "FOUR_PARTS", 0)
    rng = np.random.default_rng(parts)
    fps = balls(rng, 30, 12, 4) + balls(rng, 2, 400, 3) + [0, 1, 3, 7] + [int(x) for x in rng.integers(0, 2 ** 63, 500)]
    got, _ = linked(spark, fps)
    want = {}
    for f, c in brute_components(fps).items():
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_links_grow_with_the_group_not_its_square(spark):
    sizes = []
    for size in (400, 1600):
        fps = balls(np.random.default_rng(1), 1, size, 3)
        _, link = linked(spark, fps)
        sizes.append(link.count() / len(set(fps)))
    assert sizes[1] < 2 * sizes[0] + 5 and sizes[1] < S.WHOLE_COST


def test_budgets_are_the_cheapest_split():
    rng = np.random.default_rng(2)
    cost = rng.integers(1, 60, (4, 4, 50)).astype(float).cumsum(axis=1)
    cost[:, 0] = 0
    budget, least = S.allocated(cost)
    assert (budget.sum(axis=0) == 3).all()
    for r in range(50):
        options = [sum(cost[p, e, r] for p, e in enumerate(s)) for s in np.ndindex(4, 4, 4, 4) if sum(s) == 3]
        assert least[r] == min(options) == sum(cost[p, budget[p, r], r] for p in range(4))


def test_correlated_bits_share_a_part():
    corr = np.eye(64)
    for g in range(4):
        for i in range(g, 64, 4):
            for j in range(g, 64, 4):
                corr[i, j] = 1.0 if i == j else 0.8
    assert sorted(S.grouped_bits(corr, 4)) == [list(range(g, 64, 4)) for g in range(4)]
    assert sorted(map(len, S.grouped_bits(np.eye(64), 3))) == [21, 21, 22]
