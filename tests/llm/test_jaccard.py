"""n-gram Jaccard join against all pairs, on odd rows and near-copy families."""

import random
import re

import pytest

from triage.llm import jaccard

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = SPACE.findall((text or "").translate(AZ))
    return frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    different = list(dict.fromkeys(s for s in sets if s))
    first = {s: next(i for i, x in enumerate(sets) if x == s) for s in different}
    for i, s in enumerate(sets):
        if s:
            up[find(i)] = find(first[s])
    for i, a in enumerate(different):
        for b in different[:i]:
            if 100 * len(a & b) >= percent * len(a | b):
                up[find(first[a])] = find(first[b])
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), len(s), str(least.get(find(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def family_rows():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    shared = rng.choices(vocab, k=60)
    rows = []
    for f in range(25):
        base = rng.choices(vocab, k=rng.choice([3, 4, 5, 9, 30, 80, 300]))
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.3:      # a passage that many documents share
                w = w[:len(w) // 2] + shared + w[len(w) // 2:]
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    chain = rng.choices(vocab, k=200)    # a chain: neighbours link, ends do not
    for s in range(12):
        rows.append((2000 - s, " ".join(chain[s * 4:s * 4 + 120])))
    return rows


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_families(spark, k, percent):
    rows = family_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard.Jaccard(k, percent).documents(df).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, k, percent)


def pool_rows(n, sentences=40, of=4):
    """Texts of a few sentences out of a pool: nearly all shingles are shared."""
    rng = random.Random(9)
    pool = [[f"s{i}w{j}" for j in range(12)] for i in range(sentences)]
    return [(d, " ".join(w for s in rng.sample(pool, of) for w in s) + (f" x{d % 3}" if d % 4 else "")) for d in range(n)]


@pytest.mark.parametrize("pairs,cell", [(1, 1 << 10), (30, 5), (1 << 16, 3)])
def test_groups_are_split_without_losing_links(spark, monkeypatch, pairs, cell):
    monkeypatch.setattr(jaccard, "GROUP_PAIRS", pairs)
    monkeypatch.setattr(jaccard, "CELL_ROWS", cell)
    rows = [*pool_rows(500), *((5000 + d, t) for d, t in family_rows())]
    rows += [(9000 + d, t + " tail of it") for d, t in pool_rows(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard.Jaccard(4, 85).documents(df).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, 4, 85)


def boundary_rows(n):
    """One family whose pairs lie on both sides of the threshold: copies that
    differ in some words and in length, down to the shortest that still links."""
    rng = random.Random(21)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for d in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"m{d}x{rng.randrange(9)}"
        rows.append((d, " ".join(w[:rng.choice([60, 60, 60, 58, 55, 53, 51])])))
    return rows


@pytest.mark.parametrize("pairs", [1, 1 << 16])
def test_family_at_the_threshold(spark, monkeypatch, pairs):
    monkeypatch.setattr(jaccard, "GROUP_PAIRS", pairs)
    monkeypatch.setattr(jaccard, "CELL_ROWS", 7)
    rows = boundary_rows(250)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard.Jaccard(4, 85).documents(df).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, 4, 85)
    assert len({r.component_id for r in got}) > 1


@pytest.mark.parametrize("which", ["odd_docs", "docs"])
def test_tables(which, request):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = brute(rows, 4, 85)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.Jaccard(4, 85).documents(df).collect())
    # texts without words are linked with nothing: their component is their own id
    assert got == want


def test_one_stays_of_each_group(spark, odd_docs):
    rows = family_rows()
    df = spark.createDataFrame([(*r, "en", "s", 0) for r in [*rows, rows[3], rows[3]]], "doc_id long, text string, lang string, source string, n_chars long")
    cols = df.columns
    j = jaccard.Jaccard(5, 80)
    kept = j.representatives(df, cols).collect()
    comps = {r.component_id for r in j.documents(df).collect()}
    assert sorted(r.doc_id for r in kept) == sorted(comps)
    assert j.representatives(odd_docs, ["doc_id", "text"]).count() > 10


def test_no_documents(no_docs):
    assert jaccard.Jaccard(4, 85).documents(no_docs).count() == 0
