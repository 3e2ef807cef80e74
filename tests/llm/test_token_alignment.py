"""Cross-tokenizer alignment against byte-by-byte overlaps."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from triage.llm import token_alignment as T
from triage.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF001 = "/root/testdata/sf0.001"


def brute(rows):
    """Every token owns its bytes; two tokens are linked if they own a byte in common."""
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    back = T.byte_of_char()
    docs, counts = [], Counter()
    for doc_id, text in rows:
        ia = ib = []
        if text:
            ia, ib = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            sa = [bytes(back[c] for c in tok.id_to_token(i)) for i in ia]
            sb = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, sp.id_to_piece(i)) for i in ib)]
            if not b"".join(sa) == b"".join(sb) == b" " + text.encode():
                ia = ib = []
        if not ia:
            docs.append((doc_id, 0, 0, [], ""))
            continue
        own_a = [k for k, s in enumerate(sa) for _ in s]
        own_b = [k for k, s in enumerate(sb) for _ in s]
        links = [(ia[x], ib[y]) for x, y in sorted(set(zip(own_a, own_b)))]
        ends = sorted({sum(map(len, sa[:k + 1])) for k in range(len(sa))} & {sum(map(len, sb[:k + 1])) for k in range(len(sb))}) if len(sa) < 400 else None
        if ends is None:
            pa = pb = 0
            ea, eb = set(), set()
            for s in sa:
                pa += len(s)
                ea.add(pa)
            for s in sb:
                pb += len(s)
                eb.add(pb)
            ends = sorted(ea & eb)
        groups, lo = [], 0
        for e in ends:
            xs, ys = sorted(set(own_a[lo:e])), sorted(set(own_b[lo:e]))
            groups.append(",".join(str(ia[x]) for x in xs) + "|" + ",".join(str(ib[y]) for y in ys))
            lo = e
        counts.update(links)
        docs.append((doc_id, len(ia), len(ib), links, ";".join(groups)))
    most = defaultdict(int)
    for (_, y), c in counts.items():
        most[y] = max(most[y], c)
    return sorted(((i, na, nb, len(g.split(";")) if g else 0, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), g)
                   for i, na, nb, links, g in docs), key=str)


COLS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


@pytest.mark.parametrize("which,table_pairs", [("odd_docs", 1_000), ("odd_docs", 3), ("docs", 50), ("docs", 1_000_000)])
def test_alignment_by_bytes(which, table_pairs, request):
    df = request.getfixturevalue(which)
    df = df.where("length(text) < 5000 or text is null")
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    got = sorted((tuple(r[c] for c in COLS) for r in T.alignment(df, A, B, table_pairs=table_pairs).collect()), key=str)
    assert got == want


def test_small_memo_changes_nothing(docs, monkeypatch):
    texts = [r.text for r in docs.limit(30).collect()]
    a, b = T.tokens(A), T.tokens(B)
    want = T.align(texts, a, b, T.Windows(a, b))
    monkeypatch.setattr(T, "MEMO_ENTRIES", 5)
    memo = T.Windows(a, b)
    got = T.align(texts, a, b, memo)
    assert len(memo.young) + len(memo.old) <= 10
    assert got[4] == want[4] and all((x == y).all() for x, y in zip(got[5], want[5]))


def test_ids_equal_the_library_on_every_code_point():
    tok, a = Tokenizer.from_file(A), T.tokens(A)
    tok.encode_special_tokens = True
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(chars), 50_000):
        texts = ["".join(f"a{c}b 1{c}2 .{c}. {c}{c}a  {c} '{c}s{c}'s " for c in chars[x:x + 100]) for x in range(at, min(len(chars), at + 50_000), 100)]
        assert a.ids(texts) == [e.ids for e in tok.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("unit", [" ", "a", "^", "\n", " \n", "1", "é", "\t x"])
def test_endless_runs(unit):
    tok, a = Tokenizer.from_file(A), T.tokens(A)
    texts = [unit * (n // len(unit)) for n in (T.LONGEST - 1, T.LONGEST, T.LONGEST + 2, 400_000)]
    assert a.ids(texts) == [tok.encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_spelling_of_special_strings_and_marks():
    a, b = T.tokens(A), T.tokens(B)
    n_a, n_b, *_ = T.align(["<|endoftext|> <s>", "▁ mark", "", "ok"], a, b, T.Windows(a, b))
    assert n_a[0] > 1 and n_b[0] > 1 and not n_a[1] and not n_b[1] and not n_a[2] and n_a[3]


def test_registered_query(spark, no_docs):
    rows = QUERIES["op13_token_alignment"](spark, SF001).collect()
    want = {r[0]: r for r in brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()])}
    assert len(rows) == len(want)
    for r in rows:
        w = want[r.doc_id]
        assert tuple(r[c] for c in COLS[:-1]) == w[:-1]
        assert r.groups_sha256 == (hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "")
    assert T.alignment(no_docs, A, B).count() == 0
