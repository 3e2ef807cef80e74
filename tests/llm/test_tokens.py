"""Token counts and packing against the tokenizer libraries themselves."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from triage.llm import packing, token_counts

SP = public_tokenizers.path("piece_bpe_32k.model")
WB = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("which", ["odd_docs", "docs"])
def test_token_counts_equal_the_library(which, request):
    df = request.getfixturevalue(which)
    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    want = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), len(sp.encode(r.text or ""))) for r in df.collect())
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(df, SP).collect())
    assert got == want


def test_small_cache_and_table_change_nothing(odd_docs, monkeypatch):
    lengths = token_counts.Lengths(SP)
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 3)
    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    for r in odd_docs.collect():
        assert lengths.count(r.text) == len(sp.encode(r.text or ""))


def test_empty_table(no_docs):
    assert token_counts.token_counts(no_docs, SP).count() == 0
    assert packing.pack(packing.pieces(no_docs, WB)).count() == 0


@pytest.mark.parametrize("which,capacity", [("odd_docs", 64), ("odd_docs", 4096), ("docs", 4096)])
def test_packing(which, capacity, request):
    df = request.getfixturevalue(which)
    tok = Tokenizer.from_file(WB)
    want = []
    for r in df.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [1]
        for p in range(0, len(ids), capacity):
            part = ids[p:p + capacity]
            want.append((str(r.doc_id), p // capacity, p, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    rows = packing.pack(packing.pieces(df, WB, capacity), capacity, shard_pieces=100).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for spans in seqs.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity


def test_sum_of_squares_follows_its_rule():
    rng = np.random.default_rng(3)
    sizes, cap = rng.integers(1, 41, 400), 40
    bins, offs, made = packing.sum_of_squares(sizes, cap)
    open_, used = {}, 0
    for s, b, o in zip(sizes.tolist(), bins.tolist(), offs.tolist()):
        def ss(gaps):
            c = np.bincount([g for g in gaps if g], minlength=cap + 1)
            return int((c ** 2).sum())
        options = {}
        for k, g in open_.items():
            if g >= s:
                options.setdefault(g, ss([x - s * (j == k) for j, x in open_.items()]))
        options["new"] = ss([*open_.values(), cap - s])
        chosen = "new" if b not in open_ else open_[b]
        assert options[chosen] == min(options.values())
        assert o == (0 if chosen == "new" else cap - chosen)
        open_[b] = (cap if chosen == "new" else chosen) - s
        if not open_[b]:
            open_[b] = 0
    assert made == len(open_)


def test_sequences_hold_the_pieces_ids(docs):
    part = docs.limit(40).cache()
    tok = Tokenizer.from_file(WB)
    total = sum(len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in part.collect())
    rows = packing.packed_sequences(part, WB).collect()
    assert sum(r.n_ids for r in rows) == total
    assert all(len(r.ids) == 4 * r.n_ids <= 4 * 4096 for r in rows)
