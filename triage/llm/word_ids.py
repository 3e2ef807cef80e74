"""Token ids of texts under a `tokenizers` vocabulary whose pre-tokens hold no
white space and part letters from marks.

Texts are cut, many at a time, into units: stretches without ASCII white
space, cut again between an ASCII letter and an ASCII mark (not the
apostrophe, which contractions hold).  Letters A-Z are lower-cased first, as
the vocabulary does itself.  Units are told apart by 64-bit hashes (the chance
that any two of n different ones collide is below n^2 / 2^65); only the
distinct ones of a slice that the worker does not know are encoded, those of
one pre-token together as one text, which is told apart by the vocabulary's
end-of-word tokens.  Ids are then gathered by offsets, without a step per word.

Known units are kept in two generations of ``CACHE_ENTRIES`` at most: when the
younger is full it becomes the older, and units still in use move over.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from triage.llm import common as C

CACHE_ENTRIES = 300_000
TOGETHER = 10_000
LONGEST = 64
#: One pre-token whatever stands around it: ASCII or Latin-1 letters, or ASCII marks without apostrophes.
ONE_TOKEN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]+")

#: Class of a byte: 1 ASCII letter, 2 ASCII mark but the apostrophe, 0 any other.
KIND = np.zeros(256, np.uint8)
KIND[0x61:0x7B] = 1
KIND[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 2

_tables: dict[str, "WordIds"] = {}
C.WORKER_CACHES.append(_tables.clear)


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """lo[0], ..., hi[0] - 1, lo[1], ..., hi[1] - 1, ..."""
    n = hi - lo
    return np.arange(int(n.sum())) + np.repeat(lo - (n.cumsum() - n), n)


def unit_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(unit starts, unit ends, first unit of each text and one more) of lower-cased bytes."""
    ws, we, _ = C.word_spans(buf, starts, ends, C.SPACE_WORDS)
    kind = KIND[buf]
    cut = np.flatnonzero(kind[1:] + kind[:-1] * 4 == 6) + 1, np.flatnonzero(kind[1:] * 4 + kind[:-1] == 6) + 1     # letter, mark; mark, letter
    cut = np.sort(np.concatenate(cut))
    at = np.searchsorted(ws, cut, "right") - 1
    cut = cut[(at >= 0) & (ws[at] < cut) & (cut < we[at])] if len(ws) else cut[:0]     # inside a word, not where texts meet
    ws, we = np.sort(np.concatenate([ws, cut]), kind="stable"), np.sort(np.concatenate([we, cut]), kind="stable")
    return ws, we, np.append(np.searchsorted(ws, starts), np.searchsorted(ws, ends[-1:]))


class WordIds:
    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        # what every special string begins with; texts that hold it are left to the tokenizer, whole
        self.mark = os.path.commonprefix([t.content for t in self.tokenizer.get_added_tokens_decoder().values()]).lower().encode()
        self.young: dict[int, bytes] = {}
        self.old: dict[int, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def learn(self, keys: list[int], units: list[bytes]) -> list[bytes]:
        """Ids of units that are not known yet."""
        out: list[bytes] = [b""] * len(units)
        one = [i for i, u in enumerate(units) if ONE_TOKEN.fullmatch(u)]
        for at in range(0, len(one), TOGETHER):
            part = one[at:at + TOGETHER]
            ids = self.ids(b" ".join([units[i] for i in part]).decode())
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            whole, lo = ids.tobytes(), 0
            for i, hi in zip(part, ends, strict=True):
                out[i] = whole[lo:hi]
                lo = hi
        known = set(one)
        rest = [i for i in range(len(units)) if i not in known]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([units[i].decode() for i in rest], add_special_tokens=False)):
            out[i] = np.array(e.ids, np.uint32).tobytes()
        for k, u, x in zip(keys, units, out):
            if len(u) <= LONGEST:
                self.keep(k, x)
        return out

    def keep(self, key: int, ids: bytes) -> None:
        if len(self.young) >= CACHE_ENTRIES:
            self.old, self.young = self.young, {}
        self.young[key] = ids

    def encoded(self, texts: pa.Array, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, ids, edges) for runs of rows: text rows[r] has the ids
        ids[edges[r]:edges[r + 1]], ``end_id`` the last of them."""
        for rows, buf, lo, hi in C.slices(texts):
            low, given = C.LOWER[buf], {}
            if self.mark in (raw := low.tobytes()):
                data = buf.tobytes()
                given = {r: self.ids(data[lo[r]:hi[r]].decode()) for r in range(len(rows)) if raw.find(self.mark, lo[r], hi[r]) >= 0}
                hi = hi.copy()
                hi[list(given)] = lo[list(given)]
            yield rows, *self._slice(low, lo, hi, given, end_id)

    def _slice(self, low: np.ndarray, lo, hi, given: dict[int, np.ndarray], end_id: int):
        size = len(lo)
        ws, we, first = unit_spans(low, lo, hi)
        if given:      # texts encoded whole have no units
            inside = ws < hi[np.searchsorted(lo, ws, "right") - 1]
            ws, we = ws[inside], we[inside]
            first = np.append(np.searchsorted(ws, lo), len(ws))
        keys, one, which = np.unique(C.span_hashes(low, ws, we), return_index=True, return_inverse=True)
        keys = keys.tolist()
        found, new = list(map(self.young.get, keys)), []
        for i in [i for i, x in enumerate(found) if x is None]:
            if (x := self.old.get(keys[i])) is None:
                new.append(i)
            else:
                found[i] = x
                self.keep(keys[i], x)
        if new:
            data, at = low.tobytes(), one[new]
            units = [data[s:e] for s, e in zip(ws[at].tolist(), we[at].tolist())]
            for i, x in zip(new, self.learn([keys[i] for i in new], units)):
                found[i] = x
        base = np.append(0, np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4))
        flat = np.frombuffer(b"".join(found), np.uint32)[ranges(base[which], base[which + 1])]
        of_unit = np.append(0, np.diff(base)[which].cumsum()) if len(which) else np.zeros(1, np.int64)
        n = np.diff(of_unit[first])
        if given:
            parts = np.split(flat, of_unit[first[1:-1]]) if size > 1 else [flat]
            for r, ids in given.items():
                parts[r], n[r] = ids, len(ids)
            flat = np.concatenate(parts)
        edges = np.append(0, (n + 1).cumsum())
        out = np.full(edges[-1], end_id, np.uint32)
        out[np.arange(len(flat)) + np.repeat(np.arange(size), n)] = flat
        return out, edges


def word_ids(path: str) -> WordIds:
    if path not in _tables:
        _tables[path] = WordIds(path)
    return _tables[path]
