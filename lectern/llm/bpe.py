"""Exact byte-pair merges for many words at once, from the vocabulary file of a public tokenizer."""

from __future__ import annotations

import json

import numpy as np

#: Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others for the
#: code points from 256 on, in order.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}


class Merges:
    """Merge table of a vocabulary file: byte → first symbol, pair of symbols → (rank, symbol)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*self.vocab.values(), *self.special.values()])
        inner = [self.vocab[BYTE_CHARS[b]] for b in range(256)]
        last = [self.vocab[BYTE_CHARS[b] + self.suffix] for b in range(256)]
        self.inner, self.last = np.array(inner, dtype=np.int64), np.array(last, dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merged = np.array([self.vocab[a + b] for a, b in pairs], dtype=np.int64)
        self._build_ranks(np.array([self.vocab[a] * self.size + self.vocab[b] for a, b in pairs], dtype=np.int64))

    _TABLE_BITS = 19

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self._TABLE_BITS)).astype(np.int64)

    def _build_ranks(self, key: np.ndarray) -> None:
        """An open-addressing table, symbol pair → rank, that is filled and read vector-wise."""
        size = 1 << self._TABLE_BITS
        self._keys, self._ranks = np.full(size, -1, dtype=np.int64), np.full(size, len(key), dtype=np.int32)
        todo, slot, self._probes = np.arange(len(key)), self._slot(key), 0
        while len(todo):
            free = self._keys[slot] == -1
            self._keys[slot[free]] = key[todo[free]]  # of several for one slot the last stays
            won = self._keys[slot] == key[todo]
            self._ranks[slot[won]] = todo[won]
            todo, slot = todo[~won], (slot[~won] + 1) % size
            self._probes += 1

    def ranks(self, key: np.ndarray) -> np.ndarray:
        """The rank of each symbol pair (the number of merges if it has none)."""
        slot = self._slot(key)
        seen = self._keys[slot]
        rank = np.where(seen == key, self._ranks[slot], len(self.merged))
        open_ = np.flatnonzero((seen != key) & (seen != -1))
        slot = slot[open_]
        for _ in range(1, self._probes):
            if not len(open_):
                break
            slot = (slot + 1) & ((1 << self._TABLE_BITS) - 1)
            seen = self._keys[slot]
            hit = seen == key[open_]
            rank[open_[hit]] = self._ranks[slot[hit]]
            on = ~hit & (seen != -1)
            open_, slot = open_[on], slot[on]
        return rank

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id (special tokens: their text)."""
        of = {c: b for b, c in BYTE_CHARS.items()}
        out = [b""] * self.size
        for token, i in self.vocab.items():
            out[i] = bytes(of[c] for c in token.removesuffix(self.suffix)) if self.suffix else bytes(of[c] for c in token)
        for token, i in self.special.items():
            out[i] = token.encode()
        return out

    def encode(self, words: list[bytes], chunk: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the number of ids of each."""
        ids, counts = [], []
        for at in range(0, len(words), chunk):
            a, b = self._encode(words[at:at + chunk])
            ids.append(a)
            counts.append(b)
        empty = np.zeros(0, dtype=np.int64)
        return (np.concatenate(ids) if ids else empty), (np.concatenate(counts) if counts else empty)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        codes = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbol = self.inner[codes]
        ends = np.cumsum(lens)
        if self.suffix:
            tails = ends[lens > 0] - 1
            symbol[tails] = self.last[codes[tails]]
        word = np.repeat(np.arange(len(words)), lens)
        done_s, done_w = [], []
        none = len(self.merged)
        while len(symbol):
            rank = np.full(len(symbol), none, dtype=np.int64)
            pair = np.flatnonzero(word[:-1] == word[1:])
            rank[pair] = self.ranks(symbol[pair] * self.size + symbol[pair + 1])
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(word)))
            best = np.repeat(lowest, size)
            open_ = best < none
            if not open_.all():  # words without a pair to merge are ready
                done_s.append(symbol[~open_])
                done_w.append(word[~open_])
                symbol, word, rank, best = symbol[open_], word[open_], rank[open_], best[open_]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == best)
            # overlapping hits (a run of one symbol): every other one, from the left
            fresh = np.append(True, np.diff(hit) != 1)
            run = np.arange(len(hit)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            hit = hit[run % 2 == 0]
            symbol[hit] = self.merged[rank[hit]]
            stay = np.ones(len(symbol), dtype=bool)
            stay[hit + 1] = False
            symbol, word = symbol[stay], word[stay]
        if not done_s:
            return np.zeros(0, dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        s, w = np.concatenate(done_s), np.concatenate(done_w)
        return s[np.argsort(w, kind="stable")], np.bincount(w, minlength=len(words))


class IdTable:
    """Words seen so far and their ids, stored flat; ``gather`` lays out the ids of a sequence of
    word numbers without a Python loop. Reset when it holds more than ``limit`` words."""

    def __init__(self, limit: int = 1 << 20):
        self.limit = limit
        self.clear()

    def clear(self):
        self.number: dict = {}
        self.start = np.zeros(1024, dtype=np.int64)
        self.count = np.zeros(1024, dtype=np.int64)
        self.flat = np.zeros(4096, dtype=np.int32)
        self.used = 0

    def add(self, words: list, ids: np.ndarray, counts: np.ndarray) -> None:
        n = len(self.number)
        while n + len(words) > len(self.start):
            self.start, self.count = np.append(self.start, np.zeros_like(self.start)), np.append(self.count, np.zeros_like(self.count))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.flat[self.used:self.used + len(ids)] = ids
        self.count[n:n + len(words)] = counts
        self.start[n:n + len(words)] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        self.number.update(zip(words, range(n, n + len(words))))

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        counts = self.count[numbers]
        total = int(counts.sum())
        if not total:
            return np.zeros(0, dtype=np.int32)
        at = np.cumsum(counts)
        where = np.arange(total) + np.repeat(self.start[numbers] - at + counts, counts)
        return self.flat[where]
