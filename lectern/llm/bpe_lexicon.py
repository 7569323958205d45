"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The most frequent words (pre-tokens, counted over all documents) are compiled, with their ids as
output, into a minimal acyclic automaton: equal suffixes share states, and each transition carries
how many words come before it, so that the sum along a word is its rank, the key of its ids. The
arrays are written once per Python worker and memory-mapped; many words walk the automaton at once.
Words that it does not hold are merged exactly. Decoding joins the bytes of the ids.

At scale: counting combines within a task before the shuffle; the lexicon is bounded by ``WORDS``
(about a megabyte, broadcast); encoding and decoding are one pass over the scan with a bounded
memo, whole texts, no shuffle.

Cases: null or empty text → no ids, empty decoding; the text of a special token becomes its id;
repeated rows and null ids are rows like any other; empty table → empty result, and an empty lexicon;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.bpe import IdTable, Merges
from lectern.llm.common import Scratch, texts_of

#: Words in the lexicon.
WORDS = 1 << 15
#: Distinct words that a counting task holds before it passes them on.
HELD = 1 << 19
BATCH_BYTES = 1 << 22

#: Fixed: Unicode white space.
_S = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Fixed pattern of the byte-level pre-tokenizer.
_PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: White space with the word after it: the pattern never looks past one of these.
_CHUNK = re.compile(rb"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: White space beyond ASCII: texts that hold some are split by the pattern as a whole.
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def pretokens(text: bytes) -> list[bytes]:
    return [p.encode("utf-8", "replace") for p in _PRETOKEN.findall(text.decode("utf-8", "replace"))]


def chunks(text: bytes, special: re.Pattern) -> list[bytes]:
    """Pieces of a text whose ids, one after the other, are the text's; each special token is one."""
    out = []
    for part in special.split(text) if special.search(text) else (text,):
        if special.fullmatch(part):
            out.append(part)
        else:
            out.extend(pretokens(part) if _WIDE.search(part) else _CHUNK.findall(part))
    return out


def special_pattern(special: dict[str, int]) -> re.Pattern:
    return re.compile(b"(" + b"|".join(re.escape(s.encode()) for s in sorted(special, key=len, reverse=True)) + b")")


class Transducer:
    """A minimal acyclic automaton over byte strings with additive outputs (each word's rank)."""

    FIELDS = (("keys", np.int64), ("target", np.int32), ("output", np.int32), ("final", np.uint8), ("start", np.int32), ("ids", np.int32))

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def compile(cls, words: list[bytes], ids: np.ndarray, counts: np.ndarray) -> Transducer:
        """``words`` sorted and distinct; ``ids`` their ids in this order, ``counts`` how many."""
        register: dict = {}
        states: list[tuple[bool, tuple]] = []  # frozen: final, ((byte, state), ...)
        reach: list[int] = []  # words that each state leads to

        def freeze(node) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(states)
                states.append(key)
                reach.append(int(node[0]) + sum(reach[t] for _, t in key[1]))
            return register[key]

        path, before = [[False, []]], b""  # the open states of the word before
        for word in [*words, None]:
            keep = 0 if word is None else len(os.path.commonprefix([before, word]))
            while len(path) > keep + 1:
                done = path.pop()
                path[-1][1].append((before[len(path) - 1], freeze(done)))
            if word is not None:
                path.extend([False, []] for _ in word[keep:])
                path[-1][0] = True
                before = word
        root = freeze(path[0])
        keys, target, output = [], [], []
        for s, (final, edges) in enumerate(states):
            passed = int(final)
            for byte, t in edges:
                keys.append(s * 256 + byte)
                target.append(t)
                output.append(passed)
                passed += reach[t]
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable") if keys else np.zeros(0, np.int64)
        return cls({"keys": np.append(np.array(keys, dtype=np.int64)[order], np.int64(1) << 62), "target": np.append(np.array(target, dtype=np.int32)[order], np.int32(root)),
                    "output": np.append(np.array(output, dtype=np.int32)[order], np.int32(0)), "final": np.array([f for f, _ in states], dtype=np.uint8),
                    "start": np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), "ids": ids.astype(np.int32)})

    @property
    def states(self) -> int:
        return len(self.final)

    def dump(self) -> bytes:
        parts = [np.ascontiguousarray(getattr(self, n), dtype=k).tobytes() for n, k in self.FIELDS]
        head = np.array([len(p) for p in parts], dtype=np.int64).tobytes()
        return head + b"".join(p + bytes(-len(p) % 8) for p in parts)

    @classmethod
    def load(cls, path: str) -> Transducer:
        """Memory-maps a dumped automaton."""
        data = np.memmap(path, dtype=np.uint8, mode="r")
        sizes, at, out = data[: 8 * len(cls.FIELDS)].view(np.int64), 8 * len(cls.FIELDS), {}
        for (name, kind), n in zip(cls.FIELDS, sizes.tolist()):
            out[name] = data[at:at + n].view(kind)
            at += n + -n % 8
        return cls(out)

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 if it is not held: all words advance a byte a step."""
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        codes = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        first = np.cumsum(lens) - lens
        rank = np.full(len(words), -1, dtype=np.int64)
        alive, state, total = np.arange(len(words)), np.full(len(words), self.target[-1], dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        step = 0
        while len(alive):
            ended = lens[alive] == step
            good = ended & (self.final[state] == 1)
            rank[alive[good]] = total[good]
            alive, state, total = alive[~ended], state[~ended], total[~ended]
            if not len(alive):
                break
            key = state * 256 + codes[first[alive] + step]
            at = np.searchsorted(self.keys, key)
            on = self.keys[at] == key
            alive, state, total = alive[on], self.target[at[on]].astype(np.int64), total[on] + self.output[at[on]]
            step += 1
        return rank


def mapped(dump: bytes) -> Transducer:
    """The automaton, memory-mapped from a file of this worker's own that is unlinked at once."""
    fd, path = tempfile.mkstemp(suffix=".lexicon")
    with os.fdopen(fd, "wb") as f:
        f.write(dump)
    lexicon = Transducer.load(path)
    os.unlink(path)
    return lexicon


class Codec:
    """Encodes and decodes whole texts exactly as the vocabulary's library does."""

    def __init__(self, merges: Merges, lexicon: Transducer | None = None, limit: int = 1 << 20):
        self.merges, self.lexicon = merges, lexicon
        self.special = special_pattern(merges.special)
        self.special_ids = {s.encode(): i for s, i in merges.special.items()}
        self.table = IdTable(limit)
        self.bytes = merges.token_bytes()
        self.decimal = [str(i) for i in range(merges.size)]

    def word_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens and how many each has: from the lexicon, else merged."""
        if self.lexicon is None or not words:
            return self.merges.encode(words)
        rank = self.lexicon.ranks(words)
        held = rank >= 0
        counts = np.zeros(len(words), dtype=np.int64)
        counts[held] = self.lexicon.start[rank[held] + 1] - self.lexicon.start[rank[held]]
        rest, rest_counts = self.merges.encode([words[i] for i in np.flatnonzero(~held).tolist()])
        counts[~held] = rest_counts
        ends = np.cumsum(counts)
        ids = np.empty(int(ends[-1]), dtype=np.int32)
        within = np.arange(len(ids)) - np.repeat(ends - counts, counts)
        from_lexicon = np.repeat(held, counts)
        base = np.zeros(len(words), dtype=np.int64)
        base[held] = self.lexicon.start[rank[held]]
        ids[from_lexicon] = self.lexicon.ids[(np.repeat(base, counts) + within)[from_lexicon]]
        ids[~from_lexicon] = rest
        return ids, counts

    def _learn(self, fresh: list[bytes]) -> None:
        split = [[c] if c in self.special_ids else pretokens(c) for c in fresh]
        words = list(set(chain.from_iterable(split)).difference(self.special_ids))
        known = IdTable()
        known.add(words, *self.word_ids(words))
        known.add(list(self.special_ids), np.array(list(self.special_ids.values()), dtype=np.int32), np.ones(len(self.special_ids), dtype=np.int64))
        flat = np.fromiter(map(known.number.__getitem__, chain.from_iterable(split)), dtype=np.int64)
        per = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        counts = np.bincount(np.repeat(np.arange(len(fresh)), per), weights=known.count[flat], minlength=len(fresh)).astype(np.int64)
        self.table.add(fresh, known.gather(flat), counts)

    def encode_batch(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t or b"")
            if size > BATCH_BYTES:
                yield from self._encode(held)
                held, size = [], 0
        yield from self._encode(held)

    def _encode(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        split = [chunks(t or b"", self.special) for t in texts]
        fresh = set(chain.from_iterable(split)).difference(self.table.number)
        if len(fresh) + len(self.table.number) > self.table.limit:
            self.table.clear()
            fresh = set(chain.from_iterable(split))
        if fresh:
            self._learn(list(fresh))
        number = self.table.number.__getitem__
        for parts in split:
            yield self.table.gather(np.fromiter(map(number, parts), dtype=np.int64, count=len(parts)))

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text, special tokens included."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace").encode()

    def digest(self, ids: np.ndarray) -> str:
        return hashlib.sha256(",".join(map(self.decimal.__getitem__, ids.tolist())).encode()).hexdigest()


def word_counts(docs: DataFrame, special: dict[str, int]) -> DataFrame:
    """word (bytes) and its count over all texts."""
    pattern_of = list(special)

    def run(batches):
        pattern, count = special_pattern(dict.fromkeys(pattern_of, 0)), Counter()
        tokens = {s.encode() for s in pattern_of}

        def flush():
            words = Counter()
            for chunk, n in count.items():
                if chunk not in tokens:
                    for p in pretokens(chunk):
                        words[p] += n
            count.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array(list(words), pa.binary()), "n": pa.array(list(words.values()), pa.int64())})

        for batch in batches:
            for t in texts_of(batch.column("text")):
                if t:
                    count.update(chunks(t, pattern))
                    if len(count) >= HELD:
                        yield flush()
        yield flush()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, merges: Merges, size: int = WORDS, scratch: Scratch | None = None) -> Transducer:
    """The most frequent words of all texts, compiled: all words that occur at least as often as
    the least count that at most ``size`` words reach. Only those words come to the driver, and of
    the counts no more than ``size`` different values with how many words have each."""
    counts = (scratch or Scratch(docs.sparkSession, "lexicon"))("counts", word_counts(docs, merges.special))
    least, held = None, 0
    for r in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.col("n").desc()).limit(size).collect():
        held += r["words"]
        if held > size:
            break
        least = r["n"]
    words = [] if least is None else sorted(bytes(r["word"]) for r in counts.where(F.col("n") >= least).select("word").collect())
    return Transducer.compile(words, *merges.encode(words))


def encode_decode(docs: DataFrame, tokenizer_path: str, *, size: int = WORDS, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row (``keep``: ids and the decoded
    text as well)."""
    shared = docs.sparkSession.sparkContext.broadcast(build_lexicon(docs, Merges(tokenizer_path), size).dump())
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep

    def run(batches):
        codec = Codec(Merges(tokenizer_path), mapped(shared.value))
        for batch in batches:
            rows = []
            for ids in codec.encode_batch(texts_of(batch.column("text"))):
                text = codec.decode(ids)
                rows.append((len(ids), codec.digest(ids), hashlib.sha256(text).hexdigest(), *((ids.tolist(), text.decode()) if keep else ())))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()][: len(names) - 1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
