"""Best-fit packing: bounded-space online best fit.

Documents become token sequences (``tokenizers`` vocabulary file plus one end id); only longer ones
are cut into pieces of the capacity. Pieces are packed by online best fit with a fixed number of
open bins: a bitset keyed by free space (bit f: some open bin has f places left) finds the fullest
bin that still takes a piece in a few word operations; when all bins are open and none fits, the
fullest closes.

At scale: tokenising is one pass over the scan, with a bounded memo of words per task, and its
result (one narrow row a piece) is staged. A few MB of text at a time are split and reduced to their
distinct words by Arrow, so only those are looked up in the memo; the vocabulary is read once per
Python worker. Packing then runs on tasks of about ``PIECES_A_TASK``
pieces, dealt by a hash; a task leaves at most ``OPEN_BINS`` bins that it might have filled
further. Nothing is gathered beyond one task's narrow rows, which are streamed.

Cases: null or empty text → one piece of length 1 (the end id); repeated rows are separate
documents; a null id is packed like any other; empty table → empty result; extra columns are
ignored. Special tokens that stand in a text are encoded as the library does.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.bpe import IdTable, Merges
from lectern.llm.common import Scratch, in_parts

CAPACITY = 4096
END_ID = 1
OPEN_BINS = 512
PIECES_A_TASK = 250_000

#: Latin letters and ASCII, whose lower case and composition are the same in every version of the
#: library: words of these characters only are split here, any other goes through the library.
_NOT_LATIN = re.compile("[^ !-~À-ÖØ-öø-ÿ]")
#: Fixed pattern of the vocabulary's pre-tokenizer, on lower-case words joined by spaces.
_PRETOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ ]+| ")
#: Bytes of text that are split and merged together.
BATCH_BYTES = 1 << 22


@lru_cache(maxsize=1)
def vocabulary(path: str):
    """The library's tokenizer and the merge table of a vocabulary file, kept per Python worker; neither changes in use."""
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return library, Merges(path)


class WordTokenizer:
    """Ids of whole texts under a word-level BPE vocabulary whose pre-tokenizer drops white space:
    a text's ids are those of its white-space separated words, one after the other. Words and
    pre-tokens seen are kept in bounded memos; those not seen are merged many at a time."""

    def __init__(self, path: str, limit: int = 1 << 19):
        self.library, self.merges = vocabulary(path)
        self.words = IdTable(limit)
        self.parts = IdTable(limit)

    def _is_odd(self, word: str) -> bool:
        return _NOT_LATIN.search(word) is not None or any(s in word for s in self.merges.special)

    def _learn(self, fresh: list[bytes]) -> np.ndarray:
        """Adds words that the memo lacks; their numbers there."""
        at = len(self.words.number)
        if len(self.parts.number) > self.parts.limit:
            self.parts.clear()
        words = b" ".join(fresh).decode("utf-8", "replace").split(" ")
        joined = " ".join(words)
        odd = [i for i, w in enumerate(words) if self._is_odd(w)] if _NOT_LATIN.search(joined) or "<|" in joined else []
        if odd:
            gone = set(odd)
            words_in = [i for i in range(len(words)) if i not in gone]
            joined = " ".join(words[i] for i in words_in)
        else:
            words_in = None
        known = self.parts.number
        split = _PRETOKEN.findall(joined.lower())
        new = list(set(split).difference(known, " "))
        self.parts.add(new, *self.merges.encode([p.encode() for p in new]))
        known[" "] = -1
        flat = np.fromiter(map(known.__getitem__, split), dtype=np.int64, count=len(split))
        del known[" "]
        word = np.cumsum(flat < 0)
        word, flat = word[flat >= 0], flat[flat >= 0]
        n = len(words) - len(odd)
        counts = np.bincount(word, weights=self.parts.count[flat], minlength=n).astype(np.int64)[:n]
        self.words.add(fresh if words_in is None else [fresh[i] for i in words_in], self.parts.gather(flat), counts)
        if odd:
            got = self.library.encode_batch([words[i] for i in odd], add_special_tokens=False)
            self.words.add([fresh[i] for i in odd], np.array([x for e in got for x in e.ids], dtype=np.int32), np.array([len(e.ids) for e in got], dtype=np.int64))
        numbers = np.arange(at, at + len(fresh))
        if odd:
            numbers[words_in + odd] = numbers.copy()
        return numbers

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """The memo's number of each of these distinct words; those not seen are learned."""
        known = self.words.number
        found = np.fromiter(map(known.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        new = np.flatnonzero(found < 0)
        if len(new) and len(new) + len(known) > self.words.limit:
            self.words.clear()
            new = np.arange(len(words))
        if len(new):
            found[new] = self._learn([words[i] for i in new.tolist()])
        return found

    def encode_batch(self, texts: list[bytes | None] | pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order; ``texts`` may be an Arrow string column."""
        column = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_binary()).view(pa.large_string())
        for at, to in by_bytes(pc.fill_null(pc.binary_length(column), 0).to_pylist(), BATCH_BYTES):
            # white space at either end of a text leaves an empty word, which has no ids
            split = pc.ascii_split_whitespace(pc.fill_null(column.slice(at, to - at), ""))
            distinct = split.flatten().dictionary_encode()
            words = distinct.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False)  # to_pylist() takes ten times as long
            numbers = self._numbers(words.tolist())[distinct.indices.to_numpy()]
            ids = self.words.gather(numbers)
            ends = np.append(0, np.cumsum(self.words.count[numbers]))[split.offsets.to_numpy()].tolist()
            for start, end in zip(ends, ends[1:]):
                yield ids[start:end]


def by_bytes(lengths: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Slices of about ``limit`` bytes (a longer text is a slice of its own)."""
    at = held = 0
    for i, n in enumerate(lengths):
        if held and held + n > limit:
            yield at, i
            at, held = i, 0
        held += n + 1
    if at < len(lengths):
        yield at, len(lengths)


def pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, in one pass over the scan."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        tokenizer = WordTokenizer(tokenizer_path)
        for batch in (part for whole in batches for part in in_parts(whole)):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), tokenizer.encode_batch(batch.column("text"))):
                tokens = np.append(ids, end_id).astype("<u4")
                for k, start in enumerate(range(0, len(tokens), capacity)):
                    part = tokens[start:start + capacity]
                    rows.append((doc, k, start, len(part), zlib.crc32(part.tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, piece long, start long, length long, ids_crc32 long")


class OpenBins:
    """At most ``limit`` open bins; bit f of ``free`` is set if some open bin has f places left."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.free = 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece: the fullest bin that takes it, else a new one."""
        fits = self.free >> length
        if fits:
            f = length + (fits & -fits).bit_length() - 1
            number = self._take(f)
        else:
            if self.open == self.limit and length < self.capacity:  # one more stays open: the fullest closes
                self._take((self.free & -self.free).bit_length() - 1)
            f, number = self.capacity, self.made
            self.made += 1
        left = f - length
        if left:
            self.bins[left].append(number)
            self.free |= 1 << left
            self.open += 1
        return number, self.capacity - f

    def _take(self, f: int) -> int:
        number = self.bins[f].pop()
        if not self.bins[f]:
            self.free &= ~(1 << f)
        self.open -= 1
        return number


def pack(rows: DataFrame, *, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, pieces_a_task: int = PIECES_A_TASK) -> DataFrame:
    """``rows`` (a column ``length``, at most ``capacity``; staged) with sequence_id and offset."""
    tasks = max(1, -(-rows.count() // pieces_a_task))
    order = F.xxhash64(*rows.columns)
    dealt = rows.withColumn("_h", order).repartition(tasks, F.col("_h")).sortWithinPartitions("_h", *rows.columns)

    def run(batches):
        base, bins = TaskContext.get().partitionId() << 40, OpenBins(capacity, open_bins)
        for batch in batches:
            got = [bins.put(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([base + g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())],
                                             names=[*names, "sequence_id", "offset"])

    names = rows.columns
    return dealt.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, end_id: int = END_ID, scratch: Scratch | None = None) -> DataFrame:
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    # numbered where they are staged, so that pieces alike in everything spread over the tasks
    staged = scratch("pieces", pieces(docs, tokenizer_path, capacity=capacity, end_id=end_id).withColumn("row", F.monotonically_increasing_id()))
    return pack(staged, capacity=capacity).drop("row")
