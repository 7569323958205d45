"""Phrase collocation mining by Toivonen's method, per language.

A sample of the documents proposes the frequent phrases; one full pass counts, exactly, the proposed
phrases together with their negative border (the phrases that were not proposed although what is left
of them without their first or their last word was). A border phrase that turns out frequent is a
failure: it joins the known phrases, and a further full pass counts what that adds to the border. The
passes end when no failure is left; by induction over the length every frequent phrase has then been
counted. The sample only decides what is counted early, never the result.

A pass counts a phrase if both its parts without an end word are known. To spare passes a failure
brings its longer phrases along: one that contains a failure and whose pairs of words are all known
counts as known itself, frequent or not. What an earlier pass counted is left out, so a phrase is
counted in exactly one pass. Words fail after the first pass, their pairs after the second, and with
them come all longer phrases: there are at most four passes, three as a rule. An expansion pass looks only at the
words around the newest failures: nothing else can be new.

The first full pass, whose border is by far the largest, goes by 64-bit hashes: their counts bound the
phrases' from above, so all but the phrases of frequent hashes are out, and hashes not proposed that
reach the threshold are the failures. The second pass counts the phrases of frequent hashes by their
text, exactly, together with what the failures add.

The known phrases travel as Bloom filters, one for each pass that had failures, of 32 bits a phrase up
to ``FILTER_BITS`` (8 MB, whatever the corpus); a false positive adds a phrase to what is counted and
changes no count, since every pass and the search for failures go by the same filters. The sample is
mined by the same loop, with nothing known at the start, at a lower threshold.

Each task numbers the words of a slice of about ``SLICE`` bytes exactly (a dictionary, no hashing), numbers
the phrases of length m by (number of the first m - 1 words, last word), and passes on every distinct
phrase of the slice with its count: counts are added before the shuffle, once in the slice and once more
in Spark's partial aggregation, so a very common phrase or a hot language reaches no task whole.

Texts: A-Z lower-cased, split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words
``[^\\x20\\x09]+``; phrases lie within a piece. Scores are exact (decimals of 38 digits).

Cases: null or empty texts have no words; a null language counts as ``und``; documents are counted
however often they repeat; a text of any length is counted whole, in parts that overlap by
``longest`` - 1 words; ties in the score of a cut go to the shortest first part, ties in rank to the higher count and
then to the phrase that comes first in byte order; an empty table gives an empty result; columns
besides text and lang (doc_id, if there, spreads the sample) are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Scratch, mix64, texts_of
from lectern.operators.ordinal import ordinal

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
#: One document of so many is in the sample; its threshold is the count expected there.
SAMPLE = 16
FILTER_BITS = 1 << 26
SLICE = 3_000_000

#: What ends a piece, and what separates words besides the space.
_ENDS, _TAB = b".,;:!?\n\x0b\x0c\r", b"\t"
_TABLE = bytes.maketrans(_ENDS + _TAB, b"." * len(_ENDS) + b" ")
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Filter:
    """A Bloom filter over phrase hashes: three positions each among a power of two of bits."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def positions(h: np.ndarray, bits: int) -> list[np.ndarray]:
        mask = np.uint64(bits - 1)
        return [h & mask, (h >> np.uint64(32)) & mask, mix64(h + _STEP) & mask]

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), dtype=bool)
        for at in self.positions(h, len(self.words) << 6):
            found &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


class Known:
    """What is known: in any of some filters, of which the first ``proposed`` came from the sample and
    the others hold failures."""

    def __init__(self, filters: list[np.ndarray] | None = None, proposed: int = 0):
        self.filters, self.proposed = filters or [], proposed

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.zeros(len(h), dtype=bool)
        for words in self.filters:
            found |= Filter(words).has(h)
        return found


def _word_hash(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def _chain(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of all but its last word, and the last word's."""
    return mix64(h * _STEP + word)


def _rolling(tokens: np.ndarray, hashes: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """For each length from 1 the hash of the phrase at every place."""
    h = hashes[tokens]
    for m in range(1, longest + 1):
        yield h
        h = _chain(h[:-1], hashes[tokens[m:]]) if len(h) > 1 else h[:0]


def _walk(tokens: np.ndarray, hashes: np.ndarray, longest: int, now: _Status) -> Iterator[tuple]:
    """For each length from 2: the length, the places of the phrases that can matter, the number of the
    phrase at each, a place of each number, which places are countable, and the hash of each number.
    Then ``now`` goes on to that length."""
    phrase, h = tokens, hashes  # the number of the phrase at each place, and the hash of each number
    for m in range(2, min(longest, len(tokens)) + 1):
        countable = now.countable()
        at = np.flatnonzero(now.reach() if now.failed.filters else countable)
        numbers, distinct = pd.factorize(phrase[at] * len(hashes) + tokens[at + m - 1])
        first = np.empty(len(distinct), dtype=np.int64)
        first[numbers[::-1]] = np.arange(len(at))[::-1]
        where = at[first]
        h = _chain(h[phrase[where]], hashes[tokens[where + m - 1]])
        yield m, at, numbers, where, countable, h
        if m < longest:
            now.lengthen(countable, at, numbers, h)
            phrase = np.zeros(len(countable), dtype=np.int64)
            phrase[at] = numbers


def plain_text(text: bytes) -> bytes:
    """Lower-cased, with `` . `` at the ends of pieces and words separated by spaces."""
    return text.lower().translate(_TABLE).replace(b".", b" . ")


class _Status:
    """What one state of knowledge says about the phrases of the length at hand, by their first place:
    ``known``, ``holds`` (contains a failure) and ``pairs`` (all its pairs of words are known)."""

    def __init__(self, known: Known, words: np.ndarray, hashes: np.ndarray, tokens: np.ndarray):
        self.all, self.failed = known, Known(known.filters[known.proposed:])
        word = words & known.has(hashes)
        self.known, self.holds = word[tokens], (word & self.failed.has(hashes))[tokens]
        self.pairs = None

    def countable(self) -> np.ndarray:
        """The phrases one word longer that this state counts."""
        both = self.known[:-1] & self.known[1:]
        return both if self.pairs is None else both | self.brought()

    def brought(self) -> np.ndarray:
        """The phrases one word longer that a failure brings along."""
        return self.reach() & (self.holds[:-1] | self.holds[1:])

    def reach(self) -> np.ndarray:
        """The phrases one word longer whose pairs of words are all known."""
        return self.known[:-1] & self.known[1:] if self.pairs is None else self.pairs[:-1] & self.pairs[1:]

    def lengthen(self, countable: np.ndarray, at: np.ndarray, phrase: np.ndarray, h: np.ndarray) -> None:
        """Go on to the next length. ``h``: the hash of each phrase, ``phrase``: which one lies at each of ``at``."""
        known, failed = np.zeros(len(countable), dtype=bool), np.zeros(len(countable), dtype=bool)
        known[at] = countable[at] & self.all.has(h)[phrase]
        failed[at] = self.failed.has(h)[phrase]
        if self.pairs is not None:
            known |= self.brought()
        self.pairs = known if self.pairs is None else self.reach()
        self.holds = self.holds[:-1] | self.holds[1:] | known & failed
        self.known = known


class _Counter:
    """Counts the phrases of one language in slices of text."""

    def __init__(self, lang: str, known: Known, before: Known | None, longest: int, heavy: Filter | None = None, by_hash: bool = False):
        self.lang, self.known, self.before, self.longest, self.heavy, self.by_hash = lang, known, before, longest, heavy, by_hash
        self.parts: list[bytes] = []

    def add(self, text: bytes) -> None:
        self.parts.append(plain_text(text))

    def _coded(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """The slice as numbers of its words; which numbers are words; their hashes; the words."""
        text = pa.array([b" . ".join(self.parts)], pa.large_binary()).cast(pa.large_string())
        coded = pc.split_pattern(text, " ").flatten().dictionary_encode()
        words = coded.dictionary
        tokens = coded.indices.to_numpy().astype(np.int64)
        blank, end = (pc.index(words, w).as_py() for w in ("", "."))
        tokens = tokens[tokens != blank] if blank >= 0 else tokens
        is_word = np.ones(len(words), dtype=bool)
        is_word[[i for i in (blank, end) if i >= 0]] = False
        return tokens, is_word, _word_hash(self.lang, words.cast(pa.large_binary()).to_pylist()), words

    def counts(self) -> Iterator[pa.RecordBatch]:
        """Batches of (key, f), each phrase once for each part of the slice. The key is language and
        phrase, or (``by_hash``) the phrase's hash."""
        tokens, is_word, hashes, words = self._coded()
        step = max(1, SLICE // 4)  # words; a text that is longer than a slice is counted in several
        for start in range(0, len(tokens), step):
            yield from self._part(tokens[start:start + step + self.longest - 1], min(step, len(tokens) - start), is_word, hashes, words)

    def _part(self, tokens: np.ndarray, own: int, is_word: np.ndarray, hashes: np.ndarray, words: pa.Array) -> Iterator[pa.RecordBatch]:
        """Phrases that begin at one of the first ``own`` tokens."""
        place = None
        if self.before is None or self.heavy is not None:
            f = np.where(is_word, np.bincount(tokens[:own], minlength=len(words)), 0)
            seen = np.flatnonzero((f > 0) & self._heavy(hashes))
            yield self._batch(lambda: [words.take(pa.array(seen))], hashes[seen], f[seen])
            if not self.by_hash:
                yield self._batch(lambda: [pa.array([""], pa.large_string())], hashes[:0], f.sum(keepdims=True))
        else:
            place = self._near(tokens, hashes)
            if not len(place):
                return
            # places that were not neighbours stay apart
            gap = np.flatnonzero(np.diff(place) > 1) + 1
            tokens, place = np.insert(tokens[place], gap, len(words)), np.insert(place, gap, own)
            is_word, hashes = np.append(is_word, False), np.append(hashes, np.uint64(0))
        now = _Status(self.known, is_word, hashes, tokens)
        old = _Status(self.before, is_word, hashes, tokens) if self.before is not None else None
        for m, at, numbers, where, countable, h in _walk(tokens, hashes, self.longest, now):
            counted = old.countable() if old is not None else np.zeros(len(countable), dtype=bool)
            mine = at < own if place is None else place[at] < own
            f = np.bincount(numbers[mine], minlength=len(where))
            due = countable[where] & (~counted[where] if self.heavy is None else ~counted[where] | self._heavy(h))
            out = np.flatnonzero((f > 0) & due)
            if len(out):
                out = out[np.argsort(tokens[where[out]], kind="stable")]  # rows alike lie together and compress
                yield self._batch(lambda: [words.take(pa.array(tokens[where[out] + j])) for j in range(m)], h[out], f[out])
            if old is not None:
                old.lengthen(counted, at, numbers, h)

    def _heavy(self, h: np.ndarray) -> np.ndarray:
        return np.ones(len(h), dtype=bool) if self.heavy is None else self.heavy.has(h)

    def unknown(self, lengths: list[int]) -> np.ndarray:
        """The hashes of the texts added, phrases of these numbers of words, that are not known."""
        tokens, is_word, hashes, _ = self._coded()
        now = _Status(self.known, is_word, hashes, tokens)
        lengths = np.array(lengths)
        start = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        known, found = np.zeros(len(lengths), dtype=bool), np.zeros(len(lengths), dtype=np.uint64)
        longest = int(lengths.max())
        for m, h in enumerate(_rolling(tokens, hashes, longest), 1):
            found[lengths == m] = h[start[lengths == m]]
        known[lengths == 1] = now.known[start[lengths == 1]]
        for m, *_ in _walk(tokens, hashes, longest + 1, now):
            if m > 2:  # the walk has gone on to length m - 1 by now
                known[lengths == m - 1] = now.known[start[lengths == m - 1]]
        return found[~known]

    def _near(self, tokens: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The places of words that a phrase with one of the newest failures in it can reach."""
        newest = Filter(self.known.filters[-1])
        hit = newest.has(hashes)[tokens]
        for h in list(_rolling(tokens, hashes, self.longest - 1))[1:]:
            hit[:len(h)] |= newest.has(h)
        near = hit.copy()
        for shift in range(1, self.longest):
            near[shift:] |= hit[:-shift]
            near[:-shift] |= hit[shift:]
        return np.flatnonzero(near)

    def _batch(self, words: Callable[[], list[pa.Array]], h: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        if self.by_hash:
            return pa.RecordBatch.from_pydict({"key": h.view(np.int64), "f": f.astype(np.int64)})
        lang, space, line = (pa.scalar(x, pa.large_string()) for x in (self.lang, " ", "\n"))
        columns = words()
        phrase = pc.binary_join_element_wise(*columns, space) if len(columns) > 1 else columns[0]
        key = pc.binary_join_element_wise(lang, phrase, line)
        return pa.RecordBatch.from_pydict({"key": key.cast(pa.string()), "f": pa.array(f.astype(np.int64))})


def _rows(batches: Iterator[pa.RecordBatch], at_once: int = 256) -> Iterator[tuple[str, bytes | None]]:
    """(lang, text) of every row, a few rows of a batch at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, at_once):
            part = batch.slice(start, at_once)
            yield from zip(part.column("lang").to_pylist(), texts_of(part.column("text")))


def _sums(docs: DataFrame, known: Known, before: Known | None, longest: int, heavy: np.ndarray | None, by_hash: bool) -> DataFrame:
    """(key, f) over ``docs`` (lang, text)."""
    now, old = (known.filters, known.proposed), None if before is None else (before.filters, before.proposed)

    def run(batches):
        known, before, weighty = Known(*now), None if old is None else Known(*old), None if heavy is None else Filter(heavy)
        held: dict[str, _Counter] = {}

        def flush():
            for counter in held.values():
                yield from counter.counts()
            held.clear()

        size = 0
        for lang, text in _rows(batches):
            if not text:
                continue
            if lang not in held:
                held[lang] = _Counter(lang, known, before, longest, weighty, by_hash)
            held[lang].add(text)
            size += len(text)
            if size >= SLICE:
                yield from flush()
                size = 0
        yield from flush()

    return docs.mapInArrow(run, f"key {'long' if by_hash else 'string'}, f long").groupBy("key").agg(F.sum("f").alias("f"))


def hash_pass(docs: DataFrame, known: Known, longest: int) -> DataFrame:
    """(h, f): how often phrases of each hash occur, of all words and of the phrases that ``known`` makes countable."""
    return _sums(docs, known, None, longest, None, True).withColumnRenamed("key", "h")


def count_pass(docs: DataFrame, known: Known, before: Known | None, longest: int, heavy: np.ndarray | None = None) -> DataFrame:
    """(lang, m, phrase, f): exact counts of what ``known`` makes countable: of all words (m = 0: of
    any word) and phrases if ``before`` is None, else of the phrases that ``before`` did not; those
    in the filter ``heavy`` besides."""
    sums = _sums(docs, known, before, longest, heavy, False)
    phrase = F.substring_index("key", "\n", -1)  # no phrase holds a line feed
    m = F.when(phrase == "", 0).otherwise(F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1).cast("int")
    return sums.select(F.expr("left(key, length(key) - length(substring_index(key, '\n', -1)) - 1)").alias("lang"), m.alias("m"), phrase.alias("phrase"), "f")


def _unknown(phrases: DataFrame, known: Known) -> DataFrame:
    """(h): the hashes of those of ``phrases`` (lang, m, phrase) that are not known."""
    state = known.filters, known.proposed

    def run(batches):
        known = Known(*state)
        for batch in batches:
            by_lang: dict[str, tuple[_Counter, list[int]]] = {}
            for lang, m, phrase in zip(batch.column("lang").to_pylist(), batch.column("m").to_pylist(), texts_of(batch.column("phrase"))):
                counter, lengths = by_lang.setdefault(lang, (_Counter(lang, known, None, 0), []))
                counter.add(phrase)
                lengths.append(m)
            for counter, lengths in by_lang.values():
                yield pa.RecordBatch.from_pydict({"h": counter.unknown(lengths).view(np.int64)})

    return phrases.select("lang", "m", "phrase").mapInArrow(run, "h long")


def _filter_of(hashes: DataFrame) -> np.ndarray | None:
    """A filter that holds the stored hashes; None if there are none."""
    n = hashes.count()
    if not n:
        return None
    size = min(FILTER_BITS, 1 << max(10, (32 * n - 1).bit_length()))

    def bits(batches):
        for batch in batches:
            at = np.concatenate(Filter.positions(batch.column("h").to_numpy().view(np.uint64), size))
            yield pa.RecordBatch.from_pydict({"page": (at >> np.uint64(6)).astype(np.int64), "mask": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

    # at most one row for each word of the filter reaches the driver
    pages = hashes.mapInArrow(bits, "page long, mask long").groupBy("page").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(size >> 6, dtype=np.uint64)
    words[pages["page"].to_numpy()] = pages["mask"].to_numpy().view(np.uint64)
    return words


def _not_in(hashes: DataFrame, proposed: np.ndarray | None) -> DataFrame:
    """Those of the hashes (h) that the filter does not hold."""
    def run(batches):
        for batch in batches:
            h = batch.column("h").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_pydict({"h": (h if proposed is None else h[~Filter(proposed).has(h)]).view(np.int64)})

    return hashes.select("h").mapInArrow(run, "h long")


def closed_counts(docs: DataFrame, min_count: int, longest: int, scratch: Scratch, proposed: np.ndarray | None = None, *, by_hash: bool = False) -> tuple[DataFrame, int]:
    """Passes over ``docs`` until no border phrase fails: (lang, m, phrase, f) of every phrase with
    f >= ``min_count`` and, as m = 0, the number of words of each language; and the number of passes.
    ``by_hash``: the first pass counts hashes."""
    known, before, heavy, tables, passes = Known([] if proposed is None else [proposed], 0 if proposed is None else 1), None, None, [], 1
    if by_hash:
        hashes = scratch("hashes", hash_pass(docs, known, longest).where(F.col("f") >= min_count))
        heavy = _filter_of(hashes)
        failed = _filter_of(scratch("failed0", _not_in(hashes, proposed)))
        heavy = np.zeros(16, dtype=np.uint64) if heavy is None else heavy
        before, known, passes = known, Known(known.filters + ([failed] if failed is not None else []), known.proposed), 2
    while True:
        f = count_pass(docs, known, before, longest, heavy)
        f = scratch(f"counted{passes}", f.where((F.col("f") >= min_count) | (F.col("m") == 0)))
        tables.append(f)
        failed = _filter_of(scratch(f"failed{passes}", _unknown(f.where((F.col("m") > 0) & (F.col("m") < longest)), known)))
        if failed is None:
            break
        before, known, heavy, passes = known, Known(known.filters + [failed], known.proposed), None, passes + 1
    counts = tables[0]
    for t in tables[1:]:
        counts = counts.unionByName(t)
    return counts, passes


def propose(docs: DataFrame, min_count: int, longest: int, scratch: Scratch) -> np.ndarray | None:
    """A filter of the phrases with f >= ``min_count`` in ``docs``."""
    counts, _ = closed_counts(docs, min_count, longest, scratch)
    return _filter_of(scratch("proposed", _unknown(counts.where((F.col("m") > 0) & (F.col("m") < longest)), Known())))


def frequent_phrases(docs: DataFrame, *, min_count: int = MIN_COUNT, longest: int = LONGEST, sample: int = SAMPLE, scratch: Scratch | None = None) -> DataFrame:
    """(lang, m, phrase, f) of every phrase of 1 to ``longest`` words with f >= ``min_count``; m = 0: the number of words."""
    scratch = scratch or Scratch(docs.sparkSession, "phrases")
    spread = F.xxhash64(*([F.col("doc_id").cast("string")] if "doc_id" in docs.columns else []), F.col("text").cast("string"), F.lit("sample"))
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string"), spread.alias("spread"))
    some = scratch("sample", docs.where(F.pmod("spread", F.lit(sample)) == 0).select("lang", "text"))
    proposed = propose(some, max(2, -(-min_count // sample)), longest, Scratch(scratch.spark, "phrases-sample"))
    return closed_counts(docs.select("lang", "text"), min_count, longest, scratch, proposed, by_hash=True)[0]


def collocations(counts: DataFrame, *, longest: int = LONGEST, top: int = TOP, scratch: Scratch | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language by the score of
    their weakest cut, without those that lie in a longer one of the same count. ``counts``: what
    ``frequent_phrases`` returns."""
    scratch = scratch or Scratch(counts.sparkSession, "collocations")
    counts = scratch("counts", counts)
    words = F.split("phrase", " ")
    # a phrase lies in a longer one of its count only if it lies in one that is longer by a word
    parts = counts.where(F.col("m") > 2).withColumn("w", words).select(
        "lang", "f", F.explode(F.array(F.array_join(F.slice("w", F.lit(1), F.size("w") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.size("w") - 1), " "))).alias("phrase"))
    longer = parts.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    candidates = counts.where(F.col("m") > 1).join(longer, ["lang", "phrase"], "left")
    candidates = candidates.where(F.col("longer").isNull() | (F.col("longer") < F.col("f"))).select("lang", "m", "phrase", F.col("f").alias("a"))
    # both parts of every cut meet their counts; a common part is spread over salts
    salts = 8
    cuts = candidates.withColumn("w", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1))).withColumn("salt", F.pmod(F.hash("phrase"), F.lit(salts)))
    cuts = cuts.withColumn("first", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ")).withColumn("rest", F.array_join(F.slice("w", F.col("k") + 1, F.col("m") - F.col("k")), " "))
    single = counts.where((F.col("m") > 0) & (F.col("m") < longest)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    of = lambda part, name: single.select("lang", "salt", F.col("phrase").alias(part), F.col("f").alias(name))
    scored = cuts.drop("w").join(of("first", "l"), ["lang", "salt", "first"]).join(of("rest", "r"), ["lang", "salt", "rest"])
    total = counts.where(F.col("m") == 0).select("lang", F.col("f").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    scored = scored.join(total, ["lang", "salt"]).withColumn("above", (exact("a") * exact("n") * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)"))
    scored = scored.withColumn("score", F.expr("above div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))").cast("long"))
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "n", "a")).alias("c")).select("lang", "phrase", "c.*")
    # ranked over range partitions, so that no task holds a whole language
    ranked = ordinal(weakest.withColumn("below", -F.col("score")).withColumn("fewer", -F.col("a")).drop("k"), ["lang"], ["below", "fewer", "phrase"], "place")
    return ranked.where(F.col("place") < top).select("lang", (F.col("place") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle_sql(min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP) -> str:
    """DuckDB SQL over ``documents``: every window of every piece counted, every longer phrase compared."""
    windows = " UNION ALL ".join(
        f"SELECT lang, {m} AS m, unnest(list_transform(range(1, len(w) - {m - 2}), lambda i: array_to_string(w[i:i + {m - 1}], ' '))) AS phrase FROM pieces WHERE len(w) >= {m}"
        for m in range(1, longest + 1))
    return f"""WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
total AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM pieces GROUP BY lang),
f AS (SELECT lang, m, phrase, count(*) AS f FROM ({windows}) GROUP BY ALL HAVING count(*) >= {min_count}),
c AS (SELECT lang, m, phrase, f AS a FROM f WHERE m > 1),
kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS d WHERE d.lang = c.lang AND d.m > c.m AND 100 * d.a >= 100 * c.a
  AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))),
cut AS (SELECT lang, m, phrase, a, unnest(range(1, m)) AS k FROM kept),
scored AS (SELECT cut.lang, cut.phrase, a, k, l.f AS l, r.f AS r, n, (1000 * a::HUGEINT * n) // (l.f::HUGEINT * r.f) AS score
  FROM cut JOIN total USING (lang)
  JOIN f AS l ON l.lang = cut.lang AND l.phrase = array_to_string(string_split(cut.phrase, ' ')[1:k], ' ')
  JOIN f AS r ON r.lang = cut.lang AND r.phrase = array_to_string(string_split(cut.phrase, ' ')[k + 1:], ' ')),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= {top}"""
