"""Toivonen mining against counting every window, whatever the sample proposes."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from lectern.llm import phrase_mining
from lectern.llm.common import Scratch
from lectern.llm.phrase_mining import Filter, Known, _Counter

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def windows(rows, longest=5):
    """f of every phrase and n of every language, by counting all windows."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UPPER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f.update((lang, " ".join(words[i:i + m])) for i in range(len(words) - m + 1))
    return f, n


def plain(rows, min_count, top):
    f, n = windows(rows)
    candidates = {k: a for k, a in f.items() if a >= min_count and " " in k[1]}
    scored = {}
    for (lang, phrase), a in candidates.items():
        if any(other != (lang, phrase) and other[0] == lang and f" {phrase} " in f" {other[1]} " and b >= a for other, b in candidates.items()):
            continue
        words = phrase.split(" ")
        cuts = []
        for k in range(1, len(words)):
            left, right = f[(lang, " ".join(words[:k]))], f[(lang, " ".join(words[k:]))]
            cuts.append((int(Fraction(1000 * a * n[lang], left * right)), k, left, right))
        score, _, left, right = min(cuts)
        scored.setdefault(lang, []).append((-score, -a, phrase.encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows_ in scored.items()
                  for i, (s, a, p, left, right) in enumerate(sorted(rows_)[:top]))


def corpus(seed, docs=60):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "New", "YORK", "city", "é", "É", "x\x00y", "\x1c", "of", "the", "𝔘"]
    fixed = ["new york city hall of", "the state of the art", "a b a b a b", "of the of the"]
    rows = []
    for _ in range(docs):
        parts = [rng.choice(fixed) if rng.random() < 0.5 else rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        rows.append((rng.choice(["en", "de", None, "und"]), rng.choice([" ", "  ", "\t"]).join(p + rng.choice(["", "", "", ".", ",", "\n", "?!"]) for p in parts)))
    return rows + [("en", None), ("en", ""), (None, "..."), ("fr", "one two")]


@pytest.mark.parametrize("seed,sample", [(1, 8), (2, 3), (3, 10 ** 9), (4, 1)])
def test_against_windows(spark, seed, sample):
    """Every sample gives the whole result: an empty one (all by failures), a part, all rows."""
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], "doc_id int, lang string, text string, phrase string").repartition(3)
    got = phrase_mining.collocations(phrase_mining.frequent_phrases(docs, min_count=6, sample=sample), top=40)
    assert sorted(map(tuple, got.collect())) == plain(rows, 6, 40)


def test_passes(spark):
    """From nothing known three passes reach every length; all counts come out exact, once."""
    rows = [("en", "alpha beta gamma delta epsilon zeta")] * 7
    docs = spark.createDataFrame(rows, "lang string, text string")
    counts, passes = phrase_mining.closed_counts(docs, 7, 5, Scratch(spark, "test-passes"))
    got = {(r["m"], r["phrase"]): r["f"] for r in counts.collect()}
    assert passes == 3 and len(got) == counts.count() == 1 + 6 + 5 + 4 + 3 + 2 and set(got.values()) == {7, 42}
    # by hashes first: words fail, then pairs of words
    hashed, passes = phrase_mining.closed_counts(docs, 7, 5, Scratch(spark, "test-passes"), by_hash=True)
    assert passes == 3 and {(r["m"], r["phrase"]): r["f"] for r in hashed.collect()} == got
    # with all of them proposed, one pass is enough
    proposed = phrase_mining.propose(docs, 7, 5, Scratch(spark, "test-passes"))
    again, passes = phrase_mining.closed_counts(docs, 7, 5, Scratch(spark, "test-passes"), proposed)
    assert passes == 1 and {(r["m"], r["phrase"]): r["f"] for r in again.collect()} == got


def test_slices(monkeypatch):
    """A text longer than a slice is counted whole, windows across the seams once."""
    monkeypatch.setattr(phrase_mining, "SLICE", 40)
    full = Known([np.full(16, ~np.uint64(0))], 1)
    text = corpus(9, 30)
    counter = _Counter("en", full, None, 5)
    for _, t in text:
        counter.add((t or "").encode())
    got = Counter()
    for batch in counter.counts():
        for r in batch.to_pylist():
            got[tuple(r["key"].split("\n"))] += r["f"]
    f, n = windows([("en", t) for _, t in text])
    assert got.pop(("en", "")) == n["en"] and got == f


@pytest.mark.parametrize("seed", range(6))
def test_each_phrase_in_one_pass(seed, monkeypatch):
    """Whatever the filters hold, the passes count disjoint sets of phrases, each with its whole count."""
    rng = random.Random(seed)
    rows = [("en", t) for _, t in corpus(20 + seed, 40)]
    want = windows(rows)[0]
    phrases = [p for _, p in want]
    made = [np.zeros(64, dtype=np.uint64) for _ in range(4)]
    for k, words in enumerate(made):
        for phrase in rng.sample(phrases, 25) + (list({w for p in phrases for w in p.split(" ")}) if not k else []):
            first, *rest = phrase_mining._word_hash("en", phrase.encode().split(b" "))
            h = np.array([first])
            for w in rest:
                h = phrase_mining._chain(h, np.array([w]))
            for at in Filter.positions(h, 64 * 64):
                words[int(at[0]) >> 6] |= np.uint64(1) << (at[0] & np.uint64(63))
    monkeypatch.setattr(phrase_mining, "SLICE", 400)
    seen = {}
    for t in range(1, 5):
        now, old = Known(made[:t], 1), None if t == 1 else Known(made[:t - 1], 1)
        got, counter = Counter(), _Counter("en", now, old, 5)
        for _, text in rows:
            counter.add((text or "").encode())
        for batch in counter.counts():
            for r in batch.to_pylist():
                got[r["key"].split("\n")[1]] += r["f"]
        got.pop("", None)  # the number of words
        assert all(want[("en", p)] == f for p, f in got.items()) and not set(got) & set(seen)
        seen.update(got)
    assert len(seen) > 100


def test_exact_scores(spark):
    """Products beyond 64 bits; ties between cuts go to the shorter first part."""
    big = 3 * 10 ** 12 + 7
    counts = spark.createDataFrame([("en", 0, "", 9 * 10 ** 15 + 1), ("en", 1, "a", big), ("en", 1, "b", big), ("en", 2, "a b", big - 1), ("en", 2, "b a", big - 2), ("en", 3, "a b a", big - 3)],
                                   "lang string, m int, phrase string, f long")
    got = {r["phrase"]: r for r in phrase_mining.collocations(counts).collect()}
    n = 9 * 10 ** 15 + 1
    assert got["a b"]["score"] == 1000 * (big - 1) * n // (big * big)
    cuts = [(1000 * (big - 3) * n // (big * (big - 2)), 1), (1000 * (big - 3) * n // ((big - 1) * big), 2)]
    assert got["a b a"]["score"] == min(cuts)[0] and got["a b a"]["l"] == (big if min(cuts)[1] == 1 else big - 1)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert phrase_mining.collocations(phrase_mining.frequent_phrases(docs)).count() == 0
