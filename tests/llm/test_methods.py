"""The operators against brute force, and the parts that make their methods exact."""

import hashlib
import random
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import (bestfit_packing, bpe, bpe_lexicon, language_id, quality_fm, queries, robust_rules, simhash_pivot, substring_cover,
                         vector_sharding, vector_topk)
from lectern.llm.common import Scratch, WordScanner
from lectern.llm.components import connected_components

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


def _docs(spark, sf=SMALL):
    return spark.read.parquet(f"{sf}/documents.parquet")


def _auc(score, label):
    order = np.argsort(np.argsort(score))
    good = label == 1
    return (order[good].sum() - good.sum() * (good.sum() - 1) / 2) / max(1, good.sum() * (~good).sum())


def test_word_scanner():
    scanner, text = WordScanner(), "a bb  a\tbb\na é bb".encode()
    starts, ends = scanner.spans(text)
    assert [text[a:b] for a, b in zip(starts, ends)] == text.split()
    h = scanner.hashes(text, starts, ends)
    assert h[0] == h[2] == h[4] and h[1] == h[3] == h[6] and len(set(h.tolist())) == 3
    w = scanner.windows(h, 2)
    assert w[0] == w[2] and w[1] == w[3] and len(set(w.tolist())) == 4


# 1
def test_fm_identity():
    """The linear-time score equals the sum over all pairs."""
    rng = np.random.default_rng(1)
    fm = quality_fm.FactorisationMachine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    idx, x = np.array([3, 7, 20, 41]), rng.normal(size=4)
    pairs = sum(fm.factors[idx[i]] @ fm.factors[idx[j]] * x[i] * x[j] for i, j in combinations(range(4), 2))
    assert abs(fm.margin(idx, x) - (0.3 + fm.linear[idx] @ x + pairs)) < 1e-9


def test_quality_held_out(spark):
    got = queries.op1_quality_fm(spark, MEDIUM).join(spark.read.parquet(f"{MEDIUM}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert set(got.doc_id[got.held_out]) == {i for i in got.doc_id if zlib.crc32(str(i).encode()) % 5 == 0}
    assert _auc(held.score.values, held.quality.values) > 0.95
    assert ((held.score >= 0.3).astype(int) == held.predicted).all() and got.score.between(0, 1).all()
    assert held[held.quality == 1].predicted.mean() > 0.97


# 2
def test_language_held_out(spark):
    got = queries.op2_language_id(spark, MEDIUM).join(_docs(spark, MEDIUM).select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()


def test_families():
    close = np.array([[1, 0, 0.1, 0], [0.9, 0.1, 0, 0], [0, 0, 1, 0.9], [0, 0.1, 0.9, 1]])
    assert [sorted(g) for g in language_id.merge_families(close, list("abcd"))] == [[0, 1], [2, 3]]


# 3
def test_sharding(spark):
    got = queries.op3_vector_sharding(spark, MEDIUM).toPandas()
    docs = {r["doc_id"]: r["text"] for r in _docs(spark, MEDIUM).collect()}
    assert len(got) == len(docs) and got["shard"].between(0, 39).all()
    for r in got.itertuples():
        raw = (docs[r.doc_id] or "").encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)
    loads = got.groupby("shard")["size"].sum()
    assert loads.max() <= got["size"].sum() / 40 + got["size"].max()
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    # no group here is larger than a shard: equal texts stay together
    assert got.assign(t=got.doc_id.map(docs)).groupby("t")["shard"].nunique().max() == 1


def test_hot_group_is_split(spark):
    rows = [(i, "the very same text of all") for i in range(400)] + [(1000 + i, f"text number {i} of many others") for i in range(800)]
    got = vector_sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 10).toPandas()
    loads = got.groupby("shard")["size"].sum()
    assert loads.max() / loads.mean() < 1.15 and loads.min() / loads.mean() > 0.85


# 5
def _brute_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def _brute_components(prints):
    """doc_id → least id reachable over links of 3 or fewer bits."""
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in ids}


def test_simhash_query(spark):
    got = {r["doc_id"]: r for r in queries.op5_simhash_pivots(spark, SMALL).collect()}
    prints = {r["doc_id"]: _brute_print(r["text"]) for r in _docs(spark).collect()}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == prints
    assert {i: r["component_id"] for i, r in got.items()} == _brute_components(prints)


@pytest.mark.parametrize("seed", range(3))
def test_drop_keeps_one_row_a_component(spark, seed):
    """Repeated ids with different texts, rows without an id, equal rows: each component of rows
    keeps one row, of the least id, and nothing disappears that no kept row is linked to."""
    rng = random.Random(seed)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(90)) for _ in range(6)] + ["", None, "a b"]
    rows = []
    for i in range(90):
        words = (rng.choice(base) or "").split()
        if len(words) > 3 and rng.random() < 0.5:
            words[rng.randrange(len(words))] = f"w{rng.randrange(400)}"
        rows.append((rng.choice([None, *range(12)]), " ".join(words) if rng.random() < 0.9 else None, rng.choice(["x", "y"])))
    rows += rows[:10]
    kept = [tuple(r) for r in simhash_pivot.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()]
    root = _brute_components(dict(enumerate(_brute_print(t) for _, t, _ in rows)))
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(root[i], []).append(row)
    assert len(kept) == len(groups)
    for members in groups.values():
        mine = [r for r in kept if r in members]
        least = min((r[0] is None, r[0] or 0) for r in members)
        assert any((r[0] is None, r[0] or 0) == least for r in mine)


@pytest.mark.parametrize("limit", [4096, 8])
def test_dense_fingerprints(spark, limit):
    """Clouds of fingerprints a few bits apart, also when lists are cut at a few members."""
    rng = random.Random(5)
    prints, centres = {}, [rng.getrandbits(64) for _ in range(12)]
    for i in range(260):
        fp = rng.choice(centres)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            fp ^= 1 << rng.randrange(64)
        prints[i] = fp
    as_long = {i: int(np.array([p], dtype=np.uint64).view(np.int64)[0]) for i, p in prints.items()}
    table = simhash_pivot.pivot_table(spark.createDataFrame([(v,) for v in set(as_long.values())], "fp long"))
    scratch = Scratch(spark, "test")
    roots = {r["v"]: r["root"] for r in connected_components(simhash_pivot.near_links(scratch("t", table), scratch, limit=limit), scratch).collect()}
    want = _brute_components(prints)
    got = {i: roots.get(as_long[i], as_long[i]) for i in prints}
    groups = lambda m: {frozenset(i for i in m if m[i] == v) for v in m.values()}
    assert groups(got) == groups(want)


def test_pivots_never_lose_a_pair():
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    near = fp ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    refs = np.array(simhash_pivot.pivots(), dtype=np.int64).view(np.uint64)
    both = np.concatenate([fp, near])
    table = np.bitwise_count(both[:, None] ^ refs[None, :]).astype(np.int16)
    assert len(simhash_pivot.close_pairs(both, table, np.arange(500), np.arange(500, 1000), 3)) == 500


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(7, 7)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r["v"]: r["root"] for r in connected_components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark, "cc")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for a, b in chain:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got == {v: find(v) for v in parent if any(v in e and e[0] != e[1] for e in chain)}


# 6
def _brute_rules(text):
    words = (text or "").encode().split()
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 400 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    inside = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def test_rules_query(spark):
    texts = {r["doc_id"]: r["text"] for r in _docs(spark, MEDIUM).collect()}
    got = queries.op6_robust_rules(spark, MEDIUM).toPandas().set_index("doc_id")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    for i, r in got.iterrows():
        n, chars, symbols, dup, repeat = _brute_rules(texts[i])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and not (r.kept and r.base_failed)
    judged = got[~got.base_failed & got.index.isin(list(labels))]
    quality = judged.index.map(labels)
    assert judged.kept[quality == 1].mean() > 0.99 and judged.kept[quality == 0].mean() < 0.1


def test_mcd_ignores_contamination(spark):
    """A fifth of far outliers neither moves the centre nor widens the scatter."""
    rng = np.random.default_rng(4)
    good = rng.normal(0, 1, (800, 5)) * [1, 2, 0.5, 0.5, 0.5]
    bad = rng.normal(12, 1, (200, 5))
    rows = [(0, *(int(v * robust_rules.SCALE) for v in r)) for r in np.concatenate([good, bad])]
    df = spark.createDataFrame(rows, "k int, " + ", ".join(f"z{i} long" for i in range(5)))
    est = robust_rules.minimum_covariance(df, ["k"], Scratch(spark, "mcd"), "m", F.lit(True)).first()
    assert np.abs(np.array(est["centre"])).max() < 0.3
    spread = np.sqrt(np.diag(np.linalg.inv(np.array(est["inverse"]).reshape(5, 5))))
    assert np.allclose(spread, [1, 2, 0.5, 0.5, 0.5], rtol=0.3)


@pytest.mark.parametrize("share", [0.2, 1 / 3])
@pytest.mark.parametrize("kind", ["copies", "near", "spread"])
def test_mcd_is_not_masked(spark, share, kind):
    """Junk that holds a fifth or a third of a group is rejected, copies of one text too; the rest stays."""
    rng = np.random.default_rng(6)
    n = 1500
    bad = round(n * share)
    good = np.stack([rng.normal(5.6, 0.8, n - bad), rng.normal(5.1, 0.3, n - bad), rng.choice([0, 0, 0.05], n - bad), np.zeros(n - bad), rng.choice([0, 0, 0.1], n - bad)], 1)
    junk = np.array([5.2, 7.2, 0.6, 0.0, 0.1]) + {"copies": 0.0, "near": 0.02, "spread": np.array([0.8, 0.3, 0.05, 0.0, 0.1])}[kind] * rng.normal(0, 1, (bad, 5))
    rows = [(k, *(int(v * robust_rules.SCALE) for v in r)) for k, part in ((0, np.concatenate([good, junk])), (1, good)) for r in part]
    df = spark.createDataFrame(rows, "k int, " + ", ".join(f"z{i} long" for i in range(5)))
    fits = {r["k"]: r for r in robust_rules.minimum_covariance(df, ["k"], Scratch(spark, "mcd"), "m", F.lit(True)).collect()}
    for k, part, kept in ((0, good, True), (0, junk, False), (1, good, True)):
        d = part - np.array(fits[k]["centre"])
        d2 = np.einsum("ij,jk,ik->i", d, np.array(fits[k]["inverse"]).reshape(5, 5), d)
        assert ((d2 <= robust_rules.CUTOFF) == kept).all()


# 7
def _brute_cut(rows, window):
    first = {}
    for i, t in rows:
        x = (t or "").encode().split()
        for k in range(len(x) - window + 1):
            g = tuple(x[k:k + window])
            first[g] = min(first.get(g, i), i)
    out = {}
    for i, t in rows:
        x = (t or "").encode().split()
        gone = set()
        for k in range(len(x) - window + 1):
            if first[tuple(x[k:k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(x), len(gone), hashlib.sha256(b" ".join(w for k, w in enumerate(x) if k not in gone)).hexdigest())
    return out


def test_substring_query(spark):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op7_substring_cover(spark, SMALL).collect()}
    assert got == _brute_cut([(r["doc_id"], r["text"]) for r in _docs(spark).collect()], 50)


@pytest.mark.parametrize("window", [8, 20, 50])
def test_substring_dense(spark, window):
    """Few words, so that windows repeat at every alignment, and a hot passage in most texts."""
    rng = random.Random(window)
    passage = " ".join(rng.choice("pqrstu") for _ in range(60))
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.choice([3, window, 90]))) + " " + (passage if rng.random() < 0.7 else "") + " tail " * rng.randrange(3)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_cover.digest_report(df, window=window).collect()}
    assert got == _brute_cut(rows, window)
    cut = {r["doc_id"]: r["text"] for r in substring_cover.remove_repeats(df, window=window).collect()}
    for i, t in rows:
        want = _brute_cut(rows, window)[i] if i < 3 else got[i]
        assert cut[i] == t if want[1] == 0 else hashlib.sha256(cut[i].encode()).hexdigest() == want[2]


def test_covers():
    """Every difference modulo the period is a difference of two cover positions."""
    for v, cover in substring_cover.COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


# 8
WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = "aAéÉ'sStTrReE 12\n\t.,#×µ́ΣſŁ日½²​　 \x1f\x85_"


def _odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1, 40))) for _ in range(n)] + ["", " ", "<|endoftext|>a <|endoftext|>  b", "a" * 500, "'s's 're"]


def test_word_tokenizer():
    lib, own, texts = Tokenizer.from_file(WORD_BPE), bestfit_packing.WordTokenizer(WORD_BPE, limit=200), _odd_texts(800, 1)
    for text, ids in zip(texts, own.encode_batch([t.encode() for t in texts])):
        assert lib.encode(text, add_special_tokens=False).ids == ids.tolist()


def test_word_tokenizer_columns(monkeypatch):
    """Arrow columns, slices of them and slices of few bytes give each text's own ids, also while the memo is cleared."""
    monkeypatch.setattr(bestfit_packing, "BATCH_BYTES", 300)
    lib, texts = Tokenizer.from_file(WORD_BPE), [None, "", "  ", "\x1c", *_odd_texts(300, 2), None, " a\tb\x0b\x0c\r\n", "x " * 900, None]
    for kind in (pa.string(), pa.large_string()):
        own, column = bestfit_packing.WordTokenizer(WORD_BPE, limit=200), pa.array(["cut off", *texts, "cut off"], kind).slice(1, len(texts))
        got = [ids.tolist() for ids in own.encode_batch(column)]
        assert got == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert list(own.encode_batch(pa.array([], pa.string()))) == []
    broken = [b"a\xff\xfeb \xc3 c", b"\xe2\x80"]  # not UTF-8: what does not decode is replaced
    assert [ids.tolist() for ids in own.encode_batch(broken)] == [lib.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids for t in broken]


def test_word_tokenizer_looks_up_distinct_words():
    """Repeated words of a batch are looked up once; the vocabulary is read once per process."""
    class Counted(dict):
        lookups = 0

        def get(self, *a):
            self.lookups += 1
            return super().get(*a)

        def __getitem__(self, k):
            self.lookups += 1
            return super().__getitem__(k)

    own = bestfit_packing.WordTokenizer(WORD_BPE)
    known = own.words.number = Counted()
    assert [len(x) for x in own.encode_batch([b"one two three " * 1000] * 5)] == [3000] * 5
    assert known.lookups <= 10
    assert bestfit_packing.WordTokenizer(WORD_BPE).merges is own.merges


def _check_packing(got, docs, capacity=4096):
    lib = Tokenizer.from_file(WORD_BPE)
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, text in docs.items():
        ids = np.array(lib.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        rows = sorted(pieces[i], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"]) for r in rows] == [(k, k * capacity) for k in range(-(-len(ids) // capacity))]
        for r in rows:
            part = ids[r["start"]:r["start"] + capacity]
            assert r["length"] == len(part) and r["ids_crc32"] == zlib.crc32(part.tobytes())
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r["length"] for r in got) // capacity)


def test_packing_query(spark):
    got = queries.op8_bestfit_packing(spark, SMALL).collect()
    used, least = _check_packing(got, {r["doc_id"]: r["text"] for r in _docs(spark).collect()})
    assert used <= 1.1 * least + 2


def test_open_bins():
    """Bounded best fit: never over capacity, never more open bins than allowed, close to the least."""
    rng = random.Random(8)
    lengths = [rng.choice([5, 40, 300, 900, 4096]) for _ in range(5000)]
    bins, load = bestfit_packing.OpenBins(4096, 16), {}
    for n in lengths:
        b, at = bins.put(n)
        assert at == load.get(b, 0)
        load[b] = at + n
        assert bins.open <= 16 and load[b] <= 4096
    assert bins.made <= 1.03 * sum(lengths) / 4096
    full = bestfit_packing.OpenBins(10, 2)
    assert [full.put(n)[0] for n in (8, 7, 10, 3, 2)] == [0, 1, 2, 1, 0]  # the full bin closes no other


def test_equal_pieces_spread(spark):
    """Rows that are equal in all columns go to all tasks."""
    rows = spark.createDataFrame([(None, 0, 0, 1, 5)] * 600, "doc_id long, piece long, start long, length long, ids_crc32 long").withColumn("row", F.monotonically_increasing_id())
    packed = bestfit_packing.pack(rows, capacity=16, pieces_a_task=100)
    assert packed.select((F.col("sequence_id") / (1 << 40)).cast("int").alias("task")).distinct().count() >= 5


# 9
def test_top_k_cells(spark, monkeypatch):
    """Many small cells give the same as one, against brute force on integers."""
    monkeypatch.setattr(vector_topk, "CANDIDATES", 40)
    monkeypatch.setattr(vector_topk, "QUERIES", 3)
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 37).astype(np.float32)]) for i in range(300)] + [(300 + i, [0.25] * 37) for i in range(40)]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in vector_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()}
    ints = {i: np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int) for i, v in rows}
    for q in range(0, 340, 50):
        best = sorted(((-int(ints[q] @ v), i) for i, v in ints.items() if i != q))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]


@pytest.mark.parametrize("cell", [8192, 40])
def test_top_k_repeated_ids(spark, monkeypatch, cell):
    """Different vectors under one id take one place of a query's five; against the SQL."""
    import duckdb
    monkeypatch.setattr(vector_topk, "CANDIDATES", cell)
    monkeypatch.setattr(vector_topk, "QUERIES", max(3, cell // 4))
    rng = np.random.default_rng(19)
    few = [(0, [1.0])] + [(i, [float(s)]) for i, s in ((7, 100), (7, 99), (9, 90), (10, 80), (11, 70), (12, 60))]
    many = [(int(i), rng.normal(0, 1, 37).round(3).tolist()) for i in [*rng.integers(1, 130, 260), *[77] * 200, *[50] * 3]]
    many += [(77, (3 * np.sign(v) + rng.normal(0, 0.1, 37)).round(3).tolist()) for i, v in many if i % 50 == 0 for _ in range(8)]
    rows = few + many
    got = vector_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert got == sorted(con.execute(queries.ORACLE["op9_vector_topk"]).fetchall())
    assert [r[2] for r in got if r[0] == 0] == [7, 9, 10, 11, 12]


# 10
def test_transducer():
    words = sorted({w.encode() for w in "tap taps top tops stop stops a an and tapping topping".split()})
    ids = np.arange(2 * len(words))
    t = bpe_lexicon.mapped(bpe_lexicon.Transducer.compile(words, ids, np.full(len(words), 2)).dump())
    assert t.ranks(words).tolist() == list(range(len(words)))
    assert t.ranks([b"", b"ta", b"tapz", b"zzz"]).tolist() == [-1] * 4
    # minimal: as many states as there are different sets of suffixes
    suffixes = {frozenset(w[len(p):] for w in words if w.startswith(p)) for p in {w[:k] for w in words for k in range(len(w) + 1)}}
    assert t.states == len(suffixes)


def test_codec():
    merges, lib, texts = bpe.Merges(BYTE_BPE), Tokenizer.from_file(BYTE_BPE), _odd_texts(800, 2)
    words = sorted({p for t in texts[:300] for p in bpe_lexicon.pretokens(t.encode())})
    codec = bpe_lexicon.Codec(merges, bpe_lexicon.Transducer.compile(words, *merges.encode(words)), limit=500)
    for text, ids in zip(texts, codec.encode_batch([t.encode() for t in texts])):
        assert lib.encode(text, add_special_tokens=False).ids == ids.tolist()
        assert lib.decode(ids.tolist(), skip_special_tokens=False).encode() == codec.decode(ids)


def test_bpe_query(spark):
    lib = Tokenizer.from_file(BYTE_BPE)
    got = {r["doc_id"]: r for r in queries.op10_bpe_lexicon(spark, SMALL).collect()}
    for r in _docs(spark).collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        own = got[r["doc_id"]]
        assert own["n_tokens"] == len(ids) and own["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert own["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# pipeline
def test_pipeline(spark):
    """The pipeline's rows against its operators' parts run one text at a time."""
    import corpus_pipeline
    docs = {r["doc_id"]: r for r in _docs(spark).collect()}
    language = queries.language_model(_docs(spark))
    left = {i: r for i, r in docs.items() if language.predict(r["text"])[0] != "und"}
    model, scanner = queries.quality_model(spark, _docs(spark).where(F.col("doc_id").isin(list(left))), SMALL), WordScanner()
    left = {i: r for i, r in left.items() if model.score(*quality_fm.features(r["text"].encode(), r["n_chars"], scanner)) >= 0.3}
    groups = _brute_components({i: _brute_print(r["text"]) for i, r in left.items()})
    left = {i: r["text"] for i, r in left.items() if groups[i] == i}
    cut = _brute_cut(list(left.items()), 50)
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in got} == set(left)
    texts = {r["doc_id"]: r["text"] for r in substring_cover.remove_repeats(spark.createDataFrame(list(left.items()), "doc_id long, text string")).collect()}
    for i, t in texts.items():
        assert t == left[i] if cut[i][1] == 0 else hashlib.sha256(t.encode()).hexdigest() == cut[i][2]
    _check_packing(got, texts)
