"""Hard negatives against scoring every pair, and the bounds of the segment summaries."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import hard_negatives
from lectern.llm.hard_negatives import SEGMENT, Block, Pair, band, best_in_bands, best_rows, first_of


def table(ids, labels, v):
    parts = [[row[s:s + SEGMENT] for s in range(0, max(1, len(row)), SEGMENT)] for row in v]
    small = all(abs(x) < 1 << 28 for row in v for x in row)
    sums = [[sum(p) for p in row] for row in parts] if small else [None] * len(v)
    squares = [[sum(x * x for x in p) for p in row] for row in parts] if small else [None] * len(v)
    longs = pa.list_(pa.int64())
    return pa.table({"row": pa.array(range(len(v)), pa.int64()), "vec_id": pa.array(ids, pa.int64()), "label": pa.array(labels, pa.int64()), "v": pa.array(v, longs),
                     "sums": pa.array(sums, longs), "squares": pa.array(squares, longs)})


@pytest.mark.parametrize("dims", [0, 1, 3, 4, 7, 16, 64, 101])
@pytest.mark.parametrize("size", [3, 300, 1 << 26, 1 << 29, 1 << 45])
def test_bounds_and_searches(dims, size):
    rng = random.Random(dims * 7 + size)
    n = 120
    centre = [rng.randint(-size, size) for _ in range(dims)]
    v = [[max(-size, min(size, c + rng.randint(-size // 2, size // 2))) for c in centre] for _ in range(n)]
    v[7] = v[8] = v[9]
    block = Block(table(list(range(n)), [i % 2 for i in range(n)], v))
    pair = Pair(block, block)
    want = [[max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(x, y)))) for y in v] for x in v]
    at = np.arange(n)
    for i in range(0, n, 17):
        assert pair.scores(i, at).tolist() == want[i]
        exact = np.array([float(sum(a * b for a, b in zip(v[i], y))) for y in v])
        for level in range(pair.depth):
            low, high = (x[0] for x in pair.bounds(np.array([i]), level))
            assert (low <= exact + 1e-15 * np.abs(exact)).all() and (high >= exact - 1e-15 * np.abs(exact)).all()
    ranked = [sorted((-want[i][j], j) for j in range(n) if j != i) for i in range(n)]
    found = list(best_rows(pair, 5))
    assert found == [(i, -s, j) for i in range(n) for s, j in ranked[i][:5]]
    bands = [[band(want[i][j]) for j in rng.sample(range(n), 3)] + [(5, 4)] for i in range(n)]
    got = list(best_in_bands(pair, bands, 3))
    assert got == [(i, b, -s, j) for i in range(n) for b, (low, high) in enumerate(bands[i]) for s, j in [x for x in ranked[i] if low <= -x[0] <= high and x[1] % 2 != i % 2][:3]]


def test_pruning():
    """Where segments differ, summaries leave few rows to score, and coarse levels already drop most."""
    rng = np.random.default_rng(3)
    blocks = np.repeat(rng.normal(size=(4000, 8)) * 200, 8, axis=1) + rng.normal(size=(4000, 64)) * 5
    block = Block(table(list(range(4000)), [0] * 4000, np.floor(blocks).astype(int).tolist()))
    pair = Pair(block, block)
    some = np.arange(10)
    left = list(pair.survivors(some, np.ones((10, 4000), dtype=bool), np.full(10, -np.inf), np.full(10, np.inf), 5))
    assert sum(len(at) for _, at, _ in left) < 10 * 600
    assert all(set(at[first_of(s, at, 5)]) == set(np.argsort(-pair.scores(i, np.arange(4000)), kind="stable")[:5]) for i, at, s in left)


def plain(rows, k=5, n=3):
    """Every pair of rows scored. ``rows``: (vec_id, label, integer vector), distinct."""
    out = []
    for a_id, a_label, a in rows:
        if a_id % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(a, c)), c_id, c_label) for c_id, c_label, c in rows if c_id != a_id and len(c) == len(a)]
        scored.sort()
        for p, p_id, _ in [s for s in scored if s[2] == a_label][:k]:
            hits = [(s, i) for s, i, label in scored if label != a_label and 50 * -p <= 100 * -s <= 95 * -p][:n]
            out += [(a_id, p_id, r + 1, i, -p, -s) for r, (s, i) in enumerate(hits)]
    return sorted(out)


def test_table(spark):
    """Cases: nulls, non-finite components, ties, repeated rows and ids, lengths, empty vectors, extra columns."""
    rng = random.Random(11)
    inf, nan = float("inf"), float("nan")
    rows = [(i, [rng.choice([0.0, 0.25, 0.5, 1.0, -0.5]) for _ in range(6)], rng.randrange(3)) for i in range(0, 400)]
    rows += [(1000 + i, [0.5] * 6, 1) for i in range(60)] + [(50, [1.0] * 6, 2), (50, [1.0] * 6, 1), (7, [0.5] * 6, 0)]
    rows += rows[:40]
    rows += [(2000 + i, [0.5, 0.25], i % 2) for i in range(60)] + [(3000 + i, [], i % 2) for i in range(51)]
    bad = [(None, [1.0] * 6, 1), (5000, None, 1), (5050, [1.0] * 6, None), (5100, [inf] * 6, 1), (5150, [nan] + [1.0] * 5, 1), (5200, [None] + [1.0] * 5, 1)]
    df = spark.createDataFrame([(*r, 9, 9) for r in rows + bad], "vec_id long, embedding array<float>, label int, row int, place int").repartition(4)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    want = plain(sorted({(i, (c + 1) % 10 if i % 7 == 0 else c, tuple(int(np.floor(x * 256)) for x in v)) for i, v, c in rows}))
    got = sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 50 == 0, label).collect()))
    assert got == want and len(want) > 100
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_many_cells(spark, monkeypatch):
    """Cells of a few rows give the same result: every anchor meets every row once."""
    rng = random.Random(12)
    rows = [(i, [rng.random() - 0.3 for _ in range(9)], 0 if i % 3 else i % 4) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    whole = sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 50 == 0).collect()))
    monkeypatch.setattr(hard_negatives, "CANDIDATES", 64)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    assert sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 50 == 0).collect())) == whole
    assert whole == plain([(i, c, [int(np.floor(x * 256)) for x in v]) for i, v, c in rows])
