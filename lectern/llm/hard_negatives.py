"""Hard-negative mining: segment summaries bound the scores, finer segments step by step, then exact scores.

Components become floor(256 x). A vector is stored with the sum and the sum of squares of each of its
finest segments (``SEGMENT`` components), as exact integers; adding neighbours gives the summaries of
segments twice as long. Over a segment of d components two vectors with means m, m' and deviations
s, s' have an inner product between d (m m' - s s') and d (m m' + s s') (Cauchy-Schwarz on what is
left after the means), and the sum over segments bounds the score. An anchor's candidates go through
the levels from one segment a vector to the finest; after each, those that can't matter are dropped
before the next level looks at the rest. Survivors are scored exactly.

Two searches in cells of bounded size, merged over the cells:

  positives  anchors meet the rows of their own label; dropped when the upper bound lies below the
             scores of the k most promising ones, which are scored first
  negatives  anchors meet all rows; rows of their own label go at once. An anchor's positives give bands
             ``low`` % to ``high`` % of their scores; dropped when the bounds miss all bands

Every anchor meets every row in exactly one cell; bounds only decide what is scored, so the result is
exact. Rows are dealt to cells by their number: a label that holds most rows, or a vector that many
rows share, is spread like any other. A task's memory is ``CANDIDATES`` + ``ANCHORS`` rows.

Cases: rows with a null label, id or vector, or with a null or non-finite component, take no part;
rows equal in id, label and vector count once; different rows of one id are rows of their own, an
anchor never meets its own id; vectors meet those of their own length, empty ones score 0; fewer rows
than wanted → all; ties go to the smaller id; a positive with a score below zero has no negatives, one of zero
those of zero; scores beyond a long are clipped to it. Empty table → empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import Scratch

POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95
SEGMENT = 4
CANDIDATES = 8192
ANCHORS = 2048
#: Anchors that go through the levels together, and the share of pairs below which they part.
_TOGETHER = 32
_SPARSE = 0.1
_LONG = (1 << 63) - 1


def summarised(vectors: DataFrame, label: Column) -> DataFrame:
    """row, vec_id, label, dims, v (integers), sums and squares (of each finest segment) of the rows
    that take part, once each."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(sound, F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"),
                       F.transform(x, lambda c: F.floor(c * 256.0).cast("long")).alias("v")).distinct()
    # longs wrap beyond 2^63: such vectors are summed up where they are scored, in unbounded integers
    segments = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("v") / SEGMENT).cast("int") - 1)), lambda s: F.slice("v", s * SEGMENT + 1, SEGMENT))
    small = F.forall("v", lambda c: F.abs(c) < 1 << 28)
    total = lambda term: F.when(small, F.transform(segments, lambda s: F.aggregate(s, F.lit(0).cast("long"), lambda a, c: a + term(c))))
    rows = rows.withColumn("sums", total(lambda c: c)).withColumn("squares", total(lambda c: c * c))
    return rows.withColumn("row", F.monotonically_increasing_id()).withColumn("dims", F.size("v"))


class Block:
    """Rows of one length, with the summaries of all levels: ``means`` and ``spreads`` hold, level by
    level, sqrt(d) times mean and deviation, so that a bound is a plain inner product of both."""

    def __init__(self, table: pa.Table):
        self.ids, self.labels = table["vec_id"].to_numpy(), table["label"].to_numpy()
        self.v = _matrix(table["v"])
        n, dims = self.v.shape
        self.peak = float(np.abs(self.v.astype(float)).max(initial=0)) + 1
        if table["sums"].null_count or self.peak >= 1 << 28:
            wide = np.zeros((n, -(-dims // SEGMENT) * SEGMENT), dtype=object)
            wide[:, :dims] = self.v.astype(object)
            parts = wide.reshape(n, -1, SEGMENT)
            sums, squares = parts.sum(axis=2), (parts * parts).sum(axis=2)
        else:
            sums, squares = _matrix(table["sums"]), _matrix(table["squares"])
            if dims * dims * self.peak ** 2 >= 2.0 ** 62:
                sums, squares = sums.astype(object), squares.astype(object)
        lengths = np.minimum(SEGMENT, dims - SEGMENT * np.arange(sums.shape[1])) if dims else np.zeros(sums.shape[1], dtype=int)
        self.levels = []
        while True:
            self.levels.append(_summary(sums, squares, lengths))
            if sums.shape[1] <= 1:
                break
            if sums.shape[1] % 2:
                sums, squares = (np.concatenate([a, np.zeros((n, 1), dtype=a.dtype)], axis=1) for a in (sums, squares))
                lengths = np.append(lengths, 0)
            sums, squares, lengths = (a[..., ::2] + a[..., 1::2] for a in (sums, squares, lengths))
        self.levels.reverse()


def _summary(sums: np.ndarray, squares: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """sqrt(d) x mean and sqrt(d) x deviation of each segment: sum / sqrt(d), sqrt(squares - sum^2 / d);
    and the vector's norm, for what rounding can amount to."""
    d = np.maximum(lengths, 1)
    spread = np.maximum(d * squares - sums * sums, 0)  # exact integers
    return sums.astype(float) / np.sqrt(d), np.sqrt(spread.astype(float) / d), np.sqrt(squares.sum(axis=1).astype(float))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows x entries of a list column whose lists have one length."""
    column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0), dtype=np.int64)


class Pair:
    """Anchors against candidates of one cell: bounds by level, and exact scores.

    ``survivors`` takes a few anchors through the levels together: as long as many pairs are left a
    level is two matrix products, then each anchor's candidates are compacted and refined alone."""

    def __init__(self, anchors: Block, candidates: Block):
        self.a, self.c = anchors, candidates
        self.depth = len(anchors.levels)
        peak = max(1, anchors.v.shape[1]) * anchors.peak * candidates.peak
        self.kind = np.float64 if peak < 2 ** 52 else np.int64 if peak < 2 ** 62 else object
        self.av, self.cv = anchors.v.astype(self.kind), candidates.v.astype(self.kind)

    def bounds(self, i: np.ndarray, level: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the anchors ``i`` with the candidates ``at`` (all), a hair wider for rounding."""
        (am, ad, an), (cm, cd, cn) = ([x[i] for x in self.a.levels[level]], self.c.levels[level])
        if at is not None:
            cm, cd, cn = cm[at], cd[at], cn[at]
        middle, reach = am @ cm.T, ad @ cd.T
        reach += 1e-9 * np.multiply.outer(an, cn) + 1e-6
        return middle - reach, middle + reach

    def scores(self, i: int, at: np.ndarray) -> np.ndarray:
        return self._long(self.cv[at] @ self.av[i])

    def _long(self, products: np.ndarray) -> np.ndarray:
        if self.kind is object:
            return np.array([max(-_LONG - 1, min(_LONG, int(s))) for s in products.ravel()], dtype=np.int64).reshape(products.shape)
        return products.astype(np.int64)

    def survivors(self, anchors: np.ndarray, open_: np.ndarray, needed: np.ndarray, most: np.ndarray, k: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, candidates, their scores) for each of ``anchors``: those of ``open_`` (anchors x
        candidates) whose score can lie between ``needed`` and ``most``; with ``k`` the k best scores
        proven on the way raise what is needed."""
        for level in range(self.depth):
            lower, upper = self.bounds(anchors, level)
            if k and level in (0, self.depth - 1):
                needed = self._raise(anchors, np.where(open_, upper, -np.inf), needed, k)
            open_ = open_ & (upper >= needed[:, None]) & (lower <= most[:, None])
            if open_.mean() < _SPARSE:
                break
        else:
            scores = self._long(self.av[anchors] @ self.cv.T)
            for j, i in enumerate(anchors):
                at = np.flatnonzero(open_[j])
                yield int(i), at, scores[j, at]
            return
        for j, i in enumerate(anchors):
            at = np.flatnonzero(open_[j])
            for finer in range(level + 1, self.depth):
                lower, upper = (x[0] for x in self.bounds(np.array([i]), finer, at))
                at = at[(upper >= needed[j]) & (lower <= most[j])]
            yield int(i), at, self.scores(int(i), at)

    def _raise(self, anchors: np.ndarray, upper: np.ndarray, needed: np.ndarray, k: int) -> np.ndarray:
        """The least exact score of each anchor's ``k`` most promising candidates, where it has as many."""
        if upper.shape[1] < k:
            return needed
        seeds = np.argpartition(-upper, k - 1, axis=1)[:, :k]
        floors = [min(self.scores(int(i), s).tolist()) if np.isfinite(upper[j, s]).all() else needed[j] for j, (i, s) in enumerate(zip(anchors, seeds))]
        return np.maximum(needed, _below(np.array(floors, dtype=float)))


def _below(x: np.ndarray) -> np.ndarray:
    """At most ``x``, also where ``x`` was rounded to a double."""
    return np.where(np.isfinite(x), x - 1e-12 * np.abs(np.nan_to_num(x)), x)


def first_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties to the smaller id."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at].astype(object) if len(at) and scores[at].min() == -_LONG - 1 else -scores[at]))][:k]


def _groups(n: int) -> Iterator[np.ndarray]:
    return (np.arange(s, min(n, s + _TOGETHER)) for s in range(0, n, _TOGETHER))


def best_rows(pair: Pair, k: int) -> Iterator[tuple[int, int, int]]:
    """(anchor, score, candidate) of each anchor's ``k`` best candidates under another id."""
    for some in _groups(len(pair.a.ids)):
        open_ = pair.c.ids[None, :] != pair.a.ids[some][:, None]
        for i, at, scores in pair.survivors(some, open_, np.full(len(some), -np.inf), np.full(len(some), np.inf), k):
            for p in first_of(scores, pair.c.ids[at], k):
                yield i, int(scores[p]), int(at[p])


def best_in_bands(pair: Pair, bands: list[list[tuple[int, int]]], n: int) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, band, score, candidate): for each band (low, high) of an anchor its ``n`` best
    candidates of other labels, under another id, whose score lies in the band."""
    ends = lambda i, side, edge, none: edge([float(b[side]) for b in bands[i] if b[0] <= b[1]], default=none)
    for some in _groups(len(pair.a.ids)):
        needed = _below(np.array([ends(i, 0, min, np.inf) for i in some]))
        most = -_below(-np.array([ends(i, 1, max, -np.inf) for i in some]))
        open_ = (pair.c.ids[None, :] != pair.a.ids[some][:, None]) & (pair.c.labels[None, :] != pair.a.labels[some][:, None])
        for i, at, scores in pair.survivors(some, open_, needed, most):
            for b, (low, high) in enumerate(bands[i]):
                inside = np.flatnonzero((scores >= low) & (scores <= high))
                for p in inside[first_of(scores[inside], pair.c.ids[at[inside]], n)]:
                    yield i, b, int(scores[p]), int(at[p])


def band(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """The least and greatest integer s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def _positives(k: int):
    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        found = []
        if anchors.num_rows and candidates.num_rows:
            pair, rows = Pair(Block(anchors), Block(candidates)), anchors["row"].to_pylist()
            found = [(rows[i], int(pair.c.ids[p]), score) for i, score, p in best_rows(pair, k)]
        return _table(found, ["row", "positive_id", "positive_score"])

    return run


def _negatives(n: int, low: int, high: int):
    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        found = []
        if anchors.num_rows and candidates.num_rows:
            pair, rows = Pair(Block(anchors), Block(candidates)), anchors["row"].to_pylist()
            bands = [[band(s, low, high) for s in scores] for scores in anchors["scores"].to_pylist()]
            found = [(rows[i], place, int(pair.c.ids[p]), score) for i, place, score, p in best_in_bands(pair, bands, n)]
        return _table(found, ["row", "place", "negative_id", "negative_score"])

    return run


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    return pa.table({name: pa.array([r[j] for r in rows], pa.int64()) for j, name in enumerate(names)})


def _cells(anchors: DataFrame, candidates: DataFrame, sizes: DataFrame, on: list[str], solve, schema: str) -> DataFrame:
    """Anchors and candidates that agree in ``on`` meet in cells of about ``ANCHORS`` x ``CANDIDATES``
    rows. ``sizes``: on, n (candidates), q (anchors)."""
    blocks = sizes.select(*on, F.ceil(F.col("n") / CANDIDATES).cast("int").alias("cbs"), F.greatest(F.lit(1), F.ceil(F.col("q") / ANCHORS).cast("int")).alias("qbs"))
    # a hot group meets its row of sizes in many tasks
    salts = 32
    blocks = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    place = lambda df: df.withColumn("salt", F.pmod(F.col("row"), F.lit(salts)).cast("int")).join(blocks, [*on, "salt"]).drop("salt")
    deal = lambda side, of: F.pmod(F.xxhash64("row", F.lit(side)), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = place(anchors).withColumn("qb", deal("q", "qbs")).withColumn("cb", every("cbs")).drop("cbs", "qbs")
    again = candidates.select(*[F.col(c).alias(c) for c in candidates.columns])  # columns of its own beside the anchors'
    right = place(again).withColumn("cb", deal("c", "cbs")).withColumn("qb", every("qbs")).drop("cbs", "qbs")
    keys = [*on, "qb", "cb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(solve, schema)


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, *, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH, scratch: Scratch | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row where
    ``is_anchor`` (on ``vec_id``) holds and each of its ``positives`` best rows of the same label, the best ``negatives``
    rows of other labels whose score is ``low`` to ``high`` percent of the positive's. ``label``: an expression over the
    table's columns, the column itself by default."""
    scratch = scratch or Scratch(vectors.sparkSession, "negatives")
    rows = scratch("rows", summarised(vectors, F.col("label") if label is None else label))
    sizes = lambda *on: rows.groupBy(*on).agg(F.count("*").alias("n"), F.count(F.when(is_anchor, 1)).alias("q"))
    order = lambda score, other: [F.col(score).desc(), F.col(other)]
    anchors = rows.where(is_anchor)
    near = _cells(anchors, rows, sizes("dims", "label"), ["dims", "label"], _positives(positives), "row long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("row").orderBy(*order("positive_score", "positive_id")))
    near = scratch("positives", near.withColumn("place", place - 1).where(F.col("place") < positives))
    # an anchor's positive scores, by place: at most ``positives`` of them
    scores = near.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda s: s["positive_score"]).alias("scores"))
    far = _cells(anchors.join(scores, "row"), rows, sizes("dims"), ["dims"], _negatives(negatives, low, high), "row long, place long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("row", "place").orderBy(*order("negative_score", "negative_id")))
    far = far.withColumn("rank", rank).where(F.col("rank") <= negatives)
    named = near.join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return far.join(named, ["row", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
