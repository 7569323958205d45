"""Exact top-k search: columnar branch and bound over integer vectors.

Components become floor(256 x). Queries and candidates meet in cells of bounded size. In a cell the
candidates lie in vertical layout, dimension blocks one after the other; a query adds up its inner
products block by block and, after each block, drops the candidates whose partial sum plus what the
remaining dimensions can add at most (norms of the rest, Cauchy-Schwarz) stays below the k-th best
score already proven, counted over distinct ids. Survivors are compacted before the next block, and
their sums are exact integers at the end.

At scale: rows are dealt to cells by a hash of id and vector, ``CANDIDATES`` x ``QUERIES`` rows each
at most in expectation, so a task's memory is bounded whatever the input, also where one id holds
very many vectors; every cell passes on k ids a query row.

Cases: vectors that are null, or hold a null or non-finite component, and rows without an id take no
part; vectors only meet those of their own length; an empty vector scores 0; rows that repeat an
id exactly count once, different vectors under one id are all candidates and all ask for it (a
partner counts once, with its best score); a query never finds its own id; fewer than k partners
→ all of them; ties go to the smaller id; scores beyond a long are clipped to it. Empty table →
empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP = 5
CANDIDATES = 8192
QUERIES = 2048
BLOCK = 16


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and the integer vector ``v`` of each row that takes part, once."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(sound, F.lit(False)))
            .select(F.col("vec_id").cast("long"), F.transform(x, lambda c: F.floor(c * 256.0).cast("long")).alias("v")).distinct())


def best_in_cell(query: np.ndarray, ids: np.ndarray, columns: np.ndarray, own: int, k: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The k best ids for one query (all, if there are fewer), each once with its best score.
    ``columns``: dimensions x rows. The arithmetic is exact: doubles below 2^53, else integers."""
    dims, n = columns.shape
    alive = np.flatnonzero(ids != own)
    k = min(k, len(alive))
    if not k:
        return ids[:0], np.zeros(0, dtype=np.int64)
    cuts = [*range(0, dims, block), dims] if dims else [0]
    rest_q = [float(np.sqrt((query[c:].astype(float) ** 2).sum())) for c in cuts]
    partial = np.zeros(len(alive), dtype=columns.dtype)
    floor = None
    for b in range(len(cuts) - 1):
        partial = partial + query[cuts[b]:cuts[b + 1]] @ columns[cuts[b]:cuts[b + 1]][:, alive]
        if b == len(cuts) - 2 or len(alive) <= k:
            continue
        # the remaining mass of each candidate; a hair wider, for rounding
        rest = _rest(columns, cuts[b + 1])[alive]
        bound = partial.astype(float) + rest * rest_q[b + 1] * (1 + 1e-9) + 1e-6
        if floor is None:  # the most promising candidate of each of k ids, scored in full, prove a floor
            seeds = alive[_promising(ids[alive], bound, k)]
            floor = min((query @ columns[:, seeds]).tolist())
        keep = bound >= float(floor)
        alive, partial = alive[keep], partial[keep]
    order = np.lexsort((ids[alive], -partial if partial.dtype != object else [-p for p in partial]))
    order = _first_of_ids(ids[alive], order, k)
    return ids[alive[order]], partial[order]


def _promising(ids: np.ndarray, bound: np.ndarray, k: int) -> np.ndarray:
    """Positions of the highest bound of each of the first ``k`` ids (of all, if there are fewer)."""
    n, m = len(bound), min(len(bound), 4 * k)
    while True:
        top = np.argpartition(-bound, m - 1)[:m]
        got = _first_of_ids(ids, top[np.argsort(-bound[top])], k)
        if len(got) == k or m == n:
            return got
        m = min(n, 16 * m)


def _first_of_ids(ids: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """The positions in ``order`` at which an id comes for the first time, up to ``k`` of them."""
    m = min(len(order), 4 * k)
    while True:
        at = np.sort(np.unique(ids[order[:m]], return_index=True)[1])[:k]
        if len(at) == k or m == len(order):
            return order[at]
        m = min(len(order), 16 * m)


_RESTS: dict = {}


def _rest(columns: np.ndarray, start: int) -> np.ndarray:
    """Norm of each candidate's dimensions from ``start`` on (kept for the cell at hand)."""
    if _RESTS.get("of") is not columns:
        _RESTS.clear()
        _RESTS["of"] = columns
    if start not in _RESTS:
        _RESTS[start] = np.sqrt((columns[start:].astype(float) ** 2).sum(axis=0))
    return _RESTS[start]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows x dimensions of a list column whose lists have one length."""
    column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _solve(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if queries.num_rows and candidates.num_rows:
            q, c = _matrix(queries["v"]), _matrix(candidates["v"])
            q_ids, c_ids = queries["vec_id"].to_numpy(), candidates["vec_id"].to_numpy()
            peak = max(1, q.shape[1]) * (float(np.abs(q.astype(float)).max(initial=0)) + 1) * (float(np.abs(c.astype(float)).max(initial=0)) + 1)
            kind = np.float64 if peak < 2 ** 52 else np.int64 if peak < 2 ** 62 else object
            columns = np.ascontiguousarray(c.astype(kind).T)
            for own, row in zip(q_ids.tolist(), q.astype(kind)):
                ids, scores = best_in_cell(row, c_ids, columns, own, k)
                out["query_id"] += [own] * len(ids)
                out["vec_id"] += ids.tolist()
                out["score"] += [max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in scores.tolist()]
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best partners of each row where ``is_query`` (on
    ``vec_id``) holds, among all rows."""
    rows = quantised(vectors).withColumn("dims", F.size("v"))
    size = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    c_blocks, q_blocks = max(1, -(-size["n"] // CANDIDATES)), max(1, -(-size["q"] // QUERIES))
    c_block, q_block = (F.pmod(F.xxhash64("vec_id", "v", F.lit(side)), F.lit(n)) for side, n in (("c", c_blocks), ("q", q_blocks)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    queries = rows.where(is_query).select("vec_id", "v", "dims", q_block.alias("qb"), every(c_blocks).alias("cb"))
    candidates = rows.select("vec_id", "v", "dims", c_block.alias("cb"), every(q_blocks).alias("qb"))
    cells = queries.groupBy("dims", "qb", "cb").cogroup(candidates.groupBy("dims", "qb", "cb")).applyInArrow(_solve(k), "query_id long, vec_id long, score long")
    best = cells.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id")))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
