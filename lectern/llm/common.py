"""Helpers shared by the operators: scratch tables, vectorised word scanning and Arrow plumbing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lectern.session import run_dir

#: Fixed value: the white space that separates words (``[\x20\x09-\x0D]``).
WHITE = b" \t\n\x0b\x0c\r"

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(WHITE)] = True

_MASK = (1 << 64) - 1
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


class Scratch:
    """Write-once tables below the shared checkpoint folder.

    Writing and rereading cuts the lineage on shared storage, so that Python stages run once
    and a lost executor costs at most the tasks it ran."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.base = f"{run_dir(spark)}/llm/{tag}-{uuid.uuid4().hex}"

    def __call__(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def own_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def texts_of(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of each row of an Arrow string column (null: None)."""
    return column.cast(pa.large_binary()).to_pylist()


def in_parts(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch a few rows at a time, so that only those are held as Python objects."""
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, extended as needed."""

    def __init__(self, base: int):
        self.base = base
        self.inverse = pow(base, -1, 1 << 64)
        self._up = np.ones(1, dtype=np.uint64)
        self._down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self._up) < n:
            have = len(self._up)
            for name, step in (("_up", self.base), ("_down", self.inverse)):
                now = getattr(self, name)
                setattr(self, name, np.concatenate([now, now * np.uint64(pow(step, have, 1 << 64))]))
        return self._up[:n], self._down[:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads each input bit over the whole word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class WordScanner:
    """Finds the words of a byte string and hashes each one, without a Python loop over words.

    A word's hash is a polynomial over its bytes modulo 2^64 (prefix sums, so every word costs
    one subtraction), then mixed. ``lane`` 0 and 1 are independent hashes."""

    def __init__(self):
        self.powers = (Powers(_BASES[0]), Powers(_BASES[1]))

    def spans(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start and end offset (bytes) of each word."""
        if not text:
            empty = np.zeros(0, dtype=np.int64)
            return empty, empty
        inside = np.zeros(len(text) + 2, dtype=np.int8)
        inside[1:-1] = ~_IS_SPACE[np.frombuffer(text, dtype=np.uint8)]
        edge = np.diff(inside)
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    def hashes(self, text: bytes, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
        if len(starts) == 0:
            return np.zeros(0, dtype=np.uint64)
        up, down = self.powers[lane].upto(len(text) + 1)
        sums = np.zeros(len(text) + 1, dtype=np.uint64)
        np.cumsum((np.frombuffer(text, dtype=np.uint8).astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * down[starts])

    def windows(self, words: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
        """The hash of each run of ``size`` consecutive words (by their hashes)."""
        n = len(words) - size + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        up, down = self.powers[lane].upto(len(words) + 1)
        sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * up[:-1], out=sums[1:])
        return mix64((sums[size:] - sums[:n]) * down[:n])


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Mask over ``n`` positions: those inside a run of ``size`` that begins at one of ``starts``."""
    marks = np.zeros(n + 1, dtype=np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + size, n), -1)
    return np.cumsum(marks[:-1]) > 0
