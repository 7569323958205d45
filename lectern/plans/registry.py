"""Query registry: name → (spark query, oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lectern.plans.normalize import normalize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` (normalised) and its DuckDB SQL."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return normalize(fn(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return deco


@dataclass
class Ctx:
    files: DataFrame
    h: "object"
    log: Callable[[], DataFrame]
    stored: "object" = None

    @property
    def commits(self) -> DataFrame:
        """The stored commit log (written when first read)."""
        return self.log()


_CTX: dict[tuple[int, str], Ctx] = {}


def ctx(spark: SparkSession, sf_dir: str) -> Ctx:
    """The stored stand-in catalogue of ``sf_dir`` and its hierarchy (plans only, no caching)."""
    from lectern.operators.hierarchy import build_hierarchy
    from lectern.sources import catalogue
    key = (id(spark), sf_dir)
    if key not in _CTX:
        files = catalogue.stored_files(spark, sf_dir)
        _CTX[key] = Ctx(files=files, h=build_hierarchy(files), log=lambda: catalogue.stored_commits(spark, sf_dir))
    return _CTX[key]


def stored_ctx(spark: SparkSession, sf_dir: str) -> Ctx:
    """Like ``ctx`` but the hierarchy's level tables are written once per session to the
    checkpoint folder (the stage a load job persists) and read back, each when it is first read."""
    import hashlib
    import os

    from lectern.operators.hierarchy import store_hierarchy
    from lectern.session import run_dir
    c = ctx(spark, sf_dir)
    if c.stored is None:
        tag = hashlib.sha1(os.path.abspath(sf_dir).encode()).hexdigest()[:12]
        base = f"{run_dir(spark)}/lectern-hierarchy/{tag}"
        c.stored = store_hierarchy(c.h, base, spark)
    return Ctx(files=c.files, h=c.stored, log=c.log)


_STAGERS: dict = {}


def stager(spark: SparkSession, sf_dir: str, job: str):
    """A write-once stage folder per (session, input, job) below the checkpoint folder."""
    import hashlib
    import os

    from lectern.plans.stage import Stager
    from lectern.session import run_dir
    key = (id(spark), sf_dir, job)
    if key not in _STAGERS:
        tag = hashlib.sha1(os.path.abspath(sf_dir).encode()).hexdigest()[:12]
        _STAGERS[key] = Stager(spark, f"{run_dir(spark)}/lectern-stage/{tag}/{job}")
    return _STAGERS[key]
