"""PRJ-17: deterministic ids for nodes whose index file has no ``url_name``.

The reference draws a random 12-letter id and writes it back to the index file so it
stays stable. Here the id is derived from the node's key (course id + folder path), so
re-running gives the same id on every executor and after any retry; the ids that were
derived are also returned as a write-back table by the hierarchy job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of the digest that make an id: 128 bits, so that ids of different nodes stay apart.
ID_LENGTH = 32


def derived_id(*key_cols) -> Column:
    """32 lower-case letters (128 bits) from the SHA-256 of the joined key (digits mapped to g..p)."""
    key = F.concat_ws("/", *[F.col(c) if isinstance(c, str) else c for c in key_cols])
    return F.translate(F.substring(F.sha2(key, 256), 1, ID_LENGTH), "0123456789", "ghijklmnop")


def keyed(df: DataFrame, keys: list[str], name: str = "_key") -> DataFrame:
    """``df`` with a hash of its key columns. Put first among the keys of a large join or grouping
    (``[name, *keys]``), it changes no result: rows are sorted by a number, and the texts of the keys are
    compared only where the numbers agree."""
    return df.withColumn(name, F.xxhash64(*keys))


def join_keyed(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left.join(right, keys, how)`` with a hash of the keys in front (``keyed``)."""
    return keyed(left, keys).join(keyed(right, keys), ["_key", *keys], how).drop("_key")
