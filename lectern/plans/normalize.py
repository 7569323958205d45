"""Result normalisation shared by the registered queries.

Query results are compared with DuckDB; to keep both sides in one type vocabulary every
integral column is BIGINT, every timestamp is rendered ``yyyy-MM-dd HH:mm:ss`` (UTC), and
doubles are rounded to 6 decimals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalize(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double"), 6)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def ts_sql(expr: str) -> str:
    """The DuckDB side of the timestamp rendering."""
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"
