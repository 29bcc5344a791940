"""Where named queries are registered, and how their results are brought to plain types."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Added before rounding, so that values half-way between two roundings, which engines compute a little to either side, go the same way.
NUDGE = 1e-9
QUERIES: dict = {}
ORACLES: dict = {}


def r4(x: str) -> str:
    """The same in SQL."""
    return f"(round(({x})::DOUBLE + {NUDGE}::DOUBLE, 4) + 0.0::DOUBLE)"


def tidy(df: DataFrame) -> DataFrame:
    """Decimals and doubles as doubles of 4 places, whole numbers as bigint; arrays and times as they are."""
    def plain(c: str, kind: str):
        name = F.col(f"`{c}`")
        if kind.startswith("decimal") or kind in ("double", "float"):
            return (F.round(name.cast("double") + NUDGE, 4) + F.lit(0.0)).alias(c)
        return name.cast("bigint").alias(c) if kind in ("int", "smallint", "tinyint") else name

    return df.select(*(plain(c, kind) for c, kind in df.dtypes))


def query(name: str, sql: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame and its SQL."""
    def put(f):
        @functools.wraps(f)
        def run(spark, sf_dir):
            return tidy(f(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return put
