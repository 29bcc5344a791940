"""Column builders whose NULL and type rules the engine fixes once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: str | Column) -> Column:
    return F.nullif(col(c), F.lit(""))


def with_fallback(c: str | Column, other: str | Column) -> Column:
    """The column, or the other where it is NULL or blank."""
    return F.coalesce(blank_to_null(c), col(other))


def key_sum(m: str | Column, part: str) -> Column:
    """Sum of a map's values whose lower-cased key contains ``part``; NULL for a NULL map, 0 if no key does."""
    m = col(m)
    chosen = F.map_values(F.map_filter(m, lambda k, v: F.lower(k).contains(part)))
    return F.aggregate(F.transform(chosen, lambda v: v.cast("decimal(38, 8)")), F.lit(0).cast("decimal(38, 8)"), lambda a, v: (a + v).cast("decimal(38, 8)"))


def millis(start: str, end: str) -> Column:
    """Elapsed milliseconds; NULL if either end is."""
    return F.timestamp_diff("MILLISECOND", col(start), col(end))


def seconds(start: str, end: str) -> Column:
    return F.timestamp_diff("SECOND", col(start), col(end))


def ratio(a: Column, b: Column) -> Column:
    """Division that is NULL where the divisor is 0."""
    return F.try_divide(a, b)


def latest_non_empty(c: str, *order: str) -> Column:
    """The value of the last row, by ``order``, that has one: max_by alone would return NULL if the last row has none."""
    value = F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col(c))
    return F.max(F.when(value.isNotNull(), F.struct(*order, value.alias("value"))))["value"]


def array_size(c: str | Column) -> Column:
    """Elements of an array or map; 0 for NULL."""
    return F.coalesce(F.size(col(c)), F.lit(0))


def lookup(names: Column, values: Column, key: str) -> Column:
    """An entry of parallel arrays; NULL if the name is missing."""
    return F.try_element_at(values, F.nullif(F.array_position(names, key).cast("int"), F.lit(0)))


def path(c: str, *keys: str, kind: str = "string") -> Column:
    """A dotted path into JSON text; NULL where the text is no JSON or lacks the path."""
    return F.try_variant_get(F.try_parse_json(col(c)), "$" + "".join(f".{k}" for k in keys), kind)


def hash_share(c: str | Column) -> Column:
    """A number in [0, 1] that is the same wherever it is computed: the first 32 bits of the SHA-256 digest."""
    return F.conv(F.substring(F.sha2(col(c).cast("binary"), 256), 1, 8), 16, 10).cast("double") / F.lit(float(0xFFFFFFFF))


def sampled(c: str | Column, rate: float) -> Column:
    return hash_share(c) < F.lit(float(rate))


#: Levels by severity.
LEVELS = ("DEBUG", "DEFAULT", "WARNING", "ERROR")


def severity(c: str | Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), col(c)).cast("int")


def level_of(rank: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, LEVELS)), F.nullif(rank, F.lit(0)))
