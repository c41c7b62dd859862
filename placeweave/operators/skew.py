"""Joins that stay even when one key holds a large share of the rows."""

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot from this many rows on; about one shuffle partition of narrow rows. Its rows are
# split into parts of about so many.
HOT_ROWS = 1_000_000

# A count may be a product that no table can hold.
MOST_PARTS = 1 << 30

# Hash of a hot key -> number of parts. There is one for each HOT_ROWS rows of a table at most.
Hot = dict[int, int]

_HASH, _SALT, _PARTS = "_hash", "_salt", "_parts"


def key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*keys)


def hot_from_counts(counts: DataFrame, keys: list[str], count: str, hot_rows: int) -> Hot:
    """The hot keys of a table that has the row count per key.

    A hash shared by two keys only means that both are split.
    """
    parts = F.ceil(F.least(F.col(count) / hot_rows, F.lit(MOST_PARTS))).cast("int").alias(_PARTS)
    hot = counts.filter(F.col(count) >= hot_rows).select(key_hash(keys).alias(_HASH), parts)
    found: Hot = {}
    for row in hot.collect():
        found[row[_HASH]] = max(2, row[_PARTS], found.get(row[_HASH], 0))
    return found


def hot_from_rows(
    rows: DataFrame, keys: list[str], hot_rows: int, at_most: float = math.inf
) -> Hot:
    """As `hot_from_counts`, counting `rows`; not needed if there are `at_most` too few rows."""
    if at_most < hot_rows:
        return {}
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return hot_from_counts(counts, keys, "_n", hot_rows)


def salted_join(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    hot: Hot,
    how: str = "inner",
    null_safe: bool = False,
) -> DataFrame:
    """Join `rows`, where keys may be hot, with `table`; the key columns come out once.

    Rows of a hot key are spread over its parts by a hash of the whole row, which is the same on
    every attempt of a task, and the table's rows for that key are copied to each part.
    """
    payload = [c for c in table.columns if c not in keys]
    columns = rows.columns
    on = list(keys)
    if hot:
        # A number per hot key and no text, so Spark sends it along until it gets too large.
        split = rows.sparkSession.createDataFrame(list(hot.items()), f"{_HASH} long, {_PARTS} int")
        rows = _with_parts(rows, split, keys)
        part = F.pmod(F.xxhash64(*columns), F.col(_PARTS)).cast("int")
        rows = rows.withColumn(_SALT, F.coalesce(part, F.lit(0))).drop(_PARTS)
        table = _with_parts(table, split, keys)
        parts = F.sequence(F.lit(0), F.coalesce(_PARTS, F.lit(1)) - 1)
        table = table.withColumn(_SALT, F.explode(parts)).drop(_PARTS)
        on.append(_SALT)
    left, right = rows.alias("l"), table.alias("r")

    def equal(key: str) -> Column:
        a, b = F.col(f"l.`{key}`"), F.col(f"r.`{key}`")
        return a.eqNullSafe(b) if null_safe else a == b

    joined = left.join(right, reduce(Column.__and__, map(equal, on)), how)
    return joined.select(
        *[F.col(f"l.`{c}`") for c in columns], *[F.col(f"r.`{c}`") for c in payload]
    )


def _with_parts(rows: DataFrame, split: DataFrame, keys: list[str]) -> DataFrame:
    return rows.withColumn(_HASH, key_hash(keys)).join(split, _HASH, "left").drop(_HASH)
