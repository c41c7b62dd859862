"""Comparing the members of groups in blocks of bounded size."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY, SIZE, SIDE, DIAGONAL = "_tile", "_size", "_side", "_diagonal"


def tiled(members: DataFrame, group: Column, identity: Column, tile: int) -> DataFrame:
    """Rows of `members` (with SIZE, the number of rows in their group) dealt to tiles.

    A group of up to `tile` rows is one tile. A larger one is cut into chunks by a hash of
    `identity`, and each pair of chunks is a tile, so every pair of rows meets exactly once:
    in the tile of their chunk, or in that of their two chunks. SIDE is the row's chunk.
    """
    chunks = F.ceil(F.col(SIZE) / tile).cast("int")
    cut = members.withColumn(SIDE, F.pmod(F.xxhash64(identity, F.lit(7)), chunks).cast("int"))
    others = F.transform(
        F.sequence(F.lit(0), chunks - 1),
        lambda x: F.struct(
            F.least(x, F.col(SIDE)).alias("low"), F.greatest(x, F.col(SIDE)).alias("high")
        ),
    )
    dealt = cut.withColumn("_pair", F.explode(others))
    return dealt.withColumns(
        {
            KEY: F.xxhash64(group, "_pair.low", "_pair.high"),
            DIAGONAL: F.col("_pair.low") == F.col("_pair.high"),
        }
    ).drop("_pair")


def by_tile(rows: DataFrame) -> DataFrame:
    """One shuffle that brings a tile's rows together, next to each other."""
    return rows.repartition(KEY).sortWithinPartitions(KEY)


def whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches, cut anew so that no tile is split."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(KEY).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1]))
        if rest and last == 0 and rest[-1].column(KEY)[-1].as_py() == keys[0]:
            rest.append(batch)
            continue
        yield pa.Table.from_batches([*rest, batch.slice(0, last)])
        rest = [batch.slice(last)]
    if rest:
        yield pa.Table.from_batches(rest)


def pairs(table: pa.Table, block: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j, of all pairs of rows that meet in a tile, in bounded blocks."""
    keys = table.column(KEY).to_numpy()
    if not len(keys):
        return
    side = table.column(SIDE).to_numpy()
    diagonal = table.column(DIAGONAL).to_numpy()
    ends = np.append(np.flatnonzero(np.diff(keys)) + 1, len(keys))
    after = np.repeat(ends, np.diff(np.append(0, ends))) - np.arange(len(keys)) - 1
    total = np.cumsum(after)
    start = 0
    while start < len(keys):
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + block, "right")))
        count = after[start:stop]
        i = np.repeat(np.arange(start, stop), count)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        meets = diagonal[i] | (side[i] != side[j])
        yield i[meets], j[meets]
        start = stop
