"""Shards of near-equal bytes by a histogram sort.

Rows are ordered by a key. The exact bytes and rows below candidate boundaries are counted over
all partitions; boundaries are refined where a splitter is not yet near enough, or where a cell
between two boundaries is too large for a task, until all is within tolerance. Then each row is
exchanged once, to its cell, and the counts say where in its shard the cell starts.
"""

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeweave.staging import Stage

# Cells for each shard at least, and bytes of text that a cell should hold at most.
CELLS_PER_SHARD = 128
CELL_BYTES = 64 << 20
# A splitter may miss its place by this share of a shard.
TOLERANCE = 0.002
# New boundaries inside a cell that is refined: many while few cells are.
FEW, MANY = 16, 256
ROUNDS = 24

# The order: equal texts together, then a hash of doc_id, so that copies can be parted too.
TEXT_BITS, ROW_BITS = 40, 24


class Cells(NamedTuple):
    """Cell i holds the keys below edge i, and not below edge i - 1; a last cell holds the rest."""

    edges: np.ndarray
    rows: np.ndarray
    size: np.ndarray

    def of(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, keys, "right")


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text, none for null, plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def order_key(text: Column, doc_id: Column) -> Column:
    high = F.shiftleft(F.shiftright(F.xxhash64(text), ROW_BITS), ROW_BITS)
    return high.bitwiseOR(F.pmod(F.xxhash64(doc_id), F.lit(1 << ROW_BITS)))


def shard(docs: DataFrame, stage: Stage, shards: int) -> DataFrame:
    """`docs` with `shard` (from 0) and `slot` (gapless from 0 in a shard, in the order of keys).

    The bytes of the shards differ by the tolerance and the size of a row. Rows of equal text go
    to one shard unless a splitter has no other place within the tolerance. Rows that are equal
    in text and doc_id cannot be parted; null texts and doc_ids are ordinary values. Other columns
    stay, but for those that have the name of a result.
    """
    docs = docs.drop("shard", "slot")
    key = order_key(F.col("text"), F.col("doc_id"))
    measured = stage.keep(docs.select(key.alias("key"), text_bytes(F.col("text")).alias("size")), "keys")
    cells, splitters = find_splitters(measured, shards)
    first_edge = np.append(np.iinfo(np.int64).min, cells.edges)
    shard_of = np.searchsorted(cells.edges[splitters], first_edge, "right").astype(np.int32)
    below = np.cumsum(cells.rows) - cells.rows
    base = below - below[np.searchsorted(shard_of, shard_of)]

    @F.pandas_udf("cell int, shard int, base long")
    def locate(keys: pd.Series) -> pd.DataFrame:
        cell = cells.of(keys.to_numpy())
        return pd.DataFrame({"cell": cell, "shard": shard_of[cell], "base": base[cell]})

    placed = docs.withColumn("_key", key).withColumn("_place", locate("_key"))
    in_cell = Window.partitionBy("_place.cell").orderBy("_key", "doc_id")
    slot = F.col("_place.base") + F.row_number().over(in_cell) - 1
    placed = placed.withColumns({"shard": F.col("_place.shard"), "slot": slot})
    return placed.drop("_key", "_place")


def find_splitters(measured: DataFrame, shards: int) -> tuple[Cells, np.ndarray]:
    """Cells of the rows (key, size), and which of their edges part the shards."""
    total = measured.agg(F.sum("size")).first()[0] or 0
    number = max(CELLS_PER_SHARD * shards, -(-total // CELL_BYTES))
    step = max(1, (1 << TEXT_BITS) // number) << ROW_BITS
    edges = np.arange(number - 1, dtype=np.int64) * step + (step - (1 << 63))
    targets = [total * k // shards for k in range(1, shards)]
    for _ in range(ROUNDS):
        cells = _histogram(measured, edges)
        below = np.cumsum(cells.size)[:-1]
        splitters = [_nearest(below, edges, t, TOLERANCE * total / shards) for t in targets]
        missed = [
            int(np.searchsorted(below, t, "right"))
            for t, s in zip(targets, splitters)
            if abs(int(below[s]) - t) > TOLERANCE * total / shards
        ]
        large = np.flatnonzero(cells.size > 4 * max(1, total // number)).tolist()
        refined = _refined(edges, {k for k in missed + large if cells.rows[k] > 1})
        if len(refined) == len(edges):
            break
        edges = refined
    return cells, np.array(sorted(splitters), np.int64)


def _histogram(measured: DataFrame, edges: np.ndarray) -> Cells:
    """A row for each cell comes to the driver: as many as there are boundaries."""

    @F.pandas_udf("int")
    def cell(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, keys.to_numpy(), "right"))

    counted = measured.groupBy(cell("key").alias("cell")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("size").alias("size")
    )
    rows, size = np.zeros((2, len(edges) + 1), np.int64)
    for found in counted.collect():
        rows[found["cell"]], size[found["cell"]] = found["rows"], found["size"]
    return Cells(edges, rows, size)


def _nearest(below: np.ndarray, edges: np.ndarray, target: int, most: float) -> int:
    """The edge nearest to the target; if any is near enough, one that parts no equal texts."""
    gap = np.abs(below - target)
    whole = (edges & ((1 << ROW_BITS) - 1)) == 0
    good = whole & (gap <= most)
    return int(np.argmin(np.where(good, gap, np.iinfo(np.int64).max) if good.any() else gap))


def _refined(edges: np.ndarray, cells: set[int]) -> np.ndarray:
    """The edges with new ones inside the given cells, on multiples of a power of two."""
    parts = MANY if len(cells) <= FEW else FEW
    new = [edges]
    for cell in cells:
        low = int(edges[cell - 1]) if cell else -(1 << 63)
        high = int(edges[cell]) if cell < len(edges) else 1 << 63
        step = 1 << max(0, (max(1, (high - low) // parts) - 1).bit_length())
        first = (low // step + 1) * step
        new.append(np.array(range(first, high, step), np.int64))
    return np.unique(np.concatenate(new))
