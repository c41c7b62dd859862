"""Best-fit packing of token pieces into sequences, certified by lower bounds.

Each partition packs its pieces best-fit decreasing and bounds its number of sequences from below
by dual feasible functions. Where they differ, the pieces of its least filled quarter are packed again
in other orders, until a round gains nothing. Where both numbers agree the partition is done, but for its least filled
sequence, as the sum of the bounds is more than the bound of all. Where they do not, its
well-filled sequences stay, and the pieces of the least filled quarter are exchanged among fewer
partitions and packed again, until a round in one partition, or one that brings nothing. Only
piece numbers and lengths travel.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.llm.rows import slices
from placeweave.llm.tokens import encoder
from placeweave.staging import Stage

# Pieces that one task packs; 16 bytes each.
PIECES_PER_TASK = 200_000
# Exchanges at most. What they leave above the bound is packed as well, only not `certified`.
ROUNDS = 8
# Other orders that a round of one partition tries.
ORDERS = 8

_PIECES = "doc_id long, piece int, start long, length long, ids binary"


class Packed(NamedTuple):
    """`pieces`: row, doc_id, piece, start, length, ids (little-endian unsigned 32-bit numbers).
    `places`: row, sequence_id, offset. `certified`: whether no packing has fewer sequences, as far
    as the lower bound tells."""

    pieces: DataFrame
    places: DataFrame
    certified: bool


def pack_documents(
    docs: DataFrame, stage: Stage, tokenizer: str, capacity: int = 4096, end_id: int = 1
) -> Packed:
    """Pack `docs` (doc_id, text) into sequences of at most `capacity` tokens.

    A document is its ids and then `end_id`; a null or empty text is the end id alone. Only a
    document of more than `capacity` ids is cut. Rows are packed one by one: rows that repeat a
    doc_id, or have none, are documents of their own. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            found = []
            texts = encode.column(batch.column("text"))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), texts):
                ids += end
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    found.append((doc_id, piece, start // 4, len(part) // 4, part))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            columns = zip(*found) if found else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(columns, kinds)],
                ["doc_id", "piece", "start", "length", "ids"],
            )

    pieces = rows.mapInArrow(cut, _PIECES).withColumn("row", F.monotonically_increasing_id())
    path = stage.path("pieces")
    pieces.write.option("compression", "zstd").parquet(path)
    pieces = stage.spark.read.schema(pieces.schema).parquet(path)
    places = pack(pieces.select("row", "length"), stage, capacity)
    return Packed(pieces, places, is_certified(pieces, places, capacity))


def is_certified(pieces: DataFrame, places: DataFrame, capacity: int) -> bool:
    """Whether `places` has as few sequences as the lower bound of all `pieces`."""
    number = np.zeros(capacity + 1, np.int64)
    for length, count in pieces.groupBy("length").count().collect():
        number[length] = count
    return places.filter("offset = 0").count() == bound_of_counts(number)


def pack(pieces: DataFrame, stage: Stage, capacity: int) -> DataFrame:
    """Places (row, sequence_id, offset) for pieces (row, length); 0 < length <= capacity."""
    done: list[DataFrame] = []
    loose = pieces
    count = pieces.count()
    before = None
    for turn in range(ROUNDS):
        parts = max(1, -(-count // PIECES_PER_TASK))
        packed = stage.keep(_packed(loose, parts, turn, capacity), "packed")
        open_bins = packed.filter("NOT settled")
        count, bins = open_bins.agg(F.count(F.lit(1)), F.count_distinct("sequence_id")).first()
        settled = packed.filter("settled")
        new_bins = settled.filter("offset = 0").count()
        if before is not None and bins + new_bins > before[1]:
            return _places([*done, before[0]])
        done.append(settled)
        gained = before is None or bins + new_bins < before[1]
        before = open_bins, bins
        if not count or parts == 1 or not gained:
            break
        loose = open_bins.select("row", "length")
    return _places([*done, before[0]])


def _places(parts: list[DataFrame]) -> DataFrame:
    first, *rest = (p.select("row", "sequence_id", "offset") for p in parts)
    for part in rest:
        first = first.union(part)
    return first


def _packed(pieces: DataFrame, parts: int, turn: int, capacity: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = [batch for batch in batches if batch.num_rows]
        if not filled:
            return
        table = pa.Table.from_batches(filled)
        rows, lengths = (table.column(c).to_numpy() for c in ("row", "length"))
        order = np.lexsort((rows, -lengths))
        rows, lengths = rows[order], lengths[order]
        bins, offsets, used = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        bins, offsets, used = repacked(lengths, bins, offsets, used, capacity, bound)
        certified = len(used) == bound
        least_filled = np.argsort(used, kind="stable")
        settled = np.ones(len(used), bool)
        settled[least_filled[: 1 if certified else -(-len(used) // 4)]] = False
        settled |= used == capacity
        first = (turn << 56) + (TaskContext.get().partitionId() << 32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (rows, lengths, bins + first, offsets, settled[bins])],
            ["row", "length", "sequence_id", "offset", "settled"],
        )

    dealt = pieces.repartition(parts, F.xxhash64("row", F.lit(turn)))
    return dealt.mapInArrow(
        run, "row long, length long, sequence_id long, offset long, settled boolean"
    )


def best_fit_decreasing(
    lengths: np.ndarray, capacity: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin and offset of each of the `lengths`, in their order, and what each bin holds."""
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin has room r
    used: list[int] = []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, length in enumerate(lengths.tolist()):
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            chosen = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms ^= 1 << room
        else:
            room, chosen = capacity, len(used)
            used.append(0)
        bins[k], offsets[k] = chosen, used[chosen]
        used[chosen] += length
        left = room - length
        if left:
            open_by_room[left].append(chosen)
            rooms |= 1 << left
    return bins, offsets, np.array(used, np.int64)


def repacked(
    lengths: np.ndarray,
    bins: np.ndarray,
    offsets: np.ndarray,
    used: np.ndarray,
    capacity: int,
    bound: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The packing after rounds that pack the least filled quarter of the bins, and some that are
    drawn, best-fit in other orders; the last one reaches the bound or gains nothing."""
    draw = np.random.default_rng(len(lengths))
    gained = True
    while gained and len(used) > bound:
        gained = False
        for _ in range(ORDERS):
            again = draw.random(len(used)) < 0.1
            again[np.argsort(used, kind="stable")[: -(-len(used) // 4)]] = True
            again &= used < capacity
            loose = np.flatnonzero(again[bins])
            loose = loose[np.argsort(-lengths[loose] * draw.uniform(0.7, 1, len(loose)))]
            packed, places, filled = best_fit_decreasing(lengths[loose], capacity)
            if len(filled) >= again.sum():
                continue
            number = np.cumsum(~again) - 1
            bins = number[bins]
            bins[loose], offsets[loose] = packed + (~again).sum(), places
            used = np.append(used[~again], filled)
            gained = True
            if len(used) <= bound:
                break
    return bins, offsets, used


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1).astype(np.int64))


def bound_of_counts(number: np.ndarray) -> int:
    """No packing has fewer bins: the best of two families of dual feasible functions.

    The first drops lengths below a limit and rounds those above capacity minus limit up to
    capacity; the second rounds multiples of capacity / (k + 1) down, as fractions of k.
    """
    capacity = len(number) - 1
    x = np.arange(capacity + 1, dtype=np.int64)
    above = np.cumsum(number[::-1])[::-1]
    weight = np.append(0, np.cumsum(number * x))
    limit = np.arange(1, capacity // 2 + 1)
    kept = weight[capacity - limit + 1] - weight[limit]
    rounded = above[np.minimum(capacity - limit + 1, capacity)] * capacity
    bound = int(weight[-1])
    if len(limit):
        bound = max(bound, int((kept + rounded).max()))
    best = -(-bound // capacity)
    for k in range(1, 21):
        exact = (k + 1) * x % capacity == 0
        value = np.where(exact, x * k, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((number * value).sum()) // (k * capacity)))
    return best
