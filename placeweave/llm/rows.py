"""Columns computed in Arrow batches, and hashing of words."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

Compute = Callable[[pa.RecordBatch], list[pa.Array]]

# Rows that are computed at a time, so that what is made of long texts stays small.
ROWS = 1_000


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def with_computed(
    rows: DataFrame, schema: str, make: Callable[[], Compute], drop: tuple[str, ...] = ()
) -> DataFrame:
    """`rows` with the columns of `schema`, which replace input columns of the same names.

    `make` runs once per task and gives the function that computes the new columns of a batch.
    """
    new = StructType.fromDDL(schema)
    gone = {f.name.lower() for f in new} | {c.lower() for c in drop}
    kept = [f for f in rows.schema if f.name.lower() not in gone]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in slices(batches):
            columns = [batch.column(name) for name in names] + compute(batch)
            yield pa.RecordBatch.from_arrays(columns, [*names, *new.names])

    return rows.mapInArrow(run, StructType([*kept, *new]))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(count: int, salt: int = 0) -> np.ndarray:
    """Fixed odd 64-bit numbers."""
    start = np.arange(1, count + 1, dtype=np.uint64) + np.uint64(salt << 32)
    return mix(start * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_BYTES = seeds(256, 1)
_POWER = np.uint64(0x9E3779B97F4A7C15)
_powers = np.cumprod(np.full(64, _POWER))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each word `[^\\x20\\x09-\\x0D]+`, with A-Z in lower case."""
    global _powers
    if not text:
        return np.empty(0, np.uint64)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    edges = np.flatnonzero(np.diff(inside))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    while len(_powers) < lengths.max():
        _powers = np.concatenate([_powers, _powers * _powers[-1]])
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(firsts, lengths)
    letters = _BYTES[data[np.repeat(starts, lengths) + place]] * _powers[place]
    return mix(np.add.reduceat(letters, firsts) + lengths.astype(np.uint64))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of `width`-word shingles; the whole sequence if it is shorter."""
    words = word_hashes(text)
    if not len(words):
        return words
    span = min(width, len(words))
    factors = seeds(span, 2)
    total = np.zeros(len(words) - span + 1, np.uint64)
    for k in range(span):
        total += words[k : len(words) - span + 1 + k] * factors[k]
    return np.unique(mix(total + np.uint64(span)))
