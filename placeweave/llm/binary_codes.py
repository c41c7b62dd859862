"""Near-duplicate vectors by randomised-rotation binary codes with correction factors.

A vector is turned by random rotations and keeps the signs, one bit for each dimension. The sum of
the turned vector's absolute parts says how well its signs stand for it; with that factor, the
signs give an unbiased estimate of the cosine with any other vector, and a bound of its error. Bits
of the codes are the keys of buckets. A sketch of some fifty bytes is stored once for each vector:
the signs of the first rotation, their factor, and the turned vector in four bits a dimension,
rounded at drawn thresholds, so that the estimate stays unbiased. Only sketches go to the buckets,
where bits are counted; vectors are fetched for the rows that have a pair whose estimate is within
its bound of the threshold, and only such pairs are computed exactly, which decides.
"""

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.llm import tiles
from placeweave.llm.components import connected
from placeweave.operators import skew
from placeweave.staging import Stage

# The share of pairs at the threshold that meet in a bucket; nearer pairs meet more often. Of so many
# drawn pairs, in blocks, no more than half of the allowed ones may miss each other.
RECALL = 0.999
PAIRS, PAIR_BLOCK = 20_000, 1_000
# Vectors without a near one that a bucket should hold.
BUCKET = 16
# The bound on an estimate's error, in standard errors.
SURE = 4.0
# What the single precision of a sketch can add to an error.
SLACK = 1e-5
# Bits for each dimension of a rounded vector.
LEVELS = 4
# Vectors compared in one block.
TILE = 256
_SEED = 20_240_601


class Plan(NamedTuple):
    """`bands` keys of `bits` bits each, from that many rotations of vectors of `size` numbers."""

    bits: int
    bands: int
    threshold: float

    def rotations(self, size: int) -> int:
        return -(-self.bits * self.bands // size)


# Plans by the size of vectors and the bits of a key.
Plans = dict[tuple[int, int], Plan]


def bits_for(count: Column) -> Column:
    """Longer keys where more vectors are compared: the bits for a group of `count` vectors."""
    bits = F.round(F.log2(count / BUCKET)).cast("int") + 1
    return F.least(F.lit(32), F.greatest(F.lit(4), bits))


@cache
def plan_for(size: int, bits: int, threshold: float) -> Plan:
    """As many keys as the recall takes, measured with the rotations for vectors of `size` numbers."""
    same = 1 - np.arccos(threshold) / np.pi
    bands = max(1, int(np.ceil(np.log(1 - RECALL) / np.log(1 - same**bits))))
    if size < 2:  # The cosine of two numbers is 1 or -1.
        return Plan(bits, 1, threshold)
    while True:
        bands += bands // 2 + 1
        first = first_bands(size, Plan(bits, bands, threshold), [_SEED, size, bits])
        allowed = int(len(first) * (1 - RECALL) / 2)
        needed = int(np.sort(first)[-1 - allowed]) + 1
        if needed <= bands:
            return Plan(bits, needed, threshold)


def first_bands(size: int, plan: Plan, seed: list[int]) -> np.ndarray:
    """For drawn pairs at the threshold, the first band that they share, or the number of bands."""
    draw, found = np.random.default_rng(seed), []
    for _ in range(PAIRS // PAIR_BLOCK):
        left, other = draw.standard_normal((2, PAIR_BLOCK, size))
        left /= np.linalg.norm(left, axis=1, keepdims=True)
        other -= (other * left).sum(1, keepdims=True) * left
        other /= np.linalg.norm(other, axis=1, keepdims=True)
        right = plan.threshold * left + np.sqrt(1 - plan.threshold**2) * other
        keys = codes(np.concatenate([left, right]), plan)[1]
        same = keys[:PAIR_BLOCK] == keys[PAIR_BLOCK:]
        found.append(np.where(same.any(1), same.argmax(1), plan.bands))
    return np.concatenate(found)


def rotation(size: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    drawn = np.random.default_rng([_SEED, size, number]).standard_normal((size, size))
    turned, upper = np.linalg.qr(drawn)
    return turned * np.sign(np.diag(upper))


def codes(vectors: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """The vectors turned by the first rotation, and the band keys from the signs of all."""
    size = vectors.shape[1]
    turned = [vectors @ rotation(size, k) for k in range(plan.rotations(size))]
    signs = np.concatenate([t >= 0 for t in turned], 1)
    used = signs[:, : plan.bits * plan.bands].reshape(len(vectors), plan.bands, plan.bits)
    keys = used @ (np.int64(1) << np.arange(plan.bits, dtype=np.int64))
    return turned[0], keys


def sketch_type(size: int) -> np.dtype:
    """Signs of a turned vector, the bits of its rounded parts, and how to read both."""
    words = -(-size // 64)
    return np.dtype(
        [
            ("signs", "<u8", (words,)),
            ("planes", "<u8", (LEVELS, words)),
            ("factor", "<f4"),
            ("low", "<f4"),
            ("step", "<f4"),
        ]
    )


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit numbers."""
    padded = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64)))
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def sketches(turned: np.ndarray) -> np.ndarray:
    """The sketch of each turned vector of length one."""
    count, size = turned.shape
    found = np.zeros(count, sketch_type(size))
    found["signs"] = _packed(turned >= 0)
    found["factor"] = np.abs(turned).sum(1) / np.sqrt(size)
    top = (1 << LEVELS) - 1
    low = turned.min(1).astype(np.float32)
    step = ((turned.max(1) - low) / top).astype(np.float32)
    found["low"], found["step"] = low, step
    # Drawn once for each dimension: a part is rounded up as often as it is near the next level.
    draw = np.random.default_rng([_SEED, size]).random(size)
    scaled = (turned - low[:, None]) / np.where(step > 0, step, 1)[:, None]
    level = np.clip(np.floor(scaled + draw), 0, top).astype(np.uint8)
    for k in range(LEVELS):
        found["planes"][:, k] = _packed(level >> k & 1)
    return found


class Sketches:
    """Sketches of vectors of `size` numbers, and what their pairs share."""

    def __init__(self, rows: np.ndarray, size: int, threshold: float):
        self.size, self.signs = size, rows["signs"]
        self.planes = rows["planes"].reshape(len(rows), LEVELS, -1)
        self.factor, self.low, self.step = (
            rows[c].astype(float) for c in ("factor", "low", "step")
        )
        self.ones = np.bitwise_count(self.signs).sum(1).astype(float)
        weights = 1 << np.arange(LEVELS)
        levels = np.bitwise_count(self.planes).sum(2) @ weights
        self.total = self.low * size + self.step * levels
        # Of a pair at the threshold or nearer, the part of one vector across the other is so long;
        # the signs err by that part only, by no more than all of it, and by chance in either way.
        across = np.sqrt(1 - max(0.0, min(1.0, threshold)) ** 2)
        chance = min(1.0, SURE / np.sqrt(max(1, size - 1)))
        lost = np.sqrt(np.maximum(0, 1 - self.factor**2)) / self.factor
        self.sign_error = chance * across * lost + SLACK
        self.step_error = min(SURE / 2, np.sqrt(size)) * self.step

    def estimate(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of the signs of `i` with the rounded `j`, and their bounds,
        which hold for pairs at the threshold or nearer."""
        signs, shared = self.signs[i], np.zeros(len(i))
        for k in range(LEVELS):
            shared += np.bitwise_count(signs & self.planes[j, k]).sum(1) * float(1 << k)
        positive = self.low[j] * self.ones[i] + self.step[j] * shared
        factor = self.factor[i]
        guess = (2 * positive - self.total[j]) / np.sqrt(self.size) / factor
        return guess, self.sign_error[i] + self.step_error[j] / factor


def near_duplicates(vectors: DataFrame, stage: Stage, threshold: float = 0.93) -> DataFrame:
    """One row per row of `vectors` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Two vectors of one label, not null, and of one length are linked if their cosine, in double
    precision, is at least `threshold`. Vectors that are null, empty, zero or hold a null or a
    number that is not finite link with nothing, as do rows without vec_id; those have no
    component_id and are kept. Rows that repeat a vec_id are compared as vectors of their own; each
    has the links of all of them, and none to a row of the same vec_id. Other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), "label", "embedding")
    numbers = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = finite & F.exists(numbers, lambda x: x != 0) & F.col("label").isNotNull()
    usable = rows.filter(usable & F.col("id").isNotNull()).select(
        "id", F.xxhash64("label", F.size("embedding")).alias("group"), numbers.alias("vector")
    )
    usable = usable.withColumn("size", F.size("vector"))
    groups = usable.groupBy("group", "size").agg(F.count(F.lit(1)).alias("n"))
    groups = stage.keep(groups.withColumn("bits", bits_for(F.col("n"))), "groups")
    kinds = groups.select("size", "bits").distinct().collect()
    plans = {(r["size"], r["bits"]): plan_for(r["size"], r["bits"], threshold) for r in kinds}
    on = ["group", "size"]
    hot = skew.hot_from_counts(groups, on, "n", skew.HOT_ROWS)
    planned = skew.salted_join(usable, groups.drop("n"), on, hot)
    planned = planned.select("id", "group", "size", "bits", "vector")
    coded = planned.mapInArrow(_coder(plans), _CODED)
    coded = stage.keep(coded.withColumn("row", F.monotonically_increasing_id()), "codes")
    tiled = stage.keep(_open_rows(coded, plans, stage), "open")
    found = stage.keep(_links(tiled, coded, plans), "found")
    counts = found.groupBy("id").agg(F.sum("n_links").alias("n_links"))
    joined = connected(found.select(F.col("id").alias("a"), F.col("root").alias("b")), stage)
    joined = joined.groupBy("id").agg(F.min("component").alias("component"))
    result = rows.select("id").join(counts, "id", "left").join(joined, "id", "left")
    component = F.coalesce("component", "id")
    return result.select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    )


def unit_rows(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """The vectors at length one; scaled first, so that squares neither vanish nor overflow."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows**2).sum(1, keepdims=True))


def _by_plan(table: pa.RecordBatch | pa.Table, plans: Plans) -> Iterator[tuple]:
    """The rows of each plan, with the size of their vectors."""
    sizes, bits = (table.column(c).to_numpy() for c in ("size", "bits"))
    for size, length in sorted(set(zip(sizes.tolist(), bits.tolist()))):
        part = table.filter(pa.array((sizes == size) & (bits == length)))
        yield part, size, plans[size, length]


_CODED = (
    "id long, group long, size int, bits int, vector array<double>, sketch binary, keys array<long>"
)


def _coder(plans: Plans):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, size, plan in _by_plan(batch, plans):
                turned, keys = codes(unit_rows(part.column("vector"), size), plan)
                sketch = [row.tobytes() for row in sketches(turned)]
                added = [pa.array(sketch, pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *added],
                    ["id", "group", "size", "bits", "vector", "sketch", "keys"],
                )

    return run


_DEALT = f"{tiles.KEY} long, {tiles.SIDE} int, {tiles.DIAGONAL} boolean, row long, band int"


def _open_rows(coded: DataFrame, plans: Plans, stage: Stage) -> DataFrame:
    """The rows of each tile that have a pair there whose estimate leaves it open."""
    bucket = F.xxhash64("group", "band", "key").alias("bucket")
    banded = coded.select("*", F.posexplode("keys").alias("band", "key"))
    sizes = banded.groupBy(bucket).agg(F.count(F.lit(1)).alias(tiles.SIZE))
    # Only buckets that are more than a tile need their size; there are few.
    large = stage.keep(sizes.filter(F.col(tiles.SIZE) > TILE), "large")
    hot = skew.hot_from_counts(large, ["bucket"], tiles.SIZE, skew.HOT_ROWS)
    sketched = banded.select(bucket, "band", "row", "group", "size", "bits", "sketch")
    met = skew.salted_join(sketched, large, ["bucket"], hot, "left")
    met = met.withColumn(tiles.SIZE, F.coalesce(tiles.SIZE, F.lit(1)))
    dealt = tiles.tiled(met, F.col("bucket"), F.col("row"), TILE).drop("bucket", tiles.SIZE)
    return tiles.by_tile(dealt).mapInArrow(_estimator(plans), _DEALT)


def _links(tiled: DataFrame, coded: DataFrame, plans: Plans) -> DataFrame:
    """(id, n_links, root) from each tile where a vector has links: how many of them are counted
    there, and the smallest id that it reaches there."""
    return tiles.by_tile(tiled.join(coded, "row")).mapInArrow(
        _comparer(plans), "id long, n_links long, root long"
    )


def _open_pairs(
    table: pa.Table, size: int, plan: Plan
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    rows = np.frombuffer(b"".join(table.column("sketch").to_pylist()), sketch_type(size))
    known = Sketches(rows, size, plan.threshold)
    band, group = (table.column(c).to_numpy() for c in ("band", "group"))
    for i, j in tiles.pairs(table):
        guess, bound = known.estimate(i, j)
        meets = (guess + bound >= plan.threshold) & (band[i] == band[j]) & (group[i] == group[j])
        yield i[meets], j[meets]


def _estimator(plans: Plans):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tiles.whole_tiles(batches):
            for part, size, plan in _by_plan(table, plans):
                is_open = np.zeros(part.num_rows, bool)
                for i, j in _open_pairs(part, size, plan):
                    is_open[i] = is_open[j] = True
                names = [tiles.KEY, tiles.SIDE, tiles.DIAGONAL, "row", "band"]
                yield from part.select(names).filter(pa.array(is_open)).to_batches()

    return run


def _comparer(plans: Plans):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tiles.whole_tiles(batches):
            for part, size, plan in _by_plan(table, plans):
                yield _compare(part, size, plan)

    return run


def _compare(table: pa.Table, size: int, plan: Plan) -> pa.RecordBatch:
    vectors = unit_rows(table.column("vector"), size)
    keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, plan.bands)
    band, ids = (table.column(c).to_numpy() for c in ("band", "id"))
    links = np.zeros(len(ids), np.int64)
    root = np.arange(len(ids))
    for open_i, open_j in _open_pairs(table, size, plan):
        for start in range(0, len(open_i), 20_000):
            i, j = open_i[start : start + 20_000], open_j[start : start + 20_000]
            # A pair that meets in several buckets is compared in that of its first common band.
            first = (keys[i] == keys[j]).argmax(1) == band[i]
            first &= (keys[i, band[i]] == keys[j, band[i]]) & (ids[i] != ids[j])
            i, j = i[first], j[first]
            near = np.einsum("rd,rd->r", vectors[i], vectors[j]) >= plan.threshold
            i, j = i[near], j[near]
            np.add.at(links, i, 1)
            np.add.at(links, j, 1)
            _join(root, ids, i, j)
    linked = np.flatnonzero(links)
    while (root[root] != root).any():
        root = root[root]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[linked]), pa.array(links[linked]), pa.array(ids[root[linked]])],
        ["id", "n_links", "root"],
    )


def _join(root: np.ndarray, ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Link positions so that each points at one with a smaller id that it is joined to."""
    while len(left):
        while (root[root] != root).any():
            root[:] = root[root]
        a, b = root[left], root[right]
        apart = a != b
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        swap = (ids[a] < ids[b]) | ((ids[a] == ids[b]) & (a < b))
        high, low = np.where(swap, b, a), np.where(swap, a, b)
        root[high] = low
