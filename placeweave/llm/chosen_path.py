"""Near-duplicate texts by a chosen-path similarity join over word shingles.

A document's set is its distinct shingles. Trees branch on minwise tokens: at each node of a tree
one coordinate is chosen (at one node in four, two), and a document goes to the child named by its
minwise token at that coordinate, so that two sets of similarity s stay together with probability
s or a little more on each level. Small nodes are compared exhaustively by sketches, large ones
branch on; what is still large at the last level is compared in tiles. Independent trees are
repeated to the target recall. Every candidate is confirmed on the full sets of both whole texts.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.llm import tiles
from placeweave.llm.components import connected
from placeweave.llm.rows import mix, seeds, shingle_set, with_computed
from placeweave.staging import Stage

# Independent trees, for less than one pair in 10,000 missed at the last level, where large tables
# compare most sets. At similarity 0.8 a tree whose root has one coordinate parts a pair by its third
# level with probability 0.434, one with two 0.285 (the nodes of a level share coordinates, so its
# branches are not independent). Nine and three of them miss one pair in 79,000, at two levels one in
# 4 million; eight trees would miss one in 1,800 and one in 26,000.
TREES = 12
LEVELS = 3
# Nodes of up to so many sets are compared, larger ones branch while levels are left.
SMALL_NODE = 128
# Sets in a chunk of a node that is large at the last level; its rows are copied once per chunk.
TILE = 1024
# Bins of a sketch, and how far below a threshold of 0.8 the similarity of two sketches may lie. The
# standard error there grows with the texts, from 0.018 at a union of 100 shingles to 0.025, so the
# margin is 4.4 errors of the longest: at 0.8 the sketches lose, in two million simulated links each,
# none at 300 shingles, 5e-7 at 1,000, 8e-6 at 5,000 and 1.9e-5, one in 50,000, at 50,000.
BINS = 256
MARGIN = 0.11
# Rounds that confirm for each set only the most similar other one, before all the rest.
NEAREST_ROUNDS = 2
# Pairs whose sketches are compared at a time.
BLOCK = 20_000

_COORDINATES = TREES * LEVELS * 2
_SEEDS = seeds(_COORDINATES, 3)
_SKETCH_SEED = seeds(1, 4)[0]
_SIGNATURE = "n_shingles long, k1 long, k2 long, coordinates array<int>, sketch binary"


def signature(shingles: np.ndarray) -> tuple:
    """Two keys that equal sets share, minwise tokens, and a sketch of a byte for each bin.

    A token keeps 32 bits: equal ones stay equal, and the few others that meet are compared in vain.
    """
    if not len(shingles):
        return 0, None, None, None, None
    keys = [mix(shingles).sum(), mix(shingles ^ _SKETCH_SEED).sum()]
    least = np.array([(shingles * seed).min() for seed in _SEEDS])
    dealt = np.sort(shingles * _SKETCH_SEED)
    bins = dealt >> np.uint64(64 - BINS.bit_length() + 1)
    first = np.flatnonzero(np.diff(bins, prepend=np.uint64(BINS)))
    sketch = np.zeros(BINS, np.uint8)
    sketch[bins[first]] = (mix(dealt[first]) % np.uint64(255)).astype(np.uint8) + 1
    return (
        len(shingles),
        *[int(k.astype(np.int64)) for k in keys],
        least.astype(np.uint32).view(np.int32),
        sketch.tobytes(),
    )


def _signatures(width: int):
    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column("text")
        found = [signature(shingle_set(t.as_py(), width)) for t in texts]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary()]
        return [pa.array(x, k) for x, k in zip(zip(*found), kinds)] if found else [
            pa.array([], k) for k in kinds
        ]

    return lambda: compute


def sketch_similarity(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Estimated similarity of the sets behind rows of sketches."""
    equal = ((left == right) & (left > 0)).sum(1, dtype=np.int32)
    return equal / np.maximum(((left | right) > 0).sum(1, dtype=np.int32), 1)


def least_similarity(percent: int) -> float:
    """The similarity from which on sketches may belong to sets that are similar enough."""
    share = percent / 100
    return share - MARGIN * max(1.0, np.sqrt(share * (1 - share)) / 0.4)


def _sketches(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def _sizes_fit(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def near_duplicates(
    docs: DataFrame, stage: Stage, width: int = 5, percent: int = 80
) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked if `percent` or more of the union of their sets is shared; component_id
    is the smallest doc_id reachable. A null, empty or blank text has an empty set and links with
    nothing; a text of fewer words than `width` has one shingle, the whole sequence. Rows without
    doc_id link with nothing, have no component_id and are kept. Rows that repeat a doc_id are
    one document. Other columns are ignored; equal sets are one class throughout.
    """
    signed = with_computed(docs.select("doc_id", "text"), _SIGNATURE, _signatures(width), ("text",))
    signed = stage.keep(signed, "signatures")
    usable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    members = usable.select("doc_id", "k1", "k2").distinct().join(classes, ["k1", "k2"])
    members = stage.keep(members.select("doc_id", "rep"), "members")
    # One row per class that a doc_id stands for; rows of that doc_id without shingles are no sets.
    of_class = ["doc_id", "k1", "k2"]
    sets = usable.join(classes.withColumnRenamed("rep", "doc_id"), of_class).dropDuplicates(of_class)
    sets = sets.select(
        F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "coordinates", "sketch"
    )
    sets = stage.keep(sets, "sets")
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    texts = texts.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))

    roots = stage.keep(_branches_of_roots(sets), "roots")
    links = stage.keep(_confirmed(_stars(roots, sets, percent), texts, width, percent), "links")
    joined = connected(links, stage)
    meetings = _meetings(roots, sets, joined, stage)
    for _ in range(NEAREST_ROUNDS):
        rows = stage.keep(_mixed(meetings, joined), "mixed")
        near = _nearest(rows, sets, percent)
        links = stage.keep(_confirmed(near, texts, width, percent), "links")
        if links.isEmpty():
            break
        joined = connected(_edges(joined).union(links), stage)
    rows = stage.keep(_mixed(meetings, joined), "mixed")
    links = stage.keep(_rest(rows, sets, texts, stage, width, percent), "links")
    if not links.isEmpty():
        joined = connected(_edges(joined).union(links), stage)

    by_class = _labels(joined)
    labelled = members.join(by_class, members["rep"] == by_class["id"], "left")
    label = F.coalesce("component", "rep")
    labels = labelled.groupBy("doc_id").agg(F.min(label).alias("component_id"))
    result = signed.select("doc_id", "n_shingles").join(labels, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return result.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        component.eqNullSafe(F.col("doc_id")).alias("kept"),
    )


# -- the trees ----------------------------------------------------------------------------


def _branches_of_roots(sets: DataFrame) -> DataFrame:
    """(node, tree, id, n): the children of the roots; one root in four has two coordinates."""
    chosen = [(t, c) for t in range(TREES) for c in range(2 if t % 4 == 3 else 1)]
    nodes = [
        F.struct(
            F.xxhash64(F.lit(t), F.lit(c), F.col("coordinates")[_coordinate(t, 0, c)]).alias("node"),
            F.lit(t).alias("tree"),
        )
        for t, c in chosen
    ]
    return sets.select("id", "n", F.explode(F.array(*nodes)).alias("x")).select("x.*", "id", "n")


def _coordinate(tree: int, level: int, choice: int) -> int:
    return (tree * LEVELS + level) * 2 + choice


def _branch(rows: DataFrame, sets: DataFrame, level: int) -> DataFrame:
    """The children, on `level`, of the nodes that `rows` (node, tree, id, n) lie in."""
    first = (F.col("tree") * LEVELS + level) * 2
    at = lambda choice: F.xxhash64(
        "node", F.lit(choice), F.element_at("coordinates", first + choice + 1)
    )
    two = F.pmod(F.xxhash64("node"), F.lit(4)) == 0
    children = F.when(two, F.array(at(0), at(1))).otherwise(F.array(at(0)))
    with_tokens = rows.join(sets.select("id", "coordinates"), "id")
    return with_tokens.select(F.explode(children).alias("node"), "tree", "id", "n")


def _stars(roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """At most one pair (a, b) per set: itself and the smallest similar first set of its nodes.

    This settles groups of near copies of any size with as many comparisons as they have members.
    """
    centres = roots.groupBy("node").agg(F.min(F.struct("id", "n")).alias("centre"))
    met = roots.join(centres, "node").filter("id <> centre.id")
    met = met.filter(_sizes_fit(F.col("n"), F.col("centre.n"), percent))
    met = met.select(F.col("id").alias("a"), F.col("centre.id").alias("b")).distinct()
    left = sets.select(F.col("id").alias("a"), F.col("sketch").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("sketch").alias("right"))
    sketched = met.join(left, "a").join(right, "b")

    def similarity(batch: pa.RecordBatch) -> list[pa.Array]:
        score = sketch_similarity(_sketches(batch.column("left")), _sketches(batch.column("right")))
        return [pa.array(score)]

    scored = with_computed(sketched, "score double", lambda: similarity, ("left", "right"))
    near = scored.filter(F.col("score") >= least_similarity(percent))
    return near.groupBy("a").agg(F.min("b").alias("b"))


def _labels(joined: DataFrame) -> DataFrame:
    return joined.groupBy("id").agg(F.min("component").alias("component"))


def _edges(joined: DataFrame) -> DataFrame:
    return joined.select(F.col("id").alias("a"), F.col("component").alias("b"))


def _mixed(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """The rows of nodes whose sets are not all joined yet, with `component` and the node's size."""
    known = rows.join(_labels(joined), "id", "left")
    known = known.withColumn("component", F.coalesce("component", "id"))
    nodes = known.groupBy("node").agg(
        F.count(F.lit(1)).alias(tiles.SIZE),
        F.min("component").alias("_low"),
        F.max("component").alias("_high"),
    )
    return known.join(nodes.filter("_low <> _high").drop("_low", "_high"), "node")


def _meetings(roots: DataFrame, sets: DataFrame, joined: DataFrame, stage: Stage) -> DataFrame:
    """(node, id, n) of the nodes whose sets are compared: small ones, and all of the last level."""
    rows, found = roots, []
    for level in range(1, LEVELS + 1):
        part = stage.keep(_mixed(rows, joined).drop("component"), "nodes")
        small = F.col(tiles.SIZE) <= SMALL_NODE
        met = part if level == LEVELS else part.filter(small)
        found.append(met.select("node", "id", "n"))
        if level < LEVELS:
            rows = stage.keep(_branch(part.filter(~small), sets, level), "branches")
            if rows.isEmpty():
                break
    first, *rest = found
    for frame in rest:
        first = first.union(frame)
    return first


def _sketched_tiles(rows: DataFrame, sets: DataFrame) -> DataFrame:
    sketched = rows.join(sets.select("id", "sketch"), "id")
    dealt = tiles.tiled(sketched, F.col("node"), F.col("id"), TILE)
    columns = [tiles.KEY, tiles.SIDE, tiles.DIAGONAL, "node", "id", "n", "component", "sketch"]
    return tiles.by_tile(dealt.select(columns))


def _near_pairs(table: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Positions (i, j) and scores of pairs in a tile that may be links between components."""
    n, component = (table.column(c).to_numpy() for c in ("n", "component"))
    sketches = _sketches(table.column("sketch"))
    for i, j in tiles.pairs(table, BLOCK):
        fit = np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent
        fit &= component[i] != component[j]
        i, j = i[fit], j[fit]
        score = sketch_similarity(sketches[i], sketches[j])
        near = score >= least_similarity(percent)
        yield i[near], j[near], score[near]


def _nearest(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """For each set of `rows` that has one, the pair (a, b) with the most similar other sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tiles.whole_tiles(batches):
            ids = table.column("id").to_numpy()
            best, partner = np.zeros(len(ids)), np.full(len(ids), -1)
            for i, j, score in _near_pairs(table, percent):
                order = np.argsort(score, kind="stable")
                for x, y in ((i[order], j[order]), (j[order], i[order])):
                    better = score[order] > best[x]
                    best[x[better]], partner[x[better]] = score[order][better], y[better]
            has = np.flatnonzero(partner >= 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (ids[has], ids[partner[has]], best[has])], ["a", "b", "score"]
            )

    found = _sketched_tiles(rows, sets).mapInArrow(run, "a long, b long, score double")
    best = found.groupBy("a").agg(F.max(F.struct("score", "b")).alias("best"))
    a, b = F.col("a"), F.col("best.b")
    return best.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()


def _rest(
    rows: DataFrame, sets: DataFrame, texts: DataFrame, stage: Stage, width: int, percent: int
) -> DataFrame:
    """All links (a, b) between components that are left, but for those that others make needless.

    The rows with any similar sketch in their node are marked, and only those are brought together
    again, with their texts. So no pair leaves its tile unless it is a link.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tiles.whole_tiles(batches):
            near = np.zeros(table.num_rows, bool)
            for i, j, _ in _near_pairs(table, percent):
                near[i] = near[j] = True
            yield from table.select(["node", "id"]).filter(pa.array(near)).to_batches()

    marked = _sketched_tiles(rows, sets).mapInArrow(mark, "node long, id long").distinct()
    marked = stage.keep(marked, "marked")
    sizes = marked.groupBy("node").agg(F.count(F.lit(1)).alias(tiles.SIZE))
    marked = rows.drop(tiles.SIZE).join(marked, ["node", "id"]).join(sizes, "node")
    marked = marked.join(sets.select("id", "sketch"), "id").join(texts, "id")
    dealt = tiles.tiled(marked, F.col("node"), F.col("id"), TILE)
    columns = [tiles.KEY, tiles.SIDE, tiles.DIAGONAL, "id", "n", "component", "sketch", "text"]

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tiles.whole_tiles(batches):
            ids = table.column("id").to_numpy()
            sets_here: dict[int, np.ndarray] = {}
            component = table.column("component").to_numpy().copy()
            links = []
            for i, j, _ in _near_pairs(table, percent):
                for x, y in zip(i.tolist(), j.tolist()):
                    if component[x] == component[y]:
                        continue
                    for k in (x, y):
                        if k not in sets_here:
                            sets_here[k] = shingle_set(table.column("text")[k].as_py(), width)
                    if similar(sets_here[x], sets_here[y], percent):
                        links.append((max(ids[x], ids[y]), min(ids[x], ids[y])))
                        component[component == component[x]] = component[y]
            found = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"]
            )

    dealt = tiles.by_tile(dealt.select(columns))
    return dealt.mapInArrow(confirm, "a long, b long").distinct()


# -- confirmation -------------------------------------------------------------------------


def similar(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * shared >= percent * (len(left) + len(right) - shared)


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("right"))
    both = pairs.join(left, "a").join(right, "b")

    def make():
        last: list = [None, None]

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            verdicts = []
            for x, b, y in zip(*(batch.column(c).to_pylist() for c in ("left", "b", "right"))):
                if last[0] != (b, y):
                    last[:] = (b, y), shingle_set(y, width)
                verdicts.append(similar(shingle_set(x, width), last[1], percent))
            return [pa.array(verdicts, pa.bool_())]

        return compute

    checked = with_computed(both, "linked boolean", make, ("left", "right"))
    return checked.filter("linked").select("a", "b").distinct()
