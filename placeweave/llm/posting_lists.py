"""Filter interaction audit over sorted posting lists.

Each part of a table keeps, per filter, the sorted ids of the rows that fail it, cut into ranges of
ids. What a filter removes behind others is the difference of its list and the union of theirs, and
lists of different ranges never meet, so the sizes of all ranges just add up. The lists of a batch of
ranges are merged together: the elements of the shorter list are searched in the longer one.
"""

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeweave.llm.columns import hot_rows
from placeweave.llm.rows import with_computed
from placeweave.operators.skew import hot_from_counts, hot_from_rows, salted_join
from placeweave.staging import Stage

# Ids of a range, as a power of two: a list of one range has so many elements at most.
RANGE_BITS = 14
# Filters whose orders are audited; seven have 5,040 orders.
MOST_FILTERS = 7
# The list that every row of the table is in.
ALL = "all"

# The five filters.
FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 2
SYMBOLS = b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUED = bytes(range(0x80, 0xC0))

_FEATURES = "fails array<string>, digest binary"


# -- the filters ---------------------------------------------------------------------------


def failed(text: bytes) -> list[str]:
    """Which of the filters A to D a text fails."""
    words = text.split()
    points = len(text.translate(None, _CONTINUED))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    fails = {
        "A": len(words) < LEAST_WORDS,
        "B": 100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words),
        "C": 100 * capitals > MOST_CAPITALS_PERCENT * points,
        "D": len(text.translate(None, SYMBOLS)) < len(text),
    }
    return [name for name, fails_it in fails.items() if fails_it]


def _features(batch: pa.RecordBatch) -> list[pa.Array]:
    texts = [text.as_py() or b"" for text in batch.column("text").cast(pa.binary())]
    digests = [hashlib.blake2b(text, digest_size=16).digest() for text in texts]
    return [
        pa.array([failed(text) for text in texts], pa.list_(pa.string())),
        pa.array(digests, pa.binary()),
    ]


def failing_ids(docs: DataFrame, labels: DataFrame, stage: Stage) -> DataFrame:
    """Entries (part, id, list) of `docs` (doc_id, text, source): a row's failed filters, ALL, and
    the marks good and toxic of `labels` (doc_id, quality, toxic).

    Filter E fails a row whose text equals, by a digest of 128 bits, that of any row with a smaller
    doc_id. A null text counts as empty, a null source as empty. Rows that repeat a doc_id are rows
    of their own and no copies of each other; a row without doc_id is nobody's copy, has no smaller
    doc_id for others, and has no label. Of several labels of a doc_id, one that marks it is enough.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("source", F.lit("")).alias("part"),
        "text",
    )
    features = with_computed(rows, _FEATURES, lambda: _features, drop=("text",))
    features, seen = stage.keep_measured(features, "features", size=F.count(F.lit(1)))
    at_least = hot_rows(seen["size"])
    known = features.filter("doc_id IS NOT NULL").select("id", "doc_id", "part", "digest")

    texts = known.groupBy("digest").agg(
        F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")
    )
    shared = stage.keep(texts.filter("n > 1"), "shared-texts")
    hot = hot_from_counts(shared, ["digest"], "n", at_least)
    met = salted_join(known, shared.select("digest", "first"), ["digest"], hot)
    copies = met.filter("doc_id > first").select("part", "id", F.lit("E").alias("list"))

    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(
        F.array_compact(
            F.array(
                F.when(F.max(F.col("quality") == 1), "good"),
                F.when(F.max(F.col("toxic") == 1), "toxic"),
            )
        ).alias("marks")
    ).filter(F.size("marks") > 0)
    hot = hot_from_rows(known, ["doc_id"], at_least)
    marked = salted_join(known.select("part", "id", "doc_id"), marks, ["doc_id"], hot)
    marked = marked.select("part", "id", F.explode("marks").alias("list"))

    lists = F.explode(F.array_append("fails", F.lit(ALL))).alias("list")
    return features.select("part", "id", lists).union(copies).union(marked)


# -- the lists -----------------------------------------------------------------------------


def post(entries: DataFrame, lists: list[str]) -> DataFrame:
    """The posting lists of entries (part, id, list): a row per part and range of ids, with a sorted
    array for each of `lists`. An id is kept as its place in the range, so an array stays small."""
    place = F.col("id").bitwiseAND((1 << RANGE_BITS) - 1).cast("int")
    kept = [
        F.sort_array(F.collect_list(F.when(F.col("list") == name, place))).alias(name)
        for name in lists
    ]
    return entries.groupBy("part", F.shiftright("id", RANGE_BITS).alias("range")).agg(*kept)


def members(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which elements of a sorted array are in another."""
    if not len(long):
        return np.zeros(len(short), bool)
    at = np.searchsorted(long, short)
    return long[np.minimum(at, len(long) - 1)] == short


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    new = short[~members(short, long)]
    return np.insert(long, np.searchsorted(long, new), new)


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[~members(a, b)]


def _with_ranges(column: pa.Array) -> np.ndarray:
    """The lists of a batch as one sorted array: the row's place in the batch, then the id's."""
    places = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    return (np.repeat(np.arange(len(lengths)), lengths) << RANGE_BITS) | places


def _sizes(filters: list[str], marks: list[str]):
    names = ["part", "code", "removed", *marks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column("part").dictionary_encode()
            part = parts.indices.to_numpy()
            count = len(parts.dictionary)
            failing = [_with_ranges(batch.column(f)) for f in filters]
            marked = [_with_ranges(batch.column(m)) for m in marks]
            unions = [np.empty(0, np.int64)]
            found = []
            for subset in range(1 << len(filters)):
                if subset:
                    top = subset.bit_length() - 1
                    unions.append(union(unions[subset ^ (1 << top)], failing[top]))
                for k, ids in enumerate(failing):
                    if subset >> k & 1:
                        continue
                    removed = difference(ids, unions[subset])
                    lists = [removed, *(removed[members(removed, m)] for m in marked)]
                    sizes = [np.bincount(part[x >> RANGE_BITS], minlength=count) for x in lists]
                    some = np.flatnonzero(sizes[0])
                    code = np.full(len(some), subset * len(filters) + k)
                    found.append((some, code, *(s[some] for s in sizes)))
            places, *numbers = (np.concatenate(x) for x in zip(*found))
            columns = [parts.dictionary.take(pa.array(places)), *(pa.array(x, pa.int64()) for x in numbers)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def removed_sizes(lists: DataFrame, filters: list[str], marks: list[str]) -> DataFrame:
    """Per part and code, what a filter removes behind a set of others, and how much of it is in the
    lists `marks`. The code is the set, a bit for each filter, times their number, plus the filter's
    place; rows without anything removed are left out."""
    schema = "part string, code long, removed long" + "".join(f", `{m}` long" for m in marks)
    sizes = lists.select("part", *filters, *marks).mapInArrow(_sizes(filters, marks), schema)
    sums = [F.sum(c).alias(c) for c in ("removed", *marks)]
    return sizes.groupBy("part", "code").agg(*sums)


def audit(
    entries: DataFrame, stage: Stage, filters: list[str], marks: list[str]
) -> DataFrame:
    """What each filter does at each step of each order of `filters`, per part.

    `entries` (part, id, list) say which ids are in the lists ALL, of the filters and of the marks;
    ids are unique in the table, and an entry does not repeat. Returns part, filter_order, step (from
    1), kept, removed, redundant, unique_fails, `<mark>_lost` and shapley, zeros included.
    """
    if len(filters) > MOST_FILTERS:
        raise ValueError(f"orders of {MOST_FILTERS} filters at most")
    lists = stage.keep(post(entries, [ALL, *filters, *marks]), "posting-lists")
    sizes = removed_sizes(lists, filters, marks)
    parts = lists.groupBy("part").agg(F.sum(F.size(ALL)).alias("n"))

    k = len(filters)
    codes = F.sequence(F.lit(0), F.lit((k << k) - 1)).cast("array<long>")
    every = parts.select("part", "n", F.explode(codes).alias("code"))
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("removed", *marks)]
    every = stage.keep(
        every.join(sizes, ["part", "code"], "left").select("part", "n", "code", *numbers), "sizes"
    )

    place = F.pmod("code", F.lit(k)).cast("int")
    before = F.expr(f"code div {k}")
    others = F.bit_count(before)
    # How many orders have this set of filters, and no other, before this one.
    orders = F.get(F.array(*[F.lit(factorial(s) * factorial(k - 1 - s)) for s in range(k)]), others)
    own = every.filter(F.getbit(before, place) == 0).groupBy("part", place.alias("place"))
    per_filter = own.agg(
        F.sum(F.when(others == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(others == k - 1, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * orders).alias("shapley"),
    )
    steps = stage.spark.createDataFrame(_steps(filters), "filter_order string, step int, code long, place int")
    # One row for each step of each order: 600 rows for five filters.
    met = every.join(F.broadcast(steps), "code").join(per_filter, ["part", "place"])
    so_far = Window.partitionBy("part", "filter_order").orderBy("step")
    return met.select(
        "part",
        "filter_order",
        "step",
        (F.col("n") - F.sum("removed").over(so_far)).alias("kept"),
        "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails",
        *[F.col(m).alias(f"{m}_lost") for m in marks],
        "shapley",
    )


def _steps(filters: list[str]) -> list[tuple]:
    k, rows = len(filters), []
    for order in permutations(range(k)):
        name, before = "".join(filters[f] for f in order), 0
        for step, f in enumerate(order, 1):
            rows.append((name, step, before * k + f, f))
            before |= 1 << f
    return rows
