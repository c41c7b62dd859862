"""Type filter and mapping, union by name, collapse per id, quarantine, stage counts."""

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.functions.patterns import required_literals
from placeweave.functions.text import strip
from placeweave.staging import Stage

# Where a row comes from: the source's place in the merge, then the row's place in the source.
SOURCE = "_src"
ROW = "_row"

# A small code list as a dict, or (key, value) rows; a list of patterns, or rows of them.
Mapping = dict[str, str] | DataFrame
Patterns = list[str] | DataFrame

# Lookup tables up to this many rows become literals in the plan; larger ones are joined.
INLINE_ROWS = 1_000
# Patterns per regular expression, of those that mean the same inside a larger one.
PATTERNS_PER_FILTER = 200
# Characters by which ids and long tables of literals meet.
LITERAL_KEY = 8
# No groups that could be numbered anew, no classes, quotes or escapes that could reach further.
_MERGES = re.compile(r"[\w\s:/.,;=&@%~$^*+?-]*")


def with_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Add the missing ones of `columns` as null strings."""
    absent = {c: F.lit(None).cast("string") for c in columns if c not in rows.columns}
    return rows.withColumns(absent)


# -- merge and collapse -------------------------------------------------------------------


def merge_by_name(sources: list[DataFrame]) -> DataFrame:
    """Union by column name; absent columns are null, columns come in order of appearance.

    `_src` records the order of the sources. Nothing is shuffled.
    """
    tagged = [s.withColumn(SOURCE, F.lit(i)) for i, s in enumerate(sources)]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return merged.select(*[c for c in merged.columns if c != SOURCE], SOURCE)


def collapse_by_id(
    rows: DataFrame, order: list[str], overrides: dict[str, Column] | None = None
) -> DataFrame:
    """One row per `subject`: per column the first non-null value in the given order.

    Rows without an id are dropped. `overrides` gives other aggregates for named columns. Partial
    results are combined before the shuffle, so an id with very many rows stays small.
    """
    overrides = overrides or {}
    values = [c for c in rows.columns if c != "subject" and c not in order]
    found = {c: overrides.get(c, _first(c, order)).alias(c) for c in values}
    groups = rows.filter("subject IS NOT NULL").groupBy("subject").agg(*found.values())
    unpacked = [F.col(c) if c in overrides else F.col(c)["_value"].alias(c) for c in values]
    return groups.select("subject", *unpacked)


def _first(column: str, order: list[str], where: Column | None = None) -> Column:
    """The column's first value that is not null, of the rows for which `where` holds, with its place."""
    placed = F.struct(*order, F.col(column).alias("_value"))
    counts = F.col(column).isNotNull()
    return F.min(F.when(counts if where is None else counts & where, placed))


def collapse_counted(rows: DataFrame, order: list[str], mapping: Mapping) -> DataFrame:
    """One row per `subject`, null included, with the values that `collapse_by_id` finds in its rows of
    a known type, how many of its rows were `_loaded`, and how many are `_known` by their type.

    Rows of an unknown type come along to be counted, so unlike in `filter_type` they are read.
    """
    values = [c for c in rows.columns if c != "subject" and c not in order]
    rows, known = _with_known(with_columns(rows, ["udbLocationType"]), mapping)
    groups = rows.groupBy("subject").agg(
        *[_first(c, order, known).alias(c) for c in values],
        F.count(F.lit(1)).alias("_loaded"),
        F.count_if(known).alias("_known"),
    )
    unpacked = [F.col(c)["_value"].alias(c) for c in values]
    return groups.select("subject", *unpacked, "_loaded", "_known")


# -- type filter and mapping --------------------------------------------------------------


def inline_map(mapping: Mapping) -> Mapping:
    """The mapping as a dict, unless it has too many rows to put into a plan.

    Either way it has no null key, and of several values of a key the smallest.
    """
    if isinstance(mapping, dict):
        return {k: v for k, v in mapping.items() if k is not None}
    known = mapping.filter("key IS NOT NULL").groupBy("key").agg(F.min("value").alias("value"))
    rows = known.limit(INLINE_ROWS + 1).collect()
    return known if len(rows) > INLINE_ROWS else {r["key"]: r["value"] for r in rows}


def is_known_type(types: list[str]) -> Column:
    """The catalogue type is one of `types` or absent; reaches a Parquet scan as a filter."""
    return F.col("udbLocationType").isin(types) | F.col("udbLocationType").isNull()


def filter_type(places: DataFrame, mapping: Mapping) -> DataFrame:
    """Keep the rows whose catalogue type is a key of the mapping or absent."""
    places = with_columns(places, ["udbLocationType"])
    mapping = inline_map(mapping)
    if isinstance(mapping, dict):
        return places.filter(is_known_type(list(mapping)))
    found = _look_up(places, mapping.withColumn("_known", F.lit(True)))
    kept = found.filter(F.col("_known") | F.col("udbLocationType").isNull())
    return kept.select(places.columns)


def map_type(places: DataFrame, mapping: Mapping) -> DataFrame:
    """Set the location type to the mapped catalogue type, where there is one.

    A mapped type replaces an existing location type; otherwise that type stays.
    """
    places = with_columns(places, ["udbLocationType", "locationType"])
    mapping = inline_map(mapping)
    if not isinstance(mapping, dict):
        found = _look_up(places, mapping)
        mapped = F.col("value")
    elif mapping:
        found = places
        pairs = [F.lit(x) for pair in mapping.items() for x in pair]
        mapped = F.try_element_at(F.create_map(*pairs), F.col("udbLocationType"))
    else:
        return places
    location_type = F.coalesce(mapped, F.col("locationType"))
    return found.withColumn("locationType", location_type).select(places.columns)


def _with_known(places: DataFrame, mapping: Mapping) -> tuple[DataFrame, Column]:
    """The rows, and whether a row's type passes the type filter."""
    mapping = inline_map(mapping)
    if isinstance(mapping, dict):
        return places, is_known_type(list(mapping))
    found = _look_up(places, mapping.select("key", F.lit(True).alias("_listed")))
    return found, F.coalesce("_listed", F.col("udbLocationType").isNull())


def _look_up(places: DataFrame, mapping: DataFrame) -> DataFrame:
    """The rows with their value of the mapping, by a plain join that reads the places once.

    Few types cover most rows. A mapping that Spark can send along needs no shuffle; beyond that
    size Spark splits the partitions that come out too large, as only the places can be many.
    """
    return places.join(mapping.withColumnRenamed("key", "udbLocationType"), "udbLocationType", "left")


# -- quarantine ---------------------------------------------------------------------------


def inline_patterns(patterns: Patterns) -> Patterns:
    """The non-blank lines, stripped, as a list, unless there are too many to put into a plan."""
    if isinstance(patterns, list):
        return [p.strip() for p in patterns if p.strip()]
    lines = _lines(patterns)
    few = lines.limit(INLINE_ROWS + 1).collect()
    return lines if len(few) > INLINE_ROWS else [r["pattern"] for r in few]


def _lines(patterns: DataFrame) -> DataFrame:
    lines = patterns.select(strip(F.col(patterns.columns[0])).alias("pattern"))
    return lines.filter("pattern != ''").distinct()


def matches_any(text: Column, patterns: list[str], mode: str = "regex") -> Column:
    """Whether the text contains a match (regex), contains (literal) or is (exact) a pattern."""
    if not patterns:
        return F.lit(False)
    if mode == "exact":
        return F.coalesce(text.isin(patterns), F.lit(False))
    literal = mode == "literal"
    together = [re.escape(p) if literal else p for p in patterns if literal or _MERGES.fullmatch(p)]
    alone = [p for p in patterns if not (literal or _MERGES.fullmatch(p))]
    for start in range(0, len(together), PATTERNS_PER_FILTER):
        batch = together[start : start + PATTERNS_PER_FILTER]
        alone.append("|".join(f"(?:{p})" for p in batch))
    return F.coalesce(_any([text.rlike(p) for p in alone]), F.lit(False))


def _any(tests: list[Column]) -> Column:
    """The tests joined by OR, as a tree that stays flat however many there are."""
    while len(tests) > 1:
        tests = [reduce(Column.__or__, tests[i : i + 2]) for i in range(0, len(tests), 2)]
    return tests[0]


def remove_quarantined(
    places: DataFrame, patterns: Patterns, mode: str = "regex", stage: Stage | None = None
) -> DataFrame:
    """Drop the rows whose id matches a pattern; modes as in `matches_any`.

    A short list becomes one filter on the id, which also moves below a collapse per id. A long
    table is joined. The ids are compared apart from the rows, so with a `stage` the rows are
    written first; without one Spark works them out twice.
    """
    if mode not in ("regex", "literal", "exact"):
        raise ValueError(f"unknown mode {mode!r}")
    patterns = inline_patterns(patterns)
    if isinstance(patterns, list):
        return places.filter(~matches_any(F.col("subject"), patterns, mode))
    if mode == "exact":
        return places.join(patterns.withColumnRenamed("pattern", "subject"), "subject", "left_anti")
    if stage:
        places = stage.keep(places, "quarantine")
        patterns = stage.keep(patterns, "patterns")
    if mode == "literal":
        keyed = patterns.select("pattern", F.col("pattern").alias("literal"))
        return _remove_containing(places, keyed, F.lit(True))
    literals = F.pandas_udf(_required_literals, "array<string>")(F.col("pattern"))
    keyed = patterns.select("pattern", F.explode_outer(literals).alias("literal"))
    kept = _remove_containing(
        places, keyed.filter("literal IS NOT NULL"), F.rlike("subject", F.col("pattern"))
    )
    # What no fixed text belongs to has to be tried on every id; that is bounded in no other way.
    alone = [r["pattern"] for r in keyed.filter("literal IS NULL").select("pattern").collect()]
    return kept.filter(~matches_any(F.col("subject"), alone))


def _required_literals(patterns: pd.Series) -> pd.Series:
    return patterns.map(required_literals)


def _remove_containing(places: DataFrame, keyed: DataFrame, also: Column) -> DataFrame:
    """Drop ids that contain the literal of a row of `keyed` (pattern, literal) for which `also` holds.

    Ids and literals meet at the literal's first LITERAL_KEY characters, or at any other so many in a
    row that fewer literals have; a shorter literal is a key as a whole. So an id makes no more rows
    than it has characters for each length of key, and a beginning that all literals share is no
    key. A key that very many ids hold lies on the side that Spark splits when it is too large.
    """

    def substrings(text: str, size: Column | int) -> Column:
        last = F.char_length(text) - size + 1
        parts = F.transform(F.sequence(F.lit(1), last), lambda at: F.substring(F.col(text), at, size))
        return F.when(last >= 1, F.array_distinct(parts)).otherwise(F.array())

    size = F.least(F.char_length("literal"), F.lit(LITERAL_KEY))
    parts = keyed.select("pattern", "literal", F.explode(substrings("literal", size)).alias("part"))
    held = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    rarest = parts.join(held, "part").groupBy("pattern", "literal")
    keyed = rarest.agg(F.min(F.struct("n", "part")).alias("key"))
    keyed = keyed.select("pattern", "literal", "key.part")
    sizes = [r[0] for r in keyed.select(F.char_length("part")).distinct().collect()]
    if not sizes:
        return places
    ids = places.select("subject").distinct()
    held_by_id = F.concat(*[substrings("subject", size) for size in sorted(sizes)])
    met = ids.select("subject", F.explode(held_by_id).alias("part")).join(keyed, "part")
    hits = met.filter(F.contains("subject", "literal") & also).select("subject").distinct()
    return places.join(hits, "subject", "left_anti")


# -- stage counts -------------------------------------------------------------------------


def stage_counts(
    places: DataFrame,
    mapping: Mapping,
    patterns: Patterns,
    stage: Stage,
    mode: str = "regex",
) -> DataFrame:
    """Row counts after load, type filter, collapse per id and quarantine, as (stage, n).

    One scan and one combined aggregation per id, written once; mapping and patterns are those of
    the cleansing job. Counts are ordinary aggregates, so they stay right when a task runs again.
    """
    places = with_columns(places, ["udbLocationType"]).select("subject", "udbLocationType")
    places, known = _with_known(places, mapping)
    per_id = places.groupBy("subject").agg(
        F.count(F.lit(1)).alias("_loaded"), F.count_if(known).alias("_known")
    )
    per_id = stage.keep(per_id, "per-id")
    kept = remove_quarantined(known_ids(per_id).select("subject"), patterns, mode, stage)
    return counts_of(per_id, kept)


def known_ids(per_id: DataFrame) -> DataFrame:
    """The ids of a counted table that have a row of a known type."""
    return per_id.filter("_known > 0 AND subject IS NOT NULL")


def counts_of(per_id: DataFrame, kept: DataFrame) -> DataFrame:
    """(stage, n) from a table with `_loaded` and `_known` per id, and the rows left at the end."""

    def rows(name: str, total: Column, table: DataFrame) -> DataFrame:
        return table.agg(F.coalesce(total, F.lit(0)).alias("n")).select(F.lit(name).alias("stage"), "n")

    counts = [
        rows("load", F.sum("_loaded"), per_id),
        rows("filter", F.sum("_known"), per_id),
        rows("group", F.count(F.lit(1)), known_ids(per_id)),
        rows("remove", F.count(F.lit(1)), kept),
    ]
    return reduce(DataFrame.union, counts)
