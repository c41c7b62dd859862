"""Graph patterns over quads (g, s, p, o); `g` is null in the default graph.

All properties a job needs are gathered in one scan and one combined aggregation per node,
instead of one scan and join per property. Values of a property are only joined one by one for
the nodes that have several.
"""

import math
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from placeweave.operators.skew import HOT_ROWS, Hot, hot_from_counts, salted_join
from placeweave.staging import Stage
from placeweave.vocabulary import DEFAULT_GRAPH_CLASSES, NAMED_GRAPH_CLASSES, RDF_TYPE

# Buckets of a sketch, as a power of two, and the standard error that goes with them.
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / math.sqrt(1 << SKETCH_BITS)


def default_graph(quads: DataFrame, union: bool = False) -> DataFrame:
    """Triples (s, p, o) of the default graph.

    Some stores let the default graph hold the triples of all graphs; `union` reads it so.
    """
    if union:
        return quads.select("s", "p", "o").distinct()
    return quads.filter("g IS NULL").select("s", "p", "o")


def named_graphs(quads: DataFrame) -> DataFrame:
    return quads.filter("g IS NOT NULL")


@dataclass(frozen=True)
class Nodes:
    """One row per node with the count and the smallest value of each property.

    `table` has the columns `keys`, then `n<i>` and `v<i>` for the i-th property; `most` is the
    highest count of each property on any node, and `size` at least the number of nodes.
    """

    table: DataFrame
    triples: DataFrame
    keys: tuple[str, ...]
    properties: tuple[str, ...]
    most: tuple[int, ...]
    size: int

    def count(self, iri: str) -> Column:
        return F.col(f"n{self.properties.index(iri)}")

    def value(self, iri: str) -> Column:
        return F.col(f"v{self.properties.index(iri)}")

    def repeated(self, iri: str) -> bool:
        return self.most[self.properties.index(iri)] > 1

    def solutions_at_most(self, iris: Iterable[str]) -> int:
        """No star over these properties has more rows."""
        return math.prod((max(1, self.most[self.properties.index(p)]) for p in iris), start=self.size)


def gather_nodes(triples: DataFrame, properties: list[str], stage: Stage) -> Nodes:
    """Gather the listed properties of every node; `triples` may carry the graph `g`.

    A store holds a statement once, so statements that repeat count once.
    """
    keys = ["g", "s"] if "g" in triples.columns else ["s"]
    properties = list(dict.fromkeys(properties))
    relevant = triples.filter(F.col("p").isin(properties))
    # Long IRIs that begin alike are compared once per row; a number stands for them in all that is
    # shuffled, made distinct, sorted and measured.
    number = F.array_position(F.array(*map(F.lit, properties)), F.col("p")).cast("int")
    numbered = relevant.select(*keys, number.alias("number"), "o").distinct()
    measures, peaks = [], {}
    for i in range(len(properties)):
        is_property = F.col("number") == i + 1
        measures.append(F.count_if(is_property).alias(f"n{i}"))
        measures.append(F.min(F.when(is_property, F.col("o"))).alias(f"v{i}"))
        peaks[f"n{i}"] = F.max(f"n{i}")
    table, seen = stage.keep_measured(
        numbered.groupBy(*keys).agg(*measures), "nodes", size=F.count(F.lit(1)), **peaks
    )
    most = tuple(seen[c] for c in peaks)
    relevant = relevant.select(*keys, "p", "o").distinct()
    return Nodes(table, relevant, tuple(keys), tuple(properties), most, seen["size"])


def star(
    nodes: Nodes,
    values: dict[str, str],
    where: Column | None = None,
    one_value: tuple[str, ...] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Nodes that have every property in `values` (column -> property), one row per solution.

    A property with several values multiplies the rows, except the columns in `one_value`, which
    take the smallest value.
    """
    rows = nodes.table if where is None else nodes.table.filter(where)
    for iri in values.values():
        rows = rows.filter(nodes.count(iri) > 0)
    keys = list(nodes.keys)
    spread = {c: p for c, p in values.items() if c not in one_value and nodes.repeated(p)}
    if not spread:
        return rows.select(*keys, *[nodes.value(p).alias(c) for c, p in values.items()])

    several = F.lit(False)
    for iri in spread.values():
        several |= nodes.count(iri) > 1
    plain = rows.filter(~several)
    plain = plain.select(*keys, *[nodes.value(p).alias(c) for c, p in values.items()])
    single = [nodes.value(p).alias(c) for c, p in values.items() if c not in spread]
    many = rows.filter(several).select(*keys, *single)
    # A node's rows after each join are the product of its counts so far.
    joined: list[str] = []
    for column, iri in spread.items():
        joined.append(iri)
        hot = {}
        if math.prod(nodes.most[nodes.properties.index(p)] for p in joined) >= hot_rows:
            made = rows.select(*keys, solutions(nodes, joined).alias("_n"))
            hot = hot_from_counts(made, keys, "_n", hot_rows)
        objects = nodes.triples.filter(F.col("p") == iri).select(*keys, F.col("o").alias(column))
        many = salted_join(objects, many, keys, hot)
    return plain.unionByName(many.select(plain.columns))


def solutions(nodes: Nodes, iris: Iterable[str]) -> Column:
    """A node's number of solutions over some properties, as a double, which no product exceeds."""
    return reduce(Column.__mul__, [nodes.count(p).cast("double") for p in iris], F.lit(1.0))


def weights(
    nodes: Nodes,
    own: list[str],
    followed: dict[str, list[str]],
    where: Column | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The rows that each node contributes: its solutions over `own`, times, for each link in
    `followed`, the solutions that all its targets have over their properties (keys, `_weight`)."""
    rows = nodes.table if where is None else nodes.table.filter(where)
    for iri in (*own, *followed):
        rows = rows.filter(nodes.count(iri) > 0)
    keys = list(nodes.keys)
    found = rows.select(*keys, solutions(nodes, own).alias("_weight"))
    for iri, properties in followed.items():
        target = nodes.table.select(
            *[F.col(k).alias("_link") if k == "s" else F.col(k) for k in keys],
            solutions(nodes, properties).alias("_solutions"),
        )
        ends = [k if k != "s" else "_link" for k in keys]
        links = _links(nodes, iri, "_link")
        hot = hot_targets(nodes, iri, None, hot_rows, "_link")
        sums = salted_join(links, target.filter("_solutions > 0"), ends, hot)
        sums = sums.groupBy(*keys).agg(F.sum("_solutions").alias("_sum"))
        found = found.join(sums, keys).select(*keys, (F.col("_weight") * F.col("_sum")).alias("_weight"))
    return found


def _links(nodes: Nodes, iri: str, link: str) -> DataFrame:
    return nodes.triples.filter(F.col("p") == iri).select(*nodes.keys, F.col("o").alias(link))


def hot_targets(
    nodes: Nodes, iri: str, weight: DataFrame | None, hot_rows: int, link: str = "link"
) -> Hot:
    """The targets of links by `iri` that so many rows reach, counted exactly.

    Each link brings the `weight` of its node, or one row. So there are as many hot targets at most
    as all rows have `hot_rows`, whatever single nodes are like.
    """
    links = _links(nodes, iri, link)
    rows = F.lit(1)
    if weight is not None:
        i = nodes.properties.index(iri)
        keys = list(nodes.keys)
        hot = hot_from_counts(nodes.table, keys, f"n{i}", hot_rows) if nodes.most[i] >= hot_rows else {}
        links, rows = salted_join(links, weight, keys, hot), F.col("_weight")
    ends = [k if k != "s" else link for k in nodes.keys]
    return hot_from_counts(links.groupBy(*ends).agg(F.sum(rows).alias("_n")), ends, "_n", hot_rows)


def follow(
    rows: DataFrame,
    link: str,
    nodes: Nodes,
    values: dict[str, str],
    one_value: tuple[str, ...] = (),
    hot_rows: int = HOT_ROWS,
    hot: Hot | None = None,
) -> DataFrame:
    """Join each row with the star of the node that its column `link` points at.

    Many rows may point at one node, so the `hot` targets are salted. The link column is dropped.
    """
    target = star(nodes, values, None, one_value, hot_rows).withColumnRenamed("s", link)
    keys = [k if k != "s" else link for k in nodes.keys]
    return salted_join(rows, target, keys, hot or {}).drop(link)


# -- whole-store queries ------------------------------------------------------------------


def head(quads: DataFrame, limit: int = 5, ordered: bool = True) -> DataFrame:
    """The first quads: those of named graphs, then default triples that are in no named graph.

    Ordered by (g, s, p, o), so that the answer is the same on every run. Without `ordered` any of
    them, found at once: Spark reads the store partition by partition until there are enough.
    """
    if not ordered:
        return _any_quads(quads, limit)
    order = [F.asc_nulls_last("g"), "s", "p", "o"]
    columns = ["g", "s", "p", "o"]
    named = named_graphs(quads).select(columns).distinct()
    known = named.select("s", "p", "o").distinct()
    rest = default_graph(quads).distinct().join(known, ["s", "p", "o"], "left_anti")
    rest = rest.withColumn("g", F.lit(None).cast("string")).select(columns)
    found = named.unionByName(rest)
    return found.orderBy(*order).limit(limit)


def _any_quads(quads: DataFrame, limit: int) -> DataFrame:
    """Some quads for `head`. Default triples are taken only if the named graphs have fewer than
    `limit` quads, so that those taken are all that a default triple has to be told apart from."""
    quads = quads.select("g", "s", "p", "o")
    found = _different(named_graphs(quads), limit)
    known = {tuple(row[1:]) for row in found if None not in row}
    missing = limit - len(found)
    if missing > 0:
        rest = _different(default_graph(quads), missing + len(known))
        found += [(None, *row) for row in rest if tuple(row) not in known][:missing]
    return quads.sparkSession.createDataFrame(found, quads.schema)


def _different(rows: DataFrame, limit: int) -> list[Row]:
    """Up to `limit` different rows, all of them if there are fewer.

    A statement rarely repeats, so a few slices, each larger than the last, suffice; if they hold
    too many equal rows, Spark makes the rows distinct.
    """
    for size in (limit, 4 * limit, 16 * limit):
        slice_ = rows.take(size)
        found = list(dict.fromkeys(slice_))
        if len(found) >= limit or len(slice_) < size:
            return found[:limit]
    return rows.distinct().limit(limit).collect()


def _counted_subjects(quads: DataFrame, union: bool) -> DataFrame:
    in_named = F.col("g").isNotNull() & F.col("o").isin(NAMED_GRAPH_CLASSES)
    in_default = F.col("o").isin(DEFAULT_GRAPH_CLASSES)
    if not union:
        in_default &= F.col("g").isNull()
    return quads.filter((F.col("p") == RDF_TYPE) & (in_named | in_default)).select("s")


def subject_count(quads: DataFrame, union: bool = False) -> DataFrame:
    """Number of distinct subjects of the counted classes, from one scan."""
    return _counted_subjects(quads, union).agg(F.count_distinct("s").alias("subjectCount"))


def subject_sketch(quads: DataFrame, union: bool = False) -> DataFrame:
    """A sketch of the same subjects, one row of a few kB that can be kept; nothing is shuffled but
    one sketch per task."""
    return _counted_subjects(quads, union).agg(F.hll_sketch_agg("s", SKETCH_BITS).alias("sketch"))


def sketched_subject_count(sketches: DataFrame) -> DataFrame:
    """The estimated number of different subjects behind all rows of `sketches` together, of one store
    or of several; 0 if there are none. Its standard error is SKETCH_ERROR of the number."""
    merged = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return sketches.agg(F.coalesce(merged, F.lit(0)).alias("subjectCount"))
