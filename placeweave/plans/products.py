"""The catalogue of extraction jobs: quads in, flat place records out.

Each job is a graph pattern; predicates are case-sensitive and differ per source.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.operators.graph import (
    Nodes,
    default_graph,
    follow,
    gather_nodes,
    head,
    hot_targets,
    named_graphs,
    star,
    subject_count,
    weights,
)
from placeweave.operators.skew import HOT_ROWS
from placeweave.schema import PLACE_COLUMNS, RECORD_COLUMNS
from placeweave.staging import Stage
from placeweave.vocabulary import (
    ADMS,
    ADRES,
    DCT,
    GEBOUW,
    GEO,
    INFRA,
    LOCN,
    PLACES_SOURCE,
    PLATFORM,
    PROV,
    RDF_TYPE,
    SKOS,
)

# Which property fills which column, per kind of node.
IDENTIFIER = {"subject": SKOS + "notation", "bron": PLATFORM + "bron"}
BUILDING_ADDRESS = {
    "fullAddress": LOCN + "fullAddress",
    "postCode": LOCN + "postCode",
    "city": ADRES + "gemeentenaam",
    "thoroughfare": LOCN + "thoroughfare",
    "huisnummer": ADRES + "adresvoorstelling.huisnummer",
}
OPEN_AIR_ADDRESS = {
    "fullAddress": LOCN + "fullAddress",
    "postCode": LOCN + "postCode",
    "city": LOCN + "postName",
    "thoroughfare": LOCN + "thoroughfare",
}
SITE_ADDRESS = {
    "fullAddress": LOCN + "fullAddress",
    "postCode": LOCN + "postCode",
    "city": ADRES + "gemeentenaam",
    "thoroughfare": LOCN + "thoroughfare",
    "huisnummer": ADRES + "Adresvoorstelling.huisnummer",
}
EVENT_ADDRESS = {
    "postCode": LOCN + "postcode",
    "city": LOCN + "postName",
    "fullAddress": LOCN + "fullAddress",
    "thoroughfare": LOCN + "thoroughfare",
    "huisnummer": LOCN + "locatorDesignator",
}
GEOMETRY = {"gml": LOCN + "gml"}

# One pattern of a source with identifier nodes: the node's own values and its links.
Pattern = tuple[dict[str, str], dict[str, dict[str, str]]]

BUILDING: Pattern = (
    {"locationName": GEBOUW + "gebouwnaam", "locationType": INFRA + "Infrastructuur.type"},
    {ADMS + "identifier": IDENTIFIER, GEBOUW + "Gebouw.adres": BUILDING_ADDRESS},
)
OPEN_AIR: Pattern = (
    {"locationName": INFRA + "Infrastructuur.naam", "locationType": INFRA + "Infrastructuur.type"},
    {
        ADMS + "identifier": IDENTIFIER,
        LOCN + "address": OPEN_AIR_ADDRESS,
        LOCN + "geometry": GEOMETRY,
    },
)
FACILITY: Pattern = (
    {},
    {
        ADMS + "identifier": {"bron": PLATFORM + "bron"},
        INFRA + "Infrastructuur.locatie": SITE_ADDRESS,
    },
)
HERITAGE: Pattern = (
    {"locationName": INFRA + "Infrastructuur.naam", "locationType": INFRA + "Infrastructuur.type"},
    {ADMS + "identifier": IDENTIFIER, INFRA + "Infrastructuur.locatie": SITE_ADDRESS},
)
CAMP_SITE: Pattern = (
    {"locationName": GEBOUW + "gebouwnaam", "locationType": INFRA + "Infrastructuur.type"},
    {ADMS + "identifier": IDENTIFIER, GEBOUW + "adres": SITE_ADDRESS},
)
PLAY_ZONE: Pattern = (
    {"locationName": INFRA + "Infrastructuur.naam", "locationType": INFRA + "Infrastructuur.type"},
    {ADMS + "identifier": IDENTIFIER, LOCN + "geometry": GEOMETRY},
)


def _properties(patterns: list[Pattern]) -> list[str]:
    found = []
    for values, links in patterns:
        found += [*values.values(), *links]
        for target in links.values():
            found += target.values()
    return found


def _solutions(
    nodes: Nodes, pattern: Pattern, hot_rows: int, where: Column | None = None
) -> DataFrame:
    values, links = pattern
    linked = {f"link{i}": iri for i, iri in enumerate(links)}
    rows = star(nodes, {**values, **linked}, where, hot_rows=hot_rows)
    at_most = nodes.solutions_at_most([*values.values(), *links])
    followed: dict[str, list[str]] = {}
    for link, iri in linked.items():
        target = links[iri]
        hot = {}
        if at_most >= hot_rows:
            # What multiplies a link: the node's own values, its other links, and what was reached.
            own = [*values.values(), *(other for other in links if other not in (iri, *followed))]
            weight = weights(nodes, own, followed, where, hot_rows)
            hot = hot_targets(nodes, iri, weight, hot_rows, link)
        rows = follow(rows, link, nodes, target, hot_rows=hot_rows, hot=hot)
        at_most *= nodes.solutions_at_most(target.values()) / max(1, nodes.size)
        followed[iri] = list(target.values())
    return rows


def _record(rows: DataFrame, unbound: tuple[str, ...] = ()) -> DataFrame:
    """The record columns in order: bound variables, nulls for unbound ones, else empty texts."""

    def column(name: str) -> Column:
        if name in rows.columns:
            return F.col(name)
        missing = F.lit(None).cast("string") if name in unbound else F.lit("")
        return missing.alias(name)

    return rows.select(*map(column, RECORD_COLUMNS))


def _of_class(triples: DataFrame, iri: str) -> DataFrame:
    """Leave only type statements for this class, next to all other statements."""
    return triples.filter((F.col("p") != RDF_TYPE) | (F.col("o") == iri))


def _identified(
    quads: DataFrame, patterns: list[Pattern], stage: Stage, union: bool, hot_rows: int
) -> DataFrame:
    triples = default_graph(quads, union)
    nodes = gather_nodes(triples, _properties(patterns), stage)
    found = [_record(_solutions(nodes, p, hot_rows)) for p in patterns]
    return reduce(DataFrame.unionByName, found)


def _identified_job(*patterns: Pattern) -> Callable[..., DataFrame]:
    def job(
        quads: DataFrame, stage: Stage, union: bool = False, hot_rows: int = HOT_ROWS
    ) -> DataFrame:
        return _identified(quads, list(patterns), stage, union, hot_rows)

    return job


def facilities(
    quads: DataFrame, stage: Stage, union: bool = False, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Facilities known by their IRI; this source gives them no name and no type."""
    triples = _of_class(default_graph(quads, union), INFRA + "Infrastructuur")
    nodes = gather_nodes(triples, [RDF_TYPE, *_properties([FACILITY])], stage)
    rows = _solutions(nodes, FACILITY, hot_rows, nodes.count(RDF_TYPE) > 0)
    return _record(
        rows.withColumnRenamed("s", "subject"), unbound=("locationName", "locationType")
    )


def event_places(
    quads: DataFrame, stage: Stage, union: bool = False, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Places of the event calendar that are still valid, one row per place.

    Each place is described in the graph that bears its own name. Of several values the smallest
    is taken, per column, so links are followed and reduced one at a time and never multiply.
    The geometry text goes to `point`; `gml` stays unbound.
    """
    address, geometry = LOCN + "address", LOCN + "geometry"
    own = {"locationName": LOCN + "locatorName", "udbLocationType": DCT + "type"}
    invalidated = PROV + "invalidatedAtTime"
    targets = {address: EVENT_ADDRESS, geometry: {"point": GEO + "asGML"}}
    properties = [RDF_TYPE, invalidated, *_properties([(own, targets)])]
    triples = _of_class(named_graphs(quads), DCT + "Location")
    nodes = gather_nodes(triples, properties, stage)

    is_place = (
        (F.col("g") == F.col("s")) & (nodes.count(RDF_TYPE) > 0) & (nodes.count(invalidated) == 0)
    )
    places = star(nodes, own, is_place, one_value=tuple(own))
    for iri, values in targets.items():
        links = star(nodes, {"link": iri}, is_place, hot_rows=hot_rows)
        links = links.withColumn("place", F.col("s")).drop("s")
        hot = {}
        if nodes.solutions_at_most([iri]) >= hot_rows:
            hot = hot_targets(nodes, iri, None, hot_rows)
        reached = follow(links, "link", nodes, values, tuple(values), hot_rows, hot)
        smallest = [F.min(c).alias(c) for c in values]
        reached = reached.groupBy("g", F.col("place").alias("s")).agg(*smallest)
        places = places.join(reached, ["g", "s"])
    constants = {
        "subject": F.col("s"),
        "locationType": F.lit(""),
        "busnummer": F.lit(""),
        "gml": F.lit(None).cast("string"),
        "bron": F.lit(PLACES_SOURCE),
    }
    return places.withColumns(constants).select(PLACE_COLUMNS)


# The names that jobs are asked for by.
PRODUCTS: dict[str, Callable[..., DataFrame]] = {
    "publiq": event_places,
    "jeugdmaps": _identified_job(BUILDING, OPEN_AIR),
    "kiosk": facilities,
    "erfgoed": _identified_job(HERITAGE),
    "kampas": _identified_job(CAMP_SITE),
    "anb": _identified_job(PLAY_ZONE),
}


def fetch(product: str, quads: DataFrame, stage: Stage, **options) -> DataFrame:
    """Records of one product, from that product's store of quads.

    `head` and `count` answer the two whole-store queries.
    """
    if product == "head":
        return head(quads, **options)
    if product == "count":
        return subject_count(quads, **options)
    if product not in PRODUCTS:
        raise ValueError(f"unknown product {product!r}; known: {', '.join(PRODUCTS)}")
    return PRODUCTS[product](quads, stage, **options)
