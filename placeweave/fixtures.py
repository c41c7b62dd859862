"""Places, a second source, a quad store and code lists, derived from the driver's tables.

The places texts run unchanged in Spark and in the checking engine. Quads are listed once, as
rules, and each engine gets its own form of the same rules.
"""

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.vocabulary import ADMS, ADRES, DCT, GEBOUW, GEO, INFRA, LOCN, PLATFORM, PROV
from placeweave.vocabulary import RDF_TYPE, SKOS

_BASE = """
b AS (
  SELECT p.p_partkey AS n, CAST(floor(p.p_partkey / 8) AS INT) AS e,
         CAST(p.p_partkey % 8 AS INT) AS v,
         q.p_name AS nm, q.p_brand AS br, q.p_type AS ty, m.n_name AS city
  FROM part p
  JOIN part q   ON q.p_partkey = p.p_partkey - p.p_partkey % 8
  JOIN nation m ON m.n_nationkey = CAST(floor(p.p_partkey / 8) AS INT) % 25),
w AS (
  SELECT *, nm || ' ' || chr(97 + e % 26) || chr(97 + CAST(floor(e / 26) AS INT) % 26)
               || chr(97 + CAST(floor(e / 676) AS INT) % 26) AS base FROM b)"""

_PLACES = """
  SELECT
    n, e, v,
    'https://places.example/id/' || lpad(CAST(n AS VARCHAR(8)), 8, '0') AS subject,
    CASE WHEN v = 6 AND e % 41 = 7 THEN NULL
         WHEN v = 6 AND e % 41 = 8 THEN '/'
         WHEN v = 6 AND e % 41 = 9 THEN chr(39)
         WHEN v = 6 AND e % 41 = 10 THEN '&#039;t ' || base
         WHEN v = 6 AND e % 41 = 11 THEN '’T ' || base
         WHEN v = 0 THEN base
         WHEN v = 1 THEN upper(base) || ' 7'
         WHEN v = 2 THEN '“' || base || '”'
         WHEN v = 3 THEN '"' || base || '"?'
         WHEN v = 4 THEN 'zaal ' || base
         WHEN v = 5 THEN base || '  zaal'
         WHEN v = 6 THEN 'annex-' || base
         ELSE base || ' yard/store' END AS locationName,
    ty AS locationType,
    br || ' 1, ' || city AS fullAddress,
    br || CASE WHEN v < 2 THEN ' straat' WHEN v = 2 THEN ' laan' WHEN v = 3 THEN ' dreef'
               WHEN v IN (4, 5) THEN ' plein' WHEN v = 6 OR e % 3 = 0 THEN ' kaai'
               ELSE ' kade' END AS thoroughfare,
    CAST(1 + e % 90 AS VARCHAR(8)) AS huisnummer,
    CAST(NULL AS VARCHAR(8)) AS busnummer,
    CAST(1000 + e AS VARCHAR(8)) || CASE WHEN e % 2 = 0 THEN '.0' ELSE '' END AS postCode,
    CASE WHEN e % 5 = 0 AND v < 4 THEN NULL ELSE city END AS city,
    CAST(NULL AS VARCHAR(8)) AS gml,
    CAST(NULL AS VARCHAR(8)) AS point,
    'https://sources.example/one' AS bron,
    CASE WHEN e % 7 = 0 THEN NULL WHEN e % 7 = 1 THEN 'https://taxonomy.example/terms/other'
         ELSE 'https://taxonomy.example/terms/' || CAST(e % 5 AS VARCHAR(8)) END
      AS udbLocationType
  FROM w"""

# The second source lists every ninth place again, in its own words and without the type.
_PLACES2 = """
  SELECT
    n,
    'https://places.example/id/' || lpad(CAST(n AS VARCHAR(8)), 8, '0') AS subject,
    'alt ' || base AS locationName,
    ty AS locationType,
    br || ' 1, ' || city AS fullAddress,
    CAST(NULL AS VARCHAR(8)) AS thoroughfare,
    CAST(1 + e % 90 AS VARCHAR(8)) AS huisnummer,
    'b' || CAST(v AS VARCHAR(8)) AS busnummer,
    CAST(1000 + e AS VARCHAR(8)) AS postCode,
    city,
    CAST(NULL AS VARCHAR(8)) AS gml,
    CAST(NULL AS VARCHAR(8)) AS point,
    'https://sources.example/two' AS bron
  FROM w
  WHERE n % 9 = 0"""

# (key, value) of the type mapping; two of the types that places have are left out.
MAPPING = {
    f"https://taxonomy.example/terms/{i}": f"https://types.example/id/type#{i}" for i in range(4)
}
# Two ids, a pattern whose dot matches another character, and a blank line.
QUARANTINE = [
    "https://places.example/id/00000016",
    "https://places.example/id/00000045",
    "",
    "places.example.id/00000[01]88",
]
QUARANTINE_TEXT = ["id/00000016", "00000045", "  ", "places.example.id/"]
QUARANTINE_IDS = [f"https://places.example/id/{i:08d}" for i in (3, 16, 45, 190)]

# Longer lists than plans hold as literals; nothing in the places meets what is added.
LONG_MAPPING = {**{f"https://taxonomy.example/none/{i}": "none" for i in range(1_200)}, **MAPPING}
LONG_QUARANTINE = [*QUARANTINE, *(f"nowhere/{i}[a-c]+(?:/|$)" for i in range(5_000))]
LONG_QUARANTINE_TEXT = [*QUARANTINE_TEXT, *(f"nowhere/{i}" for i in range(1_200))]

# Added to the position of a place that a CSV source lists again.
AGAIN = 1_000_000_000

# Places whose quads one task makes, about ten for each place. A small file of parts becomes many
# quads, so Spark's splits by bytes would leave them all to a few tasks.
PLACES_A_TASK = 20_000

# Places whose quads one bucket of a store holds, which one task sorts and gathers.
PLACES_A_BUCKET = 100_000
BUCKETS_AT_LEAST = 8

_ADDRESS, _ID, _GEO, _NODE = (f"subject || '/{x}'" for x in ("address", "id", "geo", "node"))
_GML = "'<gml:Point>' || CAST(n AS VARCHAR(8)) || '</gml:Point>'"
_BRON = "'https://sources.example/' || CAST(n % 6 AS VARCHAR(8))"


def _address(when: str, graph: str, postcode: str, city: str, number: str | None):
    rows = [
        (when, graph, _ADDRESS, LOCN + "fullAddress", "fullAddress"),
        (when, graph, _ADDRESS, LOCN + "thoroughfare", "thoroughfare"),
        (when, graph, _ADDRESS, postcode, "postCode"),
        (when, graph, _ADDRESS, city, "city"),
    ]
    if number:
        rows.append((f"{when} AND e % 7 <> 3", graph, _ADDRESS, number, "huisnummer"))
    return rows


def _identified(when: str, name: str, link: str | None):
    rows = [
        (when, "NULL", _NODE, ADMS + "identifier", _ID),
        (when, "NULL", _ID, SKOS + "notation", "subject"),
        (when, "NULL", _ID, PLATFORM + "bron", _BRON),
        (when, "NULL", _NODE, name, "locationName"),
        (f"{when} AND e % 5 = 2", "NULL", _NODE, name, "locationName || ' bis'"),
        (when, "NULL", _NODE, INFRA + "Infrastructuur.type", "locationType"),
    ]
    if link:
        rows.append((when, "NULL", _NODE, link, _ADDRESS))
    return rows


def _geometry(when: str):
    return [
        (when, "NULL", _NODE, LOCN + "geometry", _GEO),
        (when, "NULL", _GEO, LOCN + "gml", _GML),
    ]


# Quads as (condition, graph, subject, predicate, object); all but the predicate are SQL texts
# over a places row. Every sixth place goes to the same source. Rows without object are dropped.
_OPEN, _BUILT = "n % 6 = 1 AND e % 2 = 1", "n % 6 = 1 AND e % 2 = 0"
QUAD_RULES = [
    ("n % 6 = 0", "subject", "subject", RDF_TYPE, f"'{DCT}Location'"),
    ("n % 6 = 0", "subject", "subject", LOCN + "locatorName", "locationName"),
    ("n % 24 = 0", "subject", "subject", LOCN + "locatorName", "locationName || ' bis'"),
    ("n % 36 = 0", "NULL", "subject", LOCN + "locatorName", "locationName"),
    ("n % 6 = 0", "subject", "subject", LOCN + "address", _ADDRESS),
    ("n % 48 = 0", "subject", "subject", LOCN + "address", "subject || '/second'"),
    *_address("n % 6 = 0", "subject", LOCN + "postcode", LOCN + "postName", None),
    ("n % 18 <> 6 AND n % 6 = 0", "subject", _ADDRESS, LOCN + "locatorDesignator", "huisnummer"),
    ("n % 18 = 6", "'https://graphs.example/other'", _ADDRESS, LOCN + "locatorDesignator", "'9'"),
    ("n % 6 = 0", "subject", "subject", LOCN + "geometry", _GEO),
    ("n % 6 = 0", "subject", _GEO, GEO + "asGML", _GML),
    ("n % 6 = 0", "subject", "subject", DCT + "type", "udbLocationType"),
    ("n % 30 = 0", "subject", "subject", PROV + "invalidatedAtTime", "'2024-01-01'"),
    *_identified(_BUILT, GEBOUW + "gebouwnaam", GEBOUW + "Gebouw.adres"),
    (_BUILT, "NULL", _NODE, RDF_TYPE, f"'{GEBOUW}Gebouw'"),
    *_address(_BUILT, "NULL", LOCN + "postCode", ADRES + "gemeentenaam",
              ADRES + "adresvoorstelling.huisnummer"),
    *_identified(_OPEN, INFRA + "Infrastructuur.naam", LOCN + "address"),
    (_OPEN, "NULL", _NODE, RDF_TYPE, f"'{INFRA}Buitenruimte'"),
    *_address(_OPEN, "NULL", LOCN + "postCode", LOCN + "postName", None),
    *_geometry(_OPEN),
    ("n % 6 = 2", "NULL", "subject", RDF_TYPE, f"'{INFRA}Infrastructuur'"),
    ("n % 6 = 2", "NULL", "subject", INFRA + "Infrastructuur.locatie", _ADDRESS),
    ("n % 6 = 2", "NULL", "subject", ADMS + "identifier", _ID),
    ("n % 6 = 2", "NULL", _ID, PLATFORM + "bron", _BRON),
    *_address("n % 6 = 2", "NULL", LOCN + "postCode", ADRES + "gemeentenaam",
              ADRES + "Adresvoorstelling.huisnummer"),
    *_identified("n % 6 = 3", INFRA + "Infrastructuur.naam", INFRA + "Infrastructuur.locatie"),
    ("n % 6 = 3 AND e % 5 = 2", "NULL", _ADDRESS, LOCN + "postCode", "'9999'"),
    *_address("n % 6 = 3", "NULL", LOCN + "postCode", ADRES + "gemeentenaam",
              ADRES + "Adresvoorstelling.huisnummer"),
    *_identified("n % 6 = 4", GEBOUW + "gebouwnaam", GEBOUW + "adres"),
    *_address("n % 6 = 4", "NULL", LOCN + "postCode", ADRES + "gemeentenaam",
              ADRES + "Adresvoorstelling.huisnummer"),
    *_identified("n % 6 = 5", INFRA + "Infrastructuur.naam", None),
    *_geometry("n % 6 = 5"),
]

# -- texts for the checking engine --------------------------------------------------------


def places_cte() -> str:
    return f"{_BASE},\nplaces AS ({_PLACES}),\nplaces2 AS ({_PLACES2})"


def quads_cte() -> str:
    rows = [
        f"SELECT CAST({g} AS VARCHAR) AS g, {s} AS s, '{p}' AS p, {o} AS o "
        f"FROM places WHERE {when} AND {o} IS NOT NULL"
        for when, g, s, p, o in QUAD_RULES
    ]
    return places_cte() + ",\nquads AS MATERIALIZED (\n" + "\nUNION ALL ".join(rows) + ")"


# -- tables for Spark ---------------------------------------------------------------------


def _derive(spark: SparkSession, sf_dir: str, text: str, **dealt: DataFrame) -> DataFrame:
    """`dealt` may hold the parts as `p` and as `q`, laid out anew."""
    part, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "nation"))
    text = f"WITH {_BASE} {text}".replace("part p", "{p} p").replace("part q", "{q} q")
    tables = {"p": part, "q": part, "nation": nation, **dealt}
    return spark.sql(text.replace("nation m", "{nation} m"), **tables)


def places_with_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, _PLACES)


def _dealt_places(spark: SparkSession, sf_dir: str, tasks: int) -> DataFrame:
    """The places with position, made by many tasks however the parts lie in their file.

    A task holds the rows that it deals out to so many others. So the one that reads a large row
    group deals out bare keys, and names only of the parts that head a group of eight; the long
    rows of places are made behind that. Without the hint all keys would be sent to every task, and
    the places made where the names are read.
    """
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    keys = part.select("p_partkey").repartition(tasks, F.expr("p_partkey - p_partkey % 8"))
    return _derive(spark, sf_dir, _PLACES, p=keys.hint("merge"), q=part.filter("p_partkey % 8 = 0"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places_with_position(spark, sf_dir).drop("n", "e", "v")


def places2_with_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, _PLACES2)


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All quads from one scan of the places: each row yields an array of its quads.

    The places are dealt out first, to as many tasks as their number asks for.
    """

    def quad(when: str, g: str, s: str, p: str, o: str):
        text = f"named_struct('g', CAST({g} AS STRING), 's', {s}, 'p', '{p}', 'o', {o})"
        return F.expr(f"CASE WHEN {when} THEN {text} END")

    rows = F.array(*[quad(*rule) for rule in QUAD_RULES])
    tasks = max(1, _shares(spark, sf_dir, PLACES_A_TASK))
    source = _dealt_places(spark, sf_dir, tasks).repartition(tasks, "n")
    return source.select(F.inline(F.array_compact(rows))).filter("o IS NOT NULL")


def store_buckets(spark: SparkSession, sf_dir: str) -> int:
    """As many buckets as keep the quads of one in a task's memory."""
    return max(BUCKETS_AT_LEAST, _shares(spark, sf_dir, PLACES_A_BUCKET))


def _shares(spark: SparkSession, sf_dir: str, places_each: int) -> int:
    return math.ceil(spark.read.parquet(f"{sf_dir}/part.parquet").count() / places_each)
