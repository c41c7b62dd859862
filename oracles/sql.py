"""Checking SQL per query, written independently of the DataFrame jobs, for DuckDB."""

from placeweave import vocabulary as V
from placeweave.fixtures import AGAIN, MAPPING, QUARANTINE, QUARANTINE_IDS, QUARANTINE_TEXT
from placeweave.fixtures import places_cte, quads_cte
from placeweave.schema import PLACE_COLUMNS, RECORD_COLUMNS
from placeweave.vocabulary import NULL_TOKENS

PLACE_LIST = ", ".join(PLACE_COLUMNS)
KEYS = "locationName, locationType, thoroughfare, huisnummer, postCode, city"
NAME_KEYS = "locationName, locationType, postCode"
ADDRESS_KEYS = "thoroughfare, huisnummer, postCode, city"
SPACES = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"
LETTERS = r"\p{Lu}\p{Ll}\p{Lt}"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(texts) -> str:
    return ", ".join(map(quoted, texts))


def query(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


IS_KNOWN = f"(udbLocationType IN ({listed(MAPPING)}) OR udbLocationType IS NULL)"
MAPPING_CTE = "mapping(key, value) AS (VALUES " + ", ".join(
    f"({quoted(k)}, {quoted(v)})" for k, v in MAPPING.items()
) + ")"


def patterns_cte(lines) -> str:
    rows = ", ".join(f"({quoted(line)})" for line in lines)
    return f"patterns AS (SELECT trim(l) AS pat FROM (VALUES {rows}) t(l) WHERE trim(l) <> '')"


HIT = "EXISTS (SELECT 1 FROM patterns WHERE regexp_matches(subject, pat))"


def cleaned_cte(source: str, name: str = "cleaned") -> str:
    """Names and postcodes cleaned step by step; `source` has the place columns."""
    others = ", ".join(c for c in PLACE_COLUMNS if c not in ("locationName", "postCode"))
    return f"""
c1 AS (SELECT *, regexp_replace(locationName, '\\p{{Nd}}', '', 'g') AS x FROM {source}),
c2 AS (SELECT * REPLACE (replace(replace(translate(x, '’‘“”', '''''""'),
         '''T', '''t'), '&#;t', '''t') AS x) FROM c1),
c3 AS (SELECT * REPLACE (CASE WHEN x IN ('''', '/', '?') THEN '' ELSE x END AS x) FROM c2),
c4 AS (SELECT * REPLACE (regexp_replace(regexp_replace(x, '[?/-]', ' ', 'g'),
         '^{SPACES}+|{SPACES}+$', '', 'g') AS x) FROM c3),
c5 AS (SELECT * REPLACE (regexp_replace(x, '{SPACES}+', ' ', 'g') AS x) FROM c4),
{name} AS (SELECT {others},
  CASE WHEN (x LIKE '''%' AND x LIKE '%''') OR (x LIKE '"%' AND x LIKE '%"')
       THEN substr(x, 2, greatest(length(x) - 2, 0)) ELSE x END AS locationName,
  CASE WHEN regexp_matches(postCode, '^\\s*[+-]?\\d*\\.0$')
       THEN regexp_replace(regexp_replace(trim(postCode), '\\.0$', ''), '^\\+?(-?)0*(\\d)', '\\1\\2')
       ELSE postCode END AS postCode
  FROM c5)"""


def title(column: str) -> str:
    runs = f"regexp_extract_all({column}, '[{LETTERS}]+|[^{LETTERS}]+')"
    return f"array_to_string(list_transform({runs}, lambda r: upper(r[1]) || lower(r[2:])), '')"


def ready_cte(source: str) -> str:
    """From filtered rows, one per id, to the rows that deduplication sees."""
    others = ", ".join(f"c.{x}" for x in PLACE_COLUMNS if x != "locationType")
    return f"""{cleaned_cte(source)},
{MAPPING_CTE},
{patterns_cte(QUARANTINE)},
ready AS (SELECT {others}, coalesce(m.value, c.locationType) AS locationType
          FROM cleaned c LEFT JOIN mapping m ON m.key = c.udbLocationType
          WHERE NOT {HIT.replace('subject', 'c.subject')}),
titled AS (SELECT * REPLACE ({title('locationName')} AS locationName,
             {title('thoroughfare')} AS thoroughfare, {title('city')} AS city),
             locationName AS plainName FROM ready)"""


def complete(keys: str) -> str:
    return " AND ".join(f"{k} IS NOT NULL" for k in keys.split(", "))


# The passes where a row that lacks a key matches nothing.
APART_CTE = f"""
p1 AS (SELECT *, CASE WHEN {complete(KEYS)} THEN count(*) OVER (PARTITION BY {KEYS}) ELSE 1 END
         AS n1, min(subject) OVER (PARTITION BY {KEYS}) AS r1 FROM titled),
p2 AS (SELECT *, CASE WHEN {complete(NAME_KEYS)}
         THEN count(*) OVER (PARTITION BY n1 > 1, {NAME_KEYS}) ELSE 1 END AS n2,
         min(subject) OVER (PARTITION BY n1 > 1, {NAME_KEYS}) AS r2 FROM p1),
p3 AS (SELECT *, CASE WHEN {complete(ADDRESS_KEYS)}
         THEN count(*) OVER (PARTITION BY n1 > 1 OR n2 > 1, {ADDRESS_KEYS}) ELSE 1 END AS n3,
         min(subject) OVER (PARTITION BY n1 > 1 OR n2 > 1, {ADDRESS_KEYS}) AS r3 FROM p2)"""

PASSES_CTE = f"""
p1 AS (SELECT *, count(*) OVER (PARTITION BY {KEYS}) AS n1,
         min(subject) OVER (PARTITION BY {KEYS}) AS r1 FROM titled),
p2 AS (SELECT *, count(*) OVER (PARTITION BY n1 > 1, {NAME_KEYS}) AS n2,
         min(subject) OVER (PARTITION BY n1 > 1, {NAME_KEYS}) AS r2 FROM p1),
p3 AS (SELECT *, count(*) OVER (PARTITION BY n1 > 1 OR n2 > 1, {ADDRESS_KEYS}) AS n3,
         min(subject) OVER (PARTITION BY n1 > 1 OR n2 > 1, {ADDRESS_KEYS}) AS r3 FROM p2)"""


def verdict_select(passes: int) -> str:
    tiers = [(1, 1.0), (2, 0.6), (3, 0.4)][:passes]
    ratio = " ".join(f"WHEN n{i} > 1 THEN {c}" for i, c in tiers)
    first = " ".join(f"WHEN n{i} > 1 THEN r{i}" for i, _ in tiers)
    matched = " OR ".join(f"n{i} > 1" for i, _ in tiers)
    return f"""SELECT * EXCLUDE (n1, r1, n2, r2, n3, r3),
  CAST(CASE {ratio} ELSE 0 END AS DOUBLE) AS certainty_ratio,
  ({matched}) AS is_duplicate,
  CASE {first} END AS duplicate_subject
  FROM p3"""


VERDICT = "subject, certainty_ratio, is_duplicate, duplicate_subject"

SORTED = rf"array_to_string(list_sort(string_split_regex(trim(%s), '\s+')), ' ')"


def lcs(a: str, b: str) -> str:
    """Longest common subsequence: one row of the usual table per character of a."""
    matches = (
        f"list_transform(string_split({a}, ''), lambda p: "
        f"list_transform(string_split({b}, ''), lambda q: CASE WHEN p = q THEN 1 ELSE 0 END))"
    )
    cell = (
        "list_max(list_transform(range(1, j + 1), lambda k: greatest(acc[k], "
        "CASE WHEN hit[k] = 1 THEN coalesce(acc[k - 1], 0) + 1 ELSE 0 END)))"
    )
    row = f"list_transform(range(1, length({b}) + 1), lambda j: {cell})"
    zeros = f"list_transform(range(0, length({b})), lambda z: 0)"
    table = f"list_reduce({matches}, lambda acc, hit: {row}, {zeros})"
    return f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE list_last({table}) END"


FUZZY_CTE = f"""
v AS ({verdict_select(3)}),
tier AS (SELECT * FROM v WHERE certainty_ratio = 0.4 AND locationName IS NOT NULL),
m AS (SELECT locationName AS name, min(subject) AS rank,
        arg_min(struct_pack(s := thoroughfare, p := postCode), subject) AS a
      FROM tier GROUP BY locationName),
o AS (SELECT v.locationName AS name, min(v.subject) AS rep,
        arg_min(struct_pack(s := v.thoroughfare, p := v.postCode), v.subject) AS a
      FROM v WHERE v.locationName IN (SELECT name FROM m) GROUP BY v.locationName),
candidates AS (
  SELECT m.name AS match, o.name AS original, mo.rank AS rank, o.rep AS first_subject,
         {SORTED % 'm.name'} AS x, {SORTED % 'o.name'} AS y
  FROM m JOIN o ON m.a.s = o.a.s AND m.a.p = o.a.p AND m.name <> o.name
         JOIN m mo ON mo.name = o.name),
near AS (SELECT * FROM candidates
         WHERE 20 * least(length(x), length(y)) >= 9 * (length(x) + length(y))),
pairs AS (SELECT match, original, rank, first_subject FROM near
          WHERE 20 * ({lcs('x', 'y')}) >= 9 * (length(x) + length(y))),
last AS (SELECT match, arg_max(first_subject, rank) AS rep FROM pairs GROUP BY match),
promoted AS (
  SELECT v.* REPLACE (
    CAST(CASE WHEN l.rep IS NOT NULL THEN 0.5 ELSE certainty_ratio END AS DOUBLE)
      AS certainty_ratio,
    coalesce(l.rep, duplicate_subject) AS duplicate_subject)
  FROM v LEFT JOIN last l ON v.certainty_ratio = 0.4 AND v.locationName = l.match),
final AS (
  SELECT * EXCLUDE (plainName) REPLACE (
    CAST(CASE WHEN certainty_ratio = 1 AND (coalesce(postCode, '') = '' OR coalesce(city, '') = '')
         THEN 0.1 ELSE certainty_ratio END AS DOUBLE) AS certainty_ratio,
    CASE WHEN duplicate_subject = subject THEN '' ELSE duplicate_subject END AS duplicate_subject,
    plainName AS locationName)
  FROM promoted)"""

MERGED_CTE = f"""
merged AS (
  SELECT {PLACE_LIST}, CAST(n AS BIGINT) AS ord FROM places
  UNION ALL BY NAME
  SELECT * EXCLUDE (n), 1000000000000 + n AS ord FROM places2)"""


# The second source lists its places again, further down and in other words.
FILES_CTE = f"""
files AS (
  SELECT {PLACE_LIST}, ord FROM merged
  UNION ALL BY NAME
  SELECT * EXCLUDE (n) REPLACE ('late ' || locationName AS locationName, 'late' AS thoroughfare),
    1000000000000 + {AGAIN} + n AS ord FROM places2)"""


def collapsed_cte(source: str, largest: tuple[str, ...] = ()) -> str:
    firsts = ", ".join(
        f"max({c}) AS {c}" if c in largest else
        f"arg_min({c}, ord) FILTER (WHERE {c} IS NOT NULL) AS {c}"
        for c in PLACE_COLUMNS if c != "subject"
    )
    return f"collapsed AS (SELECT subject, {firsts} FROM {source} WHERE subject IS NOT NULL GROUP BY subject)"


KNOWN_CTE = f"known AS (SELECT {PLACE_LIST} FROM places WHERE {IS_KNOWN})"
READY = (places_cte(), KNOWN_CTE, ready_cte("known"))
ALL_COLUMNS = f"{PLACE_LIST}, certainty_ratio, is_duplicate, duplicate_subject"


# -- graph patterns as self-joins ---------------------------------------------------------


def pattern(triples, columns: dict[str, str], graph: str = "default", extra: str = "") -> str:
    """SELECT over one self-join per triple pattern; `?x` is a variable, the rest constants."""
    bound: dict[str, str] = {}
    tests, tables = [], []
    for i, (s, p, o) in enumerate(triples):
        tables.append(f"triples t{i}" if graph == "union" else f"quads t{i}")
        tests.append(f"t{i}.p = {quoted(p)}")
        if graph != "union":
            tests.append(f"t{i}.g IS NULL" if graph == "default" else f"t{i}.g = t0.s")
        for term, column in ((s, f"t{i}.s"), (o, f"t{i}.o")):
            if not term.startswith("?"):
                tests.append(f"{column} = {quoted(term)}")
            elif term in bound:
                tests.append(f"{column} = {bound[term]}")
            else:
                bound[term] = column
    select = ", ".join(f"{bound.get(v, v)} AS {c}" for c, v in columns.items())
    return f"SELECT {select} FROM {', '.join(tables)} WHERE {' AND '.join(tests)}{extra}"


def chain(triples, columns: dict[str, str]) -> str:
    """As `pattern` in the default graph, one written join after the other, so that the order of the
    joins is the order of the triples, of which each after the first meets a variable of those before."""
    bound: dict[str, str] = {}
    steps = []
    for i, (s, p, o) in enumerate(triples):
        tests, new = ["t.g IS NULL", f"t.p = {quoted(p)}"], ["b.*"] if i else []
        for term, column in ((s, "t.s"), (o, "t.o")):
            if not term.startswith("?"):
                tests.append(f"{column} = {quoted(term)}")
            elif term in bound:
                tests.append(f"{column} = b.{bound[term]}")
            else:
                bound[term] = f"x{len(bound)}"
                new.append(f"{column} AS {bound[term]}")
        source = f"step{i - 1} b JOIN quads t ON" if i else "quads t WHERE"
        select = f"SELECT {', '.join(new)} FROM {source} {' AND '.join(tests)}"
        steps.append(f"step{i} AS MATERIALIZED ({select})")
    select = ", ".join(f"{bound.get(v, v)} AS {c}" for c, v in columns.items())
    return f"SELECT * FROM (WITH {', '.join(steps)} SELECT {select} FROM step{len(triples) - 1})"


def record(**bound: str) -> dict[str, str]:
    return {c: bound.get(c, "''") for c in RECORD_COLUMNS}


IDENTIFIED = [
    ("?node", V.ADMS + "identifier", "?id"),
    ("?id", V.SKOS + "notation", "?subject"),
    ("?id", V.PLATFORM + "bron", "?bron"),
]
NAAM, TYPE = V.INFRA + "Infrastructuur.naam", V.INFRA + "Infrastructuur.type"


def address(number: str | None, city: str = V.ADRES + "gemeentenaam"):
    rows = [
        ("?a", V.LOCN + "fullAddress", "?full"),
        ("?a", V.LOCN + "thoroughfare", "?street"),
        ("?a", V.LOCN + "postCode", "?post"),
        ("?a", city, "?city"),
    ]
    return rows + [("?a", number, "?number")] if number else rows


BASICS = dict(subject="?subject", locationName="?name", locationType="?type", bron="?bron")
STREET = dict(fullAddress="?full", thoroughfare="?street", postCode="?post", city="?city")
SITE_NUMBER = V.ADRES + "Adresvoorstelling.huisnummer"
NUMBER = dict(huisnummer="?number")

BUILDING = pattern(
    [*IDENTIFIED, ("?node", V.GEBOUW + "gebouwnaam", "?name"), ("?node", TYPE, "?type"),
     ("?node", V.GEBOUW + "Gebouw.adres", "?a"),
     *address(V.ADRES + "adresvoorstelling.huisnummer")],
    record(**BASICS, **STREET, **NUMBER),
)
OPEN_AIR = pattern(
    [*IDENTIFIED, ("?node", NAAM, "?name"), ("?node", TYPE, "?type"),
     ("?node", V.LOCN + "address", "?a"), *address(None, V.LOCN + "postName"),
     ("?node", V.LOCN + "geometry", "?geo"), ("?geo", V.LOCN + "gml", "?gml")],
    record(**BASICS, **STREET, gml="?gml"),
)
EVENT_PATTERN = pattern(
    [("?s", V.RDF_TYPE, V.DCT + "Location"), ("?s", V.LOCN + "locatorName", "?name"),
     ("?s", V.LOCN + "address", "?a"), ("?a", V.LOCN + "postcode", "?post"),
     ("?a", V.LOCN + "postName", "?city"), ("?a", V.LOCN + "fullAddress", "?full"),
     ("?a", V.LOCN + "thoroughfare", "?street"), ("?a", V.LOCN + "locatorDesignator", "?number"),
     ("?s", V.LOCN + "geometry", "?geo"), ("?geo", V.GEO + "asGML", "?point"),
     ("?s", V.DCT + "type", "?udb")],
    dict(subject="?s", locationName="?name", **STREET, **NUMBER, point="?point",
         udbLocationType="?udb"),
    "subject",
    f" AND NOT EXISTS (SELECT 1 FROM quads x WHERE x.g = t0.s AND x.s = t0.s"
    f" AND x.p = {quoted(V.PROV + 'invalidatedAtTime')})",
)
SAMPLED = ["locationName", "fullAddress", "thoroughfare", "huisnummer", "postCode", "city",
           "point", "udbLocationType"]
EVENTS = (
    "SELECT subject, " + ", ".join(f"min({c}) AS {c}" for c in SAMPLED)
    + f", '' AS locationType, '' AS busnummer, CAST(NULL AS VARCHAR) AS gml, "
    f"{quoted(V.PLACES_SOURCE)} AS bron FROM ({EVENT_PATTERN}) GROUP BY subject"
)
PRODUCTS = {
    "publiq": EVENTS,
    "jeugdmaps": f"{BUILDING} UNION ALL {OPEN_AIR}",
    "kiosk": chain(
        [("?s", V.RDF_TYPE, V.INFRA + "Infrastructuur"),
         ("?s", V.INFRA + "Infrastructuur.locatie", "?a"), *address(SITE_NUMBER),
         ("?s", V.ADMS + "identifier", "?id"), ("?id", V.PLATFORM + "bron", "?bron")],
        record(subject="?s", locationName="CAST(NULL AS VARCHAR)",
               locationType="CAST(NULL AS VARCHAR)", bron="?bron", **STREET, **NUMBER),
    ),
    "erfgoed": chain(
        [*IDENTIFIED, ("?node", NAAM, "?name"), ("?node", TYPE, "?type"),
         ("?node", V.INFRA + "Infrastructuur.locatie", "?a"), *address(SITE_NUMBER)],
        record(**BASICS, **STREET, **NUMBER),
    ),
    "kampas": chain(
        [*IDENTIFIED, ("?node", V.GEBOUW + "gebouwnaam", "?name"), ("?node", TYPE, "?type"),
         ("?node", V.GEBOUW + "adres", "?a"), *address(SITE_NUMBER)],
        record(**BASICS, **STREET, **NUMBER),
    ),
    "anb": pattern(
        [*IDENTIFIED, ("?node", NAAM, "?name"), ("?node", TYPE, "?type"),
         ("?node", V.LOCN + "geometry", "?geo"), ("?geo", V.LOCN + "gml", "?gml")],
        record(**BASICS, gml="?gml"),
    ),
}


def fetched_cte() -> str:
    """All products merged in catalogue order, blanks as nulls, ranked as the job ranks them."""
    blanks = ", ".join(
        f"CASE WHEN {c} NOT IN ({listed(NULL_TOKENS)}) THEN {c} END AS {c}" for c in PLACE_COLUMNS
    )
    sources = "\nUNION ALL BY NAME ".join(
        f"SELECT *, {i} AS src FROM ({sql})" for i, sql in enumerate(PRODUCTS.values())
    )
    cells = ", ".join(f"coalesce({c}, '')" for c in PLACE_COLUMNS)
    return f"""
fetched AS ({sources}),
blanked AS (SELECT {blanks}, src FROM fetched),
ranked AS (SELECT {PLACE_LIST}, src || md5(concat_ws('|', {cells})) AS ord FROM blanked
           WHERE {IS_KNOWN})"""


def oracle_sql() -> dict[str, str]:
    named = "SELECT g, s, p, o FROM quads WHERE g IS NOT NULL"
    default = (
        "SELECT g, s, p, o FROM quads d WHERE g IS NULL AND NOT EXISTS (SELECT 1 FROM quads x "
        "WHERE x.g IS NOT NULL AND x.s = d.s AND x.p = d.p AND x.o = d.o)"
    )
    typed = f"""p = {quoted(V.RDF_TYPE)} AND (
      g IS NOT NULL AND o IN ({listed(V.NAMED_GRAPH_CLASSES)})
      OR g IS NULL AND o IN ({listed(V.DEFAULT_GRAPH_CLASSES)}))"""
    frequency = f"""SELECT {NAME_KEYS}, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share
      FROM titled GROUP BY {NAME_KEYS}"""
    scored = f"""s AS (SELECT a.subject, {SORTED % 'a.locationName'} AS x,
        {SORTED % 'b.locationName'} AS y FROM cleaned_all a JOIN cleaned_all b
        ON b.subject = a.other)"""
    with_other = f"""cleaned_all AS (SELECT c.*, 'https://places.example/id/' ||
        lpad(CAST(p.n - p.v + 4 AS VARCHAR), 8, '0') AS other
        FROM cleaned c JOIN places p USING (subject))"""
    ready_kept = (
        f"filtered AS (SELECT * FROM merged WHERE {IS_KNOWN})",
        collapsed_cte("filtered"),
        ready_cte("collapsed"),
    )
    place_rows = f"SELECT {PLACE_LIST} FROM places"

    found = {
        "load_places": query(
            "SELECT * EXCLUDE (n, e, v) REPLACE (CASE WHEN n % 13 < 4 THEN NULL ELSE city END "
            "AS city, CASE WHEN n % 13 BETWEEN 3 AND 5 THEN NULL ELSE huisnummer END "
            "AS huisnummer) FROM places", places_cte()),
        "csv_roundtrip": query(
            "SELECT * EXCLUDE (n, e, v) REPLACE (fullAddress || ', \"bis\"' || chr(10) || "
            "'line ' || n AS fullAddress) FROM places", places_cte()),
        "bindings_flatten": query(place_rows, places_cte()),
        "stage_counts": query(
            f"""SELECT 'load' AS stage, count(*) AS n FROM merged
            UNION ALL SELECT 'filter', count(*) FROM merged WHERE {IS_KNOWN}
            UNION ALL SELECT 'group', count(DISTINCT subject) FROM merged WHERE {IS_KNOWN}
            UNION ALL SELECT 'remove', count(DISTINCT subject) FROM merged
              WHERE {IS_KNOWN} AND NOT {HIT}""",
            places_cte(), MERGED_CTE, patterns_cte(QUARANTINE)),
        "quads_head": query(
            f"SELECT * FROM ({named} UNION ALL {default}) ORDER BY g NULLS LAST, s, p, o LIMIT 5",
            quads_cte()),
        "subject_count": query(
            f"SELECT count(DISTINCT s) AS subjectCount FROM quads WHERE {typed}", quads_cte()),
        "subject_count_sketch": query(
            f"SELECT count(DISTINCT s) AS subjectCount, true AS near FROM quads WHERE {typed}", quads_cte()),
        "filter_type": query(f"{place_rows} WHERE {IS_KNOWN}", places_cte()),
        "merge_by_name": query(
            "SELECT * EXCLUDE (ord), CAST(ord >= 1000000000000 AS INTEGER) AS _src FROM merged",
            places_cte(), MERGED_CTE),
        "collapse_by_id": query(
            f"SELECT {PLACE_LIST} FROM collapsed", places_cte(), MERGED_CTE,
            collapsed_cte("merged")),
        "map_type": query(
            "SELECT p.* EXCLUDE (n, e, v) REPLACE (coalesce(m.value, p.locationType) "
            "AS locationType) FROM places p LEFT JOIN mapping m ON m.key = p.udbLocationType",
            places_cte(), MAPPING_CTE),
        "remove_quarantined": query(
            f"{place_rows} WHERE NOT {HIT}", places_cte(), patterns_cte(QUARANTINE)),
        "remove_literal": query(
            f"{place_rows} WHERE NOT EXISTS (SELECT 1 FROM patterns WHERE contains(subject, pat))",
            places_cte(), patterns_cte(QUARANTINE_TEXT)),
        "remove_exact": query(
            f"{place_rows} WHERE subject NOT IN (SELECT pat FROM patterns)",
            places_cte(), patterns_cte(QUARANTINE_IDS)),
        "clean_names": query(
            "SELECT subject, locationName FROM cleaned", places_cte(), cleaned_cte("places")),
        "fix_postcodes": query(
            "SELECT subject, postCode FROM cleaned", places_cte(), cleaned_cte("places")),
        "title_keys": query(f"SELECT subject, {KEYS} FROM titled", *READY),
        "token_sort_ratio": query(
            f"""SELECT subject, CASE WHEN x IS NULL OR y IS NULL THEN NULL
            WHEN length(x) + length(y) = 0 THEN CAST(100 AS DOUBLE) ELSE
            CAST(200 * ({lcs('x', 'y')}) AS DOUBLE) / (length(x) + length(y)) END AS score FROM s""",
            places_cte(), cleaned_cte("places"), with_other, scored),
        "relative_frequency": query(frequency, *READY),
        "dedup_exact": query(f"SELECT {VERDICT} FROM v", *READY, PASSES_CTE,
                             f"v AS ({verdict_select(1)})"),
        "dedup_name_pass": query(f"SELECT {VERDICT} FROM v", *READY, PASSES_CTE,
                                 f"v AS ({verdict_select(2)})"),
        "dedup_address_pass": query(f"SELECT {VERDICT} FROM v", *READY, PASSES_CTE,
                                    f"v AS ({verdict_select(3)})"),
        "fuzzy_pairs": query('SELECT "match", original FROM pairs', *READY, PASSES_CTE, FUZZY_CTE),
        "fuzzy_promote": query(f"SELECT {VERDICT} FROM promoted", *READY, PASSES_CTE, FUZZY_CTE),
        "dedup_final": query(f"SELECT {VERDICT} FROM final", *READY, PASSES_CTE, FUZZY_CTE),
        "deduplicate": query(f"SELECT {ALL_COLUMNS} FROM final", *READY, PASSES_CTE, FUZZY_CTE),
        "certainty_histogram": query(
            "SELECT certainty_ratio, count(*) AS n FROM final GROUP BY certainty_ratio",
            *READY, PASSES_CTE, FUZZY_CTE),
        "cleanse": query(f"SELECT {ALL_COLUMNS} FROM final", places_cte(), MERGED_CTE,
                         *ready_kept, PASSES_CTE, FUZZY_CTE),
        "end_to_end": query(f"SELECT {ALL_COLUMNS} FROM final", quads_cte(), fetched_cte(),
                            collapsed_cte("ranked"), ready_cte("collapsed"), PASSES_CTE,
                            FUZZY_CTE),
    }
    for product, sql in PRODUCTS.items():
        found[f"product_{product}"] = query(sql, quads_cte())
    erfgoed = pattern(
        [*IDENTIFIED, ("?node", NAAM, "?name"), ("?node", TYPE, "?type"),
         ("?node", V.INFRA + "Infrastructuur.locatie", "?a"), *address(SITE_NUMBER)],
        record(**BASICS, **STREET, **NUMBER), "union",
    )
    triples = "triples AS MATERIALIZED (SELECT DISTINCT s, p, o FROM quads)"
    found["product_erfgoed_union"] = query(erfgoed, quads_cte(), triples)
    found["product_jeugdmaps_store"] = found["product_jeugdmaps"]
    found["product_publiq_store"] = found["product_publiq"]
    found["bindings_streamed"] = found["bindings_flatten"]
    found["cleanse_counts"] = found["stage_counts"]
    found["cleanse_counted"] = found["cleanse"]
    some = f"least(100, (SELECT count(*) FROM ({named} UNION ALL {default})))"
    found["quads_head_any"] = query(f"SELECT {some} AS n, {some} AS known", quads_cte())
    found |= {
        "collapse_overrides": query(
            f"SELECT {PLACE_LIST} FROM collapsed", places_cte(), MERGED_CTE,
            collapsed_cte("merged", ("locationName",))),
        "merge_csv": query(
            f"SELECT {PLACE_LIST} FROM collapsed", places_cte(), MERGED_CTE, FILES_CTE,
            collapsed_cte("files")),
        "stage_counts_tables": found["stage_counts"].replace(
            "regexp_matches(subject, pat)", "contains(subject, pat)").replace(
            patterns_cte(QUARANTINE), patterns_cte(QUARANTINE_TEXT)),
        "filter_type_file": found["filter_type"],
        "map_type_file": found["map_type"],
        "remove_file": found["remove_literal"],
        "remove_regex_file": found["remove_quarantined"],
        "clean_names_null_text": query(
            "SELECT subject, locationName FROM cleaned", places_cte(),
            "named AS (SELECT * REPLACE (coalesce(locationName, 'nan') AS locationName) FROM places)",
            cleaned_cte("named")),
        "dedup_null_keys_apart": query(
            f"SELECT {VERDICT} FROM v", *READY, APART_CTE, f"v AS ({verdict_select(3)})"),
    }
    return found
