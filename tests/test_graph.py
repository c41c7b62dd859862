"""Extraction jobs against a nested-loop evaluation of their patterns."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from oracles.sql import IDENTIFIED, NAAM, SITE_NUMBER, TYPE, address
from placeweave import fixtures
from placeweave import vocabulary as V
from placeweave.operators import graph
from placeweave.operators.graph import head, subject_count
from placeweave.operators.skew import key_hash
from placeweave.plans import products
from placeweave.plans.products import PRODUCTS, fetch
from placeweave.schema import PLACE_COLUMNS, RECORD_COLUMNS
from placeweave.sources import store
from tests.compare import checking_database

SCHEMA = "g string, s string, p string, o string"


def solve(triples, patterns):
    """All solutions of a list of (subject, predicate, object) patterns; `?x` is a variable."""
    solutions = [{}]
    for s, p, o in patterns:
        found = []
        for bound in solutions:
            for ts, tp, to in triples:
                new = dict(bound)
                if tp == p and all(
                    (new.setdefault(term, value) if term[0] == "?" else term) == value
                    for term, value in ((s, ts), (o, to))
                ):
                    found.append(new)
        solutions = found
    return solutions


def records(solutions, unbound=(), **columns):
    rows = []
    for solution in solutions:
        row = {c: None if c in unbound else "" for c in RECORD_COLUMNS}
        row.update({c: solution[v] for c, v in columns.items()})
        rows.append(tuple(row[c] for c in RECORD_COLUMNS))
    return rows


BASE = dict(subject="?subject", locationName="?name", locationType="?type", bron="?bron")
STREET = dict(fullAddress="?full", thoroughfare="?street", postCode="?post", city="?city")
NAMED = [*IDENTIFIED, ("?node", TYPE, "?type")]
GML = [("?node", V.LOCN + "geometry", "?geo"), ("?geo", V.LOCN + "gml", "?gml")]


def expected(product, triples):
    if product == "jeugdmaps":
        built = [*NAMED, ("?node", V.GEBOUW + "gebouwnaam", "?name"),
                 ("?node", V.GEBOUW + "Gebouw.adres", "?a"),
                 *address(V.ADRES + "adresvoorstelling.huisnummer")]
        open_air = [*NAMED, ("?node", NAAM, "?name"), ("?node", V.LOCN + "address", "?a"),
                    *address(None, V.LOCN + "postName"), *GML]
        return records(solve(triples, built), **BASE, **STREET, huisnummer="?number") + records(
            solve(triples, open_air), **BASE, **STREET, gml="?gml")
    if product == "kiosk":
        patterns = [("?s", V.RDF_TYPE, V.INFRA + "Infrastructuur"),
                    ("?s", V.INFRA + "Infrastructuur.locatie", "?a"), *address(SITE_NUMBER),
                    ("?s", V.ADMS + "identifier", "?id"), ("?id", V.PLATFORM + "bron", "?bron")]
        return records(solve(triples, patterns), ("locationName", "locationType"), subject="?s",
                       bron="?bron", **STREET, huisnummer="?number")
    if product == "anb":
        patterns = [*NAMED, ("?node", NAAM, "?name"), *GML]
        return records(solve(triples, patterns), **BASE, gml="?gml")
    name, link = {
        "erfgoed": (NAAM, V.INFRA + "Infrastructuur.locatie"),
        "kampas": (V.GEBOUW + "gebouwnaam", V.GEBOUW + "adres"),
    }[product]
    patterns = [*NAMED, ("?node", name, "?name"), ("?node", link, "?a"), *address(SITE_NUMBER)]
    return records(solve(triples, patterns), **BASE, **STREET, huisnummer="?number")


def random_quads(seed, nodes=6):
    """Few nodes, many links: shared targets, missing and repeated values."""
    rng = random.Random(seed)
    quads = set()
    properties = sorted({(p, o.rsplit("/", 1)[-1]) for _, _, _, p, o in fixtures.QUAD_RULES})
    targets = {"address'": "a", "second'": "a", "id'": "i", "geo'": "x"}
    for p, kind in properties:
        for kind_of_node in "naix":
            for n in range(nodes):
                for _ in range(rng.choice([0] + 14 * [1] + 4 * [2])):
                    if kind in targets:
                        o = f"{targets[kind]}{rng.randrange(nodes)}"
                    elif p == V.RDF_TYPE:
                        o = rng.choice([V.INFRA + "Infrastructuur", V.GEBOUW + "Gebouw"])
                    else:
                        o = f"v{rng.randrange(50)}"
                    # Properties are spread over all nodes, but mostly where they belong.
                    belongs = "n" if kind in targets or p in (V.RDF_TYPE, TYPE, NAAM) else None
                    if belongs in (None, kind_of_node):
                        g = rng.choice(19 * [None] + ["g1"])
                        quads.add((g, f"{kind_of_node}{n}", p, o))
    return sorted(quads, key=repr)


@pytest.mark.parametrize("product", [p for p in PRODUCTS if p != "publiq"])
@pytest.mark.parametrize("seed, union, hot_rows", [(1, False, 10**6), (2, True, 2)])
def test_product_equals_nested_loops(spark, stage, product, seed, union, hot_rows):
    quads = random_quads(seed)
    triples = {q[1:] for q in quads if union or q[0] is None}
    found = fetch(product, spark.createDataFrame(quads, SCHEMA), stage, union=union, hot_rows=hot_rows)
    assert found.columns == RECORD_COLUMNS
    wanted = Counter(expected(product, triples))
    assert sum(wanted.values()) > 5 and len(wanted) > 2
    assert Counter(map(tuple, found.collect())) == wanted


def place(s, extra=(), **cells):
    cells = {V.LOCN + "locatorName": "n", V.DCT + "type": "t", **cells}
    a, x = f"{s}/a", f"{s}/x"
    rows = [(s, V.RDF_TYPE, V.DCT + "Location"), (s, V.LOCN + "address", a),
            (s, V.LOCN + "geometry", x), (x, V.GEO + "asGML", "<p/>")]
    rows += [(s, p, o) for p, o in cells.items()]
    rows += [(a, V.LOCN + p, f"{p}!") for p in
             ("postcode", "postName", "fullAddress", "thoroughfare", "locatorDesignator")]
    return [(s, *r) for r in rows + list(extra)]


@pytest.mark.parametrize("hot_rows", [10**6, 1])
def test_event_places(spark, stage, hot_rows):
    name, link = V.LOCN + "locatorName", V.LOCN + "address"
    second = [("d", link, "d/b")] + [
        ("d/b", V.LOCN + p, f"{p} ") for p in
        ("postcode", "postName", "fullAddress", "thoroughfare", "locatorDesignator")
    ]
    quads = [
        *place("a"),
        *place("b", [("b", V.PROV + "invalidatedAtTime", "2024")]),
        *place("c", [("c", name, "a2"), ("c", name, "z2")]),
        *place("d", second),
        # An incomplete second address does not count, a missing property drops the place.
        *place("e", [("e", link, "e/b"), ("e/b", V.LOCN + "postName", "!")]),
        *[q for q in place("f") if q[2] != V.GEO + "asGML"],
        # Not in the graph of that name.
        *[("other", *q[1:]) for q in place("g")],
        *[(None, *q[1:]) for q in place("h")],
        # Another class.
        *[(q[0], q[1], q[2], "x" if q[2] == V.RDF_TYPE else q[3]) for q in place("i")],
        (None, "a", V.PROV + "invalidatedAtTime", "2024"),
    ]
    found = fetch("publiq", spark.createDataFrame(quads, SCHEMA), stage, hot_rows=hot_rows)
    assert found.columns == PLACE_COLUMNS
    rows = {r["subject"]: r for r in found.collect()}
    assert sorted(rows) == ["a", "c", "d", "e"] and found.count() == 4
    a = rows["a"]
    assert (a["locationName"], a["postCode"], a["city"]) == ("n", "postcode!", "postName!")
    assert (a["gml"], a["point"], a["udbLocationType"]) == (None, "<p/>", "t")
    assert (a["locationType"], a["busnummer"], a["bron"]) == ("", "", V.PLACES_SOURCE)
    assert rows["c"]["locationName"] == "a2"
    assert rows["d"]["postCode"] == "postcode "
    assert rows["e"]["city"] == "postName!"


def test_a_third_of_all_links_to_one_address(spark, stage):
    quads = [("a", p, "x") for p in (V.LOCN + "fullAddress", V.LOCN + "thoroughfare",
             V.LOCN + "postCode", V.ADRES + "gemeentenaam", SITE_NUMBER)]
    for i in range(300):
        n = f"n{i}"
        quads += [(n, V.ADMS + "identifier", f"{n}/id"), (f"{n}/id", V.SKOS + "notation", n),
                  (f"{n}/id", V.PLATFORM + "bron", "b"), (n, NAAM, f"name {i}"), (n, TYPE, "t"),
                  (n, V.INFRA + "Infrastructuur.locatie", "a" if i % 3 == 0 else f"a{i}")]
    frame = spark.createDataFrame([(None, *q) for q in quads], SCHEMA)
    found = fetch("erfgoed", frame, stage, hot_rows=50)
    assert "explode" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["subject"] for r in found.collect()) == sorted(f"n{i}" for i in range(0, 300, 3))


def test_head(spark):
    rows = [("g1", "s", "p", "o"), ("g2", "s", "p", "o"), (None, "s", "p", "o"), (None, "a", "p", "o")]
    quads = spark.createDataFrame(rows, SCHEMA)
    everything = [("g1", "s", "p", "o"), ("g2", "s", "p", "o"), (None, "a", "p", "o")]
    for limit in (1, 2, 3, 10):
        assert [tuple(r) for r in head(quads, limit).collect()] == everything[:limit]


def test_head_in_any_order(spark):
    rows = [("g1", "s", "p", "o"), ("g2", "s", "p", "o"), (None, "s", "p", "o"), (None, "a", "p", "o")]
    quads = spark.createDataFrame(rows + rows, SCHEMA)
    found = [tuple(r) for r in head(quads, 10, ordered=False).collect()]
    assert sorted(found, key=repr) == sorted([rows[0], rows[1], rows[3]], key=repr)
    assert head(quads, 2, ordered=False).count() == 2
    assert head(quads, 0, ordered=False).count() == head(quads.limit(0), 5, ordered=False).count() == 0
    many = spark.createDataFrame(rows[:1] * 200 + rows[2:3] * 200 + rows[3:], SCHEMA)
    found = [tuple(r) for r in head(many, 2, ordered=False).collect()]
    assert sorted(found, key=repr) == sorted([rows[0], rows[3]], key=repr)


@pytest.mark.parametrize("graph_name", ["'g'", "CAST(NULL AS STRING)"])
def test_head_in_any_order_leaves_most_of_the_store_unread(spark, graph_name):
    quads = spark.range(0, 1_000, 1, 10).selectExpr(
        f"{graph_name} AS g", "IF(id < 100, concat('s', id), raise_error('read')) AS s", "'p' AS p", "'o' AS o"
    )
    assert head(quads, 20, ordered=False).count() == 20
    with pytest.raises(Exception, match="read"):
        head(quads, 20).collect()


@pytest.mark.parametrize("product", PRODUCTS)
def test_statements_that_repeat_count_once(spark, stage, product):
    quads = fixtures.quads(spark, "/root/testdata/sf0.001")
    once = Counter(map(tuple, fetch(product, quads, stage).collect()))
    assert once and Counter(map(tuple, fetch(product, quads.union(quads), stage).collect())) == once


def test_subject_count(spark):
    rows = [
        ("g", "a", V.RDF_TYPE, V.GEBOUW + "Gebouw"),
        (None, "a", V.RDF_TYPE, V.GEBOUW + "Gebouw"),
        ("g", "b", V.RDF_TYPE, V.DCT + "Location"),
        (None, "c", V.RDF_TYPE, V.DCT + "Location"),
        (None, "d", V.RDF_TYPE, V.INFRA + "Buitenruimte"),
        ("g", "e", V.RDF_TYPE, V.INFRA + "Infrastructuur"),
        (None, "f", V.RDF_TYPE, V.INFRA + "Infrastructuur"),
        (None, "g", "other", V.INFRA + "Infrastructuur"),
    ]
    quads = spark.createDataFrame(rows, SCHEMA)
    assert subject_count(quads).first()["subjectCount"] == 4
    assert subject_count(quads, union=True).first()["subjectCount"] == 5


def test_fetch_by_name(spark, stage):
    quads = spark.createDataFrame([("g", "a", V.RDF_TYPE, V.DCT + "Location")], SCHEMA)
    assert fetch("count", quads, stage).first()["subjectCount"] == 1
    assert fetch("head", quads, stage, limit=5).count() == 1
    with pytest.raises(ValueError):
        fetch("terra", quads, stage)


def test_both_engines_derive_the_same_quads(spark):
    sf_dir = "/root/testdata/sf0.001"
    found = Counter(map(tuple, fixtures.quads(spark, sf_dir).collect()))
    rows = checking_database(sf_dir).sql(f"WITH {fixtures.quads_cte()} SELECT * FROM quads").fetchall()
    assert found == Counter(rows)


def test_quads_are_made_by_as_many_tasks_as_the_places_ask_for(spark, monkeypatch):
    sf_dir = "/root/testdata/sf0.001"
    monkeypatch.setattr(fixtures, "PLACES_A_TASK", 25, raising=False)
    quads = fixtures.quads(spark, sf_dir)
    rows = [r["count"] for r in quads.groupBy(F.spark_partition_id()).count().collect()]
    assert len(rows) >= 7 and max(rows) < sum(rows) / 3
    wanted = checking_database(sf_dir).sql(f"WITH {fixtures.quads_cte()} SELECT * FROM quads").fetchall()
    assert Counter(map(tuple, quads.collect())) == Counter(wanted)


def test_places_are_made_by_many_tasks_however_the_parts_lie(spark, monkeypatch):
    made = []

    def recorded(*args, derive=fixtures._derive, **options):
        made.append(derive(*args, **options))
        return made[-1]

    monkeypatch.setattr(fixtures, "PLACES_A_TASK", 10)
    monkeypatch.setattr(fixtures, "_derive", recorded)
    fixtures.quads(spark, "/root/testdata/sf0.001")
    rows = [r["count"] for r in made[0].groupBy(F.spark_partition_id()).count().collect()]
    assert len(rows) >= 7 and max(rows) < sum(rows) / 3


@pytest.mark.parametrize("tasks", [1, 5, 20])
def test_dealt_places_are_the_places(spark, tmp_path, tasks):
    """Also with keys that repeat, that are null or negative, and groups without a head."""
    sf_dir = "/root/testdata/sf0.001"
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    odd = part.filter("p_partkey <> 24").unionByName(part.filter("p_partkey IN (8, 9, 16)"))
    less = part.filter("p_partkey < 20").withColumn("p_partkey", F.expr("-p_partkey - 1"))
    none = part.filter("p_partkey = 3").withColumn("p_partkey", F.expr("CAST(NULL AS BIGINT)"))
    odd.unionByName(less).unionByName(none).write.parquet(f"{tmp_path}/part.parquet")
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.parquet(f"{tmp_path}/nation.parquet")
    found = fixtures._dealt_places(spark, str(tmp_path), tasks)
    wanted = fixtures.places_with_position(spark, str(tmp_path))
    assert found.schema == wanted.schema
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, wanted.collect()))


@pytest.mark.parametrize("name", ["quads_head", *(f"product_{p}" for p in PRODUCTS), "product_erfgoed_union"])
def test_queries_make_their_store_once(spark, name):
    found = entry.queries()[name](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "parquet" in plan


@pytest.mark.parametrize("places, buckets", [(10, 20), (100_000, 8)])
def test_a_store_has_as_many_buckets_as_the_places_ask_for(spark, monkeypatch, places, buckets):
    sf_dir = "/root/testdata/sf0.001"
    monkeypatch.setattr(fixtures, "PLACES_A_BUCKET", places, raising=False)
    stored = []

    def recorded(*args, read=store.read_store, **options):
        stored.append(read(*args, **options))
        return stored[-1]

    monkeypatch.setattr(store, "read_store", recorded)
    found = entry.queries()["product_jeugdmaps_store"](spark, sf_dir)
    bucket = F.regexp_extract(F.input_file_name(), r"_(\d+)\.c\d+", 1)
    rows = [r["count"] for r in stored[0].groupBy(bucket).count().collect()]
    assert len(rows) == buckets and sum(rows) == fixtures.quads(spark, sf_dir).count()
    plain = entry.queries()["product_jeugdmaps"](spark, sf_dir)
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, plain.collect()))


def busy_store(spark, own):
    """200 sites, each with its identifier; every fourth shares an address. One has `own` names and
    `own` types."""
    rows = []
    values = {
        V.ADRES + "gemeentenaam": "city", V.LOCN + "fullAddress": "full", V.LOCN + "postCode": "code",
        V.LOCN + "thoroughfare": "street", V.ADRES + "Adresvoorstelling.huisnummer": "1",
    }
    for n in range(200):
        node, ident, place = f"node{n}", f"id{n}", f"place{n // 4}"
        rows += [(node, V.ADMS + "identifier", ident), (ident, V.SKOS + "notation", node)]
        rows += [(ident, V.PLATFORM + "bron", "b"), (node, V.INFRA + "Infrastructuur.locatie", place)]
        rows += [(place, p, o) for p, o in values.items()]
        for k in range(own if n == 17 else 1):
            rows += [(node, V.INFRA + "Infrastructuur.naam", f"name{k}")]
            rows += [(node, V.INFRA + "Infrastructuur.type", f"type{k}")]
    return spark.createDataFrame([(None, *row) for row in set(rows)], SCHEMA)


def test_hot_targets_are_those_that_many_rows_reach(spark, stage, monkeypatch):
    quads = busy_store(spark, 25)
    plain = Counter(map(tuple, fetch("erfgoed", quads, stage).collect()))
    assert sum(plain.values()) == 199 + 25 * 25
    found = []

    def recorded(nodes, iri, *rest):
        found.append(graph.hot_targets(nodes, iri, *rest))
        return found[-1]

    monkeypatch.setattr(products, "hot_targets", recorded)
    assert Counter(map(tuple, fetch("erfgoed", quads, stage, hot_rows=300).collect())) == plain
    hashes = spark.createDataFrame([("id17",), ("place4",)], "s string")
    expected = [r[0] for r in hashes.select(key_hash(["s"])).collect()]
    assert [list(hot) for hot in found] == [[h] for h in expected]
    assert [set(hot.values()) for hot in found] == [{3}, {3}]


def test_a_store_is_read_by_predicate_and_without_shuffle(spark, stage, monkeypatch):
    path = stage.path("store")
    quads = fixtures.quads(spark, "/root/testdata/sf0.001")
    store.write_store(quads.union(quads.limit(3).withColumn("s", F.lit(None))), path, 4)
    stored = store.read_store(spark, path, 4)
    assert Counter(map(tuple, stored.collect())) == Counter(map(tuple, quads.collect()))
    nodes = graph.gather_nodes(graph.default_graph(stored), [V.LOCN + "gml", V.LOCN + "geometry"], stage)
    grouped = nodes.triples.groupBy("s").agg(F.count("o"))
    plan = grouped._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "Exchange" not in plan and "PartitionFilters: [p" in plan and "Bucketed: true" in plan


def test_nodes_are_gathered_without_the_texts_of_their_properties(spark, stage, monkeypatch):
    rows = [("n", V.RDF_TYPE, "b"), ("n", V.RDF_TYPE, "a"), ("n", V.LOCN + "gml", "x"), ("m", "p", "o")]
    triples = spark.createDataFrame(rows + rows, "s string, p string, o string")
    kept = []

    def recorded(self, rows, name, keep=type(stage).keep):
        kept.append(rows)
        return keep(self, rows, name)

    monkeypatch.setattr(type(stage), "keep", recorded)
    nodes = graph.gather_nodes(triples, [V.LOCN + "gml", V.RDF_TYPE], stage)
    assert [tuple(r) for r in nodes.table.collect()] == [("n", 1, "x", 2, "a")]
    assert (nodes.most, nodes.size, nodes.triples.count()) == ((1, 2), 1, 3)
    plan = kept[0]._jdf.queryExecution().optimizedPlan().toString()
    groups = re.findall(r"Aggregate \[(.*?)\]", plan)
    assert len(groups) == 2 and not any(re.search(r"\bp#", group) for group in groups)


def test_sketches_of_stores_merge(spark):
    rows = spark.range(30_000).selectExpr(
        "CAST(NULL AS STRING) AS g", "concat('s', id) AS s", f"'{V.RDF_TYPE}' AS p",
        f"'{V.DEFAULT_GRAPH_CLASSES[0]}' AS o",
    )
    one, two = rows.limit(20_000), rows.filter("CAST(substr(s, 2) AS INT) >= 10000")
    parts = graph.subject_sketch(one).union(graph.subject_sketch(two)).union(graph.subject_sketch(two))
    whole = graph.sketched_subject_count(graph.subject_sketch(one.union(two))).first()[0]
    merged = graph.sketched_subject_count(parts).first()[0]
    exact = subject_count(one.union(two)).first()[0]
    assert abs(whole - exact) <= 3 * graph.SKETCH_ERROR * exact
    assert abs(merged - whole) <= graph.SKETCH_ERROR * exact
    none = graph.subject_sketch(rows.limit(0))
    assert graph.sketched_subject_count(none).first()[0] == 0
    assert graph.sketched_subject_count(none.limit(0)).first()[0] == 0
