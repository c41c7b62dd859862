"""Merge, collapse, type filter and mapping, quarantine, stage counts, salted joins."""

import re

import pytest
from pyspark.sql import functions as F

from placeweave.operators import relational
from placeweave.plans import jobs
from placeweave.plans.jobs import cleanse, cleanse_counted
from placeweave.operators.relational import (
    collapse_by_id,
    filter_type,
    map_type,
    merge_by_name,
    remove_quarantined,
    stage_counts,
)
from placeweave.operators.skew import hot_from_rows, salted_join


def values(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


def plan(frame, mode="formatted"):
    return frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), mode)


def test_merge_keeps_column_order_and_sources(spark):
    a = spark.createDataFrame([("1", "x")], "id string, a string")
    b = spark.createDataFrame([("y", "2")], "b string, id string")
    merged = merge_by_name([a, b, a])
    assert merged.columns == ["id", "a", "b", "_src"]
    assert [tuple(r) for r in merged.orderBy("_src").collect()] == [
        ("1", "x", None, 0), ("2", None, "y", 1), ("1", "x", None, 2)
    ]
    assert "Exchange" not in plan(merge_by_name([a, b]))


def test_collapse_takes_first_value_per_column(spark):
    rows = [("b", None, "late", 1, 0), ("b", "n1", None, 0, 1), ("b", "n0", None, 0, 2),
            ("a", None, None, 0, 0), (None, "lost", "lost", 0, 3)]
    frame = spark.createDataFrame(rows, "subject string, x string, y string, _src int, _row int")
    found = collapse_by_id(frame, ["_src", "_row"])
    assert found.columns == ["subject", "x", "y"]
    assert values(found, "subject", "x", "y") == [("a", None, None), ("b", "n1", "late")]
    longest = collapse_by_id(frame, ["_src", "_row"], {"x": F.max("x")})
    assert values(longest, "subject", "x", "y") == [("a", None, None), ("b", "n1", "late")]


TYPES = {"k1": "v1", "k2": "v2"}


@pytest.fixture(params=["inline", "joined"])
def mapping(request, spark, monkeypatch):
    if request.param == "inline":
        return TYPES
    monkeypatch.setattr(relational, "INLINE_ROWS", 1)
    return spark.createDataFrame(list(TYPES.items()), "key string, value string")


def test_types(spark, mapping):
    rows = [(str(i), t, "old" if i % 2 else None) for i, t in enumerate(["k1", "k2", "k3", None] * 5)]
    frame = spark.createDataFrame(rows, "subject string, udbLocationType string, locationType string")
    kept = filter_type(frame, mapping)
    assert kept.columns == frame.columns
    assert {r["subject"] for r in kept.collect()} == {s for s, t, _ in rows if t != "k3"}
    mapped = map_type(frame, mapping)
    assert mapped.columns == frame.columns
    assert values(mapped, "subject", "locationType") == sorted(
        ((s, TYPES.get(t, old)) for s, t, old in rows), key=repr
    )


def test_absent_type_column_counts_as_null(spark):
    frame = spark.createDataFrame([("a",)], "subject string")
    assert values(filter_type(frame, TYPES), "subject", "udbLocationType") == [("a", None)]
    assert values(map_type(frame, {}), "subject", "locationType") == [("a", None)]


def test_type_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "places")
    frame = spark.createDataFrame([("a", "k1", "x")], "subject string, udbLocationType string, c string")
    frame.write.parquet(path)
    text = plan(filter_type(spark.read.parquet(path), TYPES).select("subject"))
    assert "PushedFilters: [Or(In(udbLocationType, [k1,k2]),IsNull(udbLocationType))]" in text
    assert "ReadSchema: struct<subject:string,udbLocationType:string>" in text


IDS = ["http://x/1", "http://x/12", "http://y.1", "http://ya1", "a+b"]


@pytest.mark.parametrize("inline_rows", [1000, 1])
@pytest.mark.parametrize(
    "mode, lines, kept",
    [
        ("regex", ["y.1", " ", ""], ["a+b", "http://x/1", "http://x/12"]),
        ("literal", ["y.1", "  x/12 ", "a+b"], ["http://x/1", "http://ya1"]),
        ("exact", ["http://x/1", "x/12", ""], ["a+b", "http://x/12", "http://y.1", "http://ya1"]),
        ("exact", [], sorted(IDS)),
    ],
)
def test_quarantine(spark, monkeypatch, inline_rows, mode, lines, kept):
    monkeypatch.setattr(relational, "INLINE_ROWS", inline_rows)
    frame = spark.createDataFrame([(i,) for i in IDS], "subject string")
    patterns = spark.createDataFrame([(line,) for line in lines], "pattern string")
    assert sorted(r[0] for r in remove_quarantined(frame, patterns, mode).collect()) == kept
    assert sorted(r[0] for r in remove_quarantined(frame, lines, mode).collect()) == kept


def test_quarantine_by_two_expressions(spark):
    frame = spark.createDataFrame([(i,) for i in IDS], "subject string")
    found = remove_quarantined(frame, ["x/1$", "^a"])
    assert sorted(r[0] for r in found.collect()) == ["http://x/12", "http://y.1", "http://ya1"]


def test_quarantine_batches_patterns(spark, monkeypatch):
    monkeypatch.setattr(relational, "PATTERNS_PER_FILTER", 2)
    frame = spark.createDataFrame([(f"id{i}",) for i in range(9)], "subject string")
    found = remove_quarantined(frame, [f"id{i}" for i in (0, 2, 4, 6, 8)])
    assert sorted(r[0] for r in found.collect()) == ["id1", "id3", "id5", "id7"]


def test_quarantine_rejects_unknown_mode(spark):
    with pytest.raises(ValueError):
        remove_quarantined(spark.createDataFrame([("a",)], "subject string"), [], "glob")


def test_quarantine_filter_moves_below_the_collapse(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.createDataFrame([("a", "x", 0)], "subject string, x string, _row int").write.parquet(path)
    collapsed = collapse_by_id(spark.read.parquet(path), ["_row"])
    text = plan(remove_quarantined(collapsed, ["bad"]), "simple")
    assert text.index("SortAggregate") < text.index("RLIKE(subject") < text.index("FileScan")


@pytest.mark.parametrize("mode, line", [("regex", "^bad$"), ("literal", "ba"), ("exact", "bad")])
def test_stage_counts(spark, stage, mapping, mode, line):
    rows = [("a", "k1"), ("a", "k3"), ("b", "k3"), ("c", None), ("bad", "k2"), (None, "k1")]
    frame = spark.createDataFrame(rows, "subject string, udbLocationType string")
    lines = spark.createDataFrame([(line,)], "pattern string")
    for patterns in ([line], lines):
        found = dict(map(tuple, stage_counts(frame, mapping, patterns, stage, mode).collect()))
        assert found == {"load": 6, "filter": 4, "group": 3, "remove": 2}
        if mode != "regex":
            continue
        places, counts = cleanse_counted(frame.withColumn("_row", F.lit(1)), mapping, patterns, stage, mode=mode)
        assert dict(map(tuple, counts.collect())) == found
        assert sorted(r["subject"] for r in places.collect()) == ["a", "c"]
    assert {r["n"] for r in stage_counts(frame.limit(0), mapping, lines, stage).collect()} == {0}


def test_the_counted_run_reads_its_input_once(spark, stage, monkeypatch):
    rows = [("a", "k9", "late", 1), ("a", "k1", "first", 2), ("a", "k1", "next", 3), ("b", "k9", "b", 4),
            ("c", None, None, 5), (None, "k1", "nameless", 6)]
    frame = spark.createDataFrame(rows, "subject string, udbLocationType string, locationName string, _row int")
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    long = spark.createDataFrame([(f"k{i}", "x") for i in range(1, 8)], "key string, value string")
    monkeypatch.setattr(relational, "INLINE_ROWS", 5)
    places, counts = cleanse_counted(frame.mapInArrow(counted, frame.schema), long, ["zz"], stage)
    assert dict(map(tuple, counts.collect())) == {"load": 6, "filter": 4, "group": 2, "remove": 2}
    expected = cleanse(frame, long, ["zz"], stage).select(places.columns)
    assert sorted(map(tuple, places.collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)
    assert {r["subject"]: r["locationName"] for r in places.collect()} == {"a": "first", "c": None}
    assert reads.value == len(rows)


@pytest.mark.parametrize("inline_rows", [1_000, 5])
def test_a_mapping_table_has_one_rule_at_every_size(spark, monkeypatch, inline_rows):
    monkeypatch.setattr(relational, "INLINE_ROWS", inline_rows)
    entries = [("k0", "v2"), ("k0", "v1"), (None, "v3"), *((f"k{i}", f"v{i}") for i in range(3, 9))]
    table = spark.createDataFrame(entries, "key string, value string")
    rows = [("a", "k0", None), ("b", "k8", "old"), ("c", None, "old"), ("d", "no", None)]
    frame = spark.createDataFrame(rows, "subject string, udbLocationType string, locationType string")
    assert values(filter_type(frame, table), "subject") == [("a",), ("b",), ("c",)]
    assert values(map_type(frame, table), "subject", "locationType") == [
        ("a", "v1"), ("b", "v8"), ("c", "old"), ("d", None)
    ]


@pytest.mark.parametrize("per_filter", [200, 2, 1])
def test_a_pattern_means_the_same_in_any_company(spark, monkeypatch, per_filter):
    monkeypatch.setattr(relational, "PATTERNS_PER_FILTER", per_filter)
    ids = ["aa", "xbb", "xab", "A|B", "plain"]
    frame = spark.createDataFrame([(i,) for i in ids], "subject string")
    lines = [r"(a)\1", r"x(b)\1", "[|]", "plai+n", "(?i)XA"]
    for count in range(len(lines) + 1):
        expected = [i for i in ids if not any(re.search(p, i) for p in lines[:count])]
        found = remove_quarantined(frame, lines[:count])
        assert sorted(r[0] for r in found.collect()) == sorted(expected)
    many = remove_quarantined(frame, [f"({i})" for i in range(900)] + lines)
    assert many.count() == 0


def test_many_literals(spark, monkeypatch):
    ids = [f"http://places.example/{i}" for i in range(3_000)]
    frame = spark.createDataFrame([(i,) for i in ids], "subject string")
    literals = [f"http://places.example/{i}" for i in range(2_500, 7_500)] + ["ample/17"]
    table = spark.createDataFrame([(x,) for x in literals], "pattern string")
    gone = {i for i in ids if any(x in i for x in literals)}
    found = remove_quarantined(frame, table, "literal")
    assert {r[0] for r in found.collect()} == set(ids) - gone


def test_a_long_table_of_expressions_equals_the_list(spark, stage):
    ids = [f"http://places.example/{i}" for i in range(3_000)] + [None, "", "A|B", "x.y", "añb\U0001f600"]
    frame = spark.createDataFrame([(i,) for i in ids], "subject string")
    lines = [
        *(rf"example/{i}[0-3]$" for i in range(4_000, 8_980)), *(f"ample/{i}$" for i in range(40)),
        r"e/(?:1[0-5]|7)77\b", r"\QA|B\E", r"^x\.y$", "\U0001f600+", "e/2(9)\\1", "[]x]9{4}", "nowhere|/12.4",
        "(?i)EXAMPLE/1999", r"/29\d5|/2(?=888)", " ",
    ]
    assert len(lines) > 5_000
    table = spark.createDataFrame([(x,) for x in lines], "pattern string")
    expected = set(remove_quarantined(frame, lines).collect())
    assert 50 < len(ids) - len(expected) < 300
    for given in (stage, None):
        assert set(remove_quarantined(frame, table, "regex", given).collect()) == expected


def test_a_long_list_reads_its_input_once(spark, stage):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    columns = "subject string, udbLocationType string, locationName string, _row int"
    rows = [(f"id/{i}", f"k{i % 7}", f"name {i}", i) for i in range(500)]
    frame = spark.createDataFrame(rows, columns).mapInArrow(count, columns)
    mapping = spark.createDataFrame([(f"k{i}", "v") for i in range(2_000)], "key string, value string")
    for mode, lines in (("regex", [f"d/{i}$" for i in range(1_200)]), ("literal", [f"d/9{i}" for i in range(1_200)])):
        before = seen.value
        patterns = spark.createDataFrame([(x,) for x in lines], "pattern string")
        jobs.cleanse(frame, mapping, patterns, stage, mode=mode).collect()
        assert seen.value - before == 500


def test_more_hot_keys_than_a_thousand(spark):
    rows = spark.range(6_000).selectExpr("id", "id % 1500 AS k").union(
        spark.range(1_000).selectExpr("id + 6000", "CAST(NULL AS BIGINT) AS k")
    )
    hot = hot_from_rows(rows, ["k"], 4)
    assert len(hot) == 1_501 and sorted(hot.values())[-1] >= 250
    table = spark.range(1_500).selectExpr("id AS k", "id * 2 AS v")
    joined = salted_join(rows, table, ["k"], hot, how="left")
    assert joined.count() == 7_000 and joined.filter("v = k * 2").count() == 6_000


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_salted_join_equals_plain_join(spark, hot, how, null_safe):
    keys = [("k", "x")] * 40 + [("k", None)] * 10 + [(None, None)] * 20 + [("m", "y"), ("z", "z")]
    rows = spark.createDataFrame([(i, *k) for i, k in enumerate(keys)], "i int, a string, b string")
    table = spark.createDataFrame(
        [("k", "x", 1), ("k", None, 2), (None, None, 3), ("m", "y", 4), ("m", "y", 5)],
        "a string, b string, v int",
    )
    hashes = hot_from_rows(rows, ["a", "b"], 5) if hot else []
    assert len(hashes) == (3 if hot else 0)
    found = salted_join(rows, table, ["a", "b"], hashes, how, null_safe)
    assert found.columns == ["i", "a", "b", "v"]
    lookup = {}
    for a, b, v in [("k", "x", 1), ("k", None, 2), (None, None, 3), ("m", "y", 4), ("m", "y", 5)]:
        if null_safe or None not in (a, b):
            lookup.setdefault((a, b), []).append(v)
    expected = []
    for i, (a, b) in enumerate(keys):
        matches = lookup.get((a, b), [None] if how == "left" else [])
        expected += [(i, a, b, v) for v in matches]
    assert values(found, "i", "a", "b", "v") == sorted(expected, key=repr)


def test_hot_keys_are_not_looked_for_in_few_rows(spark):
    rows = spark.createDataFrame([("a",)] * 9, "k string")
    assert hot_from_rows(rows, ["k"], 5, at_most=4) == {}
    assert len(hot_from_rows(rows, ["k"], 5, at_most=9)) == 1
