"""CSV, query-result JSON, mapping and pattern files; written intermediate tables."""

import io
import itertools
import json
import tracemalloc

import pandas as pd
import pytest
from pyspark.sql import functions as F

from placeweave import vocabulary
from placeweave.operators.relational import collapse_by_id, filter_type, merge_by_name, remove_quarantined
from placeweave.plans import jobs, products
from placeweave.schema import PLACE_COLUMNS, VERDICT_COLUMNS
from placeweave.sources import responses, tables
from placeweave.staging import CHECKPOINT_DIR, Stage, checkpoint_folder


def test_csv_cells(spark, tmp_path):
    path = tmp_path / "in.csv"
    text = 'subject,a,b\n1,"x, ""y""\nz",NA\n2,"",null\n3, pad ,007\n"NaN",None,n/a\n'
    path.write_text(text, newline="", encoding="utf-8")
    rows = tables.read_csv(spark, str(path)).orderBy("_row").drop("_row").collect()
    assert [tuple(r) for r in rows] == [
        ("1", 'x, "y"\nz', None), ("2", None, None), ("3", " pad ", "007"), (None, None, None)
    ]
    expected = pd.read_csv(path, dtype=str).astype(object).where(lambda d: d.notna(), None)
    assert [tuple(r) for r in rows] == [tuple(r) for r in expected.itertuples(index=False)]


@pytest.mark.parametrize("line_per_record", [False, True])
def test_csv_with_carriage_returns(spark, tmp_path, line_per_record):
    path = tmp_path / "in.csv"
    path.write_text('subject,a\r\n1,"x"\r\n2,NA\r\n', newline="")
    found = tables.read_csv(spark, str(path), line_per_record).orderBy("_row")
    assert [(r["subject"], r["a"]) for r in found.collect()] == [("1", "x"), ("2", None)]


def test_places_get_all_columns(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("subject,extra\ns,é\n", encoding="utf-8")
    found = tables.read_places(spark, str(path)).drop("_row")
    assert found.columns == ["subject", "extra", *PLACE_COLUMNS[1:]]
    assert found.first()["extra"] == "é"


def test_csv_roundtrip(spark, tmp_path):
    rows = [("1", 'a "b", c\nd', None, 0.5, True), ("2", "'x'", " y ", 1.0, False), ("3", "\\", "#", 0.0, True)]
    frame = spark.createDataFrame(rows, "subject string, a string, b string, r double, d boolean")
    path = str(tmp_path / "out")
    tables.write_csv(frame, path)
    tables.write_csv(frame, path)  # overwrites
    found = tables.read_csv(spark, path).drop("_row").orderBy("subject").collect()
    assert [tuple(r) for r in found] == [
        (s, a, b, str(r), str(d).lower()) for s, a, b, r, d in rows
    ]


def test_few_files(spark, tmp_path):
    rows = spark.range(0, 20_000, 1, 8).select(F.col("id").alias("subject"), F.md5(F.col("id").cast("string")))
    size, floor = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    before = {key: spark.conf.get(key) for key in (size, floor)}
    tables.write_csv(rows, str(tmp_path / "small"), few_files=True)
    try:
        spark.conf.set(size, "100k")
        spark.conf.set(floor, "50k")
        tables.write_csv(rows, str(tmp_path / "large"), few_files=True)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert len(list((tmp_path / "small").glob("*.csv"))) == 1
    assert len(list((tmp_path / "large").glob("*.csv"))) > 1
    for name in ("small", "large"):
        assert tables.read_csv(spark, str(tmp_path / name)).select("subject").distinct().count() == 20_000


def test_row_positions_follow_the_file(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("subject,v\n" + "".join(f"s{i % 50},{i}\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        rows = tables.read_csv(spark, str(path), line_per_record=True)
        assert rows.rdd.getNumPartitions() > 4
        found = collapse_by_id(rows, ["_row"]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["subject"]: r["v"] for r in found} == {f"s{i}": str(i) for i in range(50)}


@pytest.mark.parametrize("line_per_record", [False, True])
def test_row_positions_follow_the_names_of_files(spark, tmp_path, line_per_record):
    (tmp_path / "part-0.csv").write_text("subject,v\n" + "".join(f"s{i},first\n" for i in range(3)))
    long = "".join(f"s{i % 5},second and longer {i}\n" for i in range(3_000))
    (tmp_path / "part-1.csv").write_text("subject,v\n" + long)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = tables.read_csv(spark, str(tmp_path), line_per_record)
        found = {r["subject"]: r["v"] for r in collapse_by_id(rows, ["_row"]).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {
        **{f"s{i}": "first" for i in range(3)},
        **{f"s{i}": f"second and longer {i}" for i in (3, 4)},
    }


def test_the_last_of_equal_keys_in_a_mapping_file_holds(spark, tmp_path):
    path = tmp_path / "map.json"
    path.write_text('{"a": "first", "b": "only", "a": "last"}')
    found = {r["key"]: r["value"] for r in tables.read_mapping(spark, str(path)).collect()}
    assert found == {"a": "last", "b": "only"}


def test_bindings(spark, tmp_path):
    def response(rows):
        cells = [{k: {"type": "literal", "value": v} for k, v in r.items()} for r in rows]
        return {"head": {"vars": ["subject"]}, "results": {"bindings": cells}}

    (tmp_path / "a.json").write_text(json.dumps(response([{"subject": "1", "city": ""}]), indent=2))
    (tmp_path / "b.json").write_text(json.dumps(response([{"subject": "2"}, {"city": "Gent"}])))
    (tmp_path / "c.json").write_text(json.dumps(response([])))
    found = tables.read_bindings(spark, str(tmp_path), ["subject", "city", "gml"])
    assert found.columns == ["subject", "city", "gml"]
    assert sorted(map(tuple, found.collect()), key=repr) == [
        ("1", "", None), ("2", None, None), (None, "Gent", None)
    ]
    (tmp_path / "lines").mkdir()
    lines = [json.dumps(response([{"subject": str(i)}])) for i in range(5)]
    (tmp_path / "lines" / "d.json").write_text("\n".join(lines))
    found = tables.read_bindings(spark, str(tmp_path / "lines"), response_per_line=True)
    assert found.columns == PLACE_COLUMNS
    assert sorted(r["subject"] for r in found.collect()) == list("01234")


def response(rows, **more):
    cells = [{k: {"type": "literal", "value": v} for k, v in r.items()} for r in rows]
    return {"head": {"vars": ["bindings"], "results": [{"bindings": [1]}]}, "results": {"x": 1, "bindings": cells}, **more}


def test_responses_binding_by_binding(spark, tmp_path):
    long = "é\U0001f600 \"]}," * 40_000
    (tmp_path / "a.json").write_text(json.dumps(response([{"s": "1", "t": ""}, {"s": long}]), indent=2))
    (tmp_path / "b.json").write_text("\ufeff" + json.dumps(response([{"t": "b"}], boolean=True), ensure_ascii=False))
    several = [response([{"s": str(i)}]) for i in range(3)] + [response([]), {"results": None}, {}]
    (tmp_path / "c.json").write_text("\n".join(map(json.dumps, several)))
    (tmp_path / "d.json").write_text("")
    (tmp_path / "e.json").write_text('{"results": {"bindings": [{"s": {"value": 12.5}}, {"s": {"value": "\\ud800"}}, {"s": null}]}}')
    (tmp_path / "_f.json").write_text("not read")
    found = responses.read_responses(spark, str(tmp_path), ["s", "t"])
    assert found.columns == ["s", "t"]
    expected = [("1", ""), (long, None), (None, "b"), ("0", None), ("1", None), ("2", None),
                ("12.5", None), ("?", None), (None, None)]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    assert found.rdd.getNumPartitions() == 4
    one = responses.read_responses(spark, str(tmp_path / "b.json"))
    assert one.columns == PLACE_COLUMNS and one.count() == 1
    (tmp_path / "none").mkdir()
    assert responses.read_responses(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("text", ['{"results": {"bindings": [{"s"', '{"results": {"bindings": [{} {}]}}', "[1]", "{1: 2}"])
def test_what_is_no_response_is_an_error(text):
    with pytest.raises(ValueError):
        list(responses.bindings(io.BytesIO(text.encode())))


def test_a_large_response_takes_the_memory_of_a_block():
    one = json.dumps({c: {"type": "literal", "value": c * 20} for c in PLACE_COLUMNS}).encode() + b","
    count = 20_000_000 // len(one)

    class Stream:
        parts = itertools.chain([b'{"results": {"bindings": ['], itertools.repeat(one, count), [b"{}]}}"])

        def read(self, size):
            return b"".join(itertools.islice(self.parts, max(1, size // len(one))))

    tracemalloc.start()
    seen = sum(1 for _ in responses.bindings(Stream()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == count + 1 and peak < 2_000_000


def test_code_lists_from_files(spark, tmp_path):
    mapping, patterns = tmp_path / "map.json", tmp_path / "list.txt"
    mapping.write_text(json.dumps(vocabulary.TYPE_MAPPING, indent=4))
    patterns.write_text("\n".join([*vocabulary.QUARANTINE, "", "   "]))
    types = list(vocabulary.TYPE_MAPPING)
    assert len(types) == 5 and len(vocabulary.QUARANTINE) == 13
    rows = [("a", types[0]), ("b", "other"), (vocabulary.QUARANTINE[3], None), ("c", None)]
    frame = spark.createDataFrame(rows, "subject string, udbLocationType string")
    known = filter_type(frame, tables.read_mapping(spark, str(mapping)))
    kept = remove_quarantined(known, tables.read_patterns(spark, str(patterns)))
    assert sorted(r["subject"] for r in kept.collect()) == ["a", "c"]


def test_files_through_merge_and_cleanse(spark, stage, tmp_path):
    """The whole way by files, as a user runs it: two CSV files in, one cleansed table out."""
    one, two, out = (str(tmp_path / n) for n in ("one.csv", "two.csv", "out"))
    header = "subject,locationName,locationType,thoroughfare,huisnummer,postCode,city"
    with open(one, "w", encoding="utf-8") as f:
        f.write(header + ",udbLocationType\n")
        f.write("s1,'t zaal 1,x,kaai,1,9000.0,gent,\n")
        f.write("s2,'T ZAAL,x,Kaai,1,9000,Gent,\n")
        f.write("s2,second,x,Kaai,1,9000,Gent,\n")
        f.write("s3,other,x,kaai,1,9000,Gent,https://unknown\n")
    with open(two, "w", encoding="utf-8") as f:
        f.write(header + "\n")
        f.write("s4,bib,y,plein,2,1000,\n")
        f.write("s2,late,x,late,1,late,late\n")
        f.write("https://data.publiq.be/places/61bb6b32-141e-4c38-97b0-7c93549e7133,a,b,c,d,e,f\n")
    merged = merge_by_name([tables.read_csv(spark, one), tables.read_csv(spark, two)])
    tables.write_csv(merged.drop("_src"), out)
    cleansed = jobs.cleanse(merged, vocabulary.TYPE_MAPPING, vocabulary.QUARANTINE, stage)
    found = {r["subject"]: r for r in cleansed.collect()}
    assert set(found) == {"s1", "s2", "s4"}
    assert [found["s1"][c] for c in VERDICT_COLUMNS] == [1.0, True, ""]
    assert [found["s2"][c] for c in VERDICT_COLUMNS] == [1.0, True, "s1"]
    assert [found["s4"][c] for c in VERDICT_COLUMNS] == [0.0, False, None]
    assert (found["s1"]["locationName"], found["s1"]["thoroughfare"]) == ("'t zaal", "Kaai")
    assert found["s1"]["postCode"] == "9000"
    tables.write_csv(cleansed, out)
    again = tables.read_csv(spark, out).filter("subject = 's2'").first()
    assert (again["certainty_ratio"], again["duplicate_subject"]) == ("1.0", "s1")


def test_stage_keeps_measures_and_releases(spark):
    stage = Stage(spark)
    assert stage.folder.startswith(checkpoint_folder(spark) + "/")
    rows = spark.range(100).withColumn("k", F.col("id") % 3)
    table, seen = stage.keep_measured(rows, "t", n=F.count(F.lit(1)), most=F.max("k"))
    assert seen == {"n": 100, "most": 2}
    assert table.schema == rows.schema or table.columns == rows.columns
    assert "FileScan parquet" in table._jdf.queryExecution().toString()
    empty, seen = stage.keep_measured(rows.filter("id < 0"), "t", most=F.max("k"))
    assert seen == {"most": 0} and empty.isEmpty()
    stage.release()
    with pytest.raises(Exception):
        spark.read.parquet(f"{stage.folder}/001-t").count()


class SessionOf:
    """As much of a session as the choice of the folder reads."""

    def __init__(self, **settings):
        self.conf = {name.replace("_", "."): value for name, value in settings.items()}


def test_folder_is_the_one_the_cluster_names():
    named = SessionOf(spark_master="yarn", spark_checkpoint_dir="hdfs://nn/shared/")
    assert checkpoint_folder(named) == "hdfs://nn/shared"
    own = checkpoint_folder(SessionOf(spark_master="local[2]"))
    assert own == checkpoint_folder(SessionOf(spark_master="local[8]"))
    for unnamed in (SessionOf(spark_master="yarn"), SessionOf(spark_master="local-cluster[2,1,1024]"), SessionOf()):
        with pytest.raises(ValueError, match=CHECKPOINT_DIR):
            checkpoint_folder(unnamed)


def test_empty_tables_go_through(spark, stage):
    columns = ", ".join(f"CAST(NULL AS STRING) AS {c}" for c in PLACE_COLUMNS)
    for text in (f"SELECT {columns}, 1 AS _row WHERE false", "SELECT 'a' AS subject, 1 AS _row WHERE false"):
        found = jobs.cleanse(spark.sql(text), vocabulary.TYPE_MAPPING, vocabulary.QUARANTINE, stage)
        assert found.columns == [*PLACE_COLUMNS, *VERDICT_COLUMNS] and found.isEmpty()
    quads = spark.sql("SELECT CAST(NULL AS STRING) AS g, 's' AS s, 'p' AS p, 'o' AS o WHERE false")
    for product in products.PRODUCTS:
        assert products.fetch(product, quads, stage).isEmpty()


def test_bare_ids_get_a_verdict(spark, stage):
    rows = spark.createDataFrame([("a", 0), ("b", 1)], "subject string, _row int")
    found = jobs.cleanse(rows, {}, [], stage).orderBy("subject").collect()
    assert [r["duplicate_subject"] for r in found] == ["", "a"]
    assert [r["certainty_ratio"] for r in found] == [0.1, 0.1]
    apart = jobs.cleanse(rows, {}, [], stage, null_keys_match=False).collect()
    assert {r["certainty_ratio"] for r in apart} == {0.0}
    named = jobs.cleanse(rows, {}, [], stage, null_name_text="nan").collect()
    assert {r["locationName"] for r in named} == {"nan"}
