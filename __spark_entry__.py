
from __future__ import annotations

import json
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oracles import sql as oracles
from placeweave import fixtures
from placeweave.functions.similarity import token_sort_ratio
from placeweave.functions.text import clean_name, drop_decimal_zero
from placeweave.operators import dedup, fuzzy, graph, relational
from placeweave.plans import jobs, products
from placeweave.schema import KEY_COLUMNS, PLACE_COLUMNS, VERDICT_COLUMNS
from placeweave.sources import responses, store, tables
from placeweave.staging import Stage

try:
    import corpus_pipeline
    from placeweave.llm import queries as llm
except ImportError:
    # The training-data operators are an optional part, with libraries of their own: all of it can
    # be imported, or it is left out.
    llm = None


# -- sources and sinks --------------------------------------------------------------------


def load_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.places_with_position(spark, sf_dir)
    mark = F.col("n") % 13
    city = F.when(mark == 0, "").when(mark == 1, "NA").when(mark == 2, "null")
    number = F.when(mark == 3, "n/a").when(mark == 4, "NaN").when(mark == 5, "#N/A")
    marked = rows.withColumns(
        {
            "city": F.coalesce(F.when(mark == 3, "None").otherwise(city), "city"),
            "huisnummer": F.coalesce(number, "huisnummer"),
        }
    )
    return _through_csv(spark, marked.drop("n", "e", "v"))


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.places_with_position(spark, sf_dir)
    text = F.concat("fullAddress", F.lit(', "bis"\nline '), F.col("n").cast("string"))
    return _through_csv(spark, rows.withColumn("fullAddress", text).drop("n", "e", "v"))


def _through_csv(spark: SparkSession, rows: DataFrame) -> DataFrame:
    path = Stage(spark).path("csv")
    tables.write_csv(rows, path)
    return tables.read_places(spark, path).select(PLACE_COLUMNS)


def _responses(spark: SparkSession, sf_dir: str) -> str:
    rows = fixtures.places_with_position(spark, sf_dir)
    cells = [
        x
        for c in PLACE_COLUMNS
        for x in (F.lit(c), F.struct(F.lit("literal").alias("type"), F.col(c).alias("value")))
    ]
    bound = F.map_filter(F.create_map(*cells), lambda _, cell: cell["value"].isNotNull())
    # A response is one page of 500 results, as a service would give them out.
    pages = rows.groupBy(F.floor(F.col("n") / 500)).agg(F.collect_list(bound).alias("bindings"))
    path = Stage(spark).path("responses")
    pages.select(F.to_json(F.struct(F.struct("bindings").alias("results")))).write.text(path)
    return path


def bindings_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_bindings(spark, _responses(spark, sf_dir), response_per_line=True)


def bindings_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the data source, which reads a response binding by binding."""
    return responses.read_responses(spark, _responses(spark, sf_dir))


# -- graph --------------------------------------------------------------------------------


def product(name: str, spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    stage = Stage(spark)
    quads = fixtures.quads(spark, sf_dir)
    if name != "count":
        # All but the count read the store several times; it is made once.
        quads = stage.keep(quads, "quads")
    return products.fetch(name, quads, stage, **options)


def product_from_store(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product, from a store that is laid out by predicate and subject."""
    stage = Stage(spark)
    path = stage.path("store")
    buckets = fixtures.store_buckets(spark, sf_dir)
    store.write_store(fixtures.quads(spark, sf_dir), path, buckets)
    return products.fetch(name, store.read_store(spark, path, buckets), stage)


def quads_head_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many quads a preview in any order has, and how many of them the store has."""
    quads = fixtures.quads(spark, sf_dir)
    some = graph.head(quads, 100, ordered=False)
    same = [some[c].eqNullSafe(quads[c]) for c in ("g", "s", "p", "o")]
    found = some.join(quads, same, "left_semi")
    return some.agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("known")).union(
        found.agg(F.lit(0), F.count(F.lit(1)))
    ).agg(F.max("n").alias("n"), F.max("known").alias("known"))


def subject_count_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the count from the sketches of two halves of the store is near the exact one."""
    quads = fixtures.quads(spark, sf_dir)
    odd = F.pmod(F.xxhash64("s", "o"), F.lit(2)) == 1
    sketches = [graph.subject_sketch(quads.filter(half)) for half in (odd, ~odd)]
    estimate = graph.sketched_subject_count(sketches[0].union(sketches[1]))
    exact = graph.subject_count(quads)
    rows = exact.select("subjectCount", F.lit(0).alias("estimate")).union(
        estimate.select(F.lit(0), "subjectCount")
    )
    both = rows.agg(F.max("subjectCount").alias("subjectCount"), F.max("estimate").alias("estimate"))
    near = F.abs(F.col("estimate") - F.col("subjectCount")) <= F.greatest(
        F.lit(1.0), 4 * graph.SKETCH_ERROR * F.col("subjectCount")
    )
    return both.select("subjectCount", near.alias("near"))


# -- relational ---------------------------------------------------------------------------


def merged_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = [
        fixtures.places_with_position(spark, sf_dir).drop("e", "v"),
        fixtures.places2_with_position(spark, sf_dir),
    ]
    return relational.merge_by_name(sources).withColumnRenamed("n", relational.ROW)


def merge_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_places(spark, sf_dir).drop(relational.ROW)


def collapse_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merged_places(spark, sf_dir)
    return relational.collapse_by_id(merged, [relational.SOURCE, relational.ROW])


def collapse_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merged_places(spark, sf_dir)
    order = [relational.SOURCE, relational.ROW]
    return relational.collapse_by_id(merged, order, {"locationName": F.max("locationName")})


def merge_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two CSV sources of several files, merged, collapsed and written as CSV again.

    The second source lists its places twice, the second time with other names.
    """
    one = fixtures.places_with_position(spark, sf_dir).drop("e", "v")
    two = fixtures.places2_with_position(spark, sf_dir)
    again = two.withColumns(
        {
            "n": F.col("n") + fixtures.AGAIN,
            "locationName": F.concat(F.lit("late "), "locationName"),
            "thoroughfare": F.lit("late"),
        }
    )
    stage = Stage(spark)
    sources = []
    for rows in (one, two.unionByName(again)):
        path = stage.path("csv")
        files = rows.repartitionByRange(3, "n").sortWithinPartitions("n")
        tables.write_csv(files.drop("n"), path)
        sources.append(tables.read_csv(spark, path))
    merged = relational.merge_by_name(sources)
    collapsed = relational.collapse_by_id(merged, [relational.SOURCE, relational.ROW])
    return _through_csv(spark, collapsed)


def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merged_places(spark, sf_dir)
    return relational.stage_counts(merged, fixtures.MAPPING, fixtures.QUARANTINE, Stage(spark))


def cleanse_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of the cleansing run itself."""
    merged = merged_places(spark, sf_dir)
    return jobs.cleanse_counted(merged, fixtures.MAPPING, fixtures.QUARANTINE, Stage(spark))[1]


def cleanse_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of that run."""
    merged = merged_places(spark, sf_dir)
    places, _ = jobs.cleanse_counted(merged, fixtures.MAPPING, fixtures.QUARANTINE, Stage(spark))
    return places.select(*PLACE_COLUMNS, *VERDICT_COLUMNS)


def stage_counts_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with mapping and quarantine as long tables."""
    stage = Stage(spark)
    return relational.stage_counts(
        merged_places(spark, sf_dir), mapping_file(stage), pattern_file(stage), stage, "literal"
    )


def mapping_file(stage: Stage) -> DataFrame:
    """The mapping, with many keys that no place has, read from a JSON file."""
    path = stage.path("mapping")
    _write_text(stage, path, [json.dumps(fixtures.LONG_MAPPING, indent=1)])
    return tables.read_mapping(stage.spark, path)


def pattern_file(stage: Stage, lines: list[str] = fixtures.LONG_QUARANTINE_TEXT) -> DataFrame:
    """The quarantined texts, with many that no id has, read from a text file."""
    path = stage.path("patterns")
    _write_text(stage, path, lines)
    return tables.read_patterns(stage.spark, path)


def _write_text(stage: Stage, path: str, lines: list[str]) -> None:
    rows = stage.spark.createDataFrame([(line,) for line in lines], "value string")
    rows.coalesce(1).write.text(path)


def filter_type_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = mapping_file(Stage(spark))
    return relational.filter_type(fixtures.places(spark, sf_dir), mapping)


def map_type_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = mapping_file(Stage(spark))
    return relational.map_type(fixtures.places(spark, sf_dir), mapping)


def remove_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = pattern_file(Stage(spark))
    return relational.remove_quarantined(fixtures.places(spark, sf_dir), patterns, "literal")


def remove_regex_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with 5,000 regular expressions."""
    stage = Stage(spark)
    patterns = pattern_file(stage, fixtures.LONG_QUARANTINE)
    places = fixtures.places(spark, sf_dir)
    return relational.remove_quarantined(places, patterns, "regex", stage)


def filter_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.filter_type(fixtures.places(spark, sf_dir), fixtures.MAPPING)


def map_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.map_type(fixtures.places(spark, sf_dir), fixtures.MAPPING)


def remove(mode: str, lines: list[str], spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.remove_quarantined(fixtures.places(spark, sf_dir), lines, mode)


def relative_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = dedup.comparison_keys(ready_places(spark, sf_dir))
    return dedup.relative_frequency(keys, list(dedup.SAME_NAME.keys), Stage(spark))


# -- text ---------------------------------------------------------------------------------


def clean_names(null_text: str | None, spark: SparkSession, sf_dir: str) -> DataFrame:
    name = clean_name(F.col("locationName"), null_text).alias("locationName")
    return fixtures.places(spark, sf_dir).select("subject", name)


def fix_postcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = drop_decimal_zero(F.col("postCode")).alias("postCode")
    return fixtures.places(spark, sf_dir).select("subject", code)


def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.comparison_keys(ready_places(spark, sf_dir)).drop(dedup.PLAIN_NAME)


def score_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each place's name against that of the fifth of its group of eight; null without a name."""
    name = clean_name(F.col("locationName"))
    rows = fixtures.places_with_position(spark, sf_dir).select("subject", "e", "v", name.alias("x"))
    fifth = rows.filter("v = 4").select("e", F.col("x").alias("y"))
    score = token_sort_ratio(F.col("x"), F.col("y")).alias("score")
    return rows.join(fifth, "e").select("subject", score)


# -- deduplication ------------------------------------------------------------------------


def ready_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.prepare_places(
        fixtures.places(spark, sf_dir), fixtures.MAPPING, fixtures.QUARANTINE
    )


def passes(count: int, null_keys_match: bool, spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark)
    keys = stage.keep(dedup.comparison_keys(ready_places(spark, sf_dir)), "keys")
    matched = dedup.match_tiers(keys, stage, dedup.TIERS[:count], null_keys_match)
    return matched.select("subject", *VERDICT_COLUMNS)


def _matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Stage]:
    stage = Stage(spark)
    keys = stage.keep(dedup.comparison_keys(ready_places(spark, sf_dir)), "keys")
    return stage.keep(dedup.match_tiers(keys, stage), "matched"), stage


def fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched, stage = _matched(spark, sf_dir)
    names = stage.keep(fuzzy.names_in_tier(matched), "names")
    return fuzzy.similar_pairs(names, stage).select("match", "original").distinct()


def fuzzy_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    promoted = fuzzy.promote_similar_names(*_matched(spark, sf_dir))
    return promoted.select("subject", *VERDICT_COLUMNS)


def dedup_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    final = jobs.verdicts(ready_places(spark, sf_dir), Stage(spark))
    return final.select("subject", *VERDICT_COLUMNS)


def deduplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = jobs.deduplicate(ready_places(spark, sf_dir), Stage(spark))
    return places.select(*PLACE_COLUMNS, *VERDICT_COLUMNS)


def certainty_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    final = jobs.verdicts(ready_places(spark, sf_dir), Stage(spark))
    return dedup.certainty_histogram(final)


# -- composite jobs -----------------------------------------------------------------------


def cleanse(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = jobs.cleanse(
        merged_places(spark, sf_dir),
        fixtures.MAPPING,
        fixtures.QUARANTINE,
        Stage(spark),
    )
    return places.select(*PLACE_COLUMNS, *VERDICT_COLUMNS)


def end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark)
    quads = stage.keep(fixtures.quads(spark, sf_dir), "quads")
    places = jobs.end_to_end(
        {name: quads for name in products.PRODUCTS},
        fixtures.MAPPING,
        fixtures.QUARANTINE,
        stage,
    )
    return places.select(*PLACE_COLUMNS, *VERDICT_COLUMNS)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: the cleansing job on the smallest tables."""
    return cleanse(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "load_places": load_places,
        "csv_roundtrip": csv_roundtrip,
        "bindings_flatten": bindings_flatten,
        "bindings_streamed": bindings_streamed,
        "stage_counts": stage_counts,
        "cleanse_counts": cleanse_counts,
        "cleanse_counted": cleanse_counted,
        "quads_head": partial(product, "head"),
        "quads_head_any": quads_head_any,
        "subject_count": partial(product, "count"),
        "subject_count_sketch": subject_count_sketch,
        "filter_type": filter_type,
        "merge_by_name": merge_by_name,
        "collapse_by_id": collapse_by_id,
        "map_type": map_type,
        "remove_quarantined": partial(remove, "regex", fixtures.QUARANTINE),
        "remove_literal": partial(remove, "literal", fixtures.QUARANTINE_TEXT),
        "remove_exact": partial(remove, "exact", fixtures.QUARANTINE_IDS),
        "collapse_overrides": collapse_overrides,
        "merge_csv": merge_csv,
        "stage_counts_tables": stage_counts_tables,
        "filter_type_file": filter_type_file,
        "map_type_file": map_type_file,
        "remove_file": remove_file,
        "remove_regex_file": remove_regex_file,
        "clean_names": partial(clean_names, None),
        "clean_names_null_text": partial(clean_names, "nan"),
        "fix_postcodes": fix_postcodes,
        "title_keys": title_keys,
        "token_sort_ratio": score_names,
        "relative_frequency": relative_frequency,
        "dedup_exact": partial(passes, 1, True),
        "dedup_name_pass": partial(passes, 2, True),
        "dedup_address_pass": partial(passes, 3, True),
        "dedup_null_keys_apart": partial(passes, 3, False),
        "fuzzy_pairs": fuzzy_pairs,
        "fuzzy_promote": fuzzy_promote,
        "dedup_final": dedup_final,
        "deduplicate": deduplicate,
        "certainty_histogram": certainty_histogram,
        "cleanse": cleanse,
        "end_to_end": end_to_end,
    }
    for name in products.PRODUCTS:
        found[f"product_{name}"] = partial(product, name)
    found["product_jeugdmaps_store"] = partial(product_from_store, "jeugdmaps")
    found["product_publiq_store"] = partial(product_from_store, "publiq")
    found["product_erfgoed_union"] = partial(product, "erfgoed", union=True)
    if llm is not None:
        found |= llm.queries() | {"pipeline": corpus_pipeline.run}
    return found


def oracle_sql() -> dict[str, str]:
    found = oracles.oracle_sql()
    if llm is not None:
        found |= llm.oracle_sql()
    return found
