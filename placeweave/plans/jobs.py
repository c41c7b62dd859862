"""The composite jobs: merge, cleanse with deduplication, and extraction through to the end."""

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.functions.text import clean_name, drop_decimal_zero
from placeweave.operators.dedup import (
    apply_verdict,
    comparison_keys,
    final_verdict,
    match_tiers,
)
from placeweave.operators.fuzzy import promote_similar_names
from placeweave.operators.relational import (
    ROW,
    SOURCE,
    Mapping,
    Patterns,
    collapse_by_id,
    collapse_counted,
    counts_of,
    filter_type,
    known_ids,
    map_type,
    merge_by_name,
    remove_quarantined,
    with_columns,
)
from placeweave.operators.skew import HOT_ROWS
from placeweave.plans.products import fetch
from placeweave.schema import PLACE_COLUMNS
from placeweave.sources.tables import blank_to_null
from placeweave.staging import Stage


def clean_columns(places: DataFrame, null_name_text: str | None = None) -> DataFrame:
    return places.withColumns(
        {
            "locationName": clean_name(F.col("locationName"), null_name_text),
            "postCode": drop_decimal_zero(F.col("postCode")),
        }
    )


def prepare_places(
    places: DataFrame,
    mapping: Mapping,
    patterns: Patterns,
    mode: str = "regex",
    null_name_text: str | None = None,
) -> DataFrame:
    """Type filter, cleaning, type mapping and quarantine of places that have one row per id."""
    known = filter_type(with_columns(places, PLACE_COLUMNS), mapping)
    cleaned = clean_columns(known, null_name_text)
    return remove_quarantined(map_type(cleaned, mapping), patterns, mode)


def verdicts(
    places: DataFrame, stage: Stage, null_keys_match: bool = True, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The final verdict per id. The compared columns alone go through the passes."""
    keys = stage.keep(comparison_keys(places), "keys")
    matched, seen = stage.keep_measured(
        match_tiers(keys, stage, null_keys_match=null_keys_match, hot_rows=hot_rows),
        "matched",
        total=F.count(F.lit(1)),
    )
    promoted = promote_similar_names(matched, stage, hot_rows=hot_rows, at_most=seen["total"])
    return final_verdict(promoted)


def deduplicate(
    places: DataFrame, stage: Stage, null_keys_match: bool = True, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Places (one row per id) with certainty, duplicate flag and representative id."""
    return apply_verdict(places, verdicts(places, stage, null_keys_match, hot_rows))


def cleanse(
    rows: DataFrame,
    mapping: Mapping,
    patterns: Patterns,
    stage: Stage,
    order: list[str] | None = None,
    mode: str = "regex",
    null_name_text: str | None = None,
    null_keys_match: bool = True,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The whole cleansing job on merged rows.

    `order` names the columns that rank the rows of one id; by default source and row position,
    as far as the rows have them. The type filter and the id pattern reach the scan, so dropped
    rows are never shuffled.
    """
    order = order or [c for c in (SOURCE, ROW) if c in rows.columns]
    known = filter_type(with_columns(rows, PLACE_COLUMNS), mapping)
    places = collapse_by_id(remove_quarantined(known, patterns, mode, stage), order)
    # Read twice, for the compared columns and for the others.
    places = stage.keep(map_type(clean_columns(places, null_name_text), mapping), "places")
    return deduplicate(places, stage, null_keys_match, hot_rows)


def cleanse_counted(
    rows: DataFrame,
    mapping: Mapping,
    patterns: Patterns,
    stage: Stage,
    order: list[str] | None = None,
    mode: str = "regex",
    null_name_text: str | None = None,
    null_keys_match: bool = True,
    hot_rows: int = HOT_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """The places of `cleanse`, and the rows after each of its steps as `stage_counts` has them.

    The rows are read once: the collapsed table, which is written anyway, carries the counts per
    id. They are summed from the written tables, so they stay right when a task runs again. The
    price is that rows of an unknown type take part in the collapse.
    """
    order = order or [c for c in (SOURCE, ROW) if c in rows.columns]
    per_id = collapse_counted(with_columns(rows, PLACE_COLUMNS), order, mapping)
    per_id = stage.keep(per_id, "per-id")
    known = known_ids(per_id).drop("_loaded", "_known")
    places = remove_quarantined(known, patterns, mode, stage)
    places = stage.keep(map_type(clean_columns(places, null_name_text), mapping), "places")
    return deduplicate(places, stage, null_keys_match, hot_rows), counts_of(per_id, places)


def end_to_end(
    stores: dict[str, DataFrame],
    mapping: Mapping,
    patterns: Patterns,
    stage: Stage,
    **options,
) -> DataFrame:
    """Extract each product from its store, merge in the given order, and cleanse.

    The products do not depend on each other, so their Spark jobs are submitted side by side.
    """

    @inheritable_thread_target(stage.spark)
    def extract(product: str) -> DataFrame:
        return stage.keep(blank_to_null(fetch(product, stores[product], stage)), product)

    with ThreadPoolExecutor(max_workers=max(1, len(stores))) as pool:
        records = list(pool.map(extract, stores))
    merged = with_columns(merge_by_name(records), PLACE_COLUMNS)
    # A job has no row order, so within one source a digest decides, which is repeatable.
    cells = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in PLACE_COLUMNS])
    return cleanse(merged.withColumn(ROW, F.md5(cells)), mapping, patterns, stage, **options)
