"""Tiered deduplication: each pass groups the rows that no earlier pass has matched.

A pass is one aggregation, combined before the shuffle. A group of one *is* its row, so the rows
left for the next pass come straight out of the aggregate; only members of larger groups are
joined back to it, with hot groups salted. No group is ever gathered in one task.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.functions.text import title_case
from placeweave.operators.skew import HOT_ROWS, hot_from_counts, salted_join
from placeweave.schema import KEY_COLUMNS, VERDICT_COLUMNS
from placeweave.staging import Stage


@dataclass(frozen=True)
class Tier:
    """Rows that agree on `keys` are duplicates with this certainty."""

    name: str
    keys: tuple[str, ...]
    certainty: float


# The passes and their certainty.
EXACT = Tier("exact", tuple(KEY_COLUMNS), 1.0)
SAME_NAME = Tier("name", ("locationName", "locationType", "postCode"), 0.6)
SAME_ADDRESS = Tier("address", ("thoroughfare", "huisnummer", "postCode", "city"), 0.4)
TIERS = (EXACT, SAME_NAME, SAME_ADDRESS)

# Certainty of an exact match without postcode or city, and of no match.
INCOMPLETE_ADDRESS = 0.1
UNIQUE = 0.0


# The name as it was before title case.
PLAIN_NAME = "plain_name"


def comparison_keys(places: DataFrame) -> DataFrame:
    """The id, the plain name, and the compared columns: name, street and city in title case."""
    titled = {c: title_case(F.col(c)) for c in ("locationName", "thoroughfare", "city")}
    plain = F.col("locationName").alias(PLAIN_NAME)
    return places.select("subject", plain, *KEY_COLUMNS).withColumns(titled)


def match_tier(
    rows: DataFrame,
    tier: Tier,
    stage: Stage,
    null_keys_match: bool = True,
    hot_rows: int = HOT_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Split `rows` (id, keys and any others) into the members of shared groups and the rest.

    Members get the tier's verdict; their representative is the smallest id of the group.
    With `null_keys_match=False` a row that lacks a key has no duplicates.
    """
    keys = list(tier.keys)
    others = [c for c in rows.columns if c not in ("subject", *keys)]
    lacking = None
    if not null_keys_match:
        complete = F.lit(True)
        for key in keys:
            complete &= F.col(key).isNotNull()
        lacking = rows.filter(~complete)
        rows = rows.filter(complete)
    groups, seen = stage.keep_measured(
        rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("subject", *others)).alias("first")
        ),
        f"groups-{tier.name}",
        largest=F.max("n"),
    )
    shared = groups.filter("n > 1")
    hot = hot_from_counts(shared, keys, "n", hot_rows) if seen["largest"] >= hot_rows else {}
    representative = shared.select(*keys, F.col("first.subject").alias("duplicate_subject"))
    members = salted_join(rows, representative, keys, hot, null_safe=True)
    rest = groups.filter("n = 1").select("first.*", *keys)
    if lacking is not None:
        rest = rest.unionByName(lacking)
    return with_verdict(members, tier.certainty, True), rest


def with_verdict(rows: DataFrame, certainty: float, duplicate: bool) -> DataFrame:
    if not duplicate:
        rows = rows.withColumn("duplicate_subject", F.lit(None).cast("string"))
    return rows.withColumns(
        {"certainty_ratio": F.lit(certainty), "is_duplicate": F.lit(duplicate)}
    )


def match_tiers(
    rows: DataFrame,
    stage: Stage,
    tiers: tuple[Tier, ...] = TIERS,
    null_keys_match: bool = True,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Every row (one per id) with the verdict of the first tier that matches it."""
    matched = []
    for tier in tiers:
        members, rows = match_tier(rows, tier, stage, null_keys_match, hot_rows)
        matched.append(members)
    verdicts = with_verdict(rows, UNIQUE, False)
    for members in matched:
        verdicts = verdicts.unionByName(members)
    return verdicts


def final_verdict(verdicts: DataFrame) -> DataFrame:
    """Blank the representative's own pointer and lower exact matches with half an address."""
    own = F.col("duplicate_subject") == F.col("subject")
    incomplete = (F.coalesce("postCode", F.lit("")) == "") | (
        F.coalesce("city", F.lit("")) == ""
    )
    exact = F.col("certainty_ratio") == EXACT.certainty
    return verdicts.withColumns(
        {
            "duplicate_subject": F.when(own, "").otherwise(F.col("duplicate_subject")),
            "certainty_ratio": F.when(exact & incomplete, INCOMPLETE_ADDRESS).otherwise(
                F.coalesce("certainty_ratio", F.lit(UNIQUE))
            ),
        }
    )


def apply_verdict(places: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Places with their verdict; street and city keep the title case, the name does not.

    The compared columns come with the verdicts, so only the other columns of `places` are worked
    out and joined. Ids are unique on both sides, so the join has no hot key, and `places` does
    not move where it is already laid out by id.
    """
    compared = verdicts.withColumn("locationName", F.col(PLAIN_NAME))
    others = [c for c in places.columns if c not in KEY_COLUMNS]
    joined = places.select(others).join(
        compared.select("subject", *KEY_COLUMNS, *VERDICT_COLUMNS), "subject"
    )
    return joined.select(*places.columns, *VERDICT_COLUMNS)


def certainty_histogram(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("certainty_ratio").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy("certainty_ratio")


def relative_frequency(rows: DataFrame, keys: list[str], stage: Stage) -> DataFrame:
    """Share of the rows that each key combination holds. `rows` is worked out once."""
    counts = stage.keep(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "counts")
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(*keys, (F.col("n") / total).alias("share"))
