"""Promotion of address matches whose names are nearly equal."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.functions.similarity import (
    is_similar,
    is_surely_similar,
    may_be_similar,
    may_meet,
    numbered_grams,
    profile,
    signatures,
    sort_tokens,
)
from placeweave.operators.dedup import SAME_ADDRESS
from placeweave.operators.skew import HOT_ROWS, hot_from_counts, hot_from_rows, salted_join
from placeweave.staging import Stage

# The lowest score that counts as the same name, and the certainty it gives.
MIN_SCORE = 90
SIMILAR_NAME = 0.5
# Up to this many names at one address, a name may be compared with each of them; from there
# on it is compared only with names that share a signature. Up to as many may share a gram that is
# a signature as it is.
QUIET_ADDRESS = 32


def names_in_tier(verdicts: DataFrame) -> DataFrame:
    """One row per name of the address tier.

    `rank` orders the names by their first id in the tier; street and postcode come from the
    first row of the name in the tier (as a match) and among all rows (as an original).
    """
    row = F.struct("subject", "thoroughfare", "postCode")
    in_tier = F.col("certainty_ratio") == SAME_ADDRESS.certainty
    wanted = verdicts.filter(in_tier).select("locationName").distinct()
    firsts = (
        verdicts.join(wanted, "locationName", "left_semi")
        .groupBy("locationName")
        .agg(F.min(row).alias("overall"), F.min(F.when(in_tier, row)).alias("tier"))
        .filter(F.col("tier").isNotNull())
    )
    return firsts.select(
        F.col("locationName").alias("name"),
        sort_tokens(F.col("locationName")).alias("sorted"),
        F.col("tier.subject").alias("rank"),
        F.col("tier.thoroughfare").alias("match_street"),
        F.col("tier.postCode").alias("match_postcode"),
        F.col("overall.subject").alias("first_subject"),
        F.col("overall.thoroughfare").alias("original_street"),
        F.col("overall.postCode").alias("original_postcode"),
    )


def _at_address(names: DataFrame, role: str, columns: list[str]) -> DataFrame:
    return names.select(
        F.col(f"{role}_street").alias("street"), F.col(f"{role}_postcode").alias("postcode"), *columns
    )


_ADDRESS = ["street", "postcode"]


def keyed_names(
    names: DataFrame, stage: Stage, min_score: int, quiet_address: int, hot_rows: int
) -> tuple[DataFrame, DataFrame, int]:
    """Matches and originals with the `signature` on which similar names at an address meet, its
    place `at` in the name, and at least the number of names at the busiest address.

    Where an address has few names they all meet, on an empty signature. Elsewhere a name has the
    rarest grams at its address as signatures, so that words that many names share are no key.
    """
    matches = _at_address(names, "match", ["name", "sorted"]).dropna(subset=_ADDRESS)
    originals = _at_address(names, "original", ["name", "sorted", "rank", "first_subject"])
    originals = originals.dropna(subset=_ADDRESS)
    counts = originals.groupBy(*_ADDRESS).agg(F.count(F.lit(1)).alias("n"))
    busy, seen = stage.keep_measured(
        counts.filter(F.col("n") > quiet_address),
        "busy-addresses",
        largest=F.max("n"),
    )
    text, roles = F.col("sorted"), {}
    if not seen["largest"]:
        quiet = [
            F.lit("").alias("signature"),
            F.lit(0).alias("at"),
            profile(text, F.lit(False)).alias("profile"),
        ]
        return matches.select("*", *quiet), originals.select("*", *quiet), quiet_address
    for role, rows in (("matches", matches), ("originals", originals)):
        hot = hot_from_rows(rows, _ADDRESS, hot_rows)
        roles[role] = stage.keep(salted_join(rows, busy, _ADDRESS, hot, how="left"), role)
    grams = {
        role: rows.filter("n IS NOT NULL").select(
            *_ADDRESS, "name", F.explode(numbered_grams(text)).alias("gram")
        )
        for role, rows in roles.items()
    }
    everywhere = grams["matches"].union(grams["originals"])
    held = everywhere.groupBy(*_ADDRESS, "gram").agg(F.count(F.lit(1)).alias("held"))
    held = stage.keep(held, "grams")
    hot = hot_from_counts(held, [*_ADDRESS, "gram"], "held", hot_rows)

    def keyed(role: str) -> DataFrame:
        # A name has no more grams than characters.
        ranked = salted_join(grams[role], held, [*_ADDRESS, "gram"], hot)
        ordered = F.sort_array(F.collect_list(F.struct("held", "gram"))).alias("rarest")
        rows = roles[role].join(
            ranked.groupBy(*_ADDRESS, "name").agg(ordered), [*_ADDRESS, "name"], "left"
        )
        is_busy = F.col("n").isNotNull()
        rarest = F.transform(
            F.coalesce("rarest", F.array().cast("array<struct<held: bigint, gram: string>>")),
            lambda x: F.struct(x["gram"].alias("gram"), (x["held"] > quiet_address).alias("common")),
        )
        keys = signatures(text, rarest, min_score, role == "matches")
        together = F.array(F.struct(F.lit("").alias("key"), F.lit(0).alias("at")))
        columns = [c for c in roles[role].columns if c != "n"]
        # Every name has a key; the outer form does not work the keys out twice to test for that.
        found = rows.select(
            *columns,
            profile(text, is_busy).alias("profile"),
            F.explode_outer(F.when(is_busy, keys).otherwise(together)).alias("found"),
        )
        return found.select(*columns, "profile", F.col("found.key").alias("signature"), "found.at")

    return keyed("matches"), keyed("originals"), seen["largest"]


def similar_pairs(
    names: DataFrame,
    stage: Stage,
    min_score: int = MIN_SCORE,
    quiet_address: int = QUIET_ADDRESS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Pairs (match, original) at one address that score `min_score`.

    Both names must be at the same street and postcode, so that is the join key, with their
    signatures. Lengths, letters and edit distance decide most pairs that meet; only the others
    go to the common subsequence.
    """
    matches, originals, largest = keyed_names(names, stage, min_score, quiet_address, hot_rows)
    key = [*_ADDRESS, "signature"]
    m = matches.select(
        *key, F.col("name").alias("match"), F.col("profile").alias("a"), F.col("at").alias("a_at")
    )
    o = originals.select(
        *key,
        F.col("name").alias("original"),
        F.col("profile").alias("b"),
        F.col("at").alias("b_at"),
        "rank",
        "first_subject",
    )
    hot = hot_from_rows(m, key, hot_rows) if largest >= hot_rows else {}
    a, b = F.col("a"), F.col("b")
    met = salted_join(m, o, key, hot).filter("match <> original")
    # At a quiet address names of any length meet; the cheap tests take those out as well.
    met = met.filter((F.col("signature") == "") | may_meet(a, b, F.col("a_at"), F.col("b_at"), min_score))
    near = met.filter(may_be_similar(a, b, min_score)).dropDuplicates(["match", "original"])
    near = stage.keep(near.withColumn("sure", is_surely_similar(a, b, min_score)), "near")
    pair = ["match", "original", "rank", "first_subject"]
    sure = near.filter("sure").select(pair)
    return sure.union(near.filter("NOT sure").filter(is_similar(a, b, min_score)).select(pair))


def promote_similar_names(
    verdicts: DataFrame,
    stage: Stage,
    min_score: int = MIN_SCORE,
    quiet_address: int = QUIET_ADDRESS,
    hot_rows: int = HOT_ROWS,
    at_most: float = math.inf,
) -> DataFrame:
    """Raise address matches that have a similar name, pointing at the last similar name's id.

    `verdicts` is read several times, so it should be a written table, of `at_most` this many
    rows where that is known.
    """
    names = stage.keep(names_in_tier(verdicts), "names")
    pairs = similar_pairs(names, stage, min_score, quiet_address, hot_rows)
    last = pairs.groupBy("match").agg(F.max(F.struct("rank", "first_subject")).alias("last"))
    promoted = last.select(
        F.col("match").alias("locationName"), F.col("last.first_subject").alias("similar_subject")
    )
    in_tier = F.col("certainty_ratio") == SAME_ADDRESS.certainty
    tier, others = verdicts.filter(in_tier), verdicts.filter(~in_tier)
    hot = hot_from_rows(tier, ["locationName"], hot_rows, at_most)
    found = salted_join(tier, promoted, ["locationName"], hot, how="left")
    similar = F.col("similar_subject").isNotNull()
    raised = found.withColumns(
        {
            "certainty_ratio": F.when(similar, SIMILAR_NAME).otherwise(F.col("certainty_ratio")),
            "duplicate_subject": F.coalesce("similar_subject", "duplicate_subject"),
        }
    )
    return others.unionByName(raised.drop("similar_subject"))
