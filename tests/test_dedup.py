"""Tiered deduplication against a sequential model, with hot keys and busy addresses."""

import random

import pytest

from placeweave.operators import dedup, fuzzy
from placeweave.plans import jobs
from placeweave.schema import KEY_COLUMNS, PLACE_COLUMNS, VERDICT_COLUMNS
from tests.test_text import common, sorted_tokens

SCHEMA = "subject string, " + ", ".join(f"{c} string" for c in KEY_COLUMNS)
TIERS = [
    (KEY_COLUMNS, 1.0),
    (["locationName", "locationType", "postCode"], 0.6),
    (["thoroughfare", "huisnummer", "postCode", "city"], 0.4),
]


def model(rows, null_keys_match=True):
    """Row by row, in the order of the ids."""
    rows = [dict(r) for r in sorted(rows, key=lambda r: r["subject"])]
    for row in rows:
        row["shown"] = row["locationName"]
        for c in ("locationName", "thoroughfare", "city"):
            row[c] = None if row[c] is None else row[c].title()
        row.update(certainty_ratio=0.0, is_duplicate=False, duplicate_subject=None)
    for keys, certainty in TIERS:
        groups = {}
        for row in rows:
            key = tuple(row[k] for k in keys)
            if not row["is_duplicate"] and (null_keys_match or None not in key):
                groups.setdefault(key, []).append(row)
        for members in groups.values():
            if len(members) > 1:
                for row in members:
                    row.update(certainty_ratio=certainty, is_duplicate=True,
                               duplicate_subject=members[0]["subject"])
    tier = [r for r in rows if r["certainty_ratio"] == 0.4]
    names = list(dict.fromkeys(r["locationName"] for r in tier if r["locationName"] is not None))
    for original in names:
        for match in names:
            a, b = sorted_tokens(original), sorted_tokens(match)
            if original == match or 20 * common(a, b) < 9 * (len(a) + len(b)):
                continue
            m = next(r for r in tier if r["locationName"] == match)
            o = next(r for r in rows if r["locationName"] == original)
            if all(m[c] is not None and m[c] == o[c] for c in ("thoroughfare", "postCode")):
                for row in tier:
                    if row["locationName"] == match:
                        row.update(certainty_ratio=0.5, duplicate_subject=o["subject"])
    for row in rows:
        if row["duplicate_subject"] == row["subject"]:
            row["duplicate_subject"] = ""
        if row["certainty_ratio"] == 1 and not (row["postCode"] and row["city"]):
            row["certainty_ratio"] = 0.1
        row["locationName"] = row.pop("shown")
    return rows


def random_places(count, seed):
    rng = random.Random(seed)
    words = ["zaal", "kring", "gemeentehuis", "sportcentrum", "de", "kringe", "Zaal", "gemeentehuys"]

    def maybe(values, nulls=0.15):
        return None if rng.random() < nulls else rng.choice(values)

    rows = []
    for i in rng.sample(range(10 * count), count):
        name = None if rng.random() < 0.1 else " ".join(rng.choices(words, k=rng.randint(1, 3)))
        rows.append(
            dict(
                subject=f"s{i:06d}", locationName=name, locationType=maybe(["x", "y", "z"], 0.2),
                thoroughfare=maybe(["kaai", "Kaai", "plein"]), huisnummer=maybe(["1", "2", "3"]),
                postCode=maybe(["1000", "2000", ""]), city=maybe(["gent", "Gent", ""]),
            )
        )
    return rows


def frame(spark, rows):
    schema = SCHEMA + "".join(f", {c} string" for c in PLACE_COLUMNS
                              if c not in ("subject", *KEY_COLUMNS))
    columns = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], schema)


def outcome(rows):
    columns = ["subject", *KEY_COLUMNS, *VERDICT_COLUMNS]
    return sorted((tuple(r[c] for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("null_keys_match", [True, False])
@pytest.mark.parametrize("seed, hot_rows", [(1, 1_000_000), (2, 2), (3, 5)])
def test_deduplicate_equals_model(spark, stage, seed, hot_rows, null_keys_match):
    rows = random_places(250, seed)
    found = jobs.deduplicate(frame(spark, rows), stage, null_keys_match, hot_rows).collect()
    expected = model(rows, null_keys_match)
    assert outcome(found) == outcome(expected)
    if null_keys_match:
        assert {0.0, 0.4, 0.6, 1.0} & {r["certainty_ratio"] for r in expected}


@pytest.mark.parametrize("quiet_address, hot_rows", [(32, 1_000_000), (0, 1_000_000), (2, 3)])
def test_fuzzy_equals_model_at_busy_addresses(spark, stage, quiet_address, hot_rows):
    # All unmatched rows share two addresses, so that the names alone decide.
    rng = random.Random(9)
    rows = []
    for i in range(160):
        base = rng.choice(["gemeentelijk sportcentrum", "oude brandweerkazerne", "sint jozefkerk"])
        name = list(base)
        for _ in range(rng.randint(0, 3)):
            name.insert(rng.randint(0, len(name)), rng.choice("abc "))
        rows.append(
            dict(subject=f"s{i:04d}", locationName="".join(name), locationType=f"t{i}",
                 thoroughfare="kaai", huisnummer=str(i % 2), postCode="1000", city="gent")
        )
    matched = dedup.match_tiers(dedup.comparison_keys(frame(spark, rows)), stage)
    matched = stage.keep(matched, "matched")
    promoted = fuzzy.promote_similar_names(
        matched, stage, quiet_address=quiet_address, hot_rows=hot_rows
    )
    found = {r["subject"]: r for r in dedup.final_verdict(promoted).collect()}
    expected = model(rows)
    assert sum(r["certainty_ratio"] == 0.5 for r in expected) > 30
    for row in expected:
        for column in VERDICT_COLUMNS:
            assert found[row["subject"]][column] == row[column], row["subject"]


def test_a_word_that_all_names_share_is_no_key(spark, stage):
    rng, count = random.Random(3), 4_000
    names = ["sporthal " + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(count)]
    rows = [(n, n, f"s{i}", "a", "1", f"s{i}", "a", "1") for i, n in enumerate(dict.fromkeys(names))]
    columns = ("name sorted rank match_street match_postcode first_subject original_street original_postcode").split()
    table = spark.createDataFrame(rows, " string, ".join(columns) + " string")
    matches, originals, _ = fuzzy.keyed_names(table, stage, 90, 32, 1_000_000)
    key = ["street", "postcode", "signature"]
    met = matches.select(*key).join(originals.select(*key), key).count()
    assert met <= 0.05 * count * (count - 1)


def test_row_order_does_not_matter(spark, stage):
    rows = random_places(150, 4)
    one = jobs.deduplicate(frame(spark, rows), stage).collect()
    other = jobs.deduplicate(frame(spark, rows[::-1]).repartition(5), stage).collect()
    assert outcome(one) == outcome(other)


def test_every_row_has_one_verdict(spark, stage):
    rows = random_places(200, 5)
    found = jobs.deduplicate(frame(spark, rows), stage)
    assert found.count() == found.select("subject").distinct().count() == len(rows)
    # The first of an address group may itself be promoted; in the other tiers it stays blank.
    grouped = found.filter("certainty_ratio IN (1.0, 0.1, 0.6)")
    heads = grouped.filter("duplicate_subject = ''").select("subject")
    pointers = grouped.filter("duplicate_subject != ''").select("duplicate_subject").distinct()
    assert pointers.subtract(heads).isEmpty()
    assert found.filter("NOT is_duplicate AND duplicate_subject IS NOT NULL").count() == 0


def test_relative_frequency(spark, stage):
    rows = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "k string")
    found = {r["k"]: r["share"] for r in dedup.relative_frequency(rows, ["k"], stage).collect()}
    assert found == {"a": 0.5, "b": 0.25, None: 0.25}


def test_histogram_is_ordered(spark):
    rows = spark.createDataFrame([(1.0,), (0.4,), (1.0,), (0.0,)], "certainty_ratio double")
    found = [tuple(r) for r in dedup.certainty_histogram(rows).collect()]
    assert found == [(0.0, 1), (0.4, 1), (1.0, 2)]
