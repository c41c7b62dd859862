"""Binary codes of vectors against cosines in double precision."""

import math

import numpy as np
import pytest

from placeweave.llm import binary_codes
from placeweave.llm.queries import queries
from tests.llm.test_documents import smallest_reachable

KIND = "vec_id long, embedding array<float>, label int"


def brute_force(rows, threshold):
    vectors = {}
    for vec_id, vector, label in rows:
        good = vector and label is not None and all(x is not None and math.isfinite(x) for x in vector)
        if good and any(vector):
            v = np.array(vector, float)
            vectors[vec_id] = (label, len(v)), v / np.linalg.norm(v)
    ids = sorted(vectors)
    links = [
        (a, b)
        for k, a in enumerate(ids)
        for b in ids[k + 1 :]
        if vectors[a][0] == vectors[b][0] and vectors[a][1] @ vectors[b][1] >= threshold
    ]
    return links, smallest_reachable([r[0] for r in rows], links)


def check(found, rows, threshold=0.93, recall=1.0):
    links, expected = brute_force(rows, threshold)
    counts = {r[0]: 0 for r in rows}
    for a, b in links:
        counts[a] += 1
        counts[b] += 1
    assert sum(r.n_links for r in found) >= recall * 2 * len(links)
    assert all(r.n_links <= counts[r.vec_id] for r in found)
    if recall == 1.0:
        assert {r.vec_id: (r.n_links, r.component_id) for r in found} == {
            k: (counts[k], expected[k]) for k in counts
        }
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    check(queries()["op8_binary_codes"](spark, folder).collect(), rows)


def test_recall_at_the_threshold(spark, stage):
    draw = np.random.default_rng(1)
    rows = []
    for k in range(400):
        one = draw.standard_normal(32)
        one /= np.linalg.norm(one)
        other = draw.standard_normal(32)
        other -= other @ one * one
        other /= np.linalg.norm(other)
        near = 0.935 * one + math.sqrt(1 - 0.935**2) * other
        rows += [(2 * k, one.tolist(), 1), (2 * k + 1, near.tolist(), 1)]
    table = spark.createDataFrame(rows, KIND)
    found = binary_codes.near_duplicates(table, stage).collect()
    check(found, rows, recall=0.95)


@pytest.mark.parametrize(("size", "bits"), [(64, 4), (64, 10), (64, 21), (16, 21)])
def test_plans_reach_their_recall(size, bits):
    plan = binary_codes.plan_for(size, bits, 0.93)
    first = binary_codes.first_bands(size, plan, [77, size])
    assert (first < plan.bands).mean() >= 0.999 - 2 * math.sqrt(0.001 / len(first))


def test_other_labels_change_no_links(spark, stage):
    draw = np.random.default_rng(5)
    one = draw.standard_normal((1_000, 16))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other = draw.standard_normal((1_000, 16))
    other -= (other * one).sum(1, keepdims=True) * one
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    near = 0.931 * one + math.sqrt(1 - 0.931**2) * other
    rows = [(k, v.tolist(), k % 1_000) for k, v in enumerate(np.concatenate([one, near]))]
    crowd = [(2_000 + k, v.tolist(), 1_000) for k, v in enumerate(draw.standard_normal((4_000, 16)))]

    def links(table):
        found = binary_codes.near_duplicates(spark.createDataFrame(table, KIND), stage).collect()
        return {r.vec_id: (r.n_links, r.component_id) for r in found if r.vec_id < 2_000}

    alone = links(rows)
    assert links(rows + crowd) == alone
    assert sum(n for n, _ in alone.values()) >= 0.997 * 2_000


def test_group_larger_than_a_tile(spark, stage, monkeypatch):
    monkeypatch.setattr(binary_codes, "TILE", 8)
    draw = np.random.default_rng(2)
    centre = draw.standard_normal(16)
    rows = [(k, (centre + 0.02 * draw.standard_normal(16)).tolist(), k % 2) for k in range(120)]
    check(binary_codes.near_duplicates(spark.createDataFrame(rows, KIND), stage).collect(), rows)


def test_odd_vectors(spark, stage):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0, 0.0], 1),
        (1, [2.0, 0.0, 0.0], 1),
        (2, [1.0, 0.0, 0.0], 2),
        (3, [1.0, 0.0, 0.0], None),
        (4, None, 1),
        (5, [], 1),
        (6, [0.0, 0.0, 0.0], 1),
        (7, [1.0, None, 0.0], 1),
        (8, [1.0, nan, 0.0], 1),
        (9, [inf, 0.0, 0.0], 1),
        (10, [1.0, 0.0], 1),
        (11, [1e-30, 0.0, 0.0], 1),
        (12, [1.0], 3),
        (13, [5.0], 3),
        (14, [-5.0], 3),
    ]
    table = spark.createDataFrame([*rows, (None, [1.0, 0.0, 0.0], 1)], KIND)
    found = binary_codes.near_duplicates(table, stage).collect()
    (lost,) = [r for r in found if r.vec_id is None]
    assert (lost.n_links, lost.component_id, lost.kept) == (0, None, True)
    check([r for r in found if r.vec_id is not None], rows)
    assert not binary_codes.near_duplicates(table.limit(0), stage).collect()


@pytest.mark.parametrize("size", [1, 2, 3, 16, 64, 100])
def test_estimates_are_unbiased_and_bounded(size):
    draw = np.random.default_rng(3)
    one, other = draw.standard_normal((2, 20_000, size))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other -= (other * one).sum(1, keepdims=True) * one
    if size > 1:
        other /= np.linalg.norm(other, axis=1, keepdims=True)
    near = 0.93 * one + math.sqrt(1 - 0.93**2) * other
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    turned = np.concatenate([one, near]) @ binary_codes.rotation(size, 0)
    known = binary_codes.Sketches(binary_codes.sketches(turned), size, 0.93)
    i = np.arange(len(one))
    guess, bound = known.estimate(i, i + len(one))
    truth = (one * near).sum(1)
    assert abs((guess - truth).mean()) < 0.01
    # Below 18 numbers the bound is certain; above, four standard errors.
    missed = (np.abs(guess - truth) > bound).mean()
    assert missed == 0 if size < 18 else missed < 2e-4


def test_sketch_is_small_and_parts_far_vectors():
    assert binary_codes.sketch_type(64).itemsize == 52
    draw = np.random.default_rng(4)
    vectors = draw.standard_normal((4_000, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    turned = vectors @ binary_codes.rotation(64, 0)
    known = binary_codes.Sketches(binary_codes.sketches(turned), 64, 0.93)
    guess, bound = known.estimate(np.arange(2_000), np.arange(2_000, 4_000))
    assert (guess + bound >= 0.93).mean() < 0.001


def test_repeated_ids_and_clashing_columns(spark, stage):
    near = [1.0, 0.1, 0.0]
    rows = [(1, [1.0, 0.0, 0.0], 1, 9), (1, [1.0, 0.0, 0.0], 1, 9), (1, [0.0, 0.0, 1.0], 1, 9)]
    rows += [(2, near, 1, 9), (3, [0.0, 0.1, 1.0], 1, 9), (4, [0.0, 1.0, 0.0], 1, 9)]
    names = ["row", "keys", "band", "_tile", "sketch", "id", "size", "bits"]
    kind = f"{KIND}, " + ", ".join(f"{name} int" for name in names)
    table = spark.createDataFrame([(*r, *[r[3]] * (len(names) - 1)) for r in rows], kind)
    found = binary_codes.near_duplicates(table, stage).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found) == [
        (1, 3, 1, True),
        (1, 3, 1, True),
        (1, 3, 1, True),
        (2, 2, 1, False),
        (3, 1, 1, False),
        (4, 0, 4, True),
    ]
