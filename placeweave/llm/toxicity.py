"""A linear classifier over character n-grams scaled by naive Bayes log-count ratios.

The ratio of an n-gram is how much more of the toxic training texts have it than of the others, in
logarithms; counts cover all labelled training texts. The n-grams with the clearest difference are
the features. A feature's value in a text is its ratio if the text has it and 0 otherwise, and a
logistic regression on these values gives the score.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.llm.rows import with_computed
from placeweave.staging import Stage

# Lengths of the n-grams, and into how many buckets (a power of two) they are hashed.
GRAMS = (3, 4, 5)
BUCKET_BITS = 18
FEATURES = 4096
# The regression is fitted on about so many labelled rows, chosen by a hash of doc_id; the ratios
# and the choice of features use all of them.
FIT_ROWS = 20_000
FIT_STEPS, STEP = 300, 0.05
# The penalty weighs as much as one row does, so that it matters where there are few.
PENALTY = 1.0


class Model(NamedTuple):
    """`weights` for each bucket, 0 for those that are no feature, and the constant."""

    weights: np.ndarray
    constant: float


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def buckets(text: str | None) -> np.ndarray:
    """The bucket of each n-gram of the text in lower case, white space made one space."""
    plain = " ".join((text or "").lower().split())
    points = np.frombuffer(f" {plain} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    found, rolled = [np.empty(0, np.uint32)], np.zeros(len(points), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if n > len(points):
            break
        rolled = rolled[: len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1 :]
        if n in GRAMS:
            spread = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
            found.append(spread >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(found)


def train(docs: DataFrame, labels: DataFrame, stage: Stage) -> Model:
    """Learn from the rows of `docs` that `labels` (doc_id, toxic) marks and that are not held out.

    A doc_id labelled more than once counts once, as toxic if any of its labels says so. Null
    labels, and labels or texts without doc_id, are not used. Without any label all texts get the
    same low score.
    """
    marked = labels.filter("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = docs.select("doc_id", "text").filter(~held_out(F.col("doc_id")))
    # The same plan at every size: labels grow with the documents.
    rows = known.join(marked.hint("merge"), "doc_id").select("doc_id", (F.col("toxic") > 0).alias("toxic"), "text")
    rows = stage.keep(rows, "labelled")
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    with_toxic, without = totals.get(True, 0), totals.get(False, 0)
    prior = (with_toxic + 0.5) / (with_toxic + without + 2)
    ratios, features = _ratios(rows, with_toxic, without)
    share = FIT_ROWS / max(FIT_ROWS, with_toxic + without)
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))
    sample = _features_of(rows.filter(chosen), features).collect()
    return _fit(sample, ratios, features, float(np.log(prior / (1 - prior))))


def _ratios(rows: DataFrame, with_toxic: int, without: int) -> tuple[np.ndarray, np.ndarray]:
    """The log-count ratio of each bucket, and the buckets that are features."""
    size = 1 << BUCKET_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, size), np.int64)
        for batch in batches:
            for toxic, text in zip(*(batch.column(c).to_pylist() for c in ("toxic", "text"))):
                seen[int(toxic), np.unique(buckets(text))] += 1
        found = np.flatnonzero(seen.any(0))
        columns = [pa.array(found.astype(np.int32)), *(pa.array(x) for x in seen[:, found])]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "without", "toxic"])

    counted = rows.select("toxic", "text").mapInArrow(count, "bucket int, without long, toxic long")
    sums = counted.groupBy("bucket").agg(
        F.sum("without").alias("without"), F.sum("toxic").alias("toxic")
    )
    p, q = F.col("toxic") / max(1, with_toxic), F.col("without") / max(1, without)
    mean = (F.col("toxic") + F.col("without")) / max(1, with_toxic + without)
    clear = F.abs(p - q) / F.sqrt(mean * (1 - mean) + 1e-4)
    best = sums.orderBy(F.desc(clear), "bucket").limit(FEATURES).toPandas()
    ratios = np.zeros(size)
    features = np.sort(best["bucket"].to_numpy(np.int64))
    more = (best["toxic"].to_numpy() + 1.0) / (with_toxic + 2.0)
    less = (best["without"].to_numpy() + 1.0) / (without + 2.0)
    ratios[best["bucket"].to_numpy(np.int64)] = np.log(more / less)
    return ratios, features


def _features_of(rows: DataFrame, features: np.ndarray) -> DataFrame:
    is_feature = np.zeros(1 << BUCKET_BITS, bool)
    is_feature[features] = True

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        found = (buckets(text) for text in batch.column("text").to_pylist())
        packed = [np.unique(b[is_feature[b]]).astype("<u4").tobytes() for b in found]
        return [pa.array(packed, pa.binary())]

    return with_computed(rows.select("toxic", "text"), "found binary", lambda: compute, ("text",))


def _fit(sample: list, ratios: np.ndarray, features: np.ndarray, constant: float) -> Model:
    """Logistic regression by adaptive steps, from weights of one per ratio."""
    weights = np.zeros(len(ratios), np.float64)
    if not sample or not len(features):
        return Model(weights.astype(np.float32), constant)
    place = np.zeros(len(ratios), np.int32)
    place[features] = np.arange(len(features))
    each = [place[np.frombuffer(r["found"], "<u4")] for r in sample]
    columns = np.concatenate(each)
    lines = np.repeat(np.arange(len(each), dtype=np.int32), list(map(len, each)))
    values = ratios[features][columns]
    truth = np.array([r["toxic"] for r in sample], float)
    theta = np.zeros(len(features) + 1)
    theta[-1] = constant
    slope, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, FIT_STEPS + 1):
        sums = np.bincount(lines, theta[columns] * values, len(each)) + theta[-1]
        error = (probability(sums) - truth) / len(each)
        down = np.append(np.bincount(columns, error[lines] * values, len(features)), error.sum())
        down[:-1] += PENALTY / len(each) * theta[:-1]
        slope = 0.9 * slope + 0.1 * down
        square = 0.999 * square + 0.001 * down**2
        size = np.sqrt(square / (1 - 0.999**step)) + 1e-8
        theta -= STEP * slope / (1 - 0.9**step) / size
    weights[features] = theta[:-1] * ratios[features]
    return Model(weights.astype(np.float32), float(theta[-1]))


def probability(sums: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(sums, -500, 500)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with `score` and `predicted` of each whole text; nothing but the text is used.

    A null text counts as empty, whose score is that of the constant alone. Other columns stay,
    but for those that have the name of a result.
    """
    used = model.weights != 0

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        sums = []
        for text in batch.column("text").to_pylist():
            found = buckets(text)
            sums.append(model.weights[np.unique(found[used[found]])].sum(dtype=np.float64))
        scores = probability(np.array(sums, float) + model.constant)
        return [pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]

    return with_computed(docs, "score double, predicted int", lambda: compute)
