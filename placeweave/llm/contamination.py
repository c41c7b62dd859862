"""Benchmark decontamination by a prefix-filtered set join.

The items of a benchmark are cut into windows of consecutive words. A window is the set of its
placed shingles. A document that holds the window holds every shingle of it, so a prefix of one
shingle, the rarest in the documents, is enough to find it: only these shingles are looked for. Where
one is met its place in the window tells where the window would begin; it has to lie inside the
document (bounds on place and length) and is then compared word by word.

All steps are DataFrame functions. Documents are never shuffled: the looked-for shingles, numbers of
64 bits, are sent along in blocks of a fixed size, one pass over the documents for each block.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeweave.llm.columns import hot_rows, lower_ascii
from placeweave.operators.skew import hot_from_rows, salted_join
from placeweave.staging import Stage

# What parts words, A-Z being in lower case: ASCII but for digits and a-z.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Words of a window, and of a shingle.
WINDOW, SHINGLE = 10, 3
# Shingles that are sent along at a time, about 64 MB.
BLOCK = 2_000_000

# What identifies a row: two hashes of its doc_id and text that do not depend on each other.
_KEY = ["h1", "h2"]


def words(text: Column) -> Column:
    """The words of a text in order; none for a null one."""
    plain = lower_ascii(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(plain, GAPS), "")


def shingles(found: str, width: int) -> Column:
    """A hash for each place in the column `found` of words: of `width` words, or of those left."""

    def hashed(word: Column, at: Column) -> Column:
        return F.xxhash64(word, *[F.get(found, at + k) for k in range(1, width)])

    return F.transform(found, hashed)


# -- the benchmark ---------------------------------------------------------------------------


def windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, content) of `items` (item_id, text): each distinct window of an item, as words.

    An item of fewer words is one window; one without words, or without item_id, has none.
    """
    rows = items.filter("item_id IS NOT NULL").select("item_id", words(F.col("text")).alias("words"))
    rows = rows.filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)))
    cut = rows.select("item_id", "words", F.explode(starts).alias("at"))
    return cut.select("item_id", F.slice("words", F.col("at"), window).alias("content")).distinct()


def placed_shingles(contents: DataFrame, width: int) -> DataFrame:
    """(unit, at, shingle, width) of each window (unit, content); a shorter one is one shingle."""
    size = F.least(F.size("content"), F.lit(width)).alias("width")
    rows = contents.select("unit", "content", size)
    of_width = [F.when(F.col("width") == w, shingles("content", w)) for w in range(1, width + 1)]
    whole = F.slice(F.coalesce(*of_width), 1, F.size("content") - F.col("width") + 1)
    rows = rows.select("unit", "width", whole.alias("hashes"))
    return rows.select("unit", "width", F.posexplode("hashes").alias("at", "shingle"))


def prefixes(placed: DataFrame, counts: DataFrame) -> DataFrame:
    """(unit, shingle, at): the rarest shingle of each window, the first among equals.

    A window with a shingle that no document has is in no document and left out.
    """
    known = placed.join(counts, "shingle", "left")
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "shingle")
    rarest = known.groupBy("unit").agg(F.min(rank).alias("best")).filter("best.n > 0")
    return rarest.select("unit", "best.shingle", "best.at")


# -- the documents ---------------------------------------------------------------------------


def _meetings(docs: DataFrame, wanted: DataFrame, widths: list[int], columns: list) -> DataFrame:
    """`columns` of each place `met` in `docs` (with words) where a wanted shingle begins."""
    hashes = F.concat(*[shingles("words", w) for w in widths]).alias("hashes")
    rows = docs.select("*", hashes)
    # Without `outer` Spark would work out the hashes a second time, to leave out empty texts early.
    begun = rows.select(*docs.columns, F.posexplode_outer("hashes").alias("_at", "shingle"))
    joined = begun.join(F.broadcast(wanted), "shingle")
    return joined.withColumn("met", F.pmod("_at", F.size("words"))).select(columns)


def _by_blocks(
    wanted: DataFrame, block: int, met: Callable[[DataFrame], DataFrame]
) -> DataFrame | None:
    """What `met` finds for the shingles of a written table, about `block` of them at a time."""
    parts = -(-wanted.count() // block)
    dealt = F.pmod(F.xxhash64("shingle", F.lit(3)), F.lit(parts))
    found = [met(wanted.filter(dealt == k)) for k in range(parts)]
    return reduce(DataFrame.union, found) if found else None


def _hits(
    docs: DataFrame, units: DataFrame, stage: Stage, window: int, width: int, block: int
) -> DataFrame | None:
    """(h1, h2, start, end, unit): the occurrences of windows; None if there cannot be any."""
    placed = stage.keep(placed_shingles(units, width), "shingles")
    widths = [r["width"] for r in placed.select("width").distinct().collect()]  # `width` at most
    looked_for = stage.keep(placed.select("shingle").distinct(), "looked-for")

    def counted(part: DataFrame) -> DataFrame:
        met = _meetings(docs, part, widths, ["shingle"])
        return met.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))

    counts = _by_blocks(looked_for, block, counted)
    if counts is None:
        return None
    prefix = stage.keep(prefixes(placed, stage.keep(counts, "counts")), "prefixes")
    rarest = stage.keep(prefix.select("shingle").distinct(), "rarest")

    # The words around a place, as far as a window that has it reaches.
    first = F.greatest(F.col("met") - (window - 1), F.lit(0))
    around = F.slice("words", first + 1, F.col("met") - first + window)
    columns = [*_KEY, "shingle", "met", first.alias("first"), around.alias("around")]
    met = _by_blocks(rarest, block, lambda part: _meetings(docs, part, widths, columns))
    if met is None:
        return None
    met, seen = stage.keep_measured(met, "met", size=F.count(F.lit(1)))
    hot = hot_from_rows(met, ["shingle"], hot_rows(seen["size"]), seen["size"])
    found = salted_join(met, prefix.join(units, "unit"), ["shingle"], hot)
    start = F.col("met") - F.col("at")
    size = F.size("content")
    place = start - F.col("first")
    inside = (start >= 0) & (place + size <= F.size("around"))
    same = F.when(inside, F.slice("around", place + 1, size) == F.col("content"))
    hits = found.filter(same).select(*_KEY, start.alias("start"), (start + size).alias("end"), "unit")
    return stage.keep(hits, "hits")


# -- the verdicts ----------------------------------------------------------------------------


def _hit_words(hits: DataFrame) -> DataFrame:
    """(h1, h2, n_hit): the words in the union of the hit windows, counted along the text."""
    spans = hits.groupBy(*_KEY, "start").agg(F.max("end").alias("end"))
    before = Window.partitionBy(*_KEY).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0)))
    spans = spans.select(*_KEY, F.greatest(F.col("end") - reached, F.lit(0)).alias("new"))
    return spans.groupBy(*_KEY).agg(F.sum("new").alias("n_hit"))


def _hit_items(hits: DataFrame, of_items: DataFrame, stage: Stage) -> DataFrame:
    """(h1, h2, item_ids): the ids, sorted as texts, of the items with hit windows.

    Rows with the same windows have the same items, which are gathered once for all of them.
    """
    sets = hits.groupBy(*_KEY).agg(F.sort_array(F.collect_set("unit")).alias("units"))
    sets, seen = stage.keep_measured(sets, "sets", size=F.count(F.lit(1)))
    different = sets.select("units").distinct()
    met = different.select("units", F.explode("units").alias("unit")).join(of_items, "unit")
    ids = F.sort_array(F.collect_set(F.col("item_id").cast("string")))
    items = met.groupBy("units").agg(ids.alias("item_ids"))
    hot = hot_from_rows(sets, ["units"], hot_rows(seen["size"]), seen["size"])
    return salted_join(sets, items, ["units"], hot).select(*_KEY, "item_ids")


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    stage: Stage,
    window: int = WINDOW,
    width: int = SHINGLE,
    block: int = BLOCK,
) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated.

    A word is hit if it lies in an occurrence of a window of `items` (item_id, text). n_items are the
    items with a window that occurs, items_sha256 the digest of their ids, sorted as texts and joined
    by commas; of the empty text if there are none. A null or empty text has no words. Rows of `docs`
    that repeat, also without doc_id, are rows of their own with equal results; rows are told apart
    by 128 bits of hash. Items that repeat an item_id are one item with the windows of all. Other
    columns are ignored. Empty `items` hit nothing.
    """
    hashes = [
        F.xxhash64(F.lit(1), "doc_id", "text").alias("h1"),
        F.xxhash64("text", "doc_id", F.lit(2)).alias("h2"),
    ]
    keyed = docs.select(*hashes, "doc_id", words(F.col("text")).alias("words"))
    cut = stage.keep(windows(items, window), "windows")
    units = cut.select("content").distinct().select(F.monotonically_increasing_id().alias("unit"), "content")
    units = stage.keep(units, "units")
    hits = _hits(keyed, units, stage, window, width, block)
    result = keyed.select(*_KEY, "doc_id", F.size("words").cast("long").alias("n_words"))
    if hits is None:
        none = F.lit(None)
        result = result.withColumns({"n_hit": none.cast("long"), "item_ids": none.cast("array<string>")})
    else:
        of_items = cut.join(units, "content").select("unit", "item_id")
        found = _hit_words(hits).join(_hit_items(hits, of_items, stage), _KEY)
        result = result.join(found, _KEY, "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return result.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
