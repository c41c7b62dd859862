"""Source divergence audit by chunk factorization.

White space cuts documents into chunks, and no term reaches over white space, so the terms of a
table follow from those of its distinct chunks. Chunks are counted per document and summed per
group, each globally distinct chunk is cut into terms once, and the terms are joined back to the
counts. What groups share is then compared in whole numbers.
"""

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeweave.llm.columns import hot_rows
from placeweave.llm.rows import slices
from placeweave.operators.skew import hot_from_counts, salted_join
from placeweave.staging import Stage

# What parts terms, A-Z being in lower case: ASCII but for a-z.
GAPS = r"[\x00-\x60\x7B-\x7F]+"
# A language keeps the terms of so many documents. The smallest and the largest document of a chunk
# tell all of its documents if these are two, so this is three at most.
LEAST_DOCUMENTS = 3
# Probabilities are whole numbers of this.
UNIT = 1_000_000_000
# Counts up to this times UNIT fit a 64-bit number.
_SMALL_COUNT = 9_000_000_000
# Terms of a group in the report.
TOP_TERMS = 200
# Bytes of text whose chunks are counted together, and of counts that are summed together.
TEXT_TOGETHER = 16_000_000
COUNTS_TOGETHER = 16_000_000

_GROUP = ["lang", "source"]
# A source is a hash of 64 bits until the report; `_groups` makes sure that no two are equal.
_CHUNKS = "chunk string, lang string, counts binary"
# What a chunk's counts hold for each source that has it.
_COUNT = np.dtype([("source", "<i8"), ("docs", "<i4"), ("n", "<i4"), ("low", "<i8"), ("span", "<i4")])
_TERMS = "term string, lang string, sources array<long>, n array<long>, enough boolean, rare array<long>"
_KEPT = "term string, lang string, hash long, n long, lang_n long, first boolean"


def _given_out(columns: list[pa.Array], schema: str) -> Iterator[pa.RecordBatch]:
    names = [field.split()[0] for field in schema.split(", ")]
    yield from slices([pa.RecordBatch.from_arrays(columns, names)])


def _lists(starts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = pa.array(np.append(starts, len(values)), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values.astype(kind.to_pandas_dtype())))


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it; the first does."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    differs = reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])
    return np.append(0, np.flatnonzero(differs) + 1)


# -- counting chunks -------------------------------------------------------------------------


def _count(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Per chunk and language of some rows, for each source, the documents, the occurrences, and the
    first and the last document."""
    langs = rows["lang"].combine_chunks().dictionary_encode()
    order = np.lexsort([rows["id"].to_numpy(), rows["hash"].to_numpy(), langs.indices.to_numpy()])
    ids, hashes = rows["id"].to_numpy()[order], rows["hash"].to_numpy()[order]
    lang = langs.indices.to_numpy()[order]
    group = np.zeros(len(ids), np.int32)
    group[_changes(lang, hashes)[1:]] = 1
    group = np.cumsum(group)

    cut = pc.ascii_split_whitespace(rows["text"].combine_chunks())
    chunks = cut.flatten().dictionary_encode()
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    met = chunks.indices.to_numpy() * np.int64(len(ids))
    met += np.repeat(place, cut.value_lengths().to_numpy())
    del cut
    empty = pc.index(chunks.dictionary, "").as_py()
    if empty >= 0:
        met = met[met // len(ids) != empty]
    met.sort()
    firsts = _changes(met)  # of a chunk in a document
    n = np.diff(np.append(firsts, len(met)))
    code, place = np.divmod(met[firsts], len(ids))
    del met
    starts = _changes(code, group[place])  # of a chunk in a group
    if not len(starts):
        return
    docs = np.diff(np.append(starts, len(code)))
    first, last = place[starts], place[starts + docs - 1]
    code = code[starts]
    outer = _changes(code, lang[first])
    counts = np.empty(len(starts), _COUNT)
    counts["source"], counts["docs"], counts["n"] = hashes[first], docs, np.add.reduceat(n, starts)
    counts["low"], counts["span"] = ids[first], ids[last] - ids[first]
    ends = np.append(outer, len(counts)).astype(np.int32) * np.int32(_COUNT.itemsize)
    packed = [None, pa.py_buffer(ends), pa.py_buffer(counts)]
    yield from _given_out(
        [
            chunks.dictionary.take(pa.array(code[outer])),
            langs.dictionary.take(pa.array(lang[first[outer]])),
            pa.Array.from_buffers(pa.binary(), len(outer), packed),
        ],
        _CHUNKS,
    )


def _count_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    together, size = [], 0
    for batch in batches:
        start = 0
        for row, length in enumerate(pc.binary_length(batch.column("text")).to_pylist(), 1):
            size += length
            if size >= TEXT_TOGETHER:
                yield from _count(pa.Table.from_batches([*together, batch.slice(start, row - start)]))
                together, size, start = [], 0, row
        together.append(batch.slice(start))
    if together:
        yield from _count(pa.Table.from_batches(together))


def chunk_counts(docs: DataFrame) -> DataFrame:
    """(chunk, lang, counts) of `docs` (lang, source, text): for each source, in how many documents
    some of the rows have a chunk and how often, the smallest of these documents, by a number that
    each row gets, and how far from it the largest is."""
    number, source = F.monotonically_increasing_id().alias("id"), F.xxhash64("source").alias("hash")
    return docs.select(number, "lang", source, "text").mapInArrow(_count_together, _CHUNKS)


# -- terms of chunks -------------------------------------------------------------------------


def _in_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The sorted rows in tables of about COUNTS_TOGETHER bytes that part no equal keys."""
    rest: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        rest.append(batch)
        size += batch.nbytes
        if size < COUNTS_TOGETHER:
            continue
        table = pa.Table.from_batches(rest).combine_chunks()
        codes = [table[k].chunk(0).dictionary_encode().indices.to_numpy() for k in keys]
        last = int(_changes(*codes)[-1])
        if last:
            yield table.slice(0, last).combine_chunks()
            rest = table.slice(last).to_batches()
            size = sum(b.nbytes for b in rest)
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(lengths.sum()) + np.repeat(starts - (ends - lengths), lengths)


class _Sums:
    """Counts summed per term and language (`pair`, a number) and source.

    `pairs` are the different pairs in order, `starts` where the sources of each begin in `sources`
    and `n`; a pair has `enough` documents if any of its rows has, else `rare` are the different
    documents of its rows, of which those of pair k begin at `rare_starts[k]`.
    """

    def __init__(self, pair, source, n, enough, rare_pair, rare):
        order = np.lexsort([source, pair])
        pair, source = pair[order], source[order]
        cells = _changes(pair, source)
        self.n = np.add.reduceat(n[order], cells)
        self.sources = source[cells]
        self.starts = _changes(pair[cells])
        self.pairs = pair[cells][self.starts]
        self.enough = np.logical_or.reduceat(enough[order], _changes(pair))
        order = np.lexsort([rare, rare_pair])
        rare_pair, rare = rare_pair[order], rare[order]
        kept = _changes(rare_pair, rare)
        rare_pair, self.rare = rare_pair[kept], rare[kept]
        self.rare_starts = np.searchsorted(rare_pair, self.pairs)
        self.rare_counts = np.searchsorted(rare_pair, self.pairs, "right") - self.rare_starts


def _join_terms(least: int):
    """Sums per term from rows sorted by chunk: each chunk is cut once, its terms get its counts.

    `enough` says that a chunk with the term has `least` documents in the language. Otherwise `rare`
    holds the documents that have it, or `least` of them, which is enough.
    """

    def sums(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = {c: rows[c].chunk(0) for c in rows.column_names}
        chunks, langs = rows["chunk"].dictionary_encode(), rows["lang"].dictionary_encode()
        chunk, lang = chunks.indices.to_numpy().astype(np.int64), langs.indices.to_numpy()
        cut = pc.split_pattern_regex(pc.ascii_lower(chunks.dictionary), GAPS)
        terms = cut.flatten().dictionary_encode()
        term, held = terms.indices.to_numpy(), cut.value_lengths().to_numpy()
        begins = np.cumsum(held) - held

        lengths = pc.binary_length(rows["counts"]).to_numpy() // _COUNT.itemsize
        flat = np.frombuffer(b"".join(rows["counts"].to_pylist()), _COUNT)
        # Documents of a chunk in a language, over all rows.
        _, of_row = np.unique(chunk * len(langs.dictionary) + lang, return_inverse=True)
        row = np.repeat(np.arange(len(lengths)), lengths)
        documents = np.bincount(of_row[row], flat["docs"])[of_row]
        enough = documents >= least

        # A row for each count of a chunk and each of its terms.
        times = held[chunk[row]]
        count = np.repeat(np.arange(len(row)), times)
        met = term[_spread(begins[chunk[row]], times)].astype(np.int64)
        filled = (pc.binary_length(terms.dictionary).to_numpy() > 0)[met]
        count, met = count[filled], met[filled]
        if not len(met):
            return
        pair = met * len(langs.dictionary) + lang[row[count]]
        seldom = ~enough[row[count]]
        few, low = pair[seldom], flat["low"][count[seldom]]
        found = _Sums(
            pair,
            flat["source"][count],
            flat["n"][count].astype(np.int64),
            ~seldom,
            np.concatenate([few, few]),
            np.concatenate([low, low + flat["span"][count[seldom]]]),
        )
        shown = np.where(found.enough, 0, np.minimum(found.rare_counts, least))
        rare = found.rare[_spread(found.rare_starts, shown)]
        yield from _given_out(
            [
                terms.dictionary.take(pa.array(found.pairs // len(langs.dictionary))),
                langs.dictionary.take(pa.array(found.pairs % len(langs.dictionary))),
                _lists(found.starts, found.sources, pa.int64()),
                _lists(found.starts, found.n, pa.int64()),
                pa.array(found.enough),
                _lists(np.cumsum(shown) - shown, rare, pa.int64()),
            ],
            _TERMS,
        )

    return _of_tables(sums, ["chunk"])


def _of_tables(compute: Callable[[pa.Table], Iterator[pa.RecordBatch]], keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _in_groups(batches, keys):
            if table.num_rows:
                yield from compute(table)

    return run


def _keep_terms(least: int):
    """The counts of the terms that have enough documents, from rows sorted by term and language."""

    def kept(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = {c: rows[c].chunk(0) for c in rows.column_names}
        terms, langs = rows["term"].dictionary_encode(), rows["lang"].dictionary_encode()
        pair = terms.indices.to_numpy().astype(np.int64) * len(langs.dictionary) + langs.indices.to_numpy()
        lengths, known = (rows[c].value_lengths().to_numpy() for c in ("sources", "rare"))
        found = _Sums(
            np.repeat(pair, lengths),
            rows["sources"].flatten().to_numpy(),
            rows["n"].flatten().to_numpy(),
            np.repeat(rows["enough"].to_numpy(zero_copy_only=False), lengths),
            np.repeat(pair, known),
            rows["rare"].flatten().to_numpy(),
        )
        stays = found.enough | (found.rare_counts >= least)
        sizes = np.diff(np.append(found.starts, len(found.n)))
        shown = np.repeat(stays, sizes)
        if not shown.any():
            return
        first = np.zeros(len(shown), bool)
        first[found.starts] = True
        pairs = np.repeat(found.pairs, sizes)[shown]
        yield from _given_out(
            [
                terms.dictionary.take(pa.array(pairs // len(langs.dictionary))),
                langs.dictionary.take(pa.array(pairs % len(langs.dictionary))),
                pa.array(found.sources[shown]),
                pa.array(found.n[shown]),
                pa.array(np.repeat(np.add.reduceat(found.n, found.starts), sizes)[shown]),
                pa.array(first[shown]),
            ],
            _KEPT,
        )

    return _of_tables(kept, ["term", "lang"])


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(term, lang, hash, n, lang_n, first) of the terms in `least` documents of a language or more.

    n are the occurrences in the source with that hash, lang_n in the language; `first` marks one row
    per language and term. Whether a term has enough documents follows exactly from its chunks: one
    of them has enough, or all have so few that their documents are known and can be counted. What a
    term sums up to in a task is combined there, so a chunk or a term that all documents have makes
    few rows.
    """
    if not 1 <= least <= 3:
        raise ValueError("the documents of a term are known up to three")
    counts = chunk_counts(docs).repartition("chunk").sortWithinPartitions("chunk")
    sums = counts.mapInArrow(_join_terms(least), _TERMS)
    sums = sums.repartition("lang", "term").sortWithinPartitions("term", "lang")
    return sums.mapInArrow(_keep_terms(least), _KEPT)


# -- comparing groups ------------------------------------------------------------------------


def probability(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + size)), exact for any count."""
    exact = F.lit(UNIT).cast("decimal(19,0)") * (count + 1).cast("decimal(19,0)")
    small = F.call_function("div", F.lit(UNIT).cast("long") * (count + 1), total + size)
    large = F.call_function("div", exact, (total + size).cast("decimal(19,0)"))
    return F.lit(1) + F.when(count < _SMALL_COUNT, small).otherwise(large)


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def source_divergence(docs: DataFrame, stage: Stage, top: int = TOP_TERMS) -> DataFrame:
    """How the sources of each language differ in their terms: (lang, source, part, item, value, rank).

    Part `pair` compares a group with each other source of its language over all terms kept, part
    `term` lists the `top` terms that it has more often than its language. Each row of `docs` (lang,
    source, text) is a document; null columns count as empty, and a text without terms still counts
    for its group. Other columns are ignored. No rows give no rows.
    """
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in (*_GROUP, "text")])
    kept = stage.keep(kept_terms(docs), "terms")
    groups = _groups(docs, kept, stage)
    size = groups.agg(F.sum("terms")).first()[0] or 0
    hot = hot_from_counts(groups, ["lang", "hash"], "terms", hot_rows(size))
    numbers = groups.select("lang", "hash", "source", "total", "size", "lang_total", "none")
    rows = salted_join(kept, numbers, ["lang", "hash"], hot)
    p = probability(F.col("n"), F.col("total"), F.col("size")).alias("p")
    q = probability(F.col("lang_n"), F.col("lang_total"), F.col("size")).alias("q")
    rows = rows.select(*_GROUP, "term", "n", p, q, "none")

    pairs = _pairs(rows, groups)
    terms = rows.filter("p > q").select(
        *_GROUP, F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value")
    )
    order = Window.partitionBy(*_GROUP).orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    columns = [*_GROUP, "part", "item", "value", "rank"]
    pairs = pairs.select("*", F.lit("pair").alias("part"), rank)
    # Spark keeps the first rows of each group before it brings them together.
    terms = terms.select("*", F.lit("term").alias("part"), rank).filter(F.col("rank") <= top)
    return pairs.select(columns).union(terms.select(columns))


def _groups(docs: DataFrame, kept: DataFrame, stage: Stage) -> DataFrame:
    """Per group the sum of its counts, its terms, those of the language, and the probability of a
    term that it lacks (`none`); null where the language keeps no term."""
    of_source = kept.groupBy("lang", "hash").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms")
    )
    of_lang = kept.groupBy("lang").agg(
        F.sum("n").alias("lang_total"), F.count_if("first").alias("size")
    )
    groups = docs.select(_GROUP).distinct().withColumn("hash", F.xxhash64("source"))
    groups = groups.join(of_source, ["lang", "hash"], "left").join(of_lang, "lang", "left")
    zero = F.lit(0).cast("long")
    groups = groups.select(
        *_GROUP,
        "hash",
        *[F.coalesce(c, zero).alias(c) for c in ("total", "terms", "lang_total", "size")],
    )
    none = F.when(F.col("size") > 0, probability(zero, F.col("total"), F.col("size")))
    groups = stage.keep(groups.withColumn("none", none), "groups")
    if not groups.groupBy("lang", "hash").count().filter("count > 1").isEmpty():
        raise ValueError("two sources of a language have the same hash")
    return groups


def _pairs(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language.

    Most terms are absent from most sources, and an absent term has one probability in a source. So
    the sum over all terms is taken as if the two shared none, from how many terms a source has per
    count, and then corrected for the terms that both have.
    """

    def renamed(table: DataFrame, names: dict[str, str]) -> DataFrame:
        return table.select(*[F.col(a).alias(b) for a, b in names.items()])

    def both_ways(table: DataFrame, value: Column, back: Column) -> DataFrame:
        """Sums of a value for (a, b) and of one for (b, a), as rows (lang, source, item, value)."""
        sums = table.groupBy("lang", "a", "b").agg(F.sum(value).alias("x"), F.sum(back).alias("y"))
        ways = F.array(
            F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("x").alias("value")),
            F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("y").alias("value")),
        )
        return sums.select("lang", F.explode(ways).alias("way")).select("lang", "way.*")

    col = F.col
    left = {"lang": "lang", "source": "a", "none": "none_a"}
    right = {"lang": "lang", "source": "b", "none": "none_b"}
    sizes = {"size": "size", "terms": "terms_a"}
    two = renamed(groups, left | sizes).join(renamed(groups, right | {"terms": "terms_b"}), "lang")
    neither = col("size") - col("terms_a") - col("terms_b")
    absent = F.coalesce(neither * divergence(col("none_a"), col("none_b")), F.lit(0).cast("long"))
    base = two.filter("a <> b").select(
        "lang", col("a").alias("source"), col("b").alias("item"), absent.alias("value")
    )

    counts = rows.groupBy(*_GROUP, "p", "none").agg(F.count(F.lit(1)).alias("h"))
    one = renamed(counts, left | {"p": "p", "h": "h"}).join(renamed(groups, right), "lang")
    alone = both_ways(
        one.filter("a <> b"),
        col("h") * divergence(col("p"), col("none_b")),
        col("h") * divergence(col("none_b"), col("p")),
    )

    a = renamed(rows, left | {"term": "term", "p": "p_a"})
    b = renamed(rows, right | {"term": "term", "p": "p_b"})

    def correction(p: Column, q: Column, none_p: Column, none_q: Column) -> Column:
        shared = divergence(p, q) + divergence(none_p, none_q)
        return shared - divergence(p, none_q) - divergence(none_p, q)

    p, q, none_p, none_q = (col(c) for c in ("p_a", "p_b", "none_a", "none_b"))
    shared = both_ways(
        a.join(b, ["lang", "term"]).filter("a < b"),
        correction(p, q, none_p, none_q),
        correction(q, p, none_q, none_p),
    )
    found = reduce(DataFrame.union, [base, alone, shared])
    return found.groupBy(*_GROUP, "item").agg(F.sum("value").alias("value"))
