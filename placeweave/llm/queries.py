"""The registered queries of the operators, each over its whole table."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.llm import (
    arrow_files,
    binary_codes,
    byte_bpe,
    chosen_path,
    chunk_terms,
    contamination,
    edit_counts,
    histogram_sort,
    line_rules,
    oracles,
    packing,
    posting_lists,
    quotations,
    toxicity,
)
from placeweave.staging import Stage

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = histogram_sort.shard(_documents(spark, sf_dir), Stage(spark), shards=8)
    content = F.coalesce("text", F.lit("")).cast("binary")
    return sharded.select(
        "doc_id",
        histogram_sort.text_bytes(F.col("text")).alias("size"),
        F.crc32(content).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), Stage(spark))
    scored = toxicity.score(docs, model)
    held_out = toxicity.held_out(F.col("doc_id")).alias("held_out")
    return scored.select("doc_id", held_out, "score", "predicted")


def mails(conversations: DataFrame) -> DataFrame:
    """Messages that quote: each turn answers the one before it, or every third the one before
    that, and quotes it, with what that one itself quoted two levels deep."""
    turns = conversations.groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    back = F.when((F.col("turn") % 3 == 2), 2).otherwise(1)

    answers = turns.select("conv_id", "turn", (F.col("turn") - back).alias("parent"))
    first = turns.select(
        "conv_id",
        F.col("turn").alias("parent"),
        (F.col("turn") - back).alias("grandparent"),
        F.regexp_replace("text", "(?m)^", "> ").alias("quoted_1"),
    )
    second = turns.select(
        "conv_id",
        F.col("turn").alias("grandparent"),
        F.regexp_replace("text", "(?m)^", "> > ").alias("quoted_2"),
    )
    quotes = answers.join(first, ["conv_id", "parent"]).join(
        second, ["conv_id", "grandparent"], "left"
    )
    quotes = quotes.select("conv_id", "turn", F.concat_ws("\n", "quoted_2", "quoted_1").alias("quotes"))
    body = F.concat_ws("\n", "quotes", "text").alias("text")
    return conversations.join(quotes, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", body
    )


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = mails(_table(spark, sf_dir, "conversations"))
    return quotations.link_quotations(messages, Stage(spark))


def op4_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.clean_lines(_documents(spark, sf_dir)).drop("text", "clean_text")


def pieces_with_places(packed: packing.Packed) -> DataFrame:
    """The pieces with a digest of their ids, and whether no packing has fewer sequences as far as the
    bound tells; the ids themselves stay where they are."""
    digest = F.crc32("ids").alias("ids_crc32")
    pieces = packed.pieces.select("row", "doc_id", "piece", "start", "length", digest)
    certified = F.lit(packed.certified).alias("certified")
    return pieces.join(packed.places, "row").drop("row").select("*", certified)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return pieces_with_places(packing.pack_documents(_documents(spark, sf_dir), Stage(spark), path))


def op6_arrow_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    files = arrow_files.write(_documents(spark, sf_dir), Stage(spark), path)
    digest = F.crc32("ids").alias("ids_crc32")
    return arrow_files.read(files).select("doc_id", "start", "n_tokens", digest)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(_documents(spark, sf_dir), ranks).select("doc_id", "ids")
    written = F.array_join(F.col("ids").cast("array<string>"), ",")
    return byte_bpe.decode(encoded, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(written, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_binary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return binary_codes.near_duplicates(vectors, Stage(spark), threshold=0.93)


def derived_edits(docs: DataFrame) -> DataFrame:
    """`docs` with three edits each, derived from the rows: up to 40 characters are replaced by up
    to 60 from another place of the same text."""
    text = F.coalesce("text", F.lit(""))
    size = F.char_length(text)

    def drawn(name: str, turn: int, below: Column | int) -> Column:
        return F.pmod(F.xxhash64("doc_id", F.lit(name), F.lit(turn)), F.lit(below)).cast("int")

    edits = []
    for turn in range(3):
        start = drawn("start", turn, size + 1)
        passage = F.substring(text, drawn("from", turn, size + 1) + 1, drawn("length", turn, 61))
        edits.append(
            F.struct(
                start.alias("start"),
                (start + drawn("gone", turn, 41)).alias("end"),
                passage.alias("new"),
            )
        )
    return docs.withColumn("edits", F.array(*edits))


def op9_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    counted = edit_counts.count(derived_edits(_documents(spark, sf_dir)), ranks)
    edited = edit_counts.apply_edits(counted, ranks)
    return edited.select(
        "doc_id",
        "n_tokens_before",
        "n_tokens",
        "n_pre_tokens",
        "n_edits",
        "n_encoded_chars",
        F.sha2("text", 256).alias("text_sha256"),
    )


def op10_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return chosen_path.near_duplicates(docs, Stage(spark), width=2, percent=80)


def op11_prefix_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "benchmark")
    return contamination.contaminated(_documents(spark, sf_dir), items, Stage(spark))


def op12_chunk_factorization(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("lang", "source", "text")
    return chunk_terms.source_divergence(docs, Stage(spark))


def op13_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    entries = posting_lists.failing_ids(docs, _table(spark, sf_dir, "labels"), stage)
    return posting_lists.audit(entries, stage, list(posting_lists.FILTERS), ["good", "toxic"])


def queries() -> dict[str, Query]:
    return {
        "op1_histogram_sort": op1_histogram_sort,
        "op2_toxicity": op2_toxicity,
        "op3_quotation_linking": op3_quotation_linking,
        "op4_line_rules": op4_line_rules,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_arrow_files": op6_arrow_files,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_binary_codes": op8_binary_codes,
        "op9_edit_counts": op9_edit_counts,
        "op10_chosen_path": op10_chosen_path,
        "op11_prefix_set_join": op11_prefix_set_join,
        "op12_chunk_factorization": op12_chunk_factorization,
        "op13_posting_lists": op13_posting_lists,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
