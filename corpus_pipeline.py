"""A pipeline from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of documents;
the last returns the packed pieces. Rows with null or empty texts fall to the quality rules. Rows that
repeat a doc_id, and rows without one, stay rows of their own; nulls in other columns and further
columns change nothing, and empty tables give no rows.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.llm import chosen_path, line_rules, toxicity
from placeweave.llm.packing import pack_documents
from placeweave.llm.queries import pieces_with_places
from placeweave.staging import Stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that break a rule, but for those that lose too much."""
    judged = line_rules.clean_lines(docs.select(COLUMNS)).filter("kept")
    length = F.length("clean_text").cast("long")
    return judged.withColumns({"text": F.col("clean_text"), "n_chars": length}).select(COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labels, learned on the stage's own input, finds not toxic.

    A score of exactly 0.5 counts as toxic. Without labels nothing goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, Stage(spark))
    return toxicity.score(docs.select(COLUMNS), model).filter("predicted = 0").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 80 % of five-word shingles, the document of the smallest doc_id.

    Rows that repeat a doc_id are one document: all of them stay or go. Rows without doc_id stay.
    """
    verdicts = chosen_path.near_duplicates(docs, Stage(spark), width=5, percent=80)
    gone = verdicts.filter("NOT kept").select("doc_id")
    return docs.select(COLUMNS).join(gone, "doc_id", "left_anti").select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences of 4096 tokens.

    Each row is packed for itself, also one whose doc_id repeats; of equal lengths any may come first.
    """
    path = public_tokenizers.path("word_bpe_49k.json")
    return pieces_with_places(pack_documents(docs, Stage(spark), path))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", drop_toxic),
    ("MinHash near-dedup", drop_near_duplicates),
    ("best-fit packing", pack),
]

# A trained model and hashed trees are no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each on the written result of the one before."""
    stage = Stage(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage.keep(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
