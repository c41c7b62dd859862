"""Readers and writers: CSV tables, query-result JSON, the type mapping and pattern lists."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.functions.text import null_if_blank_token
from placeweave.operators.relational import ROW, with_columns
from placeweave.schema import PLACE_COLUMNS
from placeweave.vocabulary import NULL_TOKENS

_CSV = {"header": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}

_BINDINGS = (
    "results struct<bindings: array<map<string, struct<type: string, value: string>>>>"
)


def blank_to_null(rows: DataFrame) -> DataFrame:
    """Null for every string cell that is empty or a null marker."""
    texts = [f.name for f in rows.schema.fields if f.dataType.simpleString() == "string"]
    return rows.withColumns({c: null_if_blank_token(F.col(c), NULL_TOKENS) for c in texts})


def read_csv(spark: SparkSession, path: str, line_per_record: bool = False) -> DataFrame:
    """One CSV source, every column a string, with the row's position in `_row`.

    Quoted cells may hold line breaks, so a file is read by one task; give
    `line_per_record=True` for files known to have none, and large files are split. The files of
    a folder share one header. Positions follow the names of the files, and within a file its
    lines, however Spark packs files and blocks into tasks.
    """
    raw = spark.read.options(**_CSV, multiLine=not line_per_record).csv(path)
    position = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    cells = raw.columns
    return blank_to_null(raw.select(*cells, position.alias(ROW)))


def read_places(spark: SparkSession, path: str, line_per_record: bool = False) -> DataFrame:
    """A place table; columns the file lacks are null."""
    return with_columns(read_csv(spark, path, line_per_record), PLACE_COLUMNS)


def write_csv(rows: DataFrame, path: str, few_files: bool = False) -> None:
    """A folder of CSV files with header; nulls and empty texts are empty cells.

    With `few_files` a small result is one file. A larger one is as many as it has parts of Spark's
    advisory partition size, so no task writes more than that; the price is one shuffle.
    """
    plain = rows.drop(ROW)
    if few_files:
        plain = plain.hint("rebalance")
    plain.write.mode("overwrite").options(**_CSV, emptyValue="", nullValue="").option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_bindings(
    spark: SparkSession,
    path: str,
    variables: list[str] | None = None,
    response_per_line: bool = False,
) -> DataFrame:
    """Landed query results as one string column per variable; unbound variables are null.

    Each file holds one JSON response, or one per line. Files are read in parallel.
    """
    reader = spark.read.schema(_BINDINGS).option("multiLine", not response_per_line)
    binding = reader.json(path).select(F.explode("results.bindings").alias("b"))
    return binding.select(
        *[F.col("b")[v]["value"].alias(v) for v in (variables or PLACE_COLUMNS)]
    )


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of strings as (key, value) rows; a key that comes twice has its last value."""
    text = spark.read.text(path, wholetext=True)
    entries = F.map_entries(F.from_json("value", "map<string,string>"))
    rows = text.select(F.posexplode(entries).alias("at", "entry"))
    last = F.max(F.struct("at", "entry.value")).alias("last")
    return rows.groupBy("entry.key").agg(last).select("key", "last.value")


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """A text file with one pattern per line."""
    return spark.read.text(path).withColumnRenamed("value", "pattern")
