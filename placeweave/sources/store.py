"""A quad store laid out by predicate, and in buckets by subject.

A job reads the folders of its own predicates only, and gathers a node's statements without
bringing them together first: each bucket holds all statements of its subjects.
"""

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "g STRING, s STRING, o STRING, p STRING"
BUCKETS = 200


def _table(path: str, buckets: int) -> str:
    """The name of the table in this session's catalog."""
    return "quads_" + hashlib.md5(f"{path} {buckets}".encode()).hexdigest()


def _declare(spark: SparkSession, path: str, buckets: int) -> str:
    name = _table(path, buckets)
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({COLUMNS}) USING parquet PARTITIONED BY (p) "
        f"CLUSTERED BY (s) SORTED BY (s) INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    return name


def write_store(quads: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write quads (g, s, p, o) to a new folder; quads without subject, predicate or object are left
    out, as no pattern meets them.

    One shuffle by subject puts each bucket into one task, which writes one file per predicate. Take
    so many buckets that one fits a task; a subject with more statements than that makes its bucket
    larger, as no bucket is ever split.
    """
    spark = quads.sparkSession
    rows = quads.select("g", "s", "o", "p").dropna(subset=["s", "p", "o"])
    name = _declare(spark, path, buckets)
    rows.repartition(buckets, "s").write.insertInto(name)


def read_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The quads of a folder that `write_store` wrote with so many buckets, as (g, s, p, o).

    Filters on `p` choose folders, and groups by `s` need no shuffle.
    """
    name = _declare(spark, path, buckets)
    spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name).select("g", "s", F.col("p"), "o")
