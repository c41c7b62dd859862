"""Connected components of a graph whose nodes and edges are spread over the cluster."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.staging import Stage


def connected(edges: DataFrame, stage: Stage) -> DataFrame:
    """Rows (id, component) for each id of the edges (a, b); component is the smallest id reached.

    Alternates two steps until the links are stars: link each larger neighbour to a node's smallest
    neighbour, then each smaller one. A node's neighbours are never gathered: its minimum is an
    aggregate, and the join that hands it back may be split where one node has many edges.
    """
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    links = edges.filter("a <> b").select(u, v).distinct()
    links = stage.keep(links, "links")
    while not _are_stars(links):
        links = stage.keep(_smaller(_larger(links)), "links")
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def _are_stars(links: DataFrame) -> bool:
    """Whether no id has two smaller neighbours, or a smaller and a larger one.

    Then the smaller of each link is the smallest of its component.
    """
    down = links.select(F.col("u").alias("id"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    up = links.select(F.col("v").alias("id"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    ids = down.union(up).groupBy("id").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return ids.filter("down > 1 OR (down = 1 AND up = 1)").isEmpty()


def _larger(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
    linked = both.filter("v > u").join(least, "u")
    return linked.select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _smaller(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("least"))
    beside = links.join(least, "u").filter("v <> least")
    return (
        least.select("u", F.col("least").alias("v"))
        .union(beside.select(F.col("v").alias("u"), F.col("least").alias("v")))
        .distinct()
    )
