"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are hung on the smallest of the node and its neighbours."""
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).unionAll(
        edges.select(F.col("v").alias("n"), F.col("u").alias("m"))
    )
    low = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("low"))
    return both.where("m > n").join(low, "n").select(F.col("m").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node, are hung on the smallest of them."""
    low = edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("low"))
    hung = edges.join(low, F.col("u") == F.col("n")).where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return hung.unionAll(low.select(F.col("n").alias("u"), F.col("low").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str, most_rounds: int = 50) -> DataFrame:
    """Rows (node, root): each linked node but the roots, with the smallest node reachable from it.

    ``links`` holds one row for each undirected link, in any direction, repeats and loops allowed. The number
    of rounds grows with the logarithm of the longest path; each round is stored, so nothing is recomputed.
    Minima are combined before each shuffle. They are joined back to the links by node, and the links of one node meet
    there in one partition, which the adaptive planner splits where it is far larger than others.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = _stored(edges, "links")
    before = None
    for _ in range(most_rounds):
        edges = _stored(_small_star(_large_star(edges)), "links")
        state = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("v")
        ).first()
        if state == before or state[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
