"""Connected components of a table of links, as alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearwave.workdir import new_folder


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b: long), component the smallest node.

    Each round points every node's larger neighbours at its smallest one, then its smaller
    neighbours likewise, until nothing changes; the number of rounds grows with the logarithm of a component's
    size.  A round is a partial aggregate (smallest neighbour) and a join, so the neighbours
    of a node are never gathered.  Rounds end in a table in the shared folder: no lineage is
    carried on, and lost executors cost one round at most.
    """
    spark = links.sparkSession
    folder = new_folder(spark, "components")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    def both_ways(edges: DataFrame) -> DataFrame:
        return edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(neighbours: DataFrame) -> DataFrame:
        """Links (node, smallest) of each node's neighbours, and its own, to the smallest of them all."""
        least = neighbours.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        linked = neighbours.join(least, "a")
        return (
            linked.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionAll(least.select("a", F.col("m").alias("b")))
            .filter("a > b")
            .distinct()
        )

    edges = stored(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "0"
    )
    before = None
    for k in range(1, max_rounds + 1):
        # Large star: only larger neighbours move.  Small star: smaller ones, and the node itself.
        around = both_ways(edges)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            around.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
        ).distinct()
        edges = stored(star(large), str(k))
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
