"""Connected components as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewatch.sources.shared import new_folder


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Links (a, b: long, any direction) to rows (a, b): each node that isn't the least of its component, with the least.

    Rounds of two steps, each a minimum per node and a join: a node's larger neighbours hang on its least one, then what hangs on several moves to the least of them.
    Stars of stars halve in depth. Each round is a table in the shared folder, so that a lost executor loses nothing.
    """
    spark, folder = links.sparkSession, new_folder(links.sparkSession)

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for k in range(rounds):
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % (1 << 40))).first()
        if now == before or not now[0]:
            return edges
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        hung = stored(both.join(nearest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), f"hung-{k}")
        least = hung.groupBy("a").agg(F.min("b").alias("m"))
        moved = hung.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), f"round-{k}")
    raise RuntimeError(f"the components did not settle in {rounds} rounds")
