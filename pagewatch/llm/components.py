"""Connected components of a graph of links, by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewatch.llm.common import forget, materialize


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Links with columns a, b (comparable, any direction, repeats and self links allowed) to rows (a, b).

    One row for each a that isn't the smallest of its component, with the smallest as b. A round
    hangs every node on the smallest neighbour it knows; stars of stars halve in depth, so that the rounds
    grow with the logarithm of the longest path. Each round is written to the shared folder, and takes the place of the one before. Minima are combined before
    the shuffle, and joins on a hot node are ones that adaptive execution can split. Null ends are no links.
    """
    edges = materialize(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .distinct(),
        "links",
    )
    seen = None
    for _ in range(rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40)), F.sum(F.xxhash64("b", "a") % (1 << 40))).first()
        if state == seen or not state[0]:
            return edges
        seen = state
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, edges = edges, materialize(moved.union(least.select("a", "m")).distinct(), "small-star")
        forget(before)
        forget(large)
    raise RuntimeError(f"the components did not settle in {rounds} rounds")
