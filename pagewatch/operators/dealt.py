"""Rows dealt to tasks where Spark can't know how many there will be."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """df by columns in as many parts as the session shuffles to, three a core at least.

    A table that is small as a file may be one task however many rows its rows become. The number is given, so that parts whose bytes are few, but whose work is
    much, aren't put together again.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), *columns)


def never_broadcast(df: DataFrame) -> DataFrame:
    """df to be joined by a shuffle. What exploded rows of a small file take can't be estimated from it, and a broadcast goes through the driver."""
    return df.hint("merge")
