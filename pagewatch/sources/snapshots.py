"""Stored versions of pages: one Parquet table, in folders by day, and by the batch that wrote them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewatch.functions import text as T
from pagewatch.sources import shared

SCHEMA = "source_id string, url string, read_at timestamp, content_type string, body binary, sha256 string, raw_sha256 string, path string, day date, batch string"


def read_snapshots(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    """Stored versions, of one day if given: only that day's folder is read."""
    df = spark.read.schema(SCHEMA).parquet(path)
    return df if day is None else df.where(F.col("day") == F.lit(day).cast("date"))


def with_bodies(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """rows with the body stored at their path; a missing one is null, not an error."""
    return rows.join(snapshots.select("path", "body"), "path", "left")


def new_versions(pages: DataFrame, stored: DataFrame) -> DataFrame:
    """Pages (source_id, url, read_at, content_type, body) that say something no stored version of theirs says, with their digests and path.

    Versions that differ in bytes only aren't new. Of equal versions in one batch the earliest is stored.
    """
    text = T.decode_body("body", F.coalesce("content_type", F.lit("")))
    own = pages.withColumns({"sha256": T.stable_digest(text), "raw_sha256": T.raw_digest("body"), "day": F.to_date("read_at")})
    own = own.join(stored.select("source_id", "sha256"), ["source_id", "sha256"], "left_anti")
    first = own.groupBy("source_id", "sha256").agg(F.min_by(F.struct("url", "read_at", "content_type", "body", "raw_sha256", "day"), F.struct("read_at", "raw_sha256")).alias("p")).select("source_id", "sha256", "p.*")
    return first.withColumn("path", F.concat_ws("/", "source_id", F.date_format("read_at", "yyyy-MM-dd"), F.concat(F.date_format("read_at", "HHmmss"), F.lit(".html"))))


def append_snapshots(pages: DataFrame, path: str, batch: str) -> None:
    """Append the new versions to the table at path, in folders by day and batch.

    What other batches have stored isn't new, whoever wrote it. A batch that is written again, after a failure or twice, takes the place of what it
    wrote before, in the same folders, so that a retry adds nothing.
    """
    spark = pages.sparkSession
    stored = read_snapshots(spark, path).where(F.col("batch") != batch) if shared.exists(spark, path) else spark.createDataFrame([], SCHEMA)
    new = new_versions(pages, stored).withColumn("batch", F.lit(batch))
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)
