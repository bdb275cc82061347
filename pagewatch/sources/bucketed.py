"""A table in buckets of its key, of which a merge rewrites only those that its batch touches.

Each merge writes the touched buckets to a folder of its own; then a small file, the manifest, says which folder holds which bucket. Readers go by the manifest, so that they
see a merge in whole or not at all, and a merge that fails leaves the table as it was. Merges of one table follow each other; readers may come at any time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewatch.sources import merge, shared

MANIFEST = "manifest.json"


def _manifest(spark: SparkSession, path: str) -> dict:
    found = shared.read_text(spark, f"{path}/{MANIFEST}")
    return json.loads(found) if found else {"buckets": {}, "count": None, "merges": 0}


def _bucket(key: str, count: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(count)).cast("int")


def read_table(spark: SparkSession, path: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
    """The table, or some buckets of it; a table that isn't there yet is empty."""
    held = _manifest(spark, path)["buckets"]
    files = [f"{path}/{folder}/_bucket={n}" for n, folder in sorted(held.items(), key=lambda x: int(x[0])) if buckets is None or int(n) in buckets]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def merge_table(path: str, batch: DataFrame, key: str, at: str, schema: str, buckets: int = 64) -> list[int]:
    """Merge a batch as upsert_first_seen does, and return the buckets that were rewritten.

    schema: of the table, with first_seen_at and last_seen_at; columns that the batch lacks are null for new rows. The number of buckets holds for good from the first merge on. Of
    the batch only the touched buckets' numbers come to the driver. A batch that comes again changes nothing. A row without a key is left out.
    """
    spark = batch.sparkSession
    now = _manifest(spark, path)
    count = now["count"] or buckets
    own = batch.where(F.col(key).isNotNull())
    touched = sorted(r[0] for r in own.select(_bucket(key, count)).distinct().collect())
    if not touched:
        return []
    merged = merge.upsert_first_seen(read_table(spark, path, schema, touched), own, key, at)
    names = [f.name for f in spark.createDataFrame([], schema).schema.fields]
    folder = f"merge-{now['merges']:08}-{uuid.uuid4().hex[:8]}"
    merged.select(*names).withColumn("_bucket", _bucket(key, count)).repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{path}/{folder}")
    shared.write_text(spark, f"{path}/{MANIFEST}", json.dumps({"buckets": now["buckets"] | {str(n): folder for n in touched}, "count": count, "merges": now["merges"] + 1}))
    return touched


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete folders that no bucket is read from, but for those of the last `keep` merges, which readers may still have open. Returns their names."""
    now = _manifest(spark, path)
    used = set(now["buckets"].values())
    gone = [x for x in shared.folders(spark, path) if x.startswith("merge-") and x not in used and int(x.split("-")[1]) < now["merges"] - keep]
    for x in gone:
        shared.delete(spark, f"{path}/{x}")
    return gone
