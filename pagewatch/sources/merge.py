"""Merges of a batch into a table, as new versions of the table: repeat them, and nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewatch.functions import text as T


def collapsed(batch: DataFrame, key: str, at: str | None = None) -> DataFrame:
    """One row per key of a batch: the latest by at; equal ones are settled by the whole row."""
    rest = [x for x in batch.columns if x != key]
    order = F.struct(*([at] if at else []), *rest)
    return batch.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def _both(existing: DataFrame, batch: DataFrame, key: str):
    columns = [*existing.columns, *(x for x in batch.columns if x not in existing.columns)]
    old = existing.select(key, F.struct(*existing.columns).alias("_old"))
    new = batch.select(key, F.struct(*batch.columns).alias("_new"))
    joined = old.join(new, key, "full_outer")

    def side(name: str, x: str, df: DataFrame):
        return F.col(f"{name}.{x}") if x in df.columns else F.lit(None)

    return joined, columns, lambda x: side("_old", x, existing), lambda x: side("_new", x, batch)


def unseen_ids(batch: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Distinct ids of the batch that the table doesn't have."""
    return batch.select(key).distinct().join(existing.select(key), key, "left_anti")


def upsert_first_seen(existing: DataFrame, batch: DataFrame, key: str, at: str) -> DataFrame:
    """existing with the batch merged in; first_seen_at is set for new ids only, last_seen_at for all of the batch.

    A field that the batch leaves null stays what it was.
    """
    return upsert(existing, collapsed(batch, key, at), key, first={"first_seen_at": at}, last={"last_seen_at": at})


def upsert(existing: DataFrame, batch: DataFrame, key: str, first: dict[str, str] | None = None, last: dict[str, str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    joined, columns, old, new = _both(existing, batch, key)
    first, last = first or {}, last or {}
    out = []
    for x in columns:
        if x == key:
            out.append(F.col(key))
        elif x in first:
            # The date an id was first stored stays; a new id takes the batch's.
            out.append(F.when(F.col("_old").isNotNull(), old(x)).otherwise(new(first[x])).alias(x))
        elif x in last:
            out.append(F.coalesce(new(last[x]), old(x)).alias(x))
        elif x in keep:
            out.append(F.when(F.col("_old").isNotNull(), old(x)).otherwise(new(x)).alias(x))
        else:
            out.append(F.coalesce(new(x), old(x)).alias(x))
    return joined.select(*out)


def upsert_preserving(existing: DataFrame, batch: DataFrame, key: str, keep: tuple[str, ...]) -> DataFrame:
    """As upsert, but the kept columns of a stored row are never written over, not even where they are null."""
    return upsert(existing, collapsed(batch, key), key, keep=keep)


def put_rows(existing: DataFrame, batch: DataFrame, key: str, clear_nulls: bool) -> DataFrame:
    """Two rules for a field that the batch has as null: a whole row put clears it, a partial merge leaves it alone."""
    joined, columns, old, new = _both(existing, collapsed(batch, key), key)
    if not clear_nulls:
        return joined.select(F.col(key), *(F.coalesce(new(x), old(x)).alias(x) for x in columns if x != key))
    return joined.select(F.col(key), *(F.when(F.col("_new").isNotNull(), new(x)).otherwise(old(x)).alias(x) for x in columns if x != key))


def rekey(requirements: DataFrame) -> DataFrame:
    """requirements (requirement_id, url, quote, lane) with new_id and state: right, moved, merged (others move to the same id) or unmovable."""
    lacking = F.lit(False)
    for x in ("url", "quote", "lane"):
        lacking = lacking | (F.coalesce(F.col(x), F.lit("")) == "")
    own = requirements.withColumn("new_id", F.when(~lacking, T.requirement_id("url", "quote", "lane")))
    least = own.where("new_id is not null").groupBy("new_id").agg(F.min(F.struct((F.col("requirement_id") != F.col("new_id")).alias("moves"), "requirement_id")).alias("_least"))
    own = own.join(least, "new_id", "left")
    state = F.when(F.col("new_id").isNull(), "unmovable").when(F.col("requirement_id") == F.col("new_id"), "right").when(F.col("requirement_id") != F.col("_least.requirement_id"), "merged").otherwise("moved")
    return own.withColumn("state", state).drop("_least")
