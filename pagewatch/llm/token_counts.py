"""Exact token counts: a histogram of encoded lengths whose suffix sums answer every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewatch.llm.byte_bpe import ByteBpe
from pagewatch.llm.common import materialize, slices, text_batches

BLOCK = 1024


def document_lengths(docs: DataFrame, ranks: str, pattern: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id and n_tokens of each whole text; a null or empty text has 0 tokens.

    Null ids and repeated rows each give their row; other columns aren't read; an empty table gives none.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.get(ranks, pattern)
        for batch in batches:
            n = [len(ids) for _, texts in slices(batch["text"]) for ids in bpe.encode_all(texts)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n_tokens": pa.array(n, pa.int64())})
        bpe.clear()

    text_batches(docs.sparkSession)
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(stream, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame, column: str = "n_tokens", block: int = BLOCK) -> DataFrame:
    """A row per length that occurs: n_tokens, docs, docs_over, total_tokens, truncated_tokens, lost_tokens, quantile.

    Taking the length as the context limit: docs_over documents are longer; truncated_tokens is what all documents hold after
    each is cut to the limit, lost_tokens the rest; quantile is the share of documents of at most this length. Between two
    lengths that occur, truncated_tokens grows by docs_over for each token of the limit, so that the rows answer every
    limit. Null lengths aren't counted; an empty table gives no rows.

    Rows of one length meet only as partial counts; the counts are stored, so that texts are encoded once. The suffix sums run within blocks of lengths, and over the blocks'
    totals, of which there are the longest length / block.
    """
    bins = lengths.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("n_tokens")).agg(F.count("*").alias("docs"))
    bins = materialize(bins.withColumn("block", F.floor(F.col("n_tokens") / block)), "lengths")
    sums = (F.sum("docs").alias("d"), F.sum(F.col("docs") * F.col("n_tokens")).alias("t"))
    blocks = bins.groupBy("block").agg(*sums)
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_later"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_later"),
        F.sum("d").over(every).alias("d_all"),
        F.sum("t").over(every).alias("t_all"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    over = F.col("d_later") + F.coalesce(F.sum("docs").over(inside), F.lit(0))
    tokens = F.col("t_later") + F.coalesce(F.sum(F.col("docs") * F.col("n_tokens")).over(inside), F.lit(0))
    out = bins.join(blocks, "block").select("n_tokens", "docs", "d_all", "t_all", over.alias("docs_over"), tokens.alias("tokens_over"))
    lost = F.col("tokens_over") - F.col("docs_over") * F.col("n_tokens")
    return out.select("n_tokens", "docs", "docs_over", F.col("t_all").alias("total_tokens"), (F.col("t_all") - lost).alias("truncated_tokens"), lost.alias("lost_tokens"), ((F.col("d_all") - F.col("docs_over")) / F.col("d_all")).alias("quantile"))


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For any context limits: limit, docs_over, truncated_tokens. limits is a short list."""
    all_ = F.sum("docs")
    spec = [F.struct(F.lit(x).cast("long").alias("limit"), F.sum(F.when(F.col("n_tokens") > x, F.col("docs")).otherwise(0)).alias("docs_over"), F.sum(F.least("n_tokens", F.lit(x)) * F.col("docs")).alias("truncated_tokens"), all_.alias("docs")) for x in limits]
    return histogram.agg(F.array(*spec).alias("rows")).select(F.explode("rows").alias("r")).select("r.*").where("docs is not null")


def length_quantile(histogram: DataFrame, share: float) -> DataFrame:
    """The least length that at least this share of documents doesn't exceed, as n_tokens."""
    return histogram.where(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))
