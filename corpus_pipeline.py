"""Raw documents to packed training sequences: quality rules, near-dedup, substring dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewatch.llm import packing, quality, simhash, substring
from pagewatch.llm.common import materialize, small
from pagewatch.llm.queries import WORD_BPE

#: Ids up to which a list of what is kept is broadcast.
BROADCAST_ROWS = 500_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL has no tokenizer and no fingerprints of these kinds; a brute-force version in the tests stands in.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, each judged where it is read.

    A null or empty text goes. Null ids and repeated rows are judged like any other; columns beyond those of documents go; an empty table gives none.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.select(*COLUMNS).where(quality.verdict(model, spark, "text")["kept"])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id; of repeated rows of it, one.

    An id may repeat with other texts: its rows are judged by id and fingerprint, each in its own group. A group in which no document has an id keeps one without. A null or empty text has
    the fingerprint zero, and one such stays. Columns beyond those of documents go; an empty table gives none. Texts stay where they are as long as the ids
    that are kept are few enough to broadcast; only rows of repeated ids, and of none, are compared with each other.
    """
    own = docs.select(*COLUMNS)
    groups = materialize(simhash.simhash_groups(own), "groups")
    ids = groups.groupBy("doc_id").agg(F.count("*").alias("rows"), F.count_if(F.col("doc_id") == F.col("component_id")).alias("first"))
    ids = materialize(ids.where("first > 0").select("doc_id", "rows"), "kept-ids")
    once, again = ids.where("rows = 1").select("doc_id"), ids.where("rows > 1").select("doc_id")
    out = own.join(small(once, BROADCAST_ROWS) or once, "doc_id", "left_semi")
    hashed = own.withColumn("_h", simhash.fingerprint("text"))
    if again.limit(1).count():
        # Rows of one id may be of different groups: each group that the id names keeps its row with the least fingerprint.
        named = groups.join(again, "doc_id", "left_semi").where("doc_id = component_id").groupBy("doc_id", "root").agg(F.min("fp").alias("_h"))
        rows = hashed.where("doc_id is not null").join(again, "doc_id", "left_semi").join(named.select("doc_id", "_h"), ["doc_id", "_h"], "left_semi")
        out = out.unionByName(rows.dropDuplicates(["doc_id", "_h"]).select(*COLUMNS))
    alone = groups.where("component_id is null").groupBy("root").agg(F.min("fp").alias("_h")).select("_h")
    if alone.limit(1).count():
        out = out.unionByName(hashed.where("doc_id is null").join(alone, "_h", "left_semi").dropDuplicates(["_h"]).select(*COLUMNS))
    return out.select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages; those of which nothing is left go, and so do those without words.

    Rows of one id are different documents: null ids and repeated ids stay, each with its row's lang and source, and a text that stands
    in two rows is a repeat. Columns beyond those of documents go, and names that clash with the operator's (n_words, kept_text) aren't read; an empty table gives none.
    """
    cut = substring.remove_repeats(docs, with_text=True, carry=("lang", "source")).where("n_removed < n_words")
    return cut.select("doc_id", F.col("kept_text").alias("text"), "carry.lang", "carry.source", F.length("kept_text").cast("long").alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document: its tokens' place in a sequence.

    A null or empty text is a document of its end token alone. Null ids and repeated rows each are documents; columns besides id and text aren't
    read; an empty table gives none.
    """
    return packing.pack_documents(docs, WORD_BPE)


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k + 1}")
    return docs
