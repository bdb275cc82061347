"""Search over a stored index against search over the documents."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from pagewatch.operators import stories as S

WORDS = "visa visas study work permit fee fees the deadline nurse École quota uk eu 2024".split()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    text = lambda k: rng.choice([None, " ".join(rng.choices(WORDS, k=rng.randint(0, k)))])
    day = lambda: rng.choice([None, datetime.date(2024, 1, 1) + datetime.timedelta(days=rng.randint(0, 40))])
    rows = [(k, rng.choice(["guide", "article"]), text(3), text(4), text(8), day()) for k in range(1500)]
    return spark.createDataFrame(rows, "doc_id int, kind string, title string, summary string, body string, date date")


@pytest.mark.parametrize(("block_docs", "first"), [(10, 2), (40, 8), (10_000, 1)])
def test_blocks_give_what_all_documents_give(spark, docs, tmp_path, block_docs, first):
    path = str(tmp_path / "index")
    S.write_index(docs, path, block_docs)
    for query in ("visa", "visa fee", "uk study permit", "ecole", "nurse quota deadline eu", "nothing", "the", "", "visas 2024"):
        for most in (5, 40):
            want = [tuple(r) for r in S.search(docs, query, most).collect()]
            assert [tuple(r) for r in S.search_stored(spark, path, query, most, first).collect()] == want, (query, most)


def test_blocks_are_skipped(spark, docs, tmp_path):
    path = str(tmp_path / "index")
    S.write_index(docs, path, 20)
    ranked = S.ranked_blocks(spark.read.parquet(f"{path}/blocks"), "quota")
    total = ranked.count()
    ahead = [r["block"] for r in ranked.orderBy(F.desc("best"), F.desc("date"), "block").limit(8).collect()]
    found = S.search(docs, "quota", 5).collect()
    assert total > 60 and S.further_blocks(ranked, ahead, found[-1]).count() < total / 2
    assert S.further_blocks(ranked, ahead, None).count() == total - 8


def test_a_block_scores_no_less_than_its_documents(spark, docs, tmp_path):
    path = str(tmp_path / "index")
    S.write_index(docs, path, 15)
    postings = spark.read.parquet(f"{path}/postings")
    for query in ("visa fee", "uk work"):
        best = {r["block"]: r["best"] for r in S.ranked_blocks(spark.read.parquet(f"{path}/blocks"), query).collect()}
        place = {r["doc_id"]: r["block"] for r in postings.select("doc_id", "block").distinct().collect()}
        found = S.search(docs, query, 1000).collect()
        assert found and all(best[place[r["doc_id"]]] >= r["score"] for r in found)
