"""Merges by buckets, and the as-of join by slices."""

import datetime
import random
from pathlib import Path

import pytest

from pagewatch.operators import changes as C
from pagewatch.sources import bucketed, merge

SCHEMA = "id long, title string, first_seen_at timestamp, last_seen_at timestamp"
at = lambda d: datetime.datetime(2024, 1, d)


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, read_at timestamp, title string")


def rows(df):
    return sorted(tuple(r) for r in df.select("id", "title", "first_seen_at", "last_seen_at").collect())


def test_a_merge_rewrites_what_it_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    assert rows(bucketed.read_table(spark, path, SCHEMA)) == []
    first = batch(spark, *((k, at(1), f"t{k}") for k in range(500)))
    assert bucketed.merge_table(path, first, "id", "read_at", SCHEMA, 16) == list(range(16))
    second = batch(spark, (7, at(2), None), (7, at(3), "new"), (9001, at(3), "come"), (None, at(3), "x"))
    touched = bucketed.merge_table(path, second, "id", "read_at", SCHEMA, 99)
    assert 1 <= len(touched) <= 2
    newest = max(p for p in Path(path).iterdir() if p.name.startswith("merge-"))
    assert sorted(int(p.name.split("=")[1]) for p in newest.glob("_bucket=*")) == touched
    size = lambda p: sum(x.stat().st_size for x in p.rglob("*.parquet"))
    assert size(newest) < size(Path(path)) / 4
    want = rows(merge.upsert_first_seen(bucketed.read_table(spark, path, SCHEMA).limit(0), first.unionByName(second.where("id is not null")), "id", "read_at").drop("read_at"))
    want = [(i, t, at(1) if i == 7 else f, la) for i, t, f, la in want]
    assert rows(bucketed.read_table(spark, path, SCHEMA)) == want
    bucketed.merge_table(path, second, "id", "read_at", SCHEMA)
    assert rows(bucketed.read_table(spark, path, SCHEMA)) == want
    gone = bucketed.vacuum(spark, path)
    assert len(gone) == 1 and rows(bucketed.read_table(spark, path, SCHEMA)) == want and bucketed.vacuum(spark, path) == []
    assert bucketed.merge_table(path, second.limit(0), "id", "read_at", SCHEMA) == []


def test_a_failed_merge_leaves_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    bucketed.merge_table(path, batch(spark, (1, at(1), "a")), "id", "read_at", SCHEMA)
    monkeypatch.setattr(bucketed.shared, "write_text", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        bucketed.merge_table(path, batch(spark, (1, at(2), "b"), (2, at(2), "c")), "id", "read_at", SCHEMA)
    assert rows(bucketed.read_table(spark, path, SCHEMA)) == [(1, "a", at(1), at(1))]


def test_one_bucket_reads_its_own_files(spark, tmp_path):
    path = str(tmp_path / "t")
    bucketed.merge_table(path, batch(spark, *((k, at(1), "t") for k in range(100))), "id", "read_at", SCHEMA, 8)
    assert {f.split("/_bucket=")[1].split("/")[0] for f in bucketed.read_table(spark, path, SCHEMA, [3]).inputFiles()} == {"3"}


@pytest.mark.parametrize("width", [60, 3600, 10**9])
def test_latest_before_whatever_the_slices(spark, width):
    rng = random.Random(width)
    moment = lambda: rng.choice([None, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=60 * rng.randint(-30, 400))])
    source = lambda: rng.choice(["hot", "hot", "hot", "b", None])
    reads = [(source(), moment(), k) for k in range(150)]
    versions = [(source(), moment(), f"p{rng.randint(0, 40)}") for _ in range(200)]
    got = C.latest_before(
        spark.createDataFrame(reads, "source_id string, read_at timestamp, n int"), spark.createDataFrame(versions, "source_id string, read_at timestamp, path string"), slice_seconds=width
    ).collect()
    low = datetime.datetime.min
    for r in got:
        earlier = [(a or low, p) for s, a, p in versions if s == r["source_id"] and r["read_at"] is not None and (a or low) < r["read_at"]]
        best = max(earlier, default=(None, None))
        assert (r["before_at"], r["before_path"]) == (None if best[0] == low else best[0], best[1])
    assert sorted(r["n"] for r in got) == list(range(150))


def test_latest_before_without_other_columns(spark):
    reads = spark.createDataFrame([("a", at(2))], "source_id string, read_at timestamp")
    versions = spark.createDataFrame([("a", at(1), "x"), ("a", at(2), "y")], "source_id string, read_at timestamp, path string")
    assert [tuple(r) for r in C.latest_before(reads, versions).collect()] == [("a", at(2), at(1), "x")]
    assert C.latest_before(reads, versions.limit(0)).collect()[0]["before_path"] is None


def test_a_hot_source_is_many_slices(spark):
    """Rows of one source are dealt by source and slice: many groups, none with more than a slice holds."""
    versions = spark.range(5000).selectExpr("'hot' as source_id", "timestamp_seconds(id * 3600) as read_at", "cast(id as string) as path")
    plan = C.latest_before(versions.select("source_id", "read_at"), versions)._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [last" in x]
    assert len(windows) == 2 and all("_slice" in x for x in windows)
