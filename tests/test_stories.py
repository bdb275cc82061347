"""Stories against the sequential greedy."""

import datetime
import random

import pytest

from pagewatch.operators import graph
from pagewatch.operators import stories as S

WORDS = "visa salary nurse border screening ebola threshold rises rise closes deadline quota the of new fee".split()


def one_by_one(rows):
    groups, out = {}, {}
    for change, country, url, summary, at in sorted(rows, key=lambda r: (r[4], r[0])):
        own, day = groups.setdefault((country, at.date()), []), S._stems(summary or "")
        for g in own:
            if url in g["urls"] or S.alike(g["stems"], day):
                break
        else:
            own.append(g := {"first": change, "urls": set(), "stems": set()})
        g["urls"].add(url)
        g["stems"] |= day
        out[change] = g["first"]
    return out


@pytest.mark.parametrize("split", [0, 25, 10_000])
def test_components_give_what_the_order_gives(spark, split):
    rng = random.Random(split)
    rows = []
    for k in range(300):
        summary = rng.choice([None, "", " ".join(rng.choice(WORDS) + rng.choice(["", f" x{rng.randint(0, 60)}word"]) for _ in range(rng.randint(1, 5)))])
        rows.append((k, rng.choice(["A", "B", None]), rng.choice([None, f"u{rng.randint(0, 200)}", f"v{k}"]), summary, datetime.datetime(2024, 1, rng.randint(1, 3), rng.randint(0, 5), rng.randint(0, 2))))
    df = spark.createDataFrame(rows, "change_id int, country string, source_url string, summary string, after_read_at timestamp")
    got = S.cluster_changes(df, split_rows=split).collect()
    assert len(got) == 300 and {r["change_id"]: r["story"] for r in got} == one_by_one(rows)


def test_a_large_day_is_many_parts(spark):
    rows = [(k, "A", f"u{k}", f"permit{k // 3} granted{k // 3}", datetime.datetime(2024, 1, 1)) for k in range(300)]
    df = spark.createDataFrame(rows, "change_id int, country string, source_url string, summary string, after_read_at timestamp").withColumn("day", S.F.to_date("after_read_at"))
    assert S._parted(df).select("_part").distinct().count() == 100


def test_components_of_a_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(0, 200)] + [(1000, k) for k in range(1001, 1100)] + [(5000, 5000)]
    got = {r["a"]: r["b"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 201)}, **{k: 1000 for k in range(1001, 1100)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
