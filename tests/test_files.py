"""Sources and sinks through files."""

import datetime

import pytest
from pyspark.sql import functions as F

from pagewatch.sources import registers, shared, snapshots

PAGES = "source_id string, url string, read_at timestamp, content_type string, body binary"


def at(day, hour=6):
    return datetime.datetime(2024, 1, day, hour)


def pages(spark, *rows):
    return spark.createDataFrame([(s, f"http://x/{s}", when, "text/html", b) for s, when, b in rows], PAGES)


def stored(spark, path):
    return sorted((r["source_id"], r["day"].day, r["batch"], bytes(r["body"])) for r in snapshots.read_snapshots(spark, path).collect())


def test_a_second_append_adds_no_row(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    first = pages(spark, ("a", at(1), b"<p>one</p>"), ("a", at(2), b" <p>one</p>\n"), ("b", at(1), b"<p>two</p>"))
    second = pages(spark, ("a", at(2), b"<p>three</p>"), ("b", at(2), b"<p>two</p><script>x</script>"), ("c", at(3), b""))
    snapshots.append_snapshots(first, path, "1")
    want = [("a", 1, "1", b"<p>one</p>"), ("b", 1, "1", b"<p>two</p>")]
    assert stored(spark, path) == want
    for _ in range(2):
        snapshots.append_snapshots(second, path, "2")
        assert stored(spark, path) == [want[0], ("a", 2, "2", b"<p>three</p>"), want[1], ("c", 3, "2", b"")]
    snapshots.append_snapshots(second, path, "another writer")
    snapshots.append_snapshots(first.limit(0), path, "none")
    assert len(stored(spark, path)) == 4


def test_a_batch_that_failed_half_way_is_made_good(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    rows = pages(spark, ("a", at(1), b"x"), ("b", at(2), b"y"))
    snapshots.append_snapshots(rows.where("source_id = 'a'"), path, "7")
    snapshots.append_snapshots(rows, path, "7")
    assert stored(spark, path) == [("a", 1, "7", b"x"), ("b", 2, "7", b"y")]


def test_one_day_reads_one_folder(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    snapshots.append_snapshots(pages(spark, *((f"s{k}", at(1 + k % 3), b"%d" % k) for k in range(30))), path, "1")
    day = snapshots.read_snapshots(spark, path, "2024-01-02")
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "2024-01-02" in plan
    read = {r[0].split("/day=")[1].split("/")[0] for r in day.select("_metadata.file_path").distinct().collect()}
    assert read == {"2024-01-02"} and day.count() == 10
    slim = day.select("source_id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<source_id:string>" in slim


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_register_csv_in_the_order_of_files_and_lines(spark, tmp_path):
    write(tmp_path / "r/a.csv", 'Name,Rating,Route\n"École, A",x,Student\nB,,Child\n,z,Student\n' + "".join(f"N{k},{k},R\n" for k in range(20_000)))
    write(tmp_path / "r/b.csv", "Name,Rating,Route\nb,y,Student\nB,w,Child\nécole,  a,q\nN5,late,S\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        rows = registers.read_csv(spark, str(tmp_path / "r"))
        assert rows.rdd.getNumPartitions() > 4
        got = {r["key"]: r for r in registers.read_register_csv(spark, str(tmp_path / "r"), "Name", status="Rating", route="Route").collect()}
        order = [r["Name"] for r in rows.orderBy("pos").select("Name").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert order[3:20_003] == [f"N{k}" for k in range(20_000)]
    assert got["b"]["name"] == "B" and got["b"]["status"] is None and got["b"]["routes"] == ["Child", "Student"]
    assert got["école, a"]["status"] == "x" and got["n5"]["status"] == "5" and got["n5"]["routes"] == ["R", "S"]
    assert None not in got and "" not in got


def test_corrupt_lines_are_told(spark, tmp_path):
    write(tmp_path / "c.csv", 'Name,Town\nA,b\nB,c,more\nC\n"D ""q""",e\n')
    rows = registers.read_csv(spark, str(tmp_path / "c.csv")).cache()  # the corrupt column alone can't be asked for of a file
    assert sorted((r["Name"], r["Town"]) for r in rows.collect()) == [("A", "b"), ("B", "c"), ("C", None), ('D "q"', "e")]
    assert sorted(r["corrupt"] for r in rows.where("corrupt is not null").collect()) == ["B,c,more", "C"]


def test_lines_within_cells(spark, tmp_path):
    write(tmp_path / "l.csv", 'Name,Town\n"A\nB",c\nD,e\n')
    got = registers.read_register_csv(spark, str(tmp_path / "l.csv"), "Name", lines=True, location="Town").collect()
    assert sorted((r["name"], r["location"]) for r in got) == [("A\nB", "c"), ("D", "e")]


def test_a_register_whose_columns_moved_fails(spark, tmp_path):
    write(tmp_path / "m.csv", "Name,Town\nA,b\n")
    with pytest.raises(ValueError, match="no column named 'Organisation'"):
        registers.read_register_csv(spark, str(tmp_path / "m.csv"), "Organisation")
    with pytest.raises(ValueError, match="no column named 'n'"):
        registers.read_counts(spark, str(tmp_path / "m.csv"), "Name", "n")
    write(tmp_path / "two/a.csv", "Name,Town\nA,b\n")
    write(tmp_path / "two/b.csv", "Town,Name\nA,b\n")
    with pytest.raises(Exception, match="header|Header"):
        registers.read_register_csv(spark, str(tmp_path / "two"), "Name").collect()


@pytest.mark.parametrize("sep", [",", "\t"])
def test_counts(spark, tmp_path, sep):
    rows = [("School, one", "1,234"), ("B", "--"), ("C", "n/a"), ("D", "0"), ("", "5"), ("E", " 12 "), ("F", "x"), ("G", "")]
    text = "".join(sep.join(f'"{c}"' if sep == "," else c for c in r) + "\n" for r in [("Name", "Count"), *rows])
    write(tmp_path / "c.csv", text)
    got = registers.read_counts(spark, str(tmp_path / "c.csv"), "Name", "Count").collect()
    assert sorted(tuple(r) for r in got) == [("D", 0), ("E", 12), ("School, one", 1234)]


def test_small_files(spark, tmp_path):
    path = str(tmp_path / "state")
    assert shared.read_text(spark, path) is None and not shared.exists(spark, path) and shared.folders(spark, path) == []
    for text in ("one", "zwei ü", ""):
        shared.write_text(spark, path, text)
        assert shared.read_text(spark, path) == text
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["state"]


def test_no_folder_on_a_cluster_without_the_setting(spark):
    class Conf:
        def get(self, *a):
            return None

    class Cluster:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "yarn"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(ValueError):
        shared.new_folder(Cluster)
    assert F is not None
