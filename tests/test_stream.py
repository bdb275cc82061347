"""The watch as a stream against the watch in batches, round by round."""

import datetime
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pagewatch.functions import text as T
from pagewatch.operators import changes as C
from pagewatch.plans import stories
from pagewatch.sources.shared import new_folder
from pagewatch.streaming import watch as ST

SNAPSHOT = "source_id string, read_at timestamp, html string, vec_before array<double>, vec_after array<double>"
DAY = datetime.datetime(2024, 1, 1)
TEXTS = ["<p>Fee 100</p><p>Open</p>", "<p>Fee  100</p><p>Open</p>", "<p>Fee 120</p><p>Open</p>", "<p>Charge 120</p><p>Open</p>", "<p>You must pay 120</p>", "", "<p>Fee 100</p>\n<p>Open</p><script>1</script>"]
SAME, OTHER = ([1.0, 0.0], [1.0, 0.01]), ([1.0, 0.0], [0.0, 1.0])


def history(seed, sources=6, days=7):
    rng = random.Random(seed)
    rows = []
    for s in range(sources):
        for d in range(days):
            if rng.random() < 0.75:
                before, after = rng.choice([SAME, OTHER, (None, None)])
                rows.append((f"s{s}", DAY + datetime.timedelta(days=d, seconds=rng.randint(0, 80_000), microseconds=rng.randint(0, 999_999)), rng.choice(TEXTS), before, after))
    return sorted(rows, key=lambda r: r[1])


def in_batches(spark, rows):
    """Round after round of watch_round, with the sources' stored fields carried from one to the next."""
    found, stored = [], {}
    rounds: dict[int, list] = {}
    seen: dict[str, int] = {}
    for r in rows:
        k = seen.get(r[0], -1) + 1
        seen[r[0]] = k
        rounds.setdefault(k, []).append(r)
    for k in sorted(rounds):
        today = spark.createDataFrame([(s, True, h, at, b, a) for s, at, h, b, a in rounds[k]], "source_id string, ok boolean, body string, read_at timestamp, vec_before array<double>, vec_after array<double>")
        sources = spark.createDataFrame([(s, *v) for s, v in stored.items()], "source_id string, digest string, body string")
        html = {r[0]: r[2] for r in rounds[k]}
        for r in C.watch_round(today, sources).collect():
            s, before = r["source_id"], stored.get(r["source_id"])
            if r["outcome"] == "changed" and before is not None:
                found.append((s, r["read_at"], before[0], r["new_digest"], r["added"], r["removed"]))
            stored[s] = (r["new_digest"], html[s] if r["store_version"] or before is None else before[1])
    return sorted(found)


def as_stream(spark, tmp_path, files, **options):
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, SNAPSHOT).coalesce(1).write.parquet(str(tmp_path / f"in/part={k:03}"))
    stream = spark.readStream.schema(SNAPSHOT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    return ST.drain(ST.stream_watch(stream, **options), "watch", str(tmp_path / "progress")).collect()


END = ("end", DAY + datetime.timedelta(days=40), "<p>end</p>", None, None)


@pytest.mark.parametrize("seed", [1, 2])
def test_the_stream_says_what_the_rounds_say_whatever_the_order_of_files(spark, tmp_path, seed):
    rows = history(seed)
    mixed = rows[:]
    random.Random(seed).shuffle(mixed)
    files = [mixed[k::4] for k in range(4)] + [[END]]
    got = as_stream(spark, tmp_path, files, delay="10 days")
    want = in_batches(spark, rows)
    assert sorted((r["source_id"], r["read_at"], r["before_digest"], r["digest"], r["added"], r["removed"]) for r in got) == want
    assert len(want) >= 8 and all(r["outcome"] == "changed" for r in got)


def test_late_versions_and_silent_sources(spark, tmp_path):
    at = lambda d: DAY + datetime.timedelta(days=d)
    page = lambda s, d, text: (s, at(d), f"<p>{text}</p>", None, None)
    files = [
        [page("a", 0, "one 1"), page("b", 0, "x"), (None, at(0), "<p>n</p>", None, None), ("c", at(0), None, None, None)],
        [page("a", 2, "three 3"), page("b", 3, "x")],
        [page("a", 1, "two 2"), page("late", 9, "z")],  # within the delay: put in its place
        [page("late", 12, "z 5")],
        [page("a", 1.5, "too late 4")],  # behind what has been compared
        [page("b", 30, "x 9"), page("late", 31, "z 5")],  # b was silent for long: it begins anew
        [page("late", 32, "z 5"), END],
    ]
    got = sorted((r["source_id"], r["outcome"], r["read_at"], r["added"], r["removed"]) for r in as_stream(spark, tmp_path, files, delay="3 days", silent=datetime.timedelta(days=10)))
    assert got == [
        ("a", "changed", at(1), 1, 1), ("a", "changed", at(2), 1, 1), ("a", "silent", at(2), 0, 0),
        ("b", "silent", at(3), 0, 0), ("late", "changed", at(12), 1, 1), ("late", "silent", at(12), 0, 0),
    ]


def test_the_state_shrinks(spark, tmp_path):
    rows = [(f"s{k}", DAY, f"<p>{k}</p>", None, None) for k in range(20)]
    as_stream(spark, tmp_path, [rows, [END], [("end", END[1] + datetime.timedelta(days=1), "<p>end</p>", None, None)]], delay="1 day", silent=datetime.timedelta(days=5))
    left = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "progress"))
    assert [r["key"]["source_id"] for r in left.collect()] == ["end"]


class OneValue:
    """A state of one source that counts what is asked of it."""

    def __init__(self):
        self.value, self.calls = None, 0

    def getValueState(self, *_):  # noqa: N802
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


def test_a_batch_of_versions_reads_and_writes_the_state_once():
    state, watch = OneValue(), ST.Watch(None, 0.97)
    watch.init(state)
    rows = [Row(at=k, digest=f"d{k}", text=f"Fee {k}", vec_before=None, vec_after=None) for k in range(50)]
    random.Random(1).shuffle(rows)
    got = list(watch.handleInputRows(("s",), iter(rows), None))
    assert [(r.at, r.before_digest, r.digest) for r in got] == [(k, f"d{k - 1}", f"d{k}") for k in range(1, 50)]
    assert state.calls == 2


def test_a_day_of_the_stream_is_many_files(spark, data, monkeypatch):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    want = sorted(str(r.page_id) for r in pages.where("page_id % 2 = 0").collect())
    shared = []
    monkeypatch.setattr(stories, "new_folder", lambda spark: shared.append(new_folder(spark)) or shared[-1])
    monkeypatch.setattr(stories, "PAGES_A_FILE", 20, raising=False)
    got = sorted(r.source_id for r in stories.stream_watch(spark, data).collect())
    files = spark.read.option("recursiveFileLookup", True).parquet(f"{shared[0]}/snapshots").select("_metadata.file_path").distinct().count()
    assert got == want and files == 3 * (1 + pages.count() // 20)


def test_meaning_outside_of_a_dataframe(spark):
    rng = random.Random(9)
    words = "must may not cannot 1.270 1,270 3 debe kann nicht deberá puede jamais Fee MUST x_must 12a".split()
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 5))), " ".join(rng.choices(words, k=rng.randint(0, 5))), *rng.choice([SAME, OTHER, (None, [1.0]), ([0.0], [0.0]), ([], []), ([1.0], [1.0, 2.0])])) for _ in range(300)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, b string, a string, vb array<double>, va array<double>")
    got = df.select("id", C.assess_meaning("b", "a", "vb", "va")[0].alias("s"), F.struct(T.numbers_in("b"), T.modality_in("b")).alias("said")).collect()
    for r in got:
        assert C.same_meaning(*rows[r["id"]]) is not r["s"], rows[r["id"]]
        assert tuple(map(list, T.said(rows[r["id"]][0]))) == tuple(map(list, r["said"])), rows[r["id"]]
