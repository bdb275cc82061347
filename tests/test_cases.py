"""Literal cases: what has to be caught, and which way a doubt falls."""

import pytest
from pyspark.sql import functions as F

from pagewatch.functions import text as T
from pagewatch.functions import urls as U
from pagewatch.operators import changes as C
from pagewatch.operators import links as L
from pagewatch.operators import quotes as Q
from pagewatch.operators import stories as S
from pagewatch.plans import registry
from pagewatch.sources import merge, registers
from pagewatch.streaming import watch as ST


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("removed", "added", "vectors", "substantive"),
    [
        ("the fee is 490 euros", "the fee is 590 euros", ([1.0, 0.0], [1.0, 0.0]), True),
        ("", "a line more", ([1.0], [1.0]), True),
        ("you must pay", "you may pay", ([1.0, 0.0], [1.0, 0.0]), True),
        ("debe pagar", "puede pagar", ([1.0, 0.0], [1.0, 0.0]), True),
        ("vous devez venir", "vous pouvez venir", ([1.0, 0.0], [1.0, 0.0]), True),
        ("you cannot work", "you can work", ([1.0, 0.0], [1.0, 0.0]), True),
        ("debe pagar", "deberá pagar", ([1.0, 0.0], [1.0, 0.01]), False),
        ("send the form", "post the form", ([1.0, 0.0], [0.99, 0.05]), False),
        ("send the form", "bring the form", ([1.0, 0.0], [0.0, 1.0]), True),
        ("send the form", "post the form", (None, [1.0]), True),
        ("send the form", "post the form", ([1.0], [1.0, 0.0]), True),
    ],
)
def test_meaning(spark, removed, added, vectors, substantive):
    df = spark.createDataFrame([(removed, added, *vectors)], "b string, a string, vb array<double>, va array<double>")
    assert df.select(C.assess_meaning("b", "a", "vb", "va")[0].alias("s")).first()["s"] is substantive


def test_page_text(spark):
    html = "<html><script>x('</p>')</script><p>One&nbsp;two</p><div>a &amp;lt; b<br>c</div><!-- no -->\n\n\n\n<p>  end </p>"
    assert value(spark, T.page_text(F.lit(html))) == "One two\na < b c\n\nend"


def test_digest_ignores_noise(spark):
    a = '<p nonce="1">x</p><script>1</script>\n<b>y</b>'
    b = '<p nonce="2">x</p><script>2</script> <b>y</b>'
    assert value(spark, T.stable_digest(F.lit(a))) == value(spark, T.stable_digest(F.lit(b)))


def test_decode(spark):
    rows = [(b"caf\xe9", "text/html; charset=iso-8859-1"), (b'<meta charset="latin-1">caf\xe9', None), ("café".encode(), None), (b"caf\x80", None), (None, None)]
    df = spark.createDataFrame(rows, "b binary, t string").coalesce(1)
    assert [r[0][-4:] for r in df.select(T.decode_body("b", "t")).collect()] == ["café", "café", "café", "caf€", ""]


def test_fold(spark):
    assert value(spark, T.fold(F.lit("“ﬁne”\xa0 – it’s\n"))) == '"fine" - it\'s'
    assert value(spark, T.name_key(F.lit("The Université d'Évry–Paris"))) == "universite d evry paris"


@pytest.mark.parametrize(("quote", "kept"), [("must hold a visa", True), ("must  hold\na visa", True), ("must hold two visas", False), ("You must … a visa", False), ("", False)])
def test_quotes(spark, quote, kept):
    pages = Q.folded_pages(spark.createDataFrame([(1, "You must hold a visa.")], "page_id long, text string"))
    claims = spark.createDataFrame([(1, "a claim", quote), (2, "a claim", quote)], "page_id long, text string, quote string")
    out = {r["page_id"]: r["kept"] for r in Q.check_quotes(claims, pages).collect()}
    assert out == {1: kept, 2: False}


def test_occupation_has_to_be_in_its_quote(spark):
    pages = Q.folded_pages(spark.createDataFrame([(1, "Welder 7237. Cook 6322.")], "page_id long, text string"))
    rows = [(1, "Welder", "Welder 7237"), (1, "Cook", "Welder 7237"), (1, "Welder", "Welder 7238"), (1, "Welder", "Welder Cook")]
    claims = spark.createDataFrame(rows, "page_id long, title string, quote string")
    whys = [r["why"] for r in Q.check_occupations(claims, pages).collect()]
    assert sorted(map(str, whys)) == sorted(["None", "the quote does not contain this occupation", Q.NOT_ON_PAGE, Q.NOT_ON_PAGE])


def test_verdicts(spark):
    df = spark.createDataFrame([(x,) for x in ("YES", "no, it does not", "", "perhaps", None, "\n **Yes**")], "a string").coalesce(1)
    assert [r[0] for r in df.select(T.read_verdict("a")).collect()] == ["agreed", "disputed", "unverified", "unverified", "unverified", "agreed"]


def test_names(spark):
    pairs = [("University of Manchester", "The University of Manchester", True), ("University of East London", "University of West London", False), ("", "x", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", T.names_match("a", "b")).collect())
    firms = [("Nomad Hauling", "Nomad Hauling Inc.", True), ("Nomad Inc", "Nomad Hauling Inc", False)]
    df = spark.createDataFrame(firms, "a string, b string, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", T.same_company("a", "b")).collect())


def test_plurals_meet(spark):
    a = set(value(spark, T.role_words(F.lit("Welder"))))
    b = set(value(spark, T.role_words(F.lit("Welders and related machine operators"))))
    assert a & b == {"welder"}


def test_canonical():
    assert U.canonical("https://www.a.example/x/y", "EN/Themen/;jsessionid=1?b=2&utm_source=q&a=1#z") == "https://www.a.example/x/EN/Themen?a=1&b=2"
    assert U.canonical("https://a.example/", "mailto:x@y") is None
    assert U.canonical("https://A.Example", "/") == "https://a.example/"


def test_robots_doubt_is_no_no(spark):
    urls = spark.createDataFrame([("https://a.example/x",), ("https://b.example/x",), ("https://c.example/x",), ("https://d.example/x",)], "url string")
    robots = spark.createDataFrame([("a.example", 200, "User-agent: *\nDisallow: /"), ("b.example", 404, None), ("c.example", 403, None)], "host string, status int, body string")
    out = {r["url"][8]: r["permission"] for r in L.robots_gate(urls, robots).collect()}
    assert out == {"a": "disallowed", "b": "allowed", "c": "unknown", "d": "unknown"}


def test_siblings_are_no_navigation(spark):
    pages = [(f"https://a.example/visa?type={k}", '<a href="/visa?type=1">1</a><a href="/visa?type=2">2</a><a href="/about">us</a>') for k in (1, 2)]
    links = L.page_links(spark.createDataFrame(pages, "url string, html string"))
    assert [r["link"] for r in L.learn_navigation(links).collect()] == ["https://a.example/about"]


def test_register_column_that_moved(spark):
    rows = spark.createDataFrame([(1, "A")], "pos long, name string")
    with pytest.raises(ValueError, match="no column named"):
        registers.register_rows(rows, "Organisation")


def test_counts(spark):
    df = spark.createDataFrame([(x,) for x in ("1,270", "--", "", "n/a", "..", "-", "x", "7")], "c string").coalesce(1)
    assert [r[0] for r in df.select(registers.count_cell("c")).collect()] == [1270, None, None, None, None, None, None, 7]


def test_upsert_twice(spark):
    schema = "id long, title string, first_seen_at string, last_seen_at string"
    table = spark.createDataFrame([(1, "a", "mon", "mon")], schema)
    batch = spark.createDataFrame([(1, None, "tue"), (2, "b", "tue"), (2, "b", "tue")], "id long, title string, read_at string")
    once = merge.upsert_first_seen(table, batch, "id", "read_at").select("id", "title", "first_seen_at", "last_seen_at")
    twice = merge.upsert_first_seen(once, batch, "id", "read_at").select("id", "title", "first_seen_at", "last_seen_at")
    assert sorted(once.collect()) == sorted(twice.collect()) == [(1, "a", "mon", "tue"), (2, "b", "tue", "tue")]


def test_put_and_merge(spark):
    table = spark.createDataFrame([(1, "kept")], "id long, why string")
    batch = spark.createDataFrame([(1, None)], "id long, why string")
    assert merge.put_rows(table, batch, "id", clear_nulls=True).collect() == [(1, None)]
    assert merge.put_rows(table, batch, "id", clear_nulls=False).collect() == [(1, "kept")]


def test_watch_twice(spark):
    page = "<p>You must pay 5 euros.</p>"
    today = spark.createDataFrame([("s", True, page, "2024-01-02 00:00:00", None, None)], "source_id string, ok boolean, body string, read_at string, vec_before array<double>, vec_after array<double>")
    sources = today.select("source_id", T.stable_digest("body").alias("digest"), "body")
    assert [r["outcome"] for r in C.watch_round(today, sources).collect()] == ["unchanged"]


def test_clusters(spark):
    rows = [(1, "CA", "u1", "Ebola screening extended for travellers", "2024-01-01 01:00:00"), (2, "CA", "u2", "Ebola screening for travellers extended again", "2024-01-01 02:00:00"), (3, "CA", "u3", "Salary threshold rises for nurses", "2024-01-01 03:00:00"), (4, "CA", "u1", "Other words", "2024-01-01 04:00:00")]
    df = spark.createDataFrame(rows, "change_id long, country string, source_url string, summary string, t string").withColumn("after_read_at", F.to_timestamp("t"))
    assert {r["change_id"]: r["story"] for r in S.cluster_changes(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}


def test_python_and_columns_stem_alike(spark):
    for text in ("Visas extended for travelling nurses", "changes, changed; changing: the fees 2024", "as is"):
        assert set(value(spark, T.story_stems(F.lit(text)))) == S._stems(text)


def test_style(spark):
    assert value(spark, T.tidy(F.lit("2024–2026 — “yes” -- it’s,"))) == '2024 to 2026, "yes", it\'s'
    assert value(spark, T.voice_hits(F.lit("A pivotal keyboard — not just big but key changes"))) == ["dash", "key changes", "not just ... but", "pivotal"]


def test_query_without_words(spark):
    docs = spark.createDataFrame([(1, "guide", "Visas", "", "", "2024")], "doc_id long, kind string, title string, summary string, body string, date string")
    assert S.search(docs, "the").count() == 0
    assert [r["score"] for r in S.search(docs, "visa").collect()] == [6]


def test_kept_and_dropped_are_all(spark, data):
    from pagewatch.plans import quotes

    out = quotes.QUERIES["check_quotes"](spark, data)
    assert out.where("kept").count() + out.where("why is not null").count() == spark.read.parquet(f"{data}/documents.parquet").count()


def test_retired_rows_stay_and_come_back(spark):
    schema = "requirement_id long, source_id long, last_confirmed_at timestamp, retired_at timestamp, retired_reason string"
    rows = spark.createDataFrame([(1, 1, None, None, None), (2, 1, None, None, None), (3, 2, None, None, None)], schema)
    now = F.lit("2024-02-01").cast("timestamp")
    read = rows.where("source_id = 1").select("source_id")
    once = C.retire_missing(rows, rows.where("requirement_id = 1").select("requirement_id"), read, now)
    assert {r["requirement_id"] for r in once.where("retired_at is not null").collect()} == {2}
    twice = C.retire_missing(once, rows.where("requirement_id = 2").select("requirement_id"), read, now)
    assert {r["requirement_id"] for r in twice.where("retired_at is not null").collect()} == {1}
    assert twice.count() == 3


def test_a_version_of_the_same_moment_is_not_earlier(spark):
    reads = spark.createDataFrame([("s", 5, "r"), ("t", 5, "q")], "source_id string, read_at long, read string")
    stored = spark.createDataFrame([("s", 5, "now"), ("s", 4, "before"), ("s", 1, "old")], "source_id string, read_at long, path string")
    assert {r["source_id"]: r["before_path"] for r in C.latest_before(reads, stored).collect()} == {"s": "before", "t": None}


def test_moved_tokens_count_once(spark):
    from pagewatch.operators import people as P

    votes = spark.createDataFrame([(1, "a", "yes", 1), (1, "a", "no", 2), (1, "b", "yes", 1), (1, "c", "maybe", 1)], "proposal long, wallet string, option string, at long")
    options = spark.createDataFrame([(1, "yes"), (1, "no")], "proposal long, option string")
    balances = spark.createDataFrame([("a", "5000000000000000000"), ("b", "0"), ("c", "7")], "wallet string, amount string")
    assert sorted(P.tally(votes, options, balances).collect()) == [(1, "no", "5000000000000000000", 1), (1, "yes", "0", 0)]


def test_unknown_cost_does_not_win(spark):
    from pagewatch.operators import people as P

    own = spark.createDataFrame([(1, c, 1, 1) for c in ("UK", "DE", "CA")], "case_id long, country string, n_reasons long, requirements long")
    costs = spark.createDataFrame([("UK", 10.0), ("CA", 20.0), ("DE", None)], "country string, cost double")
    totals = {r["country"]: r["total"] for r in P.score_study(own, costs).collect()}
    assert totals == {"UK": 4 + 8 + 16 + 12 + 30, "DE": 6 + 6 + 16 + 12, "CA": 9 + 8 + 16 + 12}


def test_second_read_sees_the_operators_window(spark, tmp_path):
    # A quote of the text's two ends that stands at character 600 as well.
    ends = "The first fifteen letters, ", " and the last fifteen"
    text = f"{ends[0]}{'x ' * 300}{ends[0][:15]}{ends[1][-15:]}{' y' * 300}{ends[1]}"
    spark.createDataFrame([(3, text, "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.QUERIES["second_read"](spark, str(tmp_path)).first()["state"] == "agreed"


def test_drain_keeps_rows_off_the_driver(spark, tmp_path):
    spark.range(50).write.parquet(f"{tmp_path}/in")
    out = ST.drain(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), "Some rows", f"{tmp_path}/progress")
    assert sorted(r["id"] for r in out.collect()) == list(range(50))
    assert out.inputFiles() and all(str(tmp_path) in x for x in out.inputFiles())


def test_lead_first_places_days_apart(spark):
    rows = [(k, None if k % 9 == 4 else f"2024-01-{k % 8 + 10}", k % 5, k % 3, 0) for k in range(90)]
    df = spark.createDataFrame(rows, "article_id long, day string, groups int, conditions int, dates int").withColumn("observed_on", F.to_date("day"))
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = S.lead_first(df, 3).select("article_id", "place", F.spark_partition_id().alias("task")).collect()
    finally:
        for k in conf:
            spark.conf.unset(k)
    newest = max(r[1] for r in rows if r[1])
    lead = max((2 * r[2] + r[3] + r[4], r[1], r[0]) for r in rows if r[1] and int(r[1][-2:]) >= int(newest[-2:]) - 3)[2]
    want = sorted(rows, key=lambda r: (r[0] != lead, -int(r[1][-2:]) if r[1] else 0, r[0]))
    assert {r["article_id"]: r["place"] for r in got} == {r[0]: k + 1 for k, r in enumerate(want)}
    assert len({r["task"] for r in got}) > 1


def test_nothing_is_quoted_of_a_text_that_is_too_short(spark, tmp_path):
    """By the query's SQL: no quote, whatever the id."""
    from pagewatch.plans import quotes

    rows = [(1, "A."), (2, "A."), (3, "A. \n"), (5, "an inn"), (6, "an inn")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = dict(map(tuple, quotes.QUERIES["check_quotes_nfkc"](spark, str(tmp_path)).collect()))
    assert got == {1: Q.NO_QUOTE, 2: Q.NO_QUOTE, 3: Q.NO_QUOTE, 5: Q.NOT_ON_PAGE, 6: None}


def test_a_version_of_the_first_of_2000_is_a_version_like_any_other(spark, tmp_path):
    """By the query's SQL: an odd source is fixed, whenever its newest version was stored."""
    from pagewatch.plans import changes

    orders = [(2, 1, "2000-01-01"), (4, 2, "2000-01-01"), (3, 3, "2000-01-01")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, d string").select("o_orderkey", "o_custkey", F.col("d").cast("timestamp").alias("o_orderdate")).write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(1,), (2,), (3,)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    got = {r["source_id"]: r["state"] for r in changes.QUERIES["point_latest"](spark, str(tmp_path)).collect()}
    assert got == {1: "fixed", 2: "right", 3: "without"}
