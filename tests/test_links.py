"""Walks and folding against what one entry, or one text, after the other gives."""

import random
import re
import unicodedata
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from pagewatch.functions import text as T
from pagewatch.functions import urls as U
from pagewatch.operators import links as L
from pagewatch.operators import quotes as Q


def walked(entry, links, depth, cap, taken):
    """Pages of one entry: (url, lead, depth), by level, cut to the cap, without what is taken."""
    found = [(entry, None, 0)]
    frontier = [entry]
    for d in range(1, depth + 1):
        known, best = {u for u, _, _ in found}, {}
        for page in frontier:
            for link, pos in links.get(page, {}).items():
                if link not in known and link not in taken:
                    best[link] = min(best.get(link, (page, pos)), (page, pos))
        new = [u for _, u in sorted((x, u) for u, x in best.items())][: cap - len(found)]
        found += [(u, best[u][0], d) for u in new]
        frontier = new
    return found


@pytest.mark.parametrize(("seed", "cap", "once"), [(1, 6, False), (2, 80, False), (3, 6, True), (4, 80, True), (5, 3, True)])
def test_walks(spark, seed, cap, once):
    rng = random.Random(seed)
    nodes = [f"p{k:02}" for k in range(40)]
    rows = [(rng.choice(nodes), rng.choice(nodes), rng.randint(0, 30)) for _ in range(150)]
    links: dict = {}
    for page, link, pos in rows:
        own = links.setdefault(page, {})
        own[link] = min(own.get(link, pos), pos)
    entries = [(e, rng.randint(0, 3)) for e in rng.sample(nodes, 7)]
    got = L.walk(spark.createDataFrame(entries, "entry_url string, pos int"), spark.createDataFrame(rows, "page_url string, link string, pos int"), 3, cap, once).collect()
    want, taken = [], set()
    for entry, _ in sorted(entries, key=lambda e: (e[1], e[0])):
        found = walked(entry, links, 3, cap, taken if once else set())
        want += [(entry, *x) for x in found]
        taken |= {u for u, _, d in found if d}
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    if once:
        pages = [r["url"] for r in got if r["depth"]]
        assert len(pages) == len(set(pages))


def test_a_portal_is_cut_before_it_is_joined(spark):
    rows = [("portal", f"page{k:06}", k) for k in range(20_000)] + [(f"page{k:06}", f"deep{k}", 0) for k in range(200)]
    got = L.walk(spark.createDataFrame([("portal",), ("page000003",)], "entry_url string"), spark.createDataFrame(rows, "page_url string, link string, pos int")).collect()
    own = [r["url"] for r in got if r["entry_url"] == "portal"]
    assert len(own) == 80 and sorted(own)[:3] == ["page000000", "page000001", "page000002"] and sum(r["depth"] == 2 for r in got) == 0


def test_of_several_leads_the_nearest_stays(spark):
    rows = [("GB", "work", "u", "z", 1, True), ("GB", "work", "u", "a", 2, True), ("GB", "work", "u", "b", 1, True), ("GB", "work", "u", "", 0, False), ("GB", "study", "u", "z", 1, True)]
    found = spark.createDataFrame(rows, "country string, lane string, url string, lead_url string, depth int, ok boolean")
    sources = spark.createDataFrame([("GB", "study", "u", "known")], "country string, lane string, url string, source_id string")
    for parts in (1, 3):
        got = {r["lane"]: r for r in L.register_discovered(found.repartition(parts), sources).collect()}
        assert (got["work"]["lead_url"], got["work"]["depth"], got["work"]["known"]) == ("b", 1, False)
        assert (got["study"]["source_id"], got["study"]["known"], len(got)) == ("known", True, 2)


def folded(text):
    text = unicodedata.normalize("NFKC", text).translate(str.maketrans("‘’“”–—\xa0", "''\"\"-- "))
    return re.sub(r"\s+", " ", text).strip()


def unmarked(text):
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def test_folding_is_that_of_python(spark):
    rng = random.Random(6)
    letters = "ab  \t\n\xa0éÉßéö‘”–—…ﬁ①½²ªº´¨ŀŉſǅЖй中ｱ한가Åµ€ 　ͅ" + "".join(map(chr, range(0xA1, 0x180)))
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 12))) for _ in range(3000)] + ["", " ", "́", "plain", None]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.fold("t").alias("f"), T.without_accents("t").alias("u")).collect()
    for r in got:
        t = texts[r["k"]]
        assert (r["f"], r["u"]) == ((None, None) if t is None else (folded(t), unmarked(t))), repr(t)


def test_text_that_needs_no_normalising_stays_in_the_jvm():
    steady = re.compile(f"[{T._STEADY}]")
    for k in range(0x3000):
        if steady.match(chr(k)):
            for around in ("", "a", "\xe9", "\xb7"):
                assert unicodedata.normalize("NFKC", around + chr(k) + around) == around + chr(k) + around


def test_the_second_reader_has_a_window(spark):
    text = "x" * 29_990 + " the very end of the window, and what lies beyond"
    pages = spark.createDataFrame([(1, text), (2, "short, with its own end")], "page_id int, text string")
    quotes = ["x the very", "the very end", "what lies beyond", "its own end", "short", "its  own\nend", "", None]
    rows = [(k, 2 if q and ("own" in q or q == "short") else 1, "en", q) for k, q in enumerate(quotes)]
    asked = spark.createDataFrame(rows, "requirement_id int, page_id int, country string, quote string")
    answers = asked.select("requirement_id").withColumn("answer", Q.F.lit("YES"))
    got = {r["requirement_id"]: r["state"] for r in Q.second_read(asked, Q.folded_pages(pages), answers, ("en",)).collect()}
    assert [got[k] for k in range(8)] == ["agreed", "unverified", "unverified", "agreed", "agreed", "agreed", "unverified", "unverified"]


def test_figures_of_a_draft(spark):
    drafts = spark.createDataFrame([(1, "12 and 1,200 and 7 and 12"), (1, "none"), (2, "99"), (None, "55 44"), (3, None)], "case_id int, text string")
    claims = spark.createDataFrame([(1, "12", None, "x"), (1, "about 7", "", ""), (2, None, "in 1999", None)], "case_id int, value string, quote string, detail string")
    got = {(r["case_id"], r["text"]): r["invented"] for r in Q.invented_numbers(drafts, claims).collect()}
    assert got == {(1, "12 and 1,200 and 7 and 12"): ["1200"], (1, "none"): [], (2, "99"): ["99"], (None, "55 44"): ["44", "55"], (3, None): []}


def test_robots_rules_decide_as_the_parser_does(spark):
    rng = random.Random(11)
    paths = ["/", "", "/a", "/a/b", "/a?", "/a?x=1", "/a%2Fb", "/ä", "/%C3%A4", "/a+b", "*", "/*", "a", "/a#", "/a#f", "//x", "%", "/%zz", "/a;p"]
    agents = ["*", "Watch", "watchbot", "other", "bot", ""]
    lines = lambda: rng.choice([f"User-agent: {rng.choice(agents)}", f"USER-AGENT :{rng.choice(agents)}  # x", f"Disallow: {rng.choice(paths)}", f"Allow:{rng.choice(paths)} ", f"Disallow: {rng.choice(paths)}", "", "", " ", "# only", "Crawl-delay: 3", "Sitemap: /s", "nonsense", "Request-rate: 1/5"])
    files = ["\n".join(lines() for _ in range(rng.randint(0, 14))) for _ in range(250)]
    files += ["User-agent: *\r\nDisallow: /a\r\n\r\nUser-agent: watch\r\nAllow: /", None, "Disallow: /\nUser-agent: *\nDisallow: /a"]
    asked = ["/", "", "/a", "/a/b/c", "/ab", "/a?x=1&y", "/a%2fb", "/%c3%a4x", "/ä", "/a+b", "/a%2Bb", "/*", "/x#f", "/a?", "//x/y", "/%zz", "/a;p?q"]
    robots = spark.createDataFrame([(f"h{k}", 200, f) for k, f in enumerate(files)], "host string, status int, body string")
    urls = spark.createDataFrame([(f"https://h{k}{p}",) for k in range(len(files)) for p in asked], "url string")
    for agent in ("*", "WatchBot/1.0"):
        got = {r["url"]: r["permission"] for r in L.robots_gate(urls, robots, agent).collect()}
        wrong = []
        for k, body in enumerate(files):
            parser = RobotFileParser()
            parser.parse((body or "").splitlines())
            for p in asked:
                url = f"https://h{k}{p}"
                if (got[url] == "allowed") != parser.can_fetch(agent, url):
                    wrong.append((url, got[url], body))
        assert not wrong, (len(wrong), wrong[:3])


def test_the_gate_asks_no_python(spark):
    robots = spark.createDataFrame([("h", 200, "User-agent: *\nDisallow: /a")], "host string, status int, body string")
    urls = spark.createDataFrame([("https://h/a", 1), ("https://h/a", 2), (None, 3), ("https://other/", 4), ("odd", 5)], "url string, n int")
    gate = L.robots_gate(urls, robots)
    assert {r["n"]: r["permission"] for r in gate.collect()} == {1: "disallowed", 2: "disallowed", 3: "unknown", 4: "unknown", 5: "unknown"}
    assert "Python" not in gate._jdf.queryExecution().executedPlan().toString()


def test_addresses_by_expressions_are_those_of_python(spark):
    rng = random.Random(12)
    hosts = ["https://A.example", "http://a.example:80", "HTTP://a.b", "https://", "", "//c.example", "mailto:x@y", "ftp://a.b", "https://u:p@a.b", "https://ä.example", "https://[::1", "https:/x"]
    paths = ["", "/", "/a/b/", "/a;jsessionid=1/b", "/x;SID=2?", "/ä/%C3%A4", "/a/../b", "a b", "/a//"]
    queries = ["", "?", "?b=2&a=1", "?a", "?a=&b", "?=v", "?utm_source=x&a=%e9", "?a=b=c", "?q=%C3%A9+x*~", "?a=%zz&&c=%", "?UTM_Source=1", "?a=1;b=2", "?x=é", "#f", "?a=1#f?b"]
    hrefs = ["".join(map(rng.choice, (["", "", " ", "\t"], hosts, paths, queries, ["", "", " ", "\n"]))) for _ in range(1500)] + [None, ""]
    df = spark.createDataFrame([(k, "https://base.example/x/y?z", h) for k, h in enumerate(hrefs)], "k int, base string, href string")
    got = df.select("k", U.canonical_url("base", "href").alias("url"), U.canonical_absolute("href").alias("whole"), U.listing_url("href").alias("posting"), U._listing("href").alias("plain")).collect()
    wrong = [(hrefs[r["k"]], r["url"], U.canonical("https://base.example/x/y?z", hrefs[r["k"]])) for r in got if r["url"] != U.canonical("https://base.example/x/y?z", hrefs[r["k"]])]
    assert not wrong, (len(wrong), wrong[:5])
    assert all(r["whole"] in (None, r["url"]) for r in got) and sum(r["whole"] is not None for r in got) > 400
    wrong = [(hrefs[r["k"]], r["posting"], r["plain"]) for r in got if r["posting"] != r["plain"]]
    assert not wrong, (len(wrong), wrong[:5])
    assert "Python" not in df.select(U.canonical_absolute("href"))._jdf.queryExecution().executedPlan().toString()


def _plan_and_tasks(df):
    """The plan as run, and in how many tasks rows come out."""
    rows = df.withColumn("_task", F.spark_partition_id()).collect()
    return df._jdf.queryExecution().toString(), len({r["_task"] for r in rows})


def test_links_of_a_small_file_are_dealt_to_tasks_and_not_broadcast(spark, tmp_path):
    """A file of a few kilobytes may become any number of links: none goes through the driver, and no task looks at all of them."""
    path = str(tmp_path / "sites")
    spark.range(400).coalesce(1).write.parquet(path)
    labels = ["Extend your stay", "Renew a permit", "News"]
    page = F.concat(F.lit("https://s"), F.col("id").cast("string"), F.lit(".example/"))
    links = spark.read.parquet(path).select(page.alias("page_url"), F.posexplode(F.array(*map(F.lit, labels))).alias("pos", "label"))
    links = links.withColumn("link", F.concat("page_url", F.lit("p"), F.col("pos").cast("string")))
    titles = links.where("pos = 0").select("page_url", F.lit("RENEW a permit").alias("title"))
    found = L.course_url(titles, links)
    plan, tasks = _plan_and_tasks(found)
    assert "Broadcast" not in plan and tasks > 3
    assert found.where(F.col("link").endswith("p1")).count() == 400
    topics = L.topic_links(links)
    plan, tasks = _plan_and_tasks(topics)
    assert tasks > 3 and topics.where("topic = 'renew'").count() == 800


def test_pages_of_one_address_are_registered_each(spark, tmp_path):
    """By the query's SQL: a row per page, known by its own number."""
    from pagewatch.plans import links

    rows = [(k, "https://a.example/x", "") for k in (1, 2, 3, 5)] + [(4, "https://a.example/y", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = dict(map(tuple, links.QUERIES["register_discovered"](spark, str(tmp_path)).collect()))
    assert got.keys() == {1, 2, 3, 4} and got[3] == "known-3" and got[1] == got[2] != got[4] and got[1].startswith("gb-work-a-example-x-")


def test_rows_of_one_address_are_one_page(spark):
    """Links of a page that comes in two versions: each once, where it comes first in either."""
    rows = [("https://a.example/", '<a href="/x">X</a><a href="/x">again</a><a href="/y">Y</a>'), ("https://a.example/", '<a href="/y">Why</a><a href="/z">Z</a>'), ("https://b.example/", '<a href="/y">B</a>')]
    got = L.page_links(spark.createDataFrame(rows, "url string, html string").repartition(3))
    assert sorted((r["page_url"][8], r["pos"], r["link"][17:], r["label"]) for r in got.collect()) == [("a", 0, "/x", "X"), ("a", 1, "/y", "Why"), ("a", 2, "/z", "Z"), ("b", 0, "/y", "B")]
    assert dict(got.dtypes)["pos"] == "int"


def test_levels_of_a_walk_are_not_broadcast(spark):
    """Levels are small files for their rows; what is joined to them doesn't go through the driver."""
    entries = spark.createDataFrame([("a", 0), ("b", 1)], "entry_url string, pos int")
    links = spark.createDataFrame([("a", "c", 0), ("b", "c", 0), ("c", "d", 0)], "page_url string, link string, pos int")
    plans, write = [], type(links).write.fget
    kept = property(lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(links), "write", kept)
        got = L.walk(entries, links, once=True).collect()
    assert {(r["entry_url"], r["url"], r["depth"]) for r in got} == {("a", "a", 0), ("a", "c", 1), ("a", "d", 2), ("b", "b", 0)}
    assert len(plans) >= 4 and not any("Broadcast" in x for x in plans)
