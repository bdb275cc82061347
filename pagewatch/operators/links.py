"""Links of pages: what is navigation, what is worth reading, and the walk from entry pages."""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewatch.functions import urls as U
from pagewatch.functions import words as W
from pagewatch.operators.dealt import dealt, never_broadcast
from pagewatch.sources.shared import new_folder

_ANCHOR = re.compile(r"<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)(?=</a\s*>|<a\b|$)", re.I | re.S)
#: How a page declares its base address.
_BASE = re.compile(r"<base[^>]+href=[\"']([^\"']+)[\"']", re.I)
_TAG = re.compile(r"<[^>]+>")
#: Pages that a walk reads at most, and how deep it goes.
MAX_PAGES, MAX_DEPTH = 80, 2


def page_links(pages: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    """page_url, link, label, pos: absolute canonical links, each once a page where it comes first; <base href> is honoured.

    Rows of one address are one page: a link stands where it comes first in any of them, and of links that stand alike the lesser address is first.
    """
    from pagewatch.functions.urls import canonical

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for page, text in zip(pdf[url], pdf[body], strict=True):
                text = text or ""
                declared = _BASE.search(text)
                base = canonical(page, declared[1]) + ("/" if declared[1].endswith("/") else "") if declared and canonical(page, declared[1]) else page
                seen: dict[str, tuple[str, int]] = {}
                for at, (href, label) in enumerate(_ANCHOR.findall(text)):
                    link = canonical(base, html.unescape(href))
                    if link and link not in seen:
                        seen[link] = (" ".join(html.unescape(_TAG.sub(" ", label)).split()), at)
                out += [(page, link, *x) for link, x in seen.items()]
            yield pd.DataFrame(out, columns=["page_url", "link", "label", "_at"])

    found = pages.select(url, body).mapInPandas(links, "page_url string, link string, label string, _at int").repartition("page_url")
    first = found.groupBy("page_url", "link").agg(F.min(F.struct("_at", "label")).alias("_f"))
    order = Window.partitionBy("page_url").orderBy("_f._at", "link")
    return first.select("page_url", "link", F.col("_f.label").alias("label"), (F.row_number().over(order) - 1).alias("pos"))


def learn_navigation(links: DataFrame) -> DataFrame:
    """host, link, n_pages: links that at least two sampled pages of a host have.

    A link with a query to the path of a sampled page is a sibling record, and no navigation. Links are counted by (host, link), so
    that a large host is many groups.
    """
    own = links.select(U.host_of("page_url").alias("host"), "page_url", "link").distinct()
    counted = own.groupBy("host", "link").agg(F.count("*").alias("n_pages")).where("n_pages >= 2")
    sampled = own.select("host", F.regexp_replace(U.path_of("page_url"), "/+$", "").alias("path")).distinct()
    counted = counted.withColumn("path", F.when(U.query_of("link") != "", F.regexp_replace(U.path_of("link"), "/+$", "")))
    return counted.join(sampled, ["host", "path"], "left_anti").select("host", "link", "n_pages")


def worth_reading(links: DataFrame, navigation: DataFrame) -> DataFrame:
    """links (link, entry_url, suffixes, ...) with keep and why: the first reason that speaks against a link, or that none does."""
    chrome = navigation.select(F.col("link"), F.lit(True).alias("_nav")).distinct()
    learned = navigation.select(F.col("host").alias("_host")).distinct().withColumn("_learned", F.lit(True))
    own = links.withColumn("_host", U.host_of("link")).join(chrome, "link", "left").join(learned, "_host", "left")
    inside, why = U.in_scope("link", "entry_url", "suffixes")
    path = F.lower(U.path_of("link"))
    entry_language, language = U.language_of("entry_url"), U.language_of("link")
    reason = (
        F.when(~inside, why)
        .when(path.rlike(rf"({'|'.join(re.escape(x) for x in W.NOT_PAGES)})$"), "not a web page")
        .when(U.path_of("link").rlike(f"(?i){W.ALTERNATE_VIEW}"), "another rendering of a page we already have")
        .when(F.regexp_replace("link", "/+$", "") == F.regexp_replace("entry_url", "/+$", ""), "the entry page itself")
        .when(entry_language.isNotNull() & language.isNotNull() & (entry_language != language), "the same document in another language")
        .when(F.col("_nav").isNotNull(), "site navigation")
        .when(F.col("_learned").isNull(), "no navigation learned for this host")
    )
    return own.withColumn("why", F.coalesce(reason, F.lit("unique to this page"))).withColumn("keep", reason.isNull()).drop("_nav", "_host", "_learned")


def walk(entries: DataFrame, links: DataFrame, max_depth: int = MAX_DEPTH, max_pages: int = MAX_PAGES, once: bool = False) -> DataFrame:
    """entry_url, url, lead_url, depth: pages reached from each entry over kept links (page_url, link, pos), breadth first.

    A page has its smallest depth, and of several leads the smallest. The cap on pages of an entry is the feature: by depth, lead and
    position. It is applied at every level before links are joined, and of a page's links only those are joined that the cap can let through, so that an
    entry's frontier has max_pages rows at most however many links a portal has. Each level is a table in the shared folder. Levels meet by shuffles alone: a level
    is a small file for its rows, and rounds of broadcasts would go through the driver.

    once: a page belongs to the first entry that finds it, and later entries neither have it nor go on from it. Entries are in the order of their column pos, if
    they have one, then of their address. What earlier entries claim changes what later ones reach, so that rounds of walks follow until none changes: as
    many as claims depend on each other in a chain, and one more. That is what one entry after the other gives.
    """
    own = entries.select("entry_url", (F.col("pos") if "pos" in entries.columns else F.lit(0)).alias("_p")).groupBy("entry_url").agg(F.min("_p").alias("_p"))
    ahead = F.struct("_p", "entry_url")
    folder = new_folder(entries.sparkSession)
    if not once:
        return _walked(own, links, max_depth, max_pages, None, folder)
    claims = before = None
    for round_ in itertools.count():
        found = _walked(own, links, max_depth, max_pages, claims, f"{folder}/{round_}")
        now = found.agg(F.count("*"), F.bit_xor(F.xxhash64("entry_url", "url", "lead_url", "depth")), F.sum(F.xxhash64("url", "entry_url") % (1 << 40))).first()
        if now == before:
            return found
        before = now
        claims = found.where("depth > 0").join(never_broadcast(own), "entry_url").groupBy(F.col("url").alias("_u")).agg(F.min(ahead).alias("_first"))


def _walked(entries: DataFrame, links: DataFrame, max_depth: int, max_pages: int, claims: DataFrame | None, folder: str) -> DataFrame:
    """The walk from each entry. claims: _u and _first, the first entry (its pos and address) that has a page; later ones can't."""
    spark = entries.sparkSession
    out = links.select("page_url", "link", "pos").groupBy("page_url", "link").agg(F.min("pos").alias("pos"))
    if claims is None:
        # Of the links before a page's 2 * max_pages-th, an entry has max_pages already at most, and smaller leads have as many at most.
        out = _first(out, ["page_url"], [F.col("pos"), F.col("link")], 2 * max_pages)
    found = entries.select("entry_url", F.col("entry_url").alias("url"), F.lit(None).cast("string").alias("lead_url"), F.lit(0).alias("depth"), "_p")
    frontier = found
    for depth in range(1, max_depth + 1):
        reached = frontier.select("entry_url", "_p", F.col("url").alias("page_url")).join(never_broadcast(out), "page_url")
        new = reached.groupBy("entry_url", "_p", F.col("link").alias("url")).agg(F.min(F.struct("page_url", "pos")).alias("f")).join(never_broadcast(found.select("entry_url", "url")), ["entry_url", "url"], "left_anti")
        if claims is not None:
            new = new.join(never_broadcast(claims), F.col("url") == F.col("_u"), "left").where(F.col("_first").isNull() | (F.col("_first") >= F.struct("_p", "entry_url"))).drop("_u", "_first")
        room = found.groupBy("entry_url").agg((max_pages - F.count("*")).alias("_room"))
        order = Window.partitionBy("entry_url").orderBy("f.page_url", "f.pos", "url")
        new = new.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_pages).join(never_broadcast(room), "entry_url").where("_n <= _room")
        new.select("entry_url", "url", F.col("f.page_url").alias("lead_url"), F.lit(depth).alias("depth"), "_p").write.parquet(f"{folder}/level-{depth}")
        frontier = spark.read.schema(found.schema).parquet(f"{folder}/level-{depth}")
        found = found.unionByName(frontier)
    return found.drop("_p")


def link_depth(sources: DataFrame, steps: int = 3) -> DataFrame:
    """sources (url, lead_url) with depth: steps along leads back to a page without one; null where that can't be traced."""
    leads = sources.select(F.col("url").alias("_u"), F.col("lead_url").alias("_next")).dropDuplicates(["_u"])
    own = sources.withColumn("_at", F.col("lead_url")).withColumn("depth", F.when(F.col("lead_url").isNull(), 0))
    for step in range(1, steps + 1):
        own = own.join(leads, F.col("_at") == F.col("_u"), "left")
        ends = F.col("depth").isNull() & F.col("_u").isNotNull() & F.col("_next").isNull()
        own = own.withColumn("depth", F.when(ends, step).otherwise(F.col("depth"))).withColumn("_at", F.col("_next")).drop("_u", "_next")
    return own.drop("_at")


def topic_links(links: DataFrame, topics: dict[str, str] = W.LIVING_TOPICS, most: int = 6) -> DataFrame:
    """topic, page_url, link, label: links of the page's own host whose address or label fits a topic's pattern, `most` a topic and page."""
    text = F.replace(F.lower(F.concat_ws(" ", "link", "label")), F.lit(" "), F.lit("-"))
    fits = F.array_compact(F.array(*(F.when(text.rlike(f"(?U){p}"), F.lit(t)) for t, p in topics.items())))
    own = _own_host(links).withColumn("topic", F.explode(fits))
    return _first(own, ["topic", "page_url"], [F.col("pos")], most)


def _own_host(links: DataFrame) -> DataFrame:
    """Links to the page's own host, dealt out by page before anything is looked at, where what is first of a page is found too."""
    return dealt(links, "page_url").where(U.host_of("link") == U.host_of("page_url"))


def _first(df: DataFrame, per: list[str], order: list[Column], most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*per).orderBy(*order))
    return df.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")


def _has(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(map(re.escape, words)))


def _rank(text: Column, words: list[str]) -> Column:
    """How early in the list the first word stands that a text has; 0 for none."""
    out = F.when(F.lit(False), 0)
    for k, w in enumerate(words):
        out = out.when(text.contains(w), len(words) - k)
    return out.otherwise(0)


def course_links(links: DataFrame, most: int = 25) -> DataFrame:
    """Links to courses with strength, best first a page: words in the path count double, short paths first. News and the like are out."""
    path, label = F.lower(U.path_of("link")), F.lower("label")
    text = F.concat_ws(" ", path, label)
    own = _own_host(links).where(~_has(text, W.COURSE_AVOID) & _has(text, [*W.COURSE_STRONG, *W.COURSE_WEAK]))
    own = own.withColumn("strength", _rank(path, W.COURSE_STRONG) * 2 + _rank(label, W.COURSE_STRONG))
    return _first(own, ["page_url"], [F.desc("strength"), F.length(U.path_of("link")), F.col("pos")], most)


def fee_links(links: DataFrame, most: int = 3) -> DataFrame:
    """Links to tuition with strength: fees for people from abroad first, then tuition and fees, then other money."""
    text = F.concat_ws(" ", F.lower(U.path_of("link")), F.lower("label"))
    own = _own_host(links).where(_has(text, W.FEE_WORDS))
    own = own.withColumn("strength", F.when(_has(text, ["international", "overseas"]), 2).otherwise(1) + _has(text, ["tuition", "fee"]).cast("int"))
    return _first(own, ["page_url"], [F.desc("strength"), F.col("pos")], most)


def contact_links(links: DataFrame, most: int = 2) -> DataFrame:
    """Links to people who answer questions with strength: two for each word of a desk that is asked first."""
    text = F.concat_ws(" ", F.lower(U.path_of("link")), F.lower("label"))
    own = _own_host(links).where(_has(text, W.CONTACT_WORDS))
    score = F.lit(0)
    for w in W.CONTACT_PREFERRED:
        score = score + F.when(text.contains(w), 2).otherwise(0)
    return _first(own.withColumn("strength", score), ["page_url"], [F.desc("strength"), F.col("pos")], most)


def course_url(titles: DataFrame, links: DataFrame) -> DataFrame:
    """titles (page_url, title) with link: that of the anchor whose folded text is the title, else of the only one that contains it.

    Titles and links meet by a shuffle on their page, as many as they are.
    """
    from pagewatch.functions.text import fold_ci

    titles, links = dealt(titles, "page_url"), dealt(links.select("page_url", "link", "label", "pos"), "page_url")
    own = titles.select("page_url", "title").distinct().withColumn("_t", fold_ci("title")).where("_t <> ''")
    pairs = own.join(never_broadcast(links.withColumn("_l", fold_ci("label"))), "page_url").where(F.col("_l").contains(F.col("_t")))
    exact = F.col("_l") == F.col("_t")
    found = pairs.groupBy("page_url", "title").agg(F.min(F.when(exact, F.struct("pos", "link"))).alias("e"), F.count_distinct("link").alias("n"), F.min("link").alias("only"))
    link = F.when(F.col("e").isNotNull(), F.col("e.link")).when(F.col("n") == 1, F.col("only"))
    return titles.join(never_broadcast(found.select("page_url", "title", link.alias("link"))), ["page_url", "title"], "left")


def link_shapes(links: DataFrame, least: int = 8) -> DataFrame:
    """page_url, shape, n, results: the commonest shape of a page's links (digits as #, long names as *), and whether it is a list of results."""
    shape = F.regexp_replace(F.regexp_replace("link", r"\d+", "#"), r"[a-z][a-z-]{14,}", "*")
    counted = links.groupBy("page_url", shape.alias("shape")).agg(F.count("*").alias("n"))
    best = counted.groupBy("page_url").agg(F.min_by(F.struct("shape", "n"), F.struct((-F.col("n")).alias("k"), "shape")).alias("b"))
    return best.select("page_url", "b.shape", "b.n", (F.col("b.n") >= least).alias("results"))


def readable_sources(sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Sources to read: not blocked (or by robots only, which is asked again), no job board, not too deep; an unset depth is 0."""
    own = sources.where((F.col("blocked").isNull() | (F.col("blocked") == "robots_disallowed")) & ~F.col("kind").eqNullSafe("job_board"))
    depth = F.coalesce("depth", F.lit(0))
    return own if max_depth is None else own.where(depth <= max_depth)


def thin_pages(pages: DataFrame, body: str = "body", least: int = 4000) -> DataFrame:
    """Pages whose body has fewer bytes than a page has: candidates for a second reading."""
    return pages.where(F.octet_length(body) < least)


def longer_reading(first: DataFrame, second: DataFrame, key: str = "url", text: str = "text", usable: int = 400) -> DataFrame:
    """first (key, text) with the longer of two readings of a page, where it comes from, and whether it has enough text to use."""
    own = first.join(second.select(key, F.col(text).alias("_second")), key, "left")
    again = F.length(F.coalesce("_second", F.lit(""))) > F.length(F.coalesce(text, F.lit("")))
    own = own.withColumn("reading", F.when(again, "second").otherwise("first")).withColumn(text, F.when(again, F.col("_second")).otherwise(F.col(text)))
    return own.withColumn("usable", F.length(F.coalesce(text, F.lit(""))) > usable).drop("_second")


def _unquoted(x: Column) -> Column:
    """Percent codes decoded; what is none stays. A plus is a plus."""
    whole = F.regexp_replace(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.when(x.contains("%"), F.url_decode(whole)).otherwise(x)


def _without_empty(x: Column) -> Column:
    """Without a question mark or hash that nothing follows."""
    return F.regexp_replace(F.regexp_replace(x, "#$", ""), r"^([^?#]*)\?(?=#|$)", "$1")


def robots_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """host, n, allow, prefix: the rules of each robots file (host, body) that are meant for the agent, in their order.

    A group is one or more user-agent lines and what follows them; a blank line ends it. Its rules count if there are any. Of groups that name the agent the first one is
    meant, else the first for all. Codes in paths are decoded.
    """
    ends = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
    rows = robots.where("body is not null").select("host", F.posexplode(F.split("body", ends)).alias("n", "raw"))
    line = F.regexp_replace(F.regexp_replace("raw", "(?s)#.*", ""), r"(?U)^\s+|\s+$", "")
    field = F.lower(F.regexp_replace(F.regexp_extract(line, "(?s)^([^:]*):", 1), r"(?U)^\s+|\s+$", ""))
    value = _unquoted(F.regexp_replace(F.regexp_extract(line, "(?s)^[^:]*:(.*)$", 1), r"(?U)^\s+|\s+$", ""))
    kind = F.when(F.col("raw") == "", "blank").when(field == "user-agent", "agent").when(field.isin("allow", "disallow"), "rule").when(field.isin("crawl-delay", "request-rate"), "other")
    rows = rows.select("host", "n", kind.alias("kind"), field.alias("field"), value.alias("value")).where("kind is not null")
    order = Window.partitionBy("host").orderBy("n")
    begins = (F.col("kind") == "blank") | (F.col("kind") == "agent") & F.lag("kind").over(order).isin("rule", "other")
    rows = rows.withColumn("_begins", F.coalesce(begins, F.lit(False)).cast("int")).withColumn("group", F.sum("_begins").over(order))
    own, is_agent = agent.split("/")[0].lower(), F.col("kind") == "agent"
    groups = rows.groupBy("host", "group").agg(
        F.bool_or(is_agent).alias("named"), F.bool_or(F.col("kind").isin("rule", "other")).alias("rules"), F.bool_or(is_agent & (F.col("value") == "*")).alias("all"), F.bool_or(is_agent & F.lit(own).contains(F.lower("value"))).alias("mine")
    )
    meant = groups.where(F.col("named") & F.col("rules") & (F.col("all") | F.col("mine"))).groupBy("host").agg(F.min(F.struct("all", "group")).alias("m")).select("host", F.col("m.group").alias("group"))
    rules = rows.where("kind = 'rule'").join(meant, ["host", "group"], "left_semi")
    return rules.select("host", "n", ((F.col("field") == "allow") | (F.col("value") == "")).alias("allow"), _without_empty(F.col("value")).alias("prefix"))


def robots_gate(urls: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """urls with permission: allowed, disallowed or unknown, by what their host's robots file (host, status, body) says.

    200: its rules decide, the first that fits. 404 and 410: there are none. Anything else is unknown, and never a no. Rules are rows: an address meets a rule as one of its own
    beginnings, of the lengths that the host's rules have, by equality. So a file is taken apart once, and no text of it goes to the addresses. Of
    several files of a host the one with the least status counts.
    """
    files = robots.groupBy("host").agg(F.min(F.struct("status", "body")).alias("_f")).select(F.col("host").alias("_host"), F.col("_f.status").alias("_status"), F.col("_f.body").alias("_body"))
    rules = robots_rules(files.where("_status = 200").select(F.col("_host").alias("host"), F.col("_body").alias("body")), agent)
    lengths = rules.groupBy(F.col("host").alias("_host")).agg(F.collect_set(F.length("prefix")).alias("_lengths"))
    plain = _unquoted(F.coalesce(F.col("url"), F.lit("")))
    rest = _without_empty(F.regexp_replace(F.regexp_replace(plain, "^[A-Za-z][A-Za-z0-9+.-]*:", ""), "^//[^/?#]*", ""))
    path = F.when(rest == "", "/").when(rest.startswith("//"), F.concat(F.lit("//"), rest)).otherwise(rest)
    own = urls.select("url", U.host_of("url").alias("_host"), path.alias("_path")).distinct()
    begins = own.join(lengths, "_host").withColumn("_n", F.explode("_lengths")).where(F.col("_n") <= F.length("_path"))
    begins = begins.select("url", "_host", F.left("_path", F.col("_n")).alias("prefix"))
    found = begins.join(rules.withColumnRenamed("host", "_host"), ["_host", "prefix"]).groupBy("url").agg(F.min_by("allow", "n").alias("_allow"))
    known = own.select("url", "_host").join(files.select("_host", "_status"), "_host", "left").join(found, "url", "left")
    permission = F.when(F.col("_status") == 200, F.when(F.coalesce("_allow", F.lit(True)), "allowed").otherwise("disallowed")).when(F.col("_status").isin(404, 410), "allowed").otherwise("unknown")
    known = known.select(F.col("url").alias("_url"), permission.alias("permission"))
    return urls.join(known, F.col("url").eqNullSafe(F.col("_url")), "left").withColumn("permission", F.coalesce("permission", F.lit("unknown"))).drop("_url")


def register_discovered(found: DataFrame, sources: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    """found (country, lane, url, lead_url, depth, ok) that were read, with source_id: a known page keeps its own.

    Of a page that several lead to, the row of the least depth stays, then of the least lead, then by all its columns. per: columns of both sides that tell pages of
    one address apart, such as a number of their own.
    """
    from pagewatch.functions.text import source_id

    key = ["country", "lane", "url", *per]
    known = sources.groupBy(*key).agg(F.min("source_id").alias("_id"))
    rest = [x for x in found.columns if x not in key]
    order = F.struct(*(x for x in ("depth", "lead_url") if x in rest), *rest)
    once = found.where("ok").groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*key, *(F.col(f"_r.{x}").alias(x) for x in rest)).select(*found.columns)
    own = once.join(known, key, "left")
    return own.withColumn("source_id", F.coalesce("_id", source_id("country", "lane", "url"))).withColumn("known", F.col("_id").isNotNull()).drop("_id")


_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.I | re.S)
_POSTING = re.compile(r"<article\b[^>]*\bid=[\"']([^\"']+)[\"'][^>]*>(.*?)</article", re.I | re.S)
_FIELD = re.compile(r"<(\w+)\b[^>]*\bclass=[\"'](?:[^\"']*\s)?(title|business|location|salary|date|source)(?:\s[^\"']*)?[\"'][^>]*>(.*?)</\1", re.I | re.S)


def parse_listings(pages: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    """Postings of result pages: url, posting_id, title, employer, location, salary, posted, via; or one row with reason for a page that is an error.

    A page that answers 200 with the title of an error is an error. Postings without a title are left out.
    """

    def clean(x: str) -> str:
        return " ".join(html.unescape(_TAG.sub(" ", x)).split())

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["url", "posting_id", "title", "employer", "location", "salary", "posted", "via", "reason"]
        for pdf in batches:
            out = []
            for page, text in zip(pdf[url], pdf[body], strict=True):
                title = _TITLE.search(text or "")
                if title and re.search(r"\b(404|not found|error)\b", clean(title[1]), re.I):
                    out.append((page, *[None] * 7, "the page is an error"))
                    continue
                for posting, block in _POSTING.findall(text or ""):
                    f = {name.lower(): clean(value) for _, name, value in reversed(_FIELD.findall(block))}
                    if f.get("title"):
                        out.append((page, posting, f["title"], *(f.get(k) or None for k in ("business", "location", "salary", "date", "source")), None))
            yield pd.DataFrame(out, columns=columns, dtype=object)

    return pages.select(url, body).mapInPandas(parse, "url string, posting_id string, title string, employer string, location string, salary string, posted string, via string, reason string")


def redundant_pages(sources: DataFrame, requirements: DataFrame, languages: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(sources, requirements) after pages in a language that the country doesn't publish in are blocked and their requirements retired."""
    own = sources.join(languages, "country", "left").withColumn("_tag", U.redundant_language("url", "languages"))
    marked = own.withColumn("blocked", F.when(F.col("_tag").isNotNull(), "duplicate_language").otherwise(F.col("blocked"))).select(*sources.columns)
    gone = own.where("_tag is not null").select("source_id").withColumn("_gone", F.lit(True))
    live = requirements.join(gone, "source_id", "left")
    retire = F.col("_gone").isNotNull() & F.col("retired_at").isNull()
    return marked, live.withColumn("retired_at", F.when(retire, now).otherwise(F.col("retired_at"))).select(*requirements.columns)


def other_lane_pages(sources: DataFrame, entries: DataFrame) -> DataFrame:
    """Sources (source_id, country, lane, url) whose address is, or is under, the entry of another lane of the country.

    Each address is joined on all its prefixes: an equality join in place of a comparison of all pairs.
    """
    under = sources.withColumn("prefix", F.explode(U.url_prefixes("url")))
    own = entries.select("country", F.col("lane").alias("_lane"), F.regexp_replace("url", "/+$", "").alias("prefix"))
    return under.join(own, ["country", "prefix"]).where("lane <> _lane").select("source_id").distinct()
