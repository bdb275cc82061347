"""Queries of change detection: yesterday's pages are today's with a fixed edit by page_id % 5."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewatch.functions import text as T
from pagewatch.operators import changes as C
from pagewatch.plans.common import host, page_text_sql, stable_digest_sql, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Today has a paragraph more; yesterday's page, by page_id % 5: the same, other script, other white space, other words, another figure.
WORDS = "<p>The office answers letters.</p><p>The fee is 590 euros.</p>"


def _two_days(spark, d):
    k = F.col("page_id") % 5
    now = F.concat("html", F.lit(WORDS))
    old = F.when(k == 1, F.replace(now, F.lit("track("), F.lit("trace("))).when(k == 2, F.replace(now, F.lit("</p><p>"), F.lit("</p>\n <p>"))).when(k == 3, F.replace(now, F.lit("answers letters"), F.lit("replies to letters"))).when(k == 4, F.replace(now, F.lit("590 euros"), F.lit("490 euros"))).otherwise(now)
    return table(spark, d, "pages").select("page_id", "url", now.alias("now"), old.alias("old"))


_DAYS = f"""d AS (SELECT page_id, url, html || '{WORDS}' AS now FROM pages), v AS (SELECT *, CASE page_id % 5 WHEN 1 THEN replace(now, 'track(', 'trace(') WHEN 2 THEN replace(now, '</p><p>', '</p>' || chr(10) || ' <p>')
    WHEN 3 THEN replace(now, 'answers letters', 'replies to letters') WHEN 4 THEN replace(now, '590 euros', '490 euros') ELSE now END AS old FROM d)"""


def _round(spark, d):
    days = _two_days(spark, d)
    vec = F.array(F.lit(1.0), F.lit(0.0))
    at = F.lit("2024-01-02 06:00:00").cast("timestamp")
    today = days.select(F.col("page_id").alias("source_id"), (F.col("page_id") % 11 != 10).alias("ok"), F.col("now").alias("body"), at.alias("read_at"), vec.alias("vec_before"), F.array(F.lit(0.99), F.lit(0.05)).alias("vec_after"))
    sources = days.select(F.col("page_id").alias("source_id"), T.stable_digest("old").alias("digest"), F.when(F.col("page_id") % 13 != 12, F.col("old")).alias("body"))
    return C.watch_round(today, sources)


_LINES = f"list_filter(string_split({{0}}, chr(10)), lambda x: trim(x) <> '')"
_ROUND = f"""WITH {_DAYS}, g AS (SELECT page_id, {stable_digest_sql('now')} AS h1, {stable_digest_sql('old')} AS h0, {_LINES.format(page_text_sql('now'))} AS l1, {_LINES.format(page_text_sql('old'))} AS l0 FROM v),
    x AS (SELECT page_id, h1, CASE WHEN page_id % 11 = 10 THEN 'unreadable' WHEN h0 = h1 THEN 'digest' WHEN page_id % 13 = 12 THEN 'first' WHEN l0 = l1 THEN 'lines'
        WHEN list_sort(regexp_extract_all(array_to_string(l0, ' '), '\\d+')) <> list_sort(regexp_extract_all(array_to_string(l1, ' '), '\\d+')) THEN 'changed' ELSE 'meaning' END AS gate FROM g)
    SELECT page_id AS source_id, CASE WHEN gate = 'unreadable' THEN 'unreadable' WHEN gate IN ('changed', 'first') THEN 'changed' ELSE 'unchanged' END AS outcome,
    CASE gate WHEN 'digest' THEN 'the digest is the same' WHEN 'lines' THEN 'not one line of text moved' WHEN 'meaning' THEN 'reworded' WHEN 'first' THEN 'no earlier version' WHEN 'changed' THEN 'the figures differ' ELSE 'not read' END AS detail,
    CASE WHEN gate IN ('meaning', 'changed') THEN 1 ELSE 0 END AS added, CASE WHEN gate IN ('meaning', 'changed') THEN 1 ELSE 0 END AS removed,
    CASE WHEN gate <> 'unreadable' THEN h1 END AS new_digest, gate IN ('changed', 'first') AS store_version FROM x"""


@query(_ROUND)
def watch_round(spark, d):
    return _round(spark, d).select("source_id", "outcome", "detail", "added", "removed", "new_digest", "store_version")


@query(f"SELECT lower(regexp_extract(p.url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host, r.outcome, r.detail, count(*) AS n FROM ({_ROUND}) r JOIN pages p ON p.page_id = r.source_id GROUP BY ALL")
def watch_pages(spark, d):
    hosts = table(spark, d, "pages").select(F.col("page_id").alias("source_id"), host().alias("host"))
    return _round(spark, d).select("source_id", "outcome", "detail").join(hosts, "source_id").groupBy("host", "outcome", "detail").agg(F.count("*").alias("n"))


@query(f"""SELECT page_id AS source_id, h0 <> '' AND h0 = h1 AS unchanged FROM (SELECT page_id, {stable_digest_sql('now')} AS h1, CASE WHEN page_id % 7 = 0 THEN '' ELSE {stable_digest_sql('old')} END AS h0 FROM (WITH {_DAYS} SELECT * FROM v))""")
def digest_gate(spark, d):
    days = _two_days(spark, d)
    today = days.select(F.col("page_id").alias("source_id"), T.stable_digest("now").alias("digest"))
    sources = days.select(F.col("page_id").alias("source_id"), F.when(F.col("page_id") % 7 == 0, "").otherwise(T.stable_digest("old")).alias("digest"))
    return C.digest_gate(today, sources).select("source_id", "unchanged")


@query(f"""WITH {_DAYS}, g AS (SELECT page_id, {_LINES.format(page_text_sql('now'))} AS l1, {_LINES.format(page_text_sql('old'))} AS l0 FROM v)
    SELECT page_id, CASE WHEN l0 = l1 THEN 0 ELSE 1 END AS added, CASE WHEN l0 = l1 THEN 0 ELSE 1 END AS removed FROM g""")
def text_diff(spark, d):
    return _two_days(spark, d).select("page_id", C.text_diff(T.page_text("old"), T.page_text("now")).alias("d")).select("page_id", "d.added", "d.removed")


@query("""SELECT doc_id, array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: NOT starts_with(x, '--')), lambda x: trim(x)), chr(10)) AS removed,
    array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(x || ' more')), chr(10)) AS added FROM documents WHERE text IS NOT NULL""")
def changed_sides(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    lines = F.split("text", "\n")
    gone, come = F.transform(lines, lambda x: F.concat(F.lit("-"), x)), F.transform(lines, lambda x: F.concat(F.lit("+ "), x, F.lit(" more")))
    diff = F.array_join(F.concat(F.array(F.lit("--- "), F.lit("+++ "), F.lit("@@ -1 +1 @@")), gone, F.array(F.lit(" same")), come), "\n")
    removed, added = C.changed_sides(diff)
    return docs.select("doc_id", removed.alias("removed"), added.alias("added"))


_PAIRS = "SELECT a.vec_id, a.embedding AS va, b.embedding AS vb, CASE a.vec_id % 4 WHEN 0 THEN '' ELSE 'pay ' || a.vec_id END AS b, CASE a.vec_id % 4 WHEN 1 THEN 'pay ' || (a.vec_id + 1) WHEN 2 THEN 'you must pay ' || a.vec_id ELSE 'now pay ' || a.vec_id END AS a FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + CASE WHEN a.vec_id % 8 = 3 THEN 0 ELSE 1 END"


@query(f"""SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 'lines were only added or only removed' WHEN 1 THEN 'the figures differ' WHEN 2 THEN 'what is required, allowed or refused differs'
    ELSE CASE WHEN s >= 0.97 THEN 'the same meaning in other words' ELSE 'the meaning differs' END END AS reason, CASE WHEN vec_id % 4 = 3 THEN round(s, 6) END AS similarity
    FROM (SELECT *, list_cosine_similarity(va::DOUBLE[], vb::DOUBLE[]) AS s FROM ({_PAIRS}))""")
def assess_meaning(spark, d):
    own = table(spark, d, "embeddings")
    k = F.col("vec_id") % 4
    n = F.col("vec_id").cast("string")
    other = own.select(F.col("vec_id").alias("other"), F.col("embedding").alias("vb"))
    pairs = own.withColumn("other", F.col("vec_id") + F.when(F.col("vec_id") % 8 == 3, 0).otherwise(1)).join(other, "other")
    before = F.when(k == 0, "").otherwise(F.concat(F.lit("pay "), n))
    after = F.when(k == 1, F.concat(F.lit("pay "), (F.col("vec_id") + 1).cast("string"))).when(k == 2, F.concat(F.lit("you must pay "), n)).otherwise(F.concat(F.lit("now pay "), n))
    _, score, reason = C.assess_meaning(before, after, "embedding", "vb")
    return pairs.select("vec_id", reason.alias("reason"), F.round(score, 6).alias("similarity"))


@query("""SELECT r.event_id, CAST(s.event_id AS VARCHAR) AS before_id FROM (SELECT * FROM events WHERE event_id % 10 = 0) r ASOF LEFT JOIN (SELECT * FROM events WHERE event_id % 10 <> 0) s ON r.user_id = s.user_id AND r.ts > s.ts""")
def latest_before(spark, d):
    events = table(spark, d, "events").select(F.col("user_id").alias("source_id"), F.col("ts").alias("read_at"), "event_id")
    reads, stored = events.where("event_id % 10 = 0"), events.where("event_id % 10 <> 0").withColumnRenamed("event_id", "path")
    return C.latest_before(reads, stored).select("event_id", F.col("before_path").cast("string").alias("before_id"))


@query("""SELECT left(sha256(o_custkey || chr(10) || 'v' || (o_orderkey % 50) || chr(10) || 'w' || o_orderkey), 24) AS change_id, v.at AS before_read_at, CASE WHEN v.at IS NULL THEN 0 ELSE o_orderkey % 7 END::INT AS added, v.at IS NULL AS history_incomplete
    FROM orders LEFT JOIN (SELECT o_custkey AS c, 'v' || (o_orderkey % 50) AS sha, max(o_orderdate) AS at FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL) v ON v.c = o_custkey AND v.sha = 'v' || (o_orderkey % 50) WHERE o_orderstatus = 'F'""")
def change_rows(spark, d):
    orders = table(spark, d, "orders").withColumn("v", F.concat(F.lit("v"), (F.col("o_orderkey") % 50).cast("string")))
    changed = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("source_id"), F.col("v").alias("before_sha"), F.concat(F.lit("w"), F.col("o_orderkey").cast("string")).alias("after_sha"), F.col("o_orderdate").alias("read_at"), F.lit("x").alias("diff"), (F.col("o_orderkey") % 7).cast("int").alias("added"), F.lit(0).alias("removed"))
    versions = orders.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("source_id"), F.col("v").alias("sha"), F.col("o_orderdate").alias("stored_at"))
    return C.change_rows(changed, versions).select("change_id", "before_read_at", "added", "history_incomplete")


@query("""SELECT event_id AS requirement_id, CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-02-01' ELSE ts END AS last_confirmed_at,
    CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 5 = 0 THEN ts WHEN user_id % 2 = 0 THEN TIMESTAMP '2024-02-01' END AS retired_at,
    CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'before' WHEN user_id % 2 = 0 THEN 'the page no longer says this' END AS retired_reason FROM events""")
def retire_missing(spark, d):
    own = table(spark, d, "events").select(F.col("event_id").alias("requirement_id"), F.col("user_id").alias("source_id"), F.col("ts").alias("last_confirmed_at"), F.when(F.col("event_id") % 5 == 0, F.col("ts")).alias("retired_at"), F.when(F.col("event_id") % 5 == 0, "before").alias("retired_reason"))
    now = F.lit("2024-02-01").cast("timestamp")
    out = C.retire_missing(own, own.where("requirement_id % 3 = 0").select("requirement_id"), own.where("source_id % 2 = 0").select("source_id"), now)
    return out.drop("source_id")


@query("""WITH p AS (SELECT o_custkey, max('s/' || strftime(o_orderdate, '%Y-%m-%d')) AS m FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1)
    SELECT c_custkey AS source_id, m AS latest_path, CASE WHEN m IS NULL THEN 'without' WHEN c_custkey % 2 = 0 THEN 'right' ELSE 'fixed' END AS state FROM customer LEFT JOIN p ON o_custkey = c_custkey""")
def point_latest(spark, d):
    # Every other source points to a version that was never stored, so that none of these is right by chance.
    paths = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("source_id"), F.concat(F.lit("s/"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("path"))
    newest = paths.groupBy("source_id").agg(F.max("path").alias("m"))
    sources = table(spark, d, "customer").select(F.col("c_custkey").alias("source_id")).join(newest, "source_id", "left").select("source_id", F.when(F.col("source_id") % 2 == 0, F.col("m")).otherwise("s/none").alias("snapshot_path"))
    return C.point_latest(sources, paths).select("source_id", "latest_path", "state")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def unread_sources(spark, d):
    sources = table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"))
    reads = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("source_id"))
    return C.unread_sources(sources, reads).select(F.col("source_id").alias("c_custkey"))



