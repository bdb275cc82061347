"""Queries of stories, house style, guides, search and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewatch.functions import text as T
from pagewatch.operators import changes as C
from pagewatch.operators import stories as S
from pagewatch.plans.common import joined, stable_digest_sql, table
from pagewatch.sources import bucketed
from pagewatch.sources.shared import new_folder
from pagewatch.streaming import watch as ST

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Summaries of changes; the first two tell one story, the third is about hours, the fourth stands alone.
SUMMARIES = ("Ebola screening extended for travellers at borders", "Ebola screening for travellers extended again", "New opening hours of the visa-free desk, closed on Mondays", "Salary threshold rises for nurses")


def _changes(spark, d):
    key = F.col("event_id")
    summary = F.element_at(F.array(*map(F.lit, SUMMARIES)), (key % 4 + 1).cast("int"))
    return table(spark, d, "events").select(key.alias("change_id"), (F.col("user_id") % 5).alias("country"), F.concat(F.lit("u"), key.cast("string")).alias("source_url"), summary.alias("summary"), F.col("ts").alias("after_read_at"), (key % 40 < 20).alias("material"))


@query("""SELECT p_partkey, p_partkey % 4 < 2 AS same FROM part""")
def same_story(spark, d):
    other = F.element_at(F.array(*map(F.lit, SUMMARIES)), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", S.T.same_story(T.story_stems(F.lit(SUMMARIES[0])), T.story_stems(other)).alias("same"))


_GROUPS = "c AS (SELECT event_id, user_id % 5 AS country, ts, ts::DATE AS day, CASE WHEN event_id % 4 < 2 THEN 0 ELSE event_id % 4 END AS kind FROM events)"


@query(f"WITH {_GROUPS} SELECT event_id AS change_id, first_value(event_id) OVER (PARTITION BY country, day, kind ORDER BY ts, event_id) AS story FROM c")
def cluster_changes(spark, d):
    return S.cluster_changes(_changes(spark, d)).select("change_id", "story")


@query(f"""WITH {_GROUPS}, m AS (SELECT * FROM c WHERE event_id % 40 < 20 AND ts >= DATE '2024-01-20'), g AS (SELECT country, day, kind, list_sort(list(event_id::VARCHAR)) AS ids, arg_min(event_id, (ts, event_id)) AS story FROM m GROUP BY ALL)
    SELECT story, array_to_string(ids, '|') AS changes FROM g WHERE story % 3 <> 0 AND NOT (kind = 3 AND country = 1)""")
def pending_stories(spark, d):
    own = _changes(spark, d)
    now = F.lit("2024-01-27").cast("date")
    recent = own.where((F.col("material")) & (F.col("after_read_at") >= F.date_sub(now, 7)))
    groups = S.cluster_changes(recent).groupBy("story").agg(F.sort_array(F.collect_list(F.col("change_id").cast("string"))).alias("ids"))
    done = groups.where("story % 3 = 0").select(T.article_id("ids").alias("article_id"))
    articles = own.where("country = 1").select("country", F.to_date("after_read_at").alias("day"), F.lit("Nurses: salary threshold rises").alias("summary")).distinct()
    return S.pending_stories(own, done, articles, now, 7).select("story", joined("changes").alias("changes"))


@query(f"WITH {_GROUPS} SELECT country, bool_and(kind = 2) AS admin FROM c GROUP BY 1 UNION ALL SELECT 100 + country, true FROM c WHERE kind = 2 GROUP BY 1")
def admin_only(spark, d):
    own = _changes(spark, d).withColumn("summary", F.replace("summary", F.lit("visa-free desk"), F.lit("desk")))
    hours = own.where("change_id % 4 = 2").withColumn("country", F.col("country") + 100)
    return S.admin_only(own.union(hours), "country")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'no line of who it is for survived the quote check' WHEN p_size % 2 = 0 AND p_partkey % 2 = 0 THEN 'nothing about what changed survived the quote check' END AS why FROM part")
def publishable(spark, d):
    some = lambda c: F.when(c, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "part").select("p_partkey", S.publishable(some(F.col("p_size") % 3 != 0), some(F.col("p_size") % 2 != 0), some(F.col("p_partkey") % 2 != 0)).alias("why"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'quote' WHEN 1 THEN 'why' ELSE 'dek' END AS field, CASE WHEN p_partkey % 3 = 0 THEN 'a robust — ' || p_name ELSE 'a robust, ' || p_name END AS text, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'robust' END AS hits, p_partkey % 3 <> 1 AS kept FROM part""")
def voice_gate(spark, d):
    field = F.element_at(F.array(*map(F.lit, ("quote", "why", "dek"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    own = table(spark, d, "part").select("p_partkey", field.alias("field"), F.concat(F.lit("a robust — "), "p_name").alias("text"))
    return S.voice_gate(own).withColumn("hits", joined("hits"))


@query("""WITH a AS (SELECT o_orderkey AS id, o_orderdate::DATE AS day, o_custkey % 7 * 2 + o_orderkey % 5 + o_custkey % 2 AS weight FROM orders),
    l AS (SELECT arg_max(id, (weight, day, id)) AS lead FROM a WHERE day >= (SELECT max(day) FROM a) - 30)
    SELECT id AS article_id, weight, row_number() OVER (ORDER BY id <> lead, day DESC, id)::INT AS place FROM a, l""")
def lead_first(spark, d):
    own = table(spark, d, "orders").select(F.col("o_orderkey").alias("article_id"), F.to_date("o_orderdate").alias("observed_on"), (F.col("o_custkey") % 7).alias("groups"), (F.col("o_orderkey") % 5).alias("conditions"), (F.col("o_custkey") % 2).alias("dates"))
    return S.lead_first(own, 30).select("article_id", "weight", "place")


_REQ = "r AS (SELECT lpad(o_orderkey::VARCHAR, 9, '0') AS id, 'p' || o_custkey AS url, o_orderpriority AS text, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'), f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS n FROM r QUALIFY n <= 12), c AS (SELECT url, count(*) AS n, left(sha256(string_agg(id || ':' || text, '|' ORDER BY id)), 20) AS fingerprint, left(sha256(url), 16) AS guide_id FROM f GROUP BY 1 HAVING count(*) >= 8)"


def _candidates(spark, d):
    own = table(spark, d, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("requirement_id"), F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("source_url"), F.col("o_orderpriority").alias("text"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("retired_at"), F.lit("CA").alias("country"), F.lit("work").alias("lane"))
    return S.guide_candidates(own, least=8, most=12)


@query(f"WITH {_REQ} SELECT guide_id, url AS source_url, n, fingerprint FROM c")
def guide_candidates(spark, d):
    return _candidates(spark, d).select("guide_id", "source_url", "n", "fingerprint")


@query(f"WITH {_REQ} SELECT guide_id FROM c WHERE n <> 9")
def stale_guides(spark, d):
    own = _candidates(spark, d)
    stored = own.select("guide_id", F.when(F.col("n") == 9, F.col("fingerprint")).otherwise("old").alias("fingerprint"), "n").where("n < 12").drop("n")
    return S.stale_guides(own, stored).select("guide_id")


@query("""WITH q AS (SELECT o_orderpriority AS category, lower(o_orderstatus || ' text ' || (o_custkey % 20)) AS k, 'p' || (o_orderkey % 13) AS url, max((o_orderdate, lpad(o_orderkey::VARCHAR, 9, '0'))) AS r FROM orders GROUP BY ALL),
    m AS (SELECT category, k, arg_max(url, (r, url)) AS url, arg_max(r[2], (r, url)) AS id, count(*) AS n FROM q GROUP BY ALL)
    SELECT m.category, m.id AS requirement_id, m.url AS source_url, m.n AS n_pages, q.url AS also FROM m LEFT JOIN q ON q.category = m.category AND q.k = m.k AND q.url <> m.url""")
def merge_requirements(spark, d):
    text = F.concat("o_orderstatus", F.lit("  Text "), (F.col("o_custkey") % 20).cast("string"))
    own = table(spark, d, "orders").select(F.col("o_orderpriority").alias("category"), text.alias("text"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("requirement_id"), F.concat(F.lit("p"), (F.col("o_orderkey") % 13).cast("string")).alias("source_url"), F.col("o_orderdate").alias("read_at"))
    merged = S.merge_requirements(own)
    return merged.join(S.also_said(own, merged), "requirement_id", "left").select("category", "requirement_id", "source_url", "n_pages", "also")


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END AS rank FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 3 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def lane_requirements(spark, d):
    own = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("lane"), F.col("o_custkey").alias("source_url"), F.col("o_orderpriority").alias("category"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")).alias("retired_at"))
    near = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("source_url"))
    return S.lane_requirements(own, "O", ("1-URGENT", "2-HIGH"), near).select("o_orderkey", F.col("rank").cast("int").alias("rank"))


@query("""WITH s AS (SELECT p_partkey AS doc_id, 'small' IN (split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)) AS t1, lower(p_type) LIKE 'econ%' AS s2, p_partkey % 2 = 0 AS guide, p_size AS date FROM part),
    h AS (SELECT doc_id, guide::INT + CASE WHEN t1 THEN 5 ELSE 0 END + CASE WHEN s2 THEN 2 ELSE 0 END + CASE WHEN s2 THEN 0 ELSE 0 END AS score, date FROM s WHERE t1 AND s2) SELECT doc_id, score, date FROM h ORDER BY score DESC, date DESC, doc_id LIMIT 40""")
def search(spark, d):
    return S.search_stored(spark, _stored_index(spark, d), "The small écon")


_indexes: dict[tuple[str, str], str] = {}


def _stored_index(spark, d) -> str:
    """The folder of the index of these tables, written once an application."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _indexes:
        docs = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_partkey") % 2 == 0, "guide").otherwise("article").alias("kind"), F.col("p_name").alias("title"), F.col("p_type").alias("summary"), F.col("p_brand").alias("body"), F.col("p_size").alias("date"))
        path = f"{new_folder(spark)}/index"
        S.write_index(docs, path)
        _indexes[key] = path
    return _indexes[key]


@query("""WITH w AS (SELECT p_partkey, p_size, unnest(list_concat(list_transform(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')), lambda x: x || ' 5'),
    list_concat(list_transform(list_distinct(regexp_extract_all(lower(p_type), '[a-z0-9]+')), lambda x: x || ' 2'), list_transform(list_distinct(regexp_extract_all(lower(p_brand), '[a-z0-9]+')), lambda x: x || ' 1')))) AS t FROM part)
    SELECT split_part(t, ' ', 1) AS word, split_part(t, ' ', 2)::INTEGER AS points, count(*) AS docs, count(DISTINCT p_size) AS dates FROM w GROUP BY 1, 2""")
def write_index(spark, d):
    postings = spark.read.parquet(f"{_stored_index(spark, d)}/postings")
    return postings.groupBy("word", "points").agg(F.count("*").alias("docs"), F.count_distinct("date").alias("dates"))


# Streams: each reads a table as a stream of files and drains it.

#: Pages of a day that make one file of the stream: files are what a trigger's tasks share out.
PAGES_A_FILE = 2_000


def _file_stream(spark, df, name: str):
    """A table as files in the shared folder, to be read as a stream."""
    path = f"{new_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


@query(f"""SELECT page_id::VARCHAR AS source_id, left(sha256(page_id || chr(10) || {stable_digest_sql('html')} || chr(10) || {stable_digest_sql("(html || '<p>A new line.</p>')")}), 24) AS change_id, 1 AS added, 1 AS removed FROM pages WHERE page_id % 2 = 0""")
def stream_watch(spark, d):
    pages = table(spark, d, "pages").withColumn("source_id", F.col("page_id").cast("string"))
    at = lambda k: F.timestamp_seconds(F.lit(1_700_000_000 + 86_400 * k)).alias("read_at")
    later = F.when(F.col("page_id") % 2 == 0, F.concat("html", F.lit("<p>A new line.</p>"))).otherwise(F.col("html")).alias("html")
    first, second, third = pages.select("source_id", at(0), "html"), pages.select("source_id", at(1), later), pages.select("source_id", at(5), later)
    # The second day's files come first; the last reading, which changes nothing, brings the watermark past both. A day is one trigger, of as many files as its pages need.
    path, files = f"{new_folder(spark)}/snapshots", 1 + pages.count() // PAGES_A_FILE
    for k, day in enumerate((second, first, third)):
        day.repartition(files).write.mode("append").option("maxRecordsPerFile", 0).parquet(f"{path}/part={k}")
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(path)
    return ST.drain(ST.stream_watch(stream, "2 days"), f"stream_watch_{abs(hash(d))}", new_folder(spark)).select("source_id", "change_id", "added", "removed")


@query("SELECT left(sha256(o_custkey || chr(10) || o_orderstatus || chr(10) || o_orderpriority), 24) AS change_id FROM orders GROUP BY o_custkey, o_orderstatus, o_orderpriority")
def stream_dedupe(spark, d):
    own = table(spark, d, "orders").select(C.T.change_id("o_custkey", "o_orderstatus", "o_orderpriority").alias("change_id"), F.lit("2024-01-01").cast("timestamp").alias("after_read_at"))
    stream = _file_stream(spark, own, "changes")
    return ST.drain(ST.stream_dedupe(stream), f"stream_dedupe_{abs(hash(d))}", new_folder(spark)).select("change_id")


@query("SELECT ts::DATE::VARCHAR AS day, count(*) AS rounds, sum(event_id % 3)::BIGINT AS changed FROM events GROUP BY ts::DATE HAVING ts::DATE + 1 <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def daily_counts(spark, d):
    own = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("started_at"), (F.col("event_id") % 3).alias("changed"), F.col("value").alias("usd"))
    stream = _file_stream(spark, own, "rounds")
    return ST.drain(ST.daily_counts(stream), f"daily_counts_{abs(hash(d))}", new_folder(spark)).select(F.col("day").cast("string").alias("day"), "rounds", "changed")


@query("""WITH b AS (SELECT o_orderkey % 500 AS id, o_orderdate AS d, o_orderstatus AS s, o_orderkey FROM orders) SELECT id, arg_max(s, (d, s)) AS title, max(d) AS last_seen_at, max(d) AS first_seen_at FROM b GROUP BY 1""")
def stream_upsert(spark, d):
    own = table(spark, d, "orders").select((F.col("o_orderkey") % 500).alias("id"), F.col("o_orderdate").alias("read_at"), F.col("o_orderstatus").alias("title"))
    stream = _file_stream(spark, own, "postings")
    path, progress = f"{new_folder(spark)}/postings", new_folder(spark)
    schema = "id long, title string, first_seen_at timestamp, last_seen_at timestamp"
    step = ST.stream_upsert(path, "id", "read_at", schema)
    for _ in range(2):  # the second time finds nothing new
        stream.writeStream.foreachBatch(step).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return bucketed.read_table(spark, path, schema)
