"""Queries of counts and sums: events stand for rounds and reads, orders for changes and requirements, customers for sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewatch.operators import stats as S
from pagewatch.plans.common import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _sources(spark, d):
    key = F.col("c_custkey")
    return table(spark, d, "customer").select(
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("country"), F.when(key % 3 == 0, "study").when(key % 3 == 1, "work").otherwise("living").alias("lane"), F.col("c_mktsegment").alias("kind"),
        F.when(key % 5 == 0, "robots_disallowed").when(key % 5 == 1, "gone").alias("blocked"), F.when(key % 7 == 0, "unreachable").alias("unverified_reason"), F.timestamp_seconds(F.lit(1_600_000_000) + key).alias("last_read_at"),
    )


_SOURCES = "s AS (SELECT 'N' || c_nationkey AS country, CASE c_custkey % 3 WHEN 0 THEN 'study' WHEN 1 THEN 'work' ELSE 'living' END AS lane, c_mktsegment AS kind, CASE c_custkey % 5 WHEN 0 THEN 'robots_disallowed' WHEN 1 THEN 'gone' END AS blocked, CASE WHEN c_custkey % 7 = 0 THEN 'unreachable' END AS unverified_reason, make_timestamp((1600000000 + c_custkey) * 1000000) AS last_read_at FROM customer)"
_ORDERS = "o AS (SELECT 'N' || (o_custkey % 25) AS country, CASE o_orderkey % 3 WHEN 0 THEN 'study' WHEN 1 THEN 'work' ELSE 'living' END AS lane, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS retired_at, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END AS material FROM orders)"


def _orders(spark, d):
    key = F.col("o_orderkey")
    return table(spark, d, "orders").select(F.concat(F.lit("N"), (F.col("o_custkey") % 25).cast("string")).alias("country"), F.when(key % 3 == 0, "study").when(key % 3 == 1, "work").otherwise("living").alias("lane"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("retired_at"), F.when(key % 4 != 0, key % 2 == 0).alias("material"))


@query(f"""WITH {_SOURCES}, {_ORDERS}, n AS (SELECT 'N' || n_nationkey AS country, n_nationkey % 3 = 0 AS daily FROM nation UNION ALL SELECT 'N90', true), x AS (SELECT * FROM s WHERE country <> 'N3'),
    t AS (SELECT country, daily::INT AS daily, (SELECT count(*) FROM x WHERE x.country = n.country) AS pages, (SELECT count(*) FROM x WHERE x.country = n.country AND lane = 'study') AS study_pages, (SELECT count(*) FROM x WHERE x.country = n.country AND lane = 'work') AS work_pages,
        (SELECT count(*) FROM x WHERE x.country = n.country AND lane = 'living') AS living_pages, (SELECT count(*) FROM x WHERE x.country = n.country AND blocked = 'robots_disallowed') AS robots_blocked, (SELECT count(*) FROM o WHERE o.country = n.country AND retired_at IS NULL AND lane IN ('study', 'work')) AS requirements,
        (SELECT count(*) FROM o WHERE o.country = n.country) AS changes, (SELECT count(*) FROM o WHERE o.country = n.country AND material) AS material, (SELECT count(*) FROM o WHERE o.country = n.country AND lane <> 'living') AS articles, (SELECT max(last_read_at) FROM x WHERE x.country = n.country) AS last_read_at FROM n)
    SELECT coalesce(country, 'all') AS country, {", ".join(f"sum({k})::BIGINT AS {k}" for k in ("daily", "pages", "study_pages", "work_pages", "living_pages", "robots_blocked", "requirements", "changes", "material", "articles"))}, max(last_read_at) AS last_read_at FROM t GROUP BY ROLLUP (country)""")
def source_stats(spark, d):
    own = _orders(spark, d)
    nations = table(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("country"), (F.col("n_nationkey") % 3 == 0).alias("daily"))
    countries = nations.union(nations.agg(F.lit("N90").alias("country"), F.lit(True).alias("daily")))
    # One country has no sources, and one has nothing at all.
    sources = _sources(spark, d).where("country <> 'N3'")
    articles = own.select("country", (F.col("lane") == "living").alias("hidden"))
    return S.source_stats(sources, own, own, articles, countries).withColumn("country", F.coalesce("country", F.lit("all")))


@query(f"WITH {_SOURCES} SELECT count(*) AS total, count(*) FILTER (blocked IS NULL AND unverified_reason IS NULL) AS readable, count(blocked) AS blocked, count(unverified_reason) AS unverified, count(DISTINCT kind) AS kinds, count(DISTINCT country) AS countries FROM s")
def registry_counts(spark, d):
    return S.registry_counts(_sources(spark, d))


@query(f"WITH {_ORDERS} SELECT (SELECT count(*) FILTER (retired_at IS NULL) FROM o) AS live, (SELECT count(retired_at) FROM o) AS retired, (SELECT count(*) FROM events WHERE event_type = 'error') AS questions, count(*) AS reads, sum(user_id)::BIGINT AS kept, sum(event_id % 3)::BIGINT AS dropped FROM events")
def corpus_totals(spark, d):
    events = table(spark, d, "events")
    reads = events.select(F.col("user_id").alias("kept"), (F.col("event_id") % 3).alias("dropped"))
    return S.corpus_totals(_orders(spark, d), events.where("event_type = 'error'"), reads)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def counts_by(spark, d):
    return S.counts_by(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("""SELECT 'N' || (l_suppkey % 25) AS country, CASE WHEN l_linenumber % 2 = 0 THEN 'study' ELSE 'work' END AS lane, l_linestatus AS mode, count(*) AS considered, count(*) FILTER (l_returnflag = 'A') AS unchanged, count(*) FILTER (l_returnflag = 'N') AS changed, count(*) FILTER (l_returnflag = 'R') AS unreadable, 0::BIGINT AS already_read,
    sum(l_linenumber)::BIGINT AS kept, sum(l_partkey % 4)::BIGINT AS dropped, round(sum(l_tax::DECIMAL(12, 2)), 2)::DOUBLE AS usd FROM lineitem GROUP BY ALL""")
def round_summary(spark, d):
    outcome = F.when(F.col("l_returnflag") == "A", "unchanged").when(F.col("l_returnflag") == "N", "changed").otherwise("unreadable")
    own = table(spark, d, "lineitem").select(F.concat(F.lit("N"), (F.col("l_suppkey") % 25).cast("string")).alias("country"), F.when(F.col("l_linenumber") % 2 == 0, "study").otherwise("work").alias("lane"), F.col("l_linestatus").alias("mode"), outcome.alias("outcome"), F.col("l_linenumber").alias("kept"), (F.col("l_partkey") % 4).alias("dropped"), F.col("l_tax").cast("decimal(12,2)").alias("usd"))
    return S.round_summary(own).withColumn("usd", F.col("usd").cast("double"))


@query("SELECT CASE WHEN event_type = 'error' THEN 'unfinished' WHEN user_id % 4 > 0 THEN (user_id % 4) || ' failed' ELSE 'clean' END AS health, count(*) AS n, round(sum(value::DECIMAL(14, 2)), 2)::DOUBLE AS total FROM events GROUP BY 1")
def round_health(spark, d):
    own = table(spark, d, "events").select(F.when(F.col("event_type") != "error", F.col("ts")).alias("finished_at"), (F.col("user_id") % 4).alias("failed"), F.col("value").cast("decimal(14,2)").alias("value"))
    return S.round_health(own).groupBy("health").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("total"))


@query("WITH r AS (SELECT event_type AS lane, CASE WHEN event_type = 'error' THEN 0 ELSE user_id % 5 END AS kept, CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 3 END AS dropped FROM events) SELECT lane, sum(kept)::BIGINT AS kept, sum(dropped)::BIGINT AS dropped, coalesce(round(sum(dropped) / nullif(sum(dropped) + sum(kept), 0), 9)::VARCHAR, 'nothing') AS rate FROM r GROUP BY 1")
def drop_rate(spark, d):
    own = table(spark, d, "events").select(F.col("event_type").alias("lane"), F.when(F.col("event_type") == "error", 0).otherwise(F.col("user_id") % 5).alias("kept"), F.when(F.col("event_type") == "error", 0).otherwise(F.col("event_id") % 3).alias("dropped"))
    return S.drop_rate(own).withColumn("rate", F.coalesce(F.round("rate", 9).cast("string"), F.lit("nothing")))


def _rounds(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("round_id"), F.col("ts").alias("started_at"), F.col("user_id").alias("fetched"), (F.col("user_id") % 7).alias("unchanged"), (F.col("user_id") % 3).alias("changed"), F.when(F.col("event_type") == "purchase", F.col("value").cast("decimal(14,2)")).alias("usd"))


def _changes(spark, d):
    return table(spark, d, "events").where("event_type = 'view'").select(F.col("event_id").alias("change_id"), F.col("ts").alias("after_read_at"), F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 3 == 1).alias("material"))


@query("""WITH w AS (SELECT TIMESTAMP '2024-01-20 12:00:00' AS now), t AS (SELECT * FROM events, w WHERE ts::DATE = now::DATE)
    SELECT (SELECT sum(user_id)::BIGINT FROM t) AS pages_today, (SELECT sum(user_id % 7)::BIGINT FROM t) AS unchanged_today, (SELECT sum(user_id % 3)::BIGINT FROM t) AS moved_today, (SELECT round(sum(value::DECIMAL(14, 2)), 6)::DOUBLE FROM t WHERE event_type = 'purchase') AS spent_today,
    (SELECT count(*) FROM events, w WHERE event_type = 'view' AND ts >= now - INTERVAL 7 DAY) AS changes_week, (SELECT count(*) FROM events, w WHERE event_type = 'view' AND ts >= now - INTERVAL 7 DAY AND event_id % 3 = 1) AS rule_changes_week,
    (SELECT floor(1000000 / avg(u))::BIGINT FROM (SELECT sum(value::DECIMAL(14, 2))::DOUBLE AS u FROM events, w WHERE event_type = 'purchase' AND value > 0 AND ts >= now - INTERVAL 7 DAY GROUP BY ts::DATE)) AS runway_days""")
def live_state(spark, d):
    now = F.lit("2024-01-20 12:00:00").cast("timestamp")
    return S.live_state(_rounds(spark, d), _changes(spark, d), now, F.lit(1_000_000)).withColumn("spent_today", F.col("spent_today").cast("double"))


@query("SELECT * FROM (SELECT 'round' AS kind, event_id::VARCHAR AS key, ts AS happened FROM events UNION ALL SELECT 'change', event_id::VARCHAR, ts FROM events WHERE event_type = 'view' AND event_id % 3 = 1) ORDER BY happened DESC, kind, key LIMIT 40")
def live_feed(spark, d):
    return S.live_feed(_rounds(spark, d), _changes(spark, d)).withColumnRenamed("at", "happened")


_TERMS = ", ".join(f"('{k}', '{t}')" for k, terms in S.DOCUMENT_TERMS.items() for t in terms)


@query(f"""WITH t(kind, term) AS (VALUES {_TERMS}), r AS (SELECT doc_id, lower(coalesce(text, '') || CASE doc_id % 5 WHEN 0 THEN ' A Passport or travel document' WHEN 1 THEN ' police certificate and degree' WHEN 2 THEN ' job offer from an employer' ELSE '' END || ' ' || coalesce(source, '')) AS h FROM documents)
    SELECT kind, count(DISTINCT doc_id) AS n FROM (SELECT DISTINCT kind FROM t) LEFT JOIN (SELECT kind, doc_id FROM r JOIN t ON contains(h, term)) USING (kind) GROUP BY 1""")
def document_worth(spark, d):
    more = F.element_at(F.array(*map(F.lit, (" A Passport or travel document", " police certificate and degree", " job offer from an employer", "", ""))), (F.col("doc_id") % 5 + 1).cast("int"))
    return S.document_worth(table(spark, d, "documents").select(F.concat(F.coalesce("text", F.lit("")), more).alias("text"), F.col("source").alias("quote")))


@query(r"""SELECT lang, count(*) AS requirements, count(*) FILTER (regexp_matches(text, '\d')) AS concrete, count(*) FILTER (doc_id % 3 = 0) AS costed, count(*) FILTER (doc_id % 4 = 0) AS timed, round_even(count(*) FILTER (regexp_matches(text, '\d')) * 100 / count(*), 0)::INT AS share FROM documents GROUP BY 1""")
def requirement_profile(spark, d):
    own = table(spark, d, "documents").select("lang", "text", F.when(F.col("doc_id") % 3 == 0, "9").alias("cost"), F.when(F.col("doc_id") % 4 == 0, "9").otherwise("").alias("duration"))
    return S.requirement_profile(own, "lang")


@query("""WITH r AS (SELECT lower(replace(n_name, '_', ' ')) AS area, sum(CASE WHEN o_orderpriority LIKE '1%' THEN 0 ELSE o_custkey + 1 END) AS p, sum(CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 0 ELSE o_custkey + 1 END) AS f FROM orders JOIN nation ON n_nationkey = o_custkey % 25 GROUP BY 1),
    u AS (SELECT * FROM r UNION ALL SELECT 'the city', sum(p), sum(f) FROM r WHERE area IN ('nation 1', 'nation 2', 'nation 3')) SELECT area, round(f * 100 / p, 2) AS share FROM u WHERE p > 0""")
def census_share(spark, d):
    category = F.when(F.col("o_orderpriority").startswith("1"), "Does not apply").when(F.col("o_orderpriority").startswith("2"), "Europe: United Kingdom: Wales").otherwise("Asia")
    rows = table(spark, d, "orders").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("o_custkey") % 25).select(F.col("n_name").alias("area"), category.alias("category"), (F.col("o_custkey") + 1).alias("people"))
    return S.census_share(rows, "the city", ("nation 1", "nation 2", "nation 3"))


@query("WITH m AS (SELECT l_suppkey AS name, year(l_shipdate) AS year, month(l_shipdate) AS month, count(*) AS n FROM lineitem GROUP BY ALL) SELECT name, year, max(n) AS n FROM m WHERE year = (SELECT max(year) FROM m) GROUP BY ALL")
def yearly_peak(spark, d):
    months = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("name"), F.year("l_shipdate").cast("long").alias("year"), F.month("l_shipdate").alias("month")).agg(F.count("*").alias("n"))
    return S.yearly_peak(months)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def recent_changes(spark, d):
    return S.newest(table(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_orderdate"), "o_orderdate", 20, "o_orderkey")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 30")
def recent_articles(spark, d):
    return S.newest(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", 30, "doc_id")


@query("SELECT event_id, ts FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id LIMIT 25")
def recent_rounds(spark, d):
    return S.newest(table(spark, d, "events").where("event_type = 'click'").select("event_id", "ts"), "ts", 25, "event_id")


@query("SELECT event_type AS why, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type)::INT AS place FROM events WHERE event_type <> 'view' GROUP BY 1")
def reason_counts(spark, d):
    return S.reason_counts(table(spark, d, "events").select(F.when(F.col("event_type") != "view", F.col("event_type")).alias("why")))


@query("SELECT n_name AS country, lane, row_number() OVER (ORDER BY lane = 'living', n_name, lane)::INT AS place FROM nation, (SELECT unnest(['study', 'work', 'living']) AS lane)")
def lanes(spark, d):
    return S.lanes(table(spark, d, "nation").select(F.col("n_name").alias("country")))
