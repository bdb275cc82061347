"""Queries of matching, alerts, votes and ranking: parts stand for occupations and courses, orders for postings, customers for cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewatch.functions import text as T
from pagewatch.functions import words as W
from pagewatch.operators import match as M
from pagewatch.operators import people as P
from pagewatch.plans.common import quoted, table
from pagewatch.plans.text import ROLE_SQL

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


COUNTRIES = ("CA", "UK", "DE", "AE", "ZZ")
_COUNTRY = f"([{quoted(COUNTRIES)}])[1 + {{0}} % 5]"


def country(key):
    return F.element_at(F.array(*map(F.lit, COUNTRIES)), (F.col(key) % 5 + 1).cast("int"))


def _roles(spark, d):
    """Two roles a case: words of parts' names and types."""
    cases = table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.posexplode(F.array(F.col("c_custkey"), F.col("c_custkey") + 7)).alias("pos", "p_partkey"))
    return cases.join(table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(" workers")).alias("role")), "p_partkey").select("case_id", "pos", "role")


def _occupations(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("occupation_id"), country("p_partkey").alias("country"), F.concat("p_name", F.lit("s and related "), F.lower("p_type"), F.lit(" operators")).alias("title"))


_BASE = f"""r AS (SELECT c_custkey AS case_id, pos, p_name || ' workers' AS role FROM (SELECT c_custkey, 0 AS pos, c_custkey AS p FROM customer UNION ALL SELECT c_custkey, 1, c_custkey + 7 FROM customer) JOIN part ON p_partkey = p),
    o AS (SELECT p_partkey AS occupation_id, {_COUNTRY.format('p_partkey')} AS country, p_name || 's and related ' || lower(p_type) || ' operators' AS title FROM part)"""


def _ws(name: str, src: str) -> str:
    return f"{name} AS (WITH src AS ({src}) {ROLE_SQL})"


_MATCH = f"""{_BASE}, {_ws('rw', "SELECT DISTINCT role AS k, role AS t FROM r")}, {_ws('ow', "SELECT DISTINCT title AS k, title AS t FROM o")},
    s AS (SELECT * FROM (SELECT rw.k AS role, ow.k AS title, len(list_intersect(rw.ws, ow.ws)) AS n FROM rw, ow) WHERE n > 0),
    b AS (SELECT case_id, occupation_id, max(n) AS strength, arg_min(role, (-n, pos)) AS because FROM r JOIN s USING (role) JOIN o USING (title) GROUP BY ALL)"""


@query(f"WITH {_MATCH} SELECT case_id, occupation_id, title, strength FROM b JOIN o USING (occupation_id)")
def match_occupations(spark, d):
    return M.match_occupations(_roles(spark, d), _occupations(spark, d))


@query(f"WITH {_MATCH} SELECT case_id, occupation_id AS listing_id, because, strength, row_number() OVER (PARTITION BY case_id ORDER BY strength DESC, title, occupation_id) AS place FROM b JOIN o USING (occupation_id) QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY strength DESC, title, occupation_id) <= 20")
def match_listings(spark, d):
    listings = _occupations(spark, d).select(F.col("occupation_id").alias("listing_id"), "title", F.lit(None).cast("string").alias("matched_occupation"))
    return M.match_listings(_roles(spark, d), listings).select("case_id", "listing_id", "because", "strength", "place")


@query(f"""WITH m AS (SELECT c_custkey AS case_id, n AS place, p FROM customer, (SELECT unnest(range(3)) AS n), LATERAL (SELECT ['F', 'O', 'P'][1 + (c_custkey + n) % 3] AS p)),
    l AS (SELECT o_orderkey AS listing_id, o_orderstatus AS p FROM orders), f AS (SELECT case_id, place, listing_id, m.p FROM m JOIN l USING (p) QUALIFY row_number() OVER (PARTITION BY case_id, m.p ORDER BY listing_id) <= 25)
    SELECT case_id, listing_id, p AS occupation FROM f QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY place, listing_id) <= 60""")
def listings_for(spark, d):
    cases = table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("place"))
    occupation = F.element_at(F.array(*map(F.lit, "FOP")), ((F.col("case_id") + F.col("place")) % 3 + 1).cast("int"))
    matched = cases.select("case_id", "place", F.lit("CA").alias("country"), occupation.alias("occupation"))
    listings = table(spark, d, "orders").select(F.col("o_orderkey").alias("listing_id"), F.lit("CA").alias("country"), F.col("o_orderstatus").alias("occupation"))
    return M.listings_for(matched, listings)


@query(f"""WITH {_MATCH}, t AS (SELECT case_id, country, lower(title) AS lt, max(strength) AS s, min(title) AS title FROM b JOIN o USING (occupation_id) GROUP BY ALL)
    SELECT case_id, country, count(*) AS n_reasons, arg_min(title, (-s, title)) AS top, CASE WHEN country = 'ZZ' THEN 0 ELSE length(country) + 5 END AS requirements, CASE WHEN country = 'ZZ' THEN 0 ELSE 3 END AS postings FROM t GROUP BY ALL""")
def eligible_work(spark, d):
    counts = _occupations(spark, d).select("country").distinct().where("country <> 'ZZ'").select("country", (F.length("country") + 5).cast("long").alias("requirements"), F.lit(3).cast("long").alias("postings"))
    return M.eligible_work(_roles(spark, d), _occupations(spark, d), counts)


_LEVELS = ("bachelors", "masters", "doctorate")


@query(f"""WITH {_BASE}, c AS (SELECT p_partkey AS course_id, {_COUNTRY.format('p_partkey')} AS country, ([{quoted(_LEVELS)}])[1 + p_partkey % 3] AS level, p_brand AS institution, p_name AS title FROM part),
    k AS (SELECT c_custkey AS case_id, CASE c_custkey % 3 WHEN 0 THEN 'masters' WHEN 1 THEN 'doctorate' ELSE 'bachelors' END AS level FROM customer),
    {_ws('rw', "SELECT DISTINCT role AS k, role AS t FROM r WHERE role <> ''")}, {_ws('cw', "SELECT DISTINCT title AS k, title AS t FROM c")}, p AS (SELECT rw.k AS role, cw.k AS title FROM rw, cw WHERE list_has_any(rw.ws, cw.ws)),
    t AS (SELECT DISTINCT k.case_id, c.country, lower(institution || '|' || c.title) AS key FROM k JOIN (SELECT DISTINCT case_id, title FROM r JOIN p USING (role)) USING (case_id) JOIN c USING (level, title)
    UNION SELECT DISTINCT k.case_id, c.country, lower(institution || '|' || c.title) FROM k JOIN c USING (level) WHERE k.case_id NOT IN (SELECT case_id FROM r WHERE role <> ''))
    SELECT case_id, country, count(*) AS n_reasons FROM t GROUP BY ALL""")
def eligible_study(spark, d):
    courses = table(spark, d, "part").select(F.col("p_partkey").alias("course_id"), country("p_partkey").alias("country"), F.element_at(F.array(*map(F.lit, _LEVELS)), (F.col("p_partkey") % 3 + 1).cast("int")).alias("level"), F.col("p_brand").alias("institution"), F.col("p_name").alias("title"))
    held = F.element_at(F.array(*map(F.lit, ("Bachelors", "masters", "unheard of"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    cases = table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), M.next_level(held).alias("level"))
    return M.eligible_study(cases, _roles(spark, d), courses)


def _schools(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("institution_id"), country("c_custkey").alias("country"), F.concat(F.lit("The Collège "), (F.col("c_custkey") % 300).cast("string")).alias("name"))


def _bulk_sql(left: str, right: str, noise, letters: int, rule: str) -> str:
    """Each name of left with each of right, the words of both as lists."""
    words = f"list_distinct(list_filter(regexp_extract_all(lower(name), '[a-z0-9]+'), lambda w: w NOT IN ({quoted(noise)}) AND len(w) >= {letters}))"
    side = "SELECT name, {0} AS ws FROM (SELECT DISTINCT name FROM ({1}))"
    return f"WITH l AS ({side.format(words, left)}), r AS ({side.format(words, right)}), p AS (SELECT l.name AS a, r.name AS b, len(l.ws) AS m, len(r.ws) AS n, len(list_intersect(l.ws, r.ws)) AS k FROM l, r) SELECT a, b FROM p WHERE k > 0 AND k = least(m, n) AND {rule}"


@query(_bulk_sql("SELECT 'The ' || c_mktsegment || ' University of Nation ' || c_nationkey || CASE WHEN c_custkey % 3 = 0 THEN ', Campus ' || (c_custkey % 40) ELSE '' END AS name FROM customer",
    "SELECT CASE s_suppkey % 3 WHEN 0 THEN 'University of nation ' || s_nationkey WHEN 1 THEN 'Machinery University (Nation ' || s_nationkey || ') Campus ' || (s_suppkey % 40) || ' in the North' ELSE 'Household, Nation ' || s_nationkey END AS name FROM supplier",
    W.SCHOOL_NOISE, 1, "true"))
def names_match_bulk(spark, d):
    campus = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(", Campus "), (F.col("c_custkey") % 40).cast("string"))).otherwise("")
    left = table(spark, d, "customer").select(F.concat(F.lit("The "), "c_mktsegment", F.lit(" University of Nation "), F.col("c_nationkey").cast("string"), campus).alias("a"))
    nation, kind = F.col("s_nationkey").cast("string"), F.col("s_suppkey") % 3
    name = F.when(kind == 0, F.concat(F.lit("University of nation "), nation)).when(kind == 1, F.concat(F.lit("Machinery University (Nation "), nation, F.lit(") Campus "), (F.col("s_suppkey") % 40).cast("string"), F.lit(" in the North")))
    right = table(spark, d, "supplier").select(name.otherwise(F.concat(F.lit("Household, Nation "), nation)).alias("b"))
    return M.names_match_bulk(left, right, "a", "b")


@query(_bulk_sql("SELECT CASE WHEN p_partkey % 2 = 0 THEN p_name || ' Ltd.' ELSE split_part(p_name, ' ', 1) || ' Group' END AS name FROM part",
    "SELECT CASE WHEN p_partkey % 2 = 0 THEN p_name || ' ' || p_type || ' Holdings' ELSE split_part(p_name, ' ', 1) || ' Inc' END AS name FROM part", W.COMPANY_NOISE, 2, "(least(m, n) > 1 OR m = n)"))
def same_companies_bulk(spark, d):
    even, first = F.col("p_partkey") % 2 == 0, F.split_part("p_name", F.lit(" "), F.lit(1))
    parts = table(spark, d, "part")
    left = parts.select(F.when(even, F.concat("p_name", F.lit(" Ltd."))).otherwise(F.concat(first, F.lit(" Group"))).alias("a"))
    right = parts.select(F.when(even, F.concat_ws(" ", "p_name", "p_type", F.lit("Holdings"))).otherwise(F.concat(first, F.lit(" Inc"))).alias("b"))
    return M.same_companies_bulk(left, right, "a", "b")


@query(f"WITH {_MATCH} SELECT case_id, occupation_id, title, strength FROM b JOIN o USING (occupation_id) QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY strength DESC, title, occupation_id) <= 10")
def first_occupations(spark, d):
    return M.match_occupations(_roles(spark, d), _occupations(spark, d), 10)


@query(f"""WITH l AS (SELECT {_COUNTRY.format('s_suppkey')} AS country, 'college ' || (s_suppkey % 60) AS k, arg_min(s_name, s_suppkey) AS website, arg_min(s_suppkey % 2 = 0, s_suppkey) AS higher_ed FROM supplier GROUP BY ALL)
    SELECT c_custkey AS institution_id, website, CAST(higher_ed AS VARCHAR) AS higher_ed FROM customer LEFT JOIN l ON l.country = {_COUNTRY.format('c_custkey')} AND k = 'college ' || (c_custkey % 300)""")
def enrich_by_name(spark, d):
    lookup = table(spark, d, "supplier").select(country("s_suppkey").alias("country"), F.concat(F.lit("college-"), (F.col("s_suppkey") % 60).cast("string")).alias("name"), F.col("s_suppkey").alias("pos"), F.col("s_name").alias("website"), (F.col("s_suppkey") % 2 == 0).alias("higher_ed"))
    return M.enrich_by_name(_schools(spark, d), lookup).select("institution_id", "website", F.col("higher_ed").cast("string").alias("higher_ed"))


@query("SELECT s_suppkey, EXISTS (SELECT 1 FROM customer WHERE c_custkey % 300 = s_suppkey % 60 AND c_custkey % 5 = s_suppkey % 5) AS listed FROM supplier")
def on_register(spark, d):
    names = table(spark, d, "supplier").select("s_suppkey", country("s_suppkey").alias("country"), F.concat(F.lit("COLLEGE "), (F.col("s_suppkey") % 60).cast("string")).alias("name"))
    return M.on_register(names, _schools(spark, d)).select("s_suppkey", "listed")


@query("""WITH c AS (SELECT n_name AS area, n_nationkey * 1.5 AS share FROM nation WHERE n_nationkey % 3 <> 0)
    SELECT c_custkey AS institution_id, share, CASE WHEN share IS NOT NULL THEN 'inferred' END AS basis FROM customer LEFT JOIN c ON area = CASE WHEN c_nationkey = 1 THEN 'NATION_2' WHEN c_nationkey = 4 THEN '' ELSE 'NATION_' || c_nationkey END""")
def area_share(spark, d):
    census = table(spark, d, "nation").where("n_nationkey % 3 <> 0").select(T.name_key("n_name").alias("area"), (F.col("n_nationkey") * 1.5).alias("share"))
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("institution_id"), F.concat(F.lit("Nation-"), F.col("c_nationkey").cast("string")).alias("town"))
    return M.area_share(own, census, {"nation 1": "nation 2", "nation 4": ""}).select("institution_id", "share", "basis")


@query("""WITH a AS (SELECT DISTINCT lower(o_orderpriority || ' ' || o_custkey) AS k FROM orders WHERE o_orderkey % 3 = 0), b AS (SELECT DISTINCT lower(o_orderpriority || ' ' || o_custkey) AS k FROM orders WHERE o_orderkey % 3 = 1)
    SELECT CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'shared' WHEN a.k IS NOT NULL THEN 'only a' ELSE 'only b' END AS side, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""")
def compare_sets(spark, d):
    own = table(spark, d, "orders").withColumn("quote", F.concat("o_orderpriority", F.lit("  "), F.col("o_custkey").cast("string"), F.lit(" ")))
    return M.compare_sets(own.where("o_orderkey % 3 = 0"), own.where("o_orderkey % 3 = 1"))


def _watches(spark, d):
    lane = F.when(F.col("c_custkey") % 2 == 0, "work").otherwise("study")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), country("c_custkey").alias("country"), lane.alias("lane"), F.lit("2000-01-01").cast("timestamp").alias("mark"))


@query(f"""WITH w AS (SELECT c_custkey AS case_id, {_COUNTRY.format('c_custkey')} AS country, CASE WHEN c_custkey % 2 = 0 THEN 'work' ELSE 'study' END AS lane FROM customer),
    o AS (SELECT *, {_COUNTRY.format('o_custkey')} AS country FROM orders WHERE o_orderdate > TIMESTAMP '2000-01-01'),
    e AS (SELECT case_id, 'rule' AS kind, o_orderkey AS k, o_orderdate AS happened FROM w JOIN o USING (country) WHERE o_orderstatus = 'F' AND lane = CASE WHEN o_orderkey % 2 = 0 THEN 'work' ELSE 'study' END
    UNION ALL SELECT case_id, CASE WHEN lane = 'work' THEN 'occupation' ELSE 'institution' END, o_orderkey, o_orderdate FROM w JOIN o USING (country) WHERE CASE WHEN lane = 'work' THEN o_orderstatus = 'O' ELSE o_orderstatus = 'P' END
    UNION ALL SELECT case_id, 'listing', o_orderkey, o_orderdate FROM w JOIN o ON o_custkey = case_id)
    SELECT case_id, kind, k::VARCHAR AS key, happened FROM e QUALIFY row_number() OVER (PARTITION BY case_id, kind ORDER BY happened DESC, k::VARCHAR) <= 6""")
def alerts_for(spark, d):
    orders = table(spark, d, "orders").withColumn("country", country("o_custkey"))
    changes = orders.select(F.col("o_orderkey").alias("change_id"), "country", F.when(F.col("o_orderkey") % 2 == 0, "work").otherwise("study").alias("lane"), (F.col("o_orderstatus") == "F").alias("material"), F.col("o_orderpriority").alias("summary"), F.col("o_orderdate").alias("after_read_at"))
    new = lambda s, key, name: orders.where(F.col("o_orderstatus") == s).select(F.col("o_orderkey").alias(key), "country", F.col("o_orderpriority").alias(name), F.col("o_orderdate").alias("first_seen_at"))
    listings = orders.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("listing_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("first_seen_at"))
    out = P.alerts_for(_watches(spark, d), changes, new("O", "occupation_id", "title"), new("P", "institution_id", "name"), listings)
    return out.select("case_id", "kind", "key", F.col("at").alias("happened"))


def _alerts(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("case_id"), F.col("event_id").alias("alert_id"), F.col("ts").alias("created_at"), F.when(F.col("event_type") == "click", F.col("ts")).alias("delivered_at"), F.when(F.col("event_type") == "view", F.col("ts")).alias("seen_at"))


@query("SELECT event_id AS alert_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS rank FROM events WHERE event_type <> 'click'")
def undelivered(spark, d):
    return P.undelivered(_alerts(spark, d)).select("alert_id", "rank")


@query("SELECT user_id AS case_id, count(*) FILTER (event_type <> 'view') AS unseen FROM events GROUP BY 1")
def unseen_counts(spark, d):
    return P.unseen_counts(_alerts(spark, d))


@query("""WITH v AS (SELECT user_id % 7 AS proposal, user_id AS wallet, arg_max(event_type, (ts, event_type)) AS option FROM events GROUP BY ALL), o AS (SELECT p AS proposal, x AS option FROM (SELECT unnest(range(7)) AS p), (SELECT unnest(['click', 'view', 'error']) AS x))
    SELECT o.proposal, o.option, coalesce(sum((w.b)::HUGEINT), 0)::VARCHAR AS weight, count(w.b) AS voters FROM o LEFT JOIN v ON v.proposal = o.proposal AND v.option = o.option LEFT JOIN (SELECT c_custkey, c_custkey::HUGEINT * 1000000000000000000 AS b FROM customer WHERE c_custkey % 3 <> 0) w ON w.c_custkey = v.wallet AND w.b > 0 GROUP BY ALL""")
def tally(spark, d):
    votes = table(spark, d, "events").select((F.col("user_id") % 7).alias("proposal"), F.col("user_id").alias("wallet"), F.col("event_type").alias("option"), F.col("ts").alias("at"))
    options = votes.select("proposal").distinct().withColumn("option", F.explode(F.array(*map(F.lit, ("click", "view", "error")))))
    balances = table(spark, d, "customer").select(F.col("c_custkey").alias("wallet"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey").cast("decimal(20,0)") * F.lit("1000000000000000000").cast("decimal(19,0)")).otherwise(0).cast("decimal(38,0)").alias("amount"))
    return P.tally(votes, options, balances)


@query("SELECT t AS \"table\", n FROM (SELECT 'cases' AS t, count(*) AS n FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey % 4 = 0 UNION ALL SELECT 'events', count(*) FROM events WHERE user_id % 4 = 0 AND user_id IN (SELECT c_custkey FROM customer))")
def expire_cases(spark, d):
    cases = table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.when(F.col("c_custkey") % 4 == 0, F.lit("2024-01-01")).otherwise("2030-01-01").cast("timestamp").alias("expires_at"))
    children = {"orders": table(spark, d, "orders").withColumnRenamed("o_custkey", "case_id"), "events": table(spark, d, "events").withColumnRenamed("user_id", "case_id")}
    return P.expire_cases(cases, children, F.lit("2024-02-01").cast("timestamp"))[2]


def _weights(values: dict, default: int) -> str:
    return "CASE country " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {default} END"


_ELIGIBLE = f"e AS (SELECT o_custkey % 100 AS case_id, {_COUNTRY.format('o_orderkey')} AS country, count(*) AS n_reasons, count(*) FILTER (o_orderstatus = 'F') AS requirements, count(*) FILTER (o_orderstatus = 'O') AS postings FROM orders GROUP BY ALL)"


def _eligible(spark, d):
    return table(spark, d, "orders").groupBy((F.col("o_custkey") % 100).alias("case_id"), country("o_orderkey").alias("country")).agg(F.count("*").alias("n_reasons"), F.count_if(F.col("o_orderstatus") == "F").alias("requirements"), F.count_if(F.col("o_orderstatus") == "O").alias("postings"))


def _capped(x: str, cap: int) -> str:
    return f"least({x} / greatest(max({x}) OVER (PARTITION BY case_id), 1)::DOUBLE, 1.0) * {cap}"


@query(f"""WITH {_ELIGIBLE}, t AS (SELECT *, {_weights(P.PR_ROUTE, 4)} + {_weights(P.SELF_SERVE, 5)} + {_weights(P.DEPENDANTS, 4)} + {_capped('n_reasons', 16)} + {_capped('requirements', 12)} + {_capped('postings', 14)} AS total FROM e)
    SELECT case_id, country, round(total, 6) AS total, row_number() OVER (PARTITION BY case_id ORDER BY round(total, 9) DESC, country)::INT AS place FROM t""")
def score_work(spark, d):
    return P.score_work(_eligible(spark, d), has_partner=True).select("case_id", "country", F.round("total", 6).alias("total"), "place")


@query(f"""WITH {_ELIGIBLE}, k AS (SELECT e.*, CASE country WHEN 'CA' THEN 12000.0 WHEN 'UK' THEN 20000.0 WHEN 'DE' THEN 0.0 WHEN 'AE' THEN 30000.0 END AS c FROM e), t AS (SELECT *, {_weights(P.PR_ROUTE, 4)} + {_weights(P.SELF_SERVE, 5)} + least(10, {_weights(P.DEPENDANTS, 4)} + 4) + {_capped('n_reasons', 16)} + {_capped('requirements', 12)}
    + coalesce(greatest(0.0, min(CASE WHEN c > 0 THEN c END) OVER (PARTITION BY case_id) / CASE WHEN c > 0 THEN c END * 2 - 1) * 30, 0) AS total FROM k)
    SELECT case_id, country, round(total, 6) AS total, row_number() OVER (PARTITION BY case_id ORDER BY round(total, 9) DESC, country)::INT AS place FROM t""")
def score_study(spark, d):
    own = _eligible(spark, d)
    cost = F.when(F.col("country") == "CA", 12000.0).when(F.col("country") == "UK", 20000.0).when(F.col("country") == "DE", 0.0).when(F.col("country") == "AE", 30000.0)
    costs = own.select("country").distinct().withColumn("cost", cost)
    return P.score_study(own, costs, research=True, has_partner=True).select("case_id", "country", F.round("total", 6).alias("total"), "place")


_BUCKET = "CASE WHEN d <= 0 THEN 'none' WHEN d <= 2 THEN 'few' WHEN d <= 5 THEN 'some' ELSE 'many' END"


@query(f"""WITH t AS (SELECT user_id % 9 AS d, value AS s, ts FROM events WHERE value > 0), n AS (SELECT {_BUCKET} AS bucket, s, d FROM t QUALIFY row_number() OVER (PARTITION BY {_BUCKET} ORDER BY ts DESC, s) <= 40),
    g AS (SELECT bucket, list_sort(list(s)) AS t, count(*) AS n FROM n GROUP BY 1)
    SELECT bucket, n, greatest(75.0, least(900.0, t[1 + least(n - 1, round_even((n - 1) * 0.9, 0)::INT)] * 1.15)) AS seconds, true AS measured FROM g""")
def run_estimate(spark, d):
    times = table(spark, d, "events").select((F.col("user_id") % 9).alias("documents"), F.col("value").alias("seconds"), F.col("ts").alias("at"))
    return P.run_estimate(times)


@query("""WITH r AS (SELECT o_custkey AS case_id, o_orderkey AS requirement_id FROM orders WHERE o_orderpriority <> '5-LOW'), m AS (SELECT o_custkey AS case_id, o_orderkey AS requirement_id, o_orderkey % 5 <> 0 AS verified FROM orders WHERE o_orderstatus <> 'P')
    SELECT r.case_id, count(*) AS satisfiable, count(m.requirement_id) AS covered, count(*) FILTER (NOT m.verified) AS unverified, floor(count(m.requirement_id) * 100 / count(*))::INT AS score FROM r LEFT JOIN m USING (case_id, requirement_id) GROUP BY 1""")
def coverage_score(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("requirement_id"), F.col("o_orderpriority").alias("category"), "o_orderstatus")
    matches = orders.where("o_orderstatus <> 'P'").withColumn("verified", F.col("requirement_id") % 5 != 0)
    return P.coverage_score(orders, matches, ("5-LOW",))


@query(f"""WITH r AS (SELECT c_custkey AS institution_id, {_COUNTRY.format('c_custkey')} AS country, row_number() OVER (PARTITION BY c_custkey % 5 ORDER BY CASE WHEN c_custkey % 6 = 0 THEN 0 ELSE c_acctbal END DESC, c_name, c_custkey)::INT AS rank FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 4 <> 1)
    SELECT *, row_number() OVER (ORDER BY rank, country)::INT AS place FROM r""")
def reading_order(spark, d):
    key = F.col("c_custkey")
    routes = F.when(key % 4 == 0, F.array().cast("array<string>")).when(key % 4 == 1, F.array(F.lit("Child Student"))).otherwise(F.array(F.lit("Child Student"), F.lit("Student")))
    own = table(spark, d, "customer").select(key.alias("institution_id"), country("c_custkey").alias("country"), F.col("c_name").alias("name"), F.when(key % 7 != 0, "w").alias("website"), (key % 11 != 0).alias("higher_ed"), routes.alias("routes"), F.when(key % 6 != 0, F.col("c_acctbal")).alias("score"))
    return P.reading_order(own)


