"""Queries of the text functions over pages, documents, parts and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewatch.functions import text as T
from pagewatch.functions import words as W
from pagewatch.operators import kinds, links
from pagewatch.plans.common import HOST, host, joined, page_text_sql, quoted, stable_digest_sql, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT page_id, sha256(html) AS body_sha, length(html) AS n_chars FROM pages")
def decode_body(spark: SparkSession, d: str) -> DataFrame:
    body = F.encode("html", "utf-8")
    text = T.decode_body(body, F.lit("text/html"))
    return table(spark, d, "pages").select("page_id", F.sha2(text, 256).alias("body_sha"), F.length(text).cast("long").alias("n_chars"))


@query(f"SELECT page_id, {stable_digest_sql('html')} AS digest FROM pages")
def stable_digest(spark, d):
    return table(spark, d, "pages").select("page_id", T.stable_digest("html").alias("digest"))


@query("SELECT page_id, sha256(html) AS digest FROM pages")
def raw_digest(spark, d):
    return table(spark, d, "pages").select("page_id", T.raw_digest(F.encode("html", "utf-8")).alias("digest"))


@query(f"SELECT page_id, length(t) AS n_chars, sha256(t) AS text_sha FROM (SELECT page_id, {page_text_sql('html')} AS t FROM pages)")
def page_text(spark, d):
    pages = table(spark, d, "pages").select("page_id", T.page_text("html").alias("t"))
    return pages.select("page_id", F.length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("text_sha"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS folded, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS folded_ci FROM documents")
def fold(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.fold("text"), 256).alias("folded"), F.sha2(T.fold_ci("text"), 256).alias("folded_ci"))


@query("SELECT p_partkey, regexp_replace(trim(regexp_replace(lower('The ' || p_name || ', ' || p_brand), '[^a-z0-9]+', ' ', 'g')), '^the ', '') AS key FROM part")
def name_key(spark, d):
    return table(spark, d, "part").select("p_partkey", T.name_key(F.concat(F.lit("The "), "p_name", F.lit(", "), "p_brand")).alias("key"))


@query(f"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(p_name || ' of the ' || p_type), '[a-z0-9]+'), lambda x: x NOT IN ({quoted(W.SEARCH_STOP)})))), '|') AS words FROM part")
def search_words(spark, d):
    return table(spark, d, "part").select("p_partkey", joined(F.array_sort(T.search_words(F.concat("p_name", F.lit(" of the "), "p_type")))).alias("words"))


_PLURAL = "CASE WHEN w LIKE '%ies' AND length(w) >= 7 THEN left(w, length(w) - 3) || 'y' WHEN w LIKE '%es' AND length(w) >= 6 THEN left(w, length(w) - 2) WHEN w LIKE '%s' AND length(w) >= 5 THEN left(w, length(w) - 1) ELSE w END"
ROLE_SQL = f"""
    SELECT k, list_sort(list_distinct(list(w))) AS ws FROM (
        SELECT k, {_PLURAL} AS w FROM (SELECT k, unnest(regexp_extract_all(lower(t), '[a-z]+')) AS w FROM src)
        WHERE length(w) > 2 AND w NOT IN ({quoted(W.ROLE_NOISE)})
    ) WHERE w NOT IN (SELECT {_PLURAL} FROM (SELECT unnest([{quoted(W.ROLE_NOISE)}]) AS w)) GROUP BY k"""


@query(f"WITH src AS (SELECT p_partkey AS k, p_name || ' workers and related ' || p_type || ' managers, batteries' AS t FROM part) SELECT k AS p_partkey, array_to_string(ws, '|') AS words FROM ({ROLE_SQL})")
def role_words(spark, d):
    title = F.concat("p_name", F.lit(" workers and related "), "p_type", F.lit(" managers, batteries"))
    return table(spark, d, "part").select("p_partkey", joined(F.array_sort(T.role_words(title))).alias("words"))


_STORY = "CASE WHEN w LIKE '%ing' AND length(w) > 6 THEN left(w, length(w) - 3) WHEN w LIKE '%ed' AND length(w) > 5 THEN left(w, length(w) - 2) WHEN w LIKE '%es' AND length(w) > 5 THEN left(w, length(w) - 2) WHEN w LIKE '%s' AND length(w) > 4 THEN left(w, length(w) - 1) ELSE w END"


@query(f"SELECT doc_id, count(DISTINCT s) AS n, md5(string_agg(DISTINCT s, '|' ORDER BY s)) AS stems FROM (SELECT doc_id, {_STORY} AS s FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents) WHERE length(w) > 2 AND w NOT IN ({quoted(W.STORY_STOP)})) GROUP BY doc_id")
def story_stems(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.story_stems("text").alias("s")).where(F.size("s") > 0)
    return docs.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(joined(F.array_sort("s"))).alias("stems"))


@query("""SELECT e.event_id, left(sha256('https://a.example/' || user_id || chr(10) || props || chr(10) || event_type), 24) AS requirement_id,
    left(sha256(user_id || chr(10) || event_type || chr(10) || event_id), 24) AS change_id,
    event_type || '-' || event_id || '-' || left(sha256(event_type || chr(10) || event_id), 10) AS listing_id,
    left(sha256(array_to_string(list_sort([event_type, user_id::VARCHAR, 'x']), '|')), 16) AS article_id FROM events e""")
def row_ids(spark, d):
    return table(spark, d, "events").select(
        "event_id",
        T.requirement_id(F.concat(F.lit("https://a.example/"), F.col("user_id").cast("string")), "props", "event_type").alias("requirement_id"),
        T.change_id("user_id", "event_type", "event_id").alias("change_id"),
        T.listing_id("event_type", "event_id").alias("listing_id"),
        T.article_id(F.array("event_type", F.col("user_id").cast("string"), F.lit("x"))).alias("article_id"),
    )


@query("""WITH x AS (SELECT page_id, url, regexp_replace(url, '^.*?//', '') AS r FROM pages), y AS (SELECT *, regexp_extract(r, '^([^/]*)', 1) AS h,
    regexp_replace(regexp_replace(lower(regexp_extract(r, '^[^/]*(.*)$', 1)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS p FROM x)
    SELECT page_id, 'gb-study-' || replace(h, '.', '-') || '-' || CASE WHEN p = '' THEN 'root' ELSE right(p, 48) END || '-' || left(sha256(url), 8) AS source_id FROM y""")
def source_id(spark, d):
    return table(spark, d, "pages").select("page_id", T.source_id(F.lit("GB"), F.lit("study"), "url").alias("source_id"))


@query("WITH x AS (SELECT doc_id, regexp_replace(left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 70), '-+$', '') AS s FROM documents) SELECT doc_id, CASE WHEN s = '' THEN 'article' ELSE s END AS slug FROM x")
def slugify(spark, d):
    return table(spark, d, "documents").select("doc_id", T.slugify("text").alias("slug"))


@query(f"SELECT p_partkey, array_to_string(list_filter(regexp_extract_all(lower('The University of ' || p_name || ' at ' || p_brand), '[a-z0-9]+'), lambda x: x NOT IN ({quoted(W.SCHOOL_NOISE)})), '-') AS slug FROM part")
def ranking_slug(spark, d):
    return table(spark, d, "part").select("p_partkey", T.ranking_slug(F.concat(F.lit("The University of "), "p_name", F.lit(" at "), "p_brand")).alias("slug"))


@query(r"SELECT o_orderkey, array_to_string(list_sort(list_transform(regexp_extract_all('pay ' || printf('%.2f', o_totalprice) || ' or 1,270. by ' || o_custkey || ' and 1.270', '\d[\d.,]*'), lambda x: regexp_replace(x, '[.,]', '', 'g'))), '|') AS figures FROM orders")
def numbers_in(spark, d):
    text = F.concat(F.lit("pay "), F.format_string("%.2f", "o_totalprice"), F.lit(" or 1,270. by "), F.col("o_custkey").cast("string"), F.lit(" and 1.270"))
    return table(spark, d, "orders").select("o_orderkey", joined(T.numbers_in(text)).alias("figures"))


_MODAL = "list_value('you must pay', 'you may pay but cannot leave', 'no fee, not required', 'puede o debe', 'plain words')"


@query(f"""WITH x AS (SELECT o_orderkey, ({_MODAL})[1 + o_orderkey % 5] || ' ' || o_orderpriority AS t FROM orders),
    w AS (SELECT o_orderkey, unnest(regexp_extract_all(lower(t), '[a-z]+')) AS w FROM x),
    m AS (SELECT o_orderkey, 'obligation' AS m FROM w WHERE w IN ({quoted(W.OBLIGATION)}) UNION ALL SELECT o_orderkey, 'permission' FROM w WHERE w IN ({quoted([*W.PERMISSION, W.REFUSED])}) UNION ALL SELECT o_orderkey, 'negation' FROM w WHERE w IN ({quoted([*W.NEGATION, W.REFUSED])}))
    SELECT o_orderkey, coalesce(string_agg(m, '|' ORDER BY m), '') AS modality FROM x LEFT JOIN m USING (o_orderkey) GROUP BY o_orderkey""")
def modality_in(spark, d):
    cases = F.array(*map(F.lit, ("you must pay", "you may pay but cannot leave", "no fee, not required", "puede o debe", "plain words")))
    text = F.concat(F.element_at(cases, (F.col("o_orderkey") % 5 + 1).cast("int")), F.lit(" "), "o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", joined(T.modality_in(text)).alias("modality"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE round(p_retailprice, 2) END AS amount, CASE p_partkey % 4 WHEN 0 THEN 'GBP' WHEN 1 THEN 'EUR' WHEN 2 THEN 'CAD' ELSE '' END AS currency FROM part")
def money(spark, d):
    kind = (F.col("p_partkey") % 4 + 1).cast("int")
    text = F.concat(F.lit("Fee: "), F.element_at(F.array(*map(F.lit, ("£", "€ ", "CAD ", "none "))), kind), F.format_number("p_retailprice", 2), F.lit(" a year"))
    amount, currency = T.money(text)
    return table(spark, d, "part").select("p_partkey", amount.alias("amount"), currency.alias("currency"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN (p_size % 100)::DOUBLE END AS share, CASE WHEN p_partkey % 3 = 0 AND p_size % 2 = 0 THEN 'World University Rankings 2024' END AS edition,
    CASE p_partkey % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'the page does not state an international student percentage' ELSE 'the page is about another institution' END AS reason FROM part""")
def read_share(spark, d):
    third = F.col("p_partkey") % 3
    text = F.concat_ws("\n", F.lit(" "), F.when(third == 2, F.lit("Other School")).otherwise(F.concat(F.lit("The University of "), "p_name")), F.when(F.col("p_size") % 2 == 0, F.lit("World University Rankings 2024")), F.when(third != 1, F.concat(F.lit("International student percentage "), (F.col("p_size") % 100).cast("string"), F.lit(" %"))))
    share, edition, reason = T.read_share(text, F.concat(F.lit("University of "), "p_name"))
    return table(spark, d, "part").select("p_partkey", share.alias("share"), edition.alias("edition"), reason.alias("reason"))


@query(r"SELECT doc_id, length(text) >= 20 AND len(regexp_extract_all(text, '\p{L}')) / length(text) > 0.35 AS words FROM documents")
def looks_like_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.looks_like_text("text").alias("words"))


@query("""SELECT p_partkey, p_size || ' to ' || (p_size + 1) || ', "' || p_name || '", it''s' AS tidied FROM part""")
def tidy(spark, d):
    text = F.concat(F.col("p_size").cast("string"), F.lit(" – "), (F.col("p_size") + 1).cast("string"), F.lit(" — , “"), "p_name", F.lit("”  —  it’s —"))
    return table(spark, d, "part").select("p_partkey", T.tidy(text).alias("tidied"))


@query(f"""WITH x AS (SELECT doc_id, lower(coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN ' a pivotal, Robust landmark' WHEN 1 THEN ' not only big but key changes' WHEN 2 THEN ' serves as a testament to it' ELSE '' END) AS t FROM documents),
    h AS (SELECT doc_id, w AS h FROM x, (SELECT unnest([{quoted(W.BANNED)}]) AS w) WHERE regexp_matches(t, '\\b' || replace(replace(w, '-', '\\-'), '.', '\\.') || '\\b')
    UNION ALL SELECT doc_id, w FROM x, (SELECT unnest([{quoted(W.INFLATION)}]) AS w) WHERE contains(t, w) UNION ALL SELECT doc_id, 'key changes' FROM x WHERE contains(t, 'key changes') UNION ALL SELECT doc_id, 'not just ... but' FROM x WHERE regexp_matches(t, '{W.NOT_JUST}'))
    SELECT doc_id, coalesce(string_agg(DISTINCT h, '|' ORDER BY h), '') AS hits FROM x LEFT JOIN h USING (doc_id) GROUP BY doc_id""")
def voice_hits(spark, d):
    more = F.element_at(F.array(*map(F.lit, (" a pivotal, Robust landmark", " not only big but key changes", " serves as a testament to it", ""))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", joined(T.voice_hits(F.concat(F.coalesce("text", F.lit("")), more))).alias("hits"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\p{L}\p{M}\p{N}_.+-]+@[\p{L}\p{M}\p{N}_-]+\.[\p{L}\p{M}\p{N}_.-]+', '', 'g'), '(\+?\d[\d\-\s().]{7,}\d)', '', 'g'), '^[ ,;·-]+|[ ,;·-]+$', '', 'g')) AS clean FROM documents")
def strip_contacts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.strip_contacts("text")).alias("clean"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || ', ' || p_type || '|' || p_name ELSE p_name END AS asked FROM part")
def search_queries(spark, d):
    title = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(", "), "p_type")).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", joined(T.search_queries(title)).alias("asked"))


_SIGNALS = ", ".join(f"('{k}', '{p}', {w})" for k, own in W.KIND_SIGNALS.items() for p, w in own)
_DETECT = f"""WITH s(kind, phrase, weight) AS (VALUES {_SIGNALS}), x AS (SELECT doc_id, lower(text || CASE doc_id % 5 WHEN 0 THEN ' passport no 1, issuing authority X, nationality' WHEN 1 THEN ' bachelor of arts conferred, academic record, gpa'
        WHEN 2 THEN ' opening balance 1 closing balance 2' ELSE '' END) AS t FROM documents),
    k AS (SELECT doc_id, kind, sum(weight)::INT AS score FROM x JOIN s ON contains(t, phrase) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, kind) AS rn FROM k),
    b AS (SELECT x.doc_id, length(trim(t)) < 40 AS short, r1.kind AS best, coalesce(r1.score, 0) AS score, r2.kind AS second, coalesce(r2.score, 0) AS second_score
        FROM x LEFT JOIN r r1 ON x.doc_id = r1.doc_id AND r1.rn = 1 LEFT JOIN r r2 ON x.doc_id = r2.doc_id AND r2.rn = 2)
    SELECT doc_id, CASE WHEN NOT short AND score >= 4 AND score - second_score >= 2 THEN best END AS kind, CASE WHEN short THEN 0 ELSE score END AS score, CASE WHEN NOT short THEN second END AS runner_up,
        CASE WHEN short THEN 'no text' WHEN best IS NULL THEN 'no words' WHEN score < 4 THEN 'too weak' WHEN score - second_score < 2 THEN 'too close' ELSE 'named' END AS reason FROM b"""


def _kinds(spark, d):
    more = F.element_at(F.array(*map(F.lit, (" passport no 1, issuing authority X, nationality", " bachelor of arts conferred, academic record, gpa", " opening balance 1 closing balance 2", "", ""))), (F.col("doc_id") % 5 + 1).cast("int"))
    return kinds.detect_kind(table(spark, d, "documents").select("doc_id", F.concat("text", more).alias("text")))


@query(_DETECT)
def detect_kind(spark, d):
    return _kinds(spark, d).select("doc_id", "kind", "score", "runner_up", "reason")


@query(f"SELECT doc_id, CASE WHEN kind IS NULL THEN 'unchecked' WHEN kind = CASE WHEN doc_id % 2 = 0 THEN 'passport' ELSE 'bank_statement' END THEN 'agreed' ELSE 'disagreed' END AS state FROM ({_DETECT})")
def kind_agreement(spark, d):
    model = F.when(F.col("doc_id") % 2 == 0, "passport").otherwise("bank_statement")
    return _kinds(spark, d).select("doc_id", T.kind_agreement(model, "kind").alias("state"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'agreed' WHEN 1 THEN 'disputed' WHEN 2 THEN 'unverified' WHEN 3 THEN 'agreed' ELSE 'unverified' END AS verdict FROM events")
def read_verdict(spark, d):
    answers = F.array(*map(F.lit, ("YES", "**No.**\nIt does not say", "", "\n  yes, it does", "I cannot tell")))
    return table(spark, d, "events").select("event_id", T.read_verdict(F.element_at(answers, (F.col("event_id") % 5 + 1).cast("int"))).alias("verdict"))


@query(f"SELECT page_id, {HOST} AS host FROM pages WHERE octet_length(encode(html)) < 4000")
def thin_pages(spark, d):
    return links.thin_pages(table(spark, d, "pages"), "html").select("page_id", host().alias("host"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'second' ELSE 'first' END AS reading, CASE WHEN doc_id % 3 = 0 THEN length(text) + 5 ELSE length(text) END > 400 AS usable FROM documents")
def longer_reading(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    again = docs.where("doc_id % 3 < 2").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" more"))).otherwise("").alias("text"))
    return links.longer_reading(docs, again, "doc_id").select("doc_id", "reading", "usable")


@query("""WITH x AS (SELECT p_partkey, regexp_extract_all(lower(p_name), '[a-z0-9]+') AS a, regexp_extract_all(lower(CASE p_partkey % 3 WHEN 0 THEN 'The ' || p_name || ' ' || p_brand WHEN 1 THEN split_part(p_name, ' ', 1) ELSE p_type END), '[a-z0-9]+') AS b FROM part),
    y AS (SELECT p_partkey, list_distinct(list_filter(a, lambda w: w NOT IN ('the', 'of', 'at', 'in', 'and', 'a'))) AS a, list_distinct(list_filter(b, lambda w: w NOT IN ('the', 'of', 'at', 'in', 'and', 'a'))) AS b FROM x)
    SELECT p_partkey, len(list_intersect(a, b)) = least(len(a), len(b)) AS same FROM y""")
def names_match(spark, d):
    kind = F.col("p_partkey") % 3
    other = F.when(kind == 0, F.concat(F.lit("The "), "p_name", F.lit(" "), "p_brand")).when(kind == 1, F.split_part("p_name", F.lit(" "), F.lit(1))).otherwise(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", T.names_match("p_name", other).alias("same"))


@query("SELECT p_partkey, p_partkey % 3 = 0 AS company, p_partkey % 3 <> 2 AS place FROM part")
def same_company(spark, d):
    kind = F.col("p_partkey") % 3
    other = F.when(kind == 0, F.concat("p_name", F.lit(" Holdings Inc."))).when(kind == 1, F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" Ltd"))).otherwise(F.lit("Qqq Zzz"))
    return table(spark, d, "part").select("p_partkey", T.same_company("p_name", other).alias("company"), T.same_place("p_name", other).alias("place"))
