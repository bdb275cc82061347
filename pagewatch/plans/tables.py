"""Queries of snapshots, registers and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewatch.functions import text as T
from pagewatch.plans.common import joined, stable_digest_sql, table
from pagewatch.sources import bucketed, merge, registers, shared, snapshots

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _snapshots(spark, d):
    """A version of each page; every third was stored a day before."""
    day = F.when(F.col("page_id") % 3 == 0, F.lit("2024-01-01")).otherwise(F.lit("2024-01-02"))
    return table(spark, d, "pages").select(
        F.concat(F.lit("s"), F.col("page_id").cast("string")).alias("source_id"), "url", F.to_timestamp(F.concat(day, F.lit(" 06:00:00"))).alias("read_at"),
        F.lit("text/html").alias("content_type"), F.encode("html", "utf-8").alias("body"), F.concat(F.lit("s"), F.col("page_id").cast("string")).alias("path"), day.cast("date").alias("day"),
    )


@query("SELECT 's' || page_id AS source_id, CASE WHEN page_id % 3 = 1 THEN CAST(octet_length(encode(html)) AS VARCHAR) END AS n_bytes FROM pages")
def with_bodies(spark, d):
    own = _snapshots(spark, d)
    second = own.where(F.col("day") == F.lit("2024-01-02").cast("date")).where(~F.col("source_id").isin("none") & (F.substring("source_id", 2, 20).cast("long") % 3 == 1))
    return snapshots.with_bodies(own.select("source_id", "path"), second).select("source_id", F.octet_length("body").cast("string").alias("n_bytes"))


@query(f"""WITH p AS (SELECT page_id, html, {stable_digest_sql('html')} AS h FROM pages),
    b AS (SELECT 's' || (page_id % 40) AS source_id, page_id, h FROM p WHERE page_id % 2 = 0), s AS (SELECT 's' || (page_id % 40) AS source_id, h FROM p WHERE page_id % 4 = 0)
    SELECT source_id, h AS sha256, min(page_id) AS first_page FROM b WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.source_id = b.source_id AND s.h = b.h) GROUP BY ALL""")
def new_versions(spark, d):
    pages = table(spark, d, "pages").select(F.concat(F.lit("s"), (F.col("page_id") % 40).cast("string")).alias("source_id"), F.col("page_id").cast("string").alias("url"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id")).alias("read_at"), F.lit("text/html").alias("content_type"), F.encode("html", "utf-8").alias("body"), "page_id", "html")
    stored = pages.where("page_id % 4 = 0").select("source_id", T.stable_digest("html").alias("sha256"))
    new = snapshots.new_versions(pages.where("page_id % 2 = 0").drop("page_id", "html"), stored)
    return new.select("source_id", "sha256", F.col("url").cast("long").alias("first_page"))


@query("""WITH r AS (SELECT p_partkey AS pos, trim(p_name) AS name, p_brand AS status, p_type AS route FROM part),
    f AS (SELECT lower(name) AS key, arg_min(name, pos) AS name, arg_min(status, pos) AS status, min(pos) AS pos FROM r GROUP BY 1),
    s AS (SELECT key, string_agg(route, '|' ORDER BY p) AS routes FROM (SELECT lower(name) AS key, route, min(pos) AS p FROM r GROUP BY ALL) GROUP BY 1)
    SELECT key, name, status, routes, pos FROM f JOIN s USING (key)""")
def register_rows(spark, d):
    rows = table(spark, d, "part").withColumn("pos", F.col("p_partkey"))
    out = registers.register_rows(rows, "p_name", status="p_brand", route="p_type")
    return out.select("key", "name", "status", joined("routes").alias("routes"), "pos")


@query("SELECT min(page_id) AS page_id, regexp_extract(url, '//([^/?#]*)', 1) AS name FROM pages GROUP BY 2")
def read_register_html(spark, d):
    host = F.regexp_extract("url", "//([^/?#]*)", 1)
    row = F.concat(F.lit("<table><tr><th>Name</th><th>Town</th></tr><tr><td><b>"), host, F.lit("</b></td><td>A &amp; B</td></tr><tr><td>short</td></tr></table>"))
    pages = table(spark, d, "pages").select("page_id", F.concat("html", row).alias("html"))
    return registers.read_register_html(pages, 0, 2, header=("name",)).select("page_id", "name")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey * 1000 + 7 AS VARCHAR) END AS n FROM orders")
def count_cell(spark, d):
    cells = F.when(F.col("o_orderkey") % 5 == 0, F.element_at(F.array(*map(F.lit, registers.SUPPRESSED)), (F.floor(F.col("o_orderkey") / 5) % 5 + 1).cast("int"))).otherwise(F.format_number(F.col("o_custkey") * 1000 + 7, 0))
    return table(spark, d, "orders").select("o_orderkey", registers.count_cell(cells).cast("string").alias("n"))


# Files: each is written to the shared folder first, then read as a publisher's would be.


@query("SELECT 's' || page_id AS source_id, CASE WHEN page_id % 3 <> 0 THEN CAST(octet_length(encode(html)) AS VARCHAR) END AS n_bytes FROM pages")
def read_snapshots(spark, d):
    own, path = _snapshots(spark, d).drop("path", "day"), f"{shared.new_folder(spark)}/snapshots"
    snapshots.append_snapshots(own, path, "all")
    asked = snapshots.read_snapshots(spark, path).select("source_id", "path")
    return snapshots.with_bodies(asked, snapshots.read_snapshots(spark, path, "2024-01-02")).select("source_id", F.octet_length("body").cast("string").alias("n_bytes"))


@query(f"""WITH p AS (SELECT 's' || (page_id % 40) AS source_id, page_id, {stable_digest_sql('html')} AS h FROM pages),
    a AS (SELECT source_id, h, min(page_id) AS page FROM p WHERE page_id % 4 = 0 GROUP BY ALL), b AS (SELECT source_id, h, min(page_id) AS page FROM p WHERE (source_id, h) NOT IN (SELECT (source_id, h) FROM a) GROUP BY ALL)
    SELECT 'first' AS batch, source_id, h AS sha256, page FROM a UNION ALL SELECT 'second', source_id, h, page FROM b""")
def append_snapshots(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.concat(F.lit("s"), (F.col("page_id") % 40).cast("string")).alias("source_id"), F.col("page_id").cast("string").alias("url"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id")).alias("read_at"), F.lit("text/html").alias("content_type"), F.encode("html", "utf-8").alias("body"))
    path = f"{shared.new_folder(spark)}/snapshots"
    # The second batch comes twice, then once more under another name: neither adds a row.
    for rows, batch in ((pages.where("page_id % 4 = 0"), "first"), (pages, "second"), (pages, "second"), (pages, "third")):
        snapshots.append_snapshots(rows.drop("page_id"), path, batch)
    return snapshots.read_snapshots(spark, path).select("batch", "source_id", "sha256", F.col("url").cast("long").alias("page"))


@query("""WITH r AS (SELECT p_partkey AS pos, trim(p_name) AS name, p_brand || ', "new"' AS status, p_type AS route FROM part),
    f AS (SELECT lower(name) AS key, arg_min(name, pos) AS name, arg_min(status, pos) AS status FROM r GROUP BY 1),
    s AS (SELECT key, string_agg(route, '|' ORDER BY p) AS routes FROM (SELECT lower(name) AS key, route, min(pos) AS p FROM r GROUP BY ALL) GROUP BY 1)
    SELECT key, name, status, routes FROM f JOIN s USING (key)""")
def read_register_csv(spark, d):
    path = f"{shared.new_folder(spark)}/register"
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit(" "), "p_name").alias("Organisation Name"), F.concat("p_brand", F.lit(', "new"')).alias("Rating"), F.col("p_type").alias("Route"))
    # A publisher's files are in order by name, and within.
    rows.repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey").drop("p_partkey").write.option("header", True).option("escape", '"').csv(path)
    out = registers.read_register_csv(spark, path, "Organisation Name", status="Rating", route="Route")
    return out.select("key", "name", "status", joined("routes").alias("routes"))


@query("SELECT 'College, ' || o_orderkey AS name, o_custkey * 1000 + 7 AS n FROM orders WHERE o_orderkey % 5 <> 0")
def read_counts(spark, d):
    cells = F.when(F.col("o_orderkey") % 5 == 0, F.element_at(F.array(*map(F.lit, registers.SUPPRESSED)), (F.floor(F.col("o_orderkey") / 5) % 5 + 1).cast("int"))).otherwise(F.format_number(F.col("o_custkey") * 1000 + 7, 0))
    path = f"{shared.new_folder(spark)}/counts"
    table(spark, d, "orders").select(F.concat(F.lit(" College, "), F.col("o_orderkey").cast("string")).alias("Institution"), cells.alias("Permit holders"), F.lit("x").alias("a"), F.lit("y").alias("b")).write.option("header", True).option("sep", "\t").csv(path)
    return registers.read_counts(spark, path, "Institution", "Permit holders")


def _postings(spark, d):
    own = table(spark, d, "orders").select((F.col("o_orderkey") % 6000).alias("id"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("note"), "o_orderdate", "o_orderkey")
    return own.where("o_orderkey % 2 = 0"), own.where("o_orderkey % 2 = 1 or o_orderkey % 7 = 0")


_POSTINGS = "o AS (SELECT o_orderkey % 6000 AS id, o_orderpriority AS title, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS note, o_orderdate, o_orderkey FROM orders), e0 AS (SELECT * FROM o WHERE o_orderkey % 2 = 0), b0 AS (SELECT * FROM o WHERE o_orderkey % 2 = 1 OR o_orderkey % 7 = 0)"
_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM {0}) WHERE rn = 1)"


def _existing(df):
    return merge.collapsed(df.select("id", "o_orderdate", "o_orderkey", "title", "note"), "id", "o_orderdate").select("id", "title", "note", F.col("o_orderdate").alias("first_seen_at"), F.col("o_orderdate").alias("last_seen_at"))


@query(f"""WITH {_POSTINGS}, e AS {_LATEST.format('e0')}, b AS {_LATEST.format('b0')}
    SELECT coalesce(e.id, b.id) AS id, coalesce(b.title, e.title) AS title, coalesce(b.note, e.note) AS note,
    CASE WHEN e.id IS NOT NULL THEN e.o_orderdate ELSE b.o_orderdate END AS first_seen_at, coalesce(b.o_orderdate, e.o_orderdate) AS last_seen_at FROM e FULL JOIN b ON e.id = b.id""")
def upsert_first_seen(spark, d):
    old, new = _postings(spark, d)
    batch = new.select("id", F.col("o_orderdate").alias("read_at"), "o_orderkey", "title", "note")
    return merge.upsert_first_seen(_existing(old), batch, "id", "read_at").select("id", "title", "note", "first_seen_at", "last_seen_at")


@query(f"""WITH {_POSTINGS}, e AS {_LATEST.format('e0')}, b AS {_LATEST.format('b0')}
    SELECT coalesce(e.id, b.id) AS id, coalesce(b.title, e.title) AS title, coalesce(b.note, e.note) AS note,
    CASE WHEN e.id IS NOT NULL THEN e.o_orderdate ELSE b.o_orderdate END AS first_seen_at, coalesce(b.o_orderdate, e.o_orderdate) AS last_seen_at FROM e FULL JOIN b ON e.id = b.id""")
def merge_table(spark, d):
    path, schema = f"{shared.new_folder(spark)}/postings", "id long, title string, note string, first_seen_at timestamp, last_seen_at timestamp"
    for rows in _postings(spark, d):
        latest = merge.collapsed(rows.select("id", "o_orderdate", "o_orderkey", "title", "note"), "id", "o_orderdate").select("id", F.col("o_orderdate").alias("read_at"), "title", "note")
        bucketed.merge_table(path, latest, "id", "read_at", schema)
    return bucketed.read_table(spark, path, schema)


@query(f"""WITH {_POSTINGS}, e AS {_LATEST.format('e0')}, b AS {_LATEST.format('b0')}
    SELECT coalesce(e.id, b.id) AS id, coalesce(b.title, e.title) AS title, CASE WHEN e.id IS NOT NULL THEN e.note ELSE b.note END AS note FROM e FULL JOIN b ON e.id = b.id""")
def upsert_preserving(spark, d):
    old, new = _postings(spark, d)
    batch = new.select("id", "o_orderdate", "o_orderkey", "title", "note")
    kept = merge.collapsed(old.select("id", "o_orderdate", "o_orderkey", "title", "note"), "id", "o_orderdate").select("id", "o_orderdate", "title", "note")
    return merge.upsert_preserving(kept, batch, "id", ("note",)).select("id", "title", "note")


@query(f"""WITH {_POSTINGS}, e AS {_LATEST.format('e0')}, b AS {_LATEST.format('b0')}
    SELECT coalesce(e.id, b.id) AS id, CASE WHEN b.id IS NOT NULL THEN b.note ELSE e.note END AS put, coalesce(b.note, e.note) AS merged FROM e FULL JOIN b ON e.id = b.id""")
def put_rows(spark, d):
    old, new = _postings(spark, d)
    rows = [merge.collapsed(x.select("id", "o_orderdate", "o_orderkey", "note"), "id", "o_orderdate").select("id", "note") for x in (old, new)]
    put = merge.put_rows(*rows, "id", clear_nulls=True).withColumnRenamed("note", "put")
    return put.join(merge.put_rows(*rows, "id", clear_nulls=False).withColumnRenamed("note", "merged"), "id")


@query("""WITH r AS (SELECT CASE WHEN event_id % 4 = 0 THEN left(sha256('u' || (user_id % 20) || chr(10) || event_type || chr(10) || 'study'), 24) ELSE 'old' || event_id END AS requirement_id,
    CASE WHEN event_id % 9 <> 0 THEN 'u' || (user_id % 20) END AS url, event_type AS quote FROM events),
    n AS (SELECT *, CASE WHEN url IS NOT NULL THEN left(sha256(url || chr(10) || quote || chr(10) || 'study'), 24) END AS new_id FROM r),
    m AS (SELECT new_id, coalesce(min(CASE WHEN requirement_id = new_id THEN requirement_id END), min(requirement_id)) AS least FROM n WHERE new_id IS NOT NULL GROUP BY 1)
    SELECT CASE WHEN n.new_id IS NULL THEN 'unmovable' WHEN requirement_id = n.new_id THEN 'right' WHEN requirement_id <> least THEN 'merged' ELSE 'moved' END AS state, count(*) AS n FROM n LEFT JOIN m ON n.new_id = m.new_id GROUP BY 1""")
def rekey(spark, d):
    url = F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string"))
    own = table(spark, d, "events").select(
        F.when(F.col("event_id") % 4 == 0, T.requirement_id(url, "event_type", F.lit("study"))).otherwise(F.concat(F.lit("old"), F.col("event_id").cast("string"))).alias("requirement_id"),
        F.when(F.col("event_id") % 9 != 0, url).alias("url"), F.col("event_type").alias("quote"), F.lit("study").alias("lane"),
    )
    return merge.rekey(own).groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND event_id % 2 = 0)")
def unseen_ids(spark, d):
    events = table(spark, d, "events")
    return merge.unseen_ids(events.where("event_type = 'purchase'"), events.where("event_type = 'error' and event_id % 2 = 0"), "user_id")
