"""Counts and sums over the tables: what is held, what a round did, what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewatch.functions import text as T
from pagewatch.functions import words as W

#: Terms by which a requirement mentions a kind of document.
DOCUMENT_TERMS = {
    "passport": ("passport", "travel document"),
    "english_test": ("english", "ielts", "toefl", "language test"),
    "offer_letter": ("acceptance", "offer", "letter of acceptance", "admission"),
    "bank_statement": ("proof of funds", "bank statement", "enough money", "financial support", "guaranteed investment certificate"),
    "transcript": ("transcript", "academic record", "results"),
    "degree_certificate": ("degree certificate", "degree", "diploma", "qualification", "graduation"),
    "police_certificate": ("police certificate", "police clearance", "criminal record", "criminal check", "character requirement"),
    "medical_exam": ("medical exam", "medical examination", "panel physician", "immunis", "immuniz", "chest x-ray"),
    "birth_certificate": ("birth certificate", "date of birth"),
    "employment_letter": ("employment", "employer", "job offer", "work experience"),
    "professional_registration": ("registration", "licence", "license", "regulator"),
    "marriage_certificate": ("marriage", "spouse", "partner"),
    "national_id": ("national identity", "identity card"),
}


def source_stats(sources: DataFrame, requirements: DataFrame, changes: DataFrame, articles: DataFrame, countries: DataFrame, lanes: tuple[str, ...] = ("study", "work")) -> DataFrame:
    """country (null: all) with daily, pages, study_pages, work_pages, living_pages, robots_blocked, requirements, changes, material, articles, last_read_at.

    countries: country, daily. Each of them has its row, with or without sources, and so has a country that only another table knows; of the total, daily
    is the number of countries that are watched daily. articles: country, hidden; hidden ones don't count. Each table is counted by country on
    its own before they meet; the total is a rollup of the counts.
    """
    lane = lambda x: F.count_if(F.col("lane") == x)
    counts = {
        "pages": sources.groupBy("country").agg(F.count("*").alias("pages"), lane("study").alias("study_pages"), lane("work").alias("work_pages"), lane("living").alias("living_pages"), F.count_if(F.coalesce(F.col("blocked") == "robots_disallowed", F.lit(False))).alias("robots_blocked"), F.max("last_read_at").alias("last_read_at")),
        "requirements": requirements.where(F.col("retired_at").isNull() & F.col("lane").isin(*lanes)).groupBy("country").agg(F.count("*").alias("requirements")),
        "changes": changes.groupBy("country").agg(F.count("*").alias("changes"), F.count_if(F.coalesce("material", F.lit(False))).alias("material")),
        "articles": articles.where(~F.coalesce("hidden", F.lit(False))).groupBy("country").agg(F.count("*").alias("articles")),
    }
    per = countries.groupBy("country").agg(F.max(F.coalesce("daily", F.lit(False)).cast("int")).alias("daily"))
    for own in counts.values():
        per = per.join(own, "country", "full_outer")
    numbers = ["daily", "pages", "study_pages", "work_pages", "living_pages", "robots_blocked", "requirements", "changes", "material", "articles"]
    per = per.where("country is not null").fillna(0, numbers)
    return per.rollup("country").agg(*(F.sum(x).alias(x) for x in numbers), F.max("last_read_at").alias("last_read_at"))


def registry_counts(sources: DataFrame) -> DataFrame:
    """One row: total, readable, blocked, unverified, kinds, countries."""
    return sources.agg(
        F.count("*").alias("total"), F.count_if(F.col("blocked").isNull() & F.col("unverified_reason").isNull()).alias("readable"), F.count("blocked").alias("blocked"),
        F.count("unverified_reason").alias("unverified"), F.count_distinct("kind").alias("kinds"), F.count_distinct("country").alias("countries"),
    )


def corpus_totals(requirements: DataFrame, questions: DataFrame, reads: DataFrame) -> DataFrame:
    """One row: live and retired requirements, open questions, reads, kept, dropped."""
    a = requirements.agg(F.count_if(F.col("retired_at").isNull()).alias("live"), F.count("retired_at").alias("retired"))
    b = questions.agg(F.count("*").alias("questions"))
    c = reads.agg(F.count("*").alias("reads"), F.coalesce(F.sum("kept"), F.lit(0)).alias("kept"), F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped"))
    return a.crossJoin(b).crossJoin(c)  # of one row each


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def round_summary(outcomes: DataFrame) -> DataFrame:
    """Per country, lane and mode: considered, unchanged, changed, unreadable, already_read, kept, dropped, usd."""
    return outcomes.groupBy("country", "lane", "mode").agg(
        F.count("*").alias("considered"), *(F.count_if(F.col("outcome") == x).alias(x.replace(" ", "_")) for x in ("unchanged", "changed", "unreadable", "already read")),
        F.sum("kept").alias("kept"), F.sum("dropped").alias("dropped"), F.sum("usd").alias("usd"),
    )


def round_health(rounds: DataFrame) -> DataFrame:
    """rounds with health: unfinished, N failed, or clean."""
    return rounds.withColumn("health", F.when(F.col("finished_at").isNull(), "unfinished").when(F.col("failed") > 0, F.concat(F.col("failed").cast("string"), F.lit(" failed"))).otherwise("clean"))


def drop_rate(reads: DataFrame) -> DataFrame:
    """lane, kept, dropped, rate: dropped of all proposed; null where nothing was."""
    out = reads.groupBy("lane").agg(F.sum("kept").alias("kept"), F.sum("dropped").alias("dropped"))
    return out.withColumn("rate", F.try_divide("dropped", F.col("dropped") + F.col("kept")))


def live_state(rounds: DataFrame, changes: DataFrame, now: Column, available: Column) -> DataFrame:
    """One row: sums of today, counts of the last seven days, spending and how many days the balance lasts. What nobody recorded is null, not 0."""
    today = F.to_date("started_at") == F.to_date(now)
    week = now - F.expr("interval 7 days")
    a = rounds.agg(
        F.coalesce(F.sum(F.when(today, F.col("fetched"))), F.lit(0)).alias("pages_today"), F.coalesce(F.sum(F.when(today, F.col("unchanged"))), F.lit(0)).alias("unchanged_today"),
        F.coalesce(F.sum(F.when(today, F.col("changed"))), F.lit(0)).alias("moved_today"), F.round(F.sum(F.when(today, F.col("usd"))), 6).alias("spent_today"),
    )
    b = changes.agg(F.count_if(F.col("after_read_at") >= week).alias("changes_week"), F.count_if((F.col("after_read_at") >= week) & F.coalesce("material", F.lit(False))).alias("rule_changes_week"))
    days = rounds.where((F.col("started_at") >= week) & (F.col("usd") > 0)).groupBy(F.to_date("started_at").alias("d")).agg(F.sum("usd").alias("u"))
    c = days.agg(F.floor(available / F.avg("u")).cast("long").alias("runway_days"))
    return a.crossJoin(b).crossJoin(c)  # of one row each


def live_feed(rounds: DataFrame, changes: DataFrame, most: int = 40) -> DataFrame:
    """kind, key, at: the newest of rounds and material changes; the limit is the feature."""
    a = rounds.select(F.lit("round").alias("kind"), F.col("round_id").cast("string").alias("key"), F.col("started_at").alias("at"))
    b = changes.where("material").select(F.lit("change").alias("kind"), F.col("change_id").cast("string").alias("key"), F.col("after_read_at").alias("at"))
    return a.union(b).where("at is not null").orderBy(F.desc("at"), "kind", "key").limit(most)


def document_worth(requirements: DataFrame) -> DataFrame:
    """kind, n: how many requirements (text, quote) mention a kind of document; kinds that none mentions have 0."""
    hay = F.lower(F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("quote", F.lit(""))))

    def says(terms: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for t in terms:
            out = out | hay.contains(t)
        return out

    row = requirements.agg(*(F.count_if(says(terms)).alias(kind) for kind, terms in DOCUMENT_TERMS.items()))
    return row.unpivot([], list(DOCUMENT_TERMS), "kind", "n")


def requirement_profile(requirements: DataFrame, *keys: str) -> DataFrame:
    """Per keys: requirements, concrete (with a digit), share (half to even), costed, timed."""
    out = requirements.groupBy(*keys).agg(F.count("*").alias("requirements"), F.count_if(F.col("text").rlike(r"\d")).alias("concrete"), F.count_if(F.coalesce("cost", F.lit("")) != "").alias("costed"), F.count_if(F.coalesce("duration", F.lit("")) != "").alias("timed"))
    return out.withColumn("share", F.bround(F.col("concrete") * 100 / F.col("requirements")).cast("int"))


def census_share(rows: DataFrame, city: str = "london", boroughs: tuple[str, ...] = W.LONDON_BOROUGHS) -> DataFrame:
    """area, share of people born abroad (per cent, two digits), with one figure for a city that is summed over its boroughs.

    rows: area, category, people. Totals and what doesn't apply count for nothing; categories that begin with "europe: united kingdom" are at home.
    """
    category = F.lower(F.trim("category"))
    own = rows.where(~category.startswith("does not apply") & (category != "total")).select(T.name_key("area").alias("area"), "people", (~category.startswith("europe: united kingdom")).alias("abroad"))
    per = own.groupBy("area").agg(F.sum("people").alias("p"), F.sum(F.when(F.col("abroad"), F.col("people")).otherwise(0)).alias("f"))
    whole = per.where(F.col("area").isin(*boroughs)).agg(F.sum("p").alias("p"), F.sum("f").alias("f")).select(F.lit(city).alias("area"), "p", "f")
    return per.union(whole).where("p > 0").select("area", F.round(F.col("f") * 100 / F.col("p"), 2).alias("share"))


def yearly_peak(counts: DataFrame) -> DataFrame:
    """name, year, n: the largest month of the newest year (of all names), never the sum: one person is in many months."""
    peaks = counts.groupBy("name", "year").agg(F.max("n").alias("n"))
    newest = counts.agg(F.max("year").alias("year"))
    return peaks.join(F.broadcast(newest), "year").select("name", "year", "n")  # newest is one row


def newest(df: DataFrame, at: str, most: int, *ties: str) -> DataFrame:
    """The newest rows; the limit is the feature."""
    return df.orderBy(F.desc(at), *ties).limit(most)


def reason_counts(rows: DataFrame, why: str = "why") -> DataFrame:
    """why, n, place of why rows weren't kept, commonest first. The reasons are few."""
    out = rows.where(F.col(why).isNotNull()).groupBy(why).agg(F.count("*").alias("n"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), why)))


def lanes(countries: DataFrame, names: tuple[str, ...] = ("study", "work"), last: str = "living") -> DataFrame:
    """country, lane, place: every country with every lane in fixed order, and the last lane after all others."""
    every = countries.select("country").distinct().withColumn("lane", F.explode(F.array(*map(F.lit, (*names, last)))))
    order = Window.orderBy((F.col("lane") == last).cast("int"), "country", F.array_position(F.array(*map(F.lit, names)), F.col("lane")))
    return every.withColumn("place", F.row_number().over(order))
