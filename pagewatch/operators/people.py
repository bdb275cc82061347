"""What concerns people: alerts, votes, cases that end, and ranking of countries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewatch.functions import words as W
from pagewatch.functions.text import row_id

PER_KIND = 6
#: Judgements per country, and how far each measured term may move a total.
PR_ROUTE = {"CA": 9, "AU": 8, "PT": 7, "DE": 6, "ES": 5, "FR": 5, "UK": 4, "IT": 4, "US": 3, "SA": 1, "AE": 1}
DEPENDANTS = {"CA": 9, "AU": 7, "DE": 6, "PT": 6, "ES": 5, "FR": 5, "IT": 4, "UK": 3, "US": 3, "AE": 2, "SA": 2}
SELF_SERVE = {"CA": 8, "UK": 8, "AU": 7, "DE": 6, "PT": 6, "FR": 5, "ES": 5, "IT": 4, "US": 5, "AE": 4, "SA": 3}
CAP_CORPUS, CAP_POSTINGS, CAP_MATCH, CAP_COST = 12, 14, 16, 30
#: The wait before anything was measured, its margin, and its bounds, in seconds.
BASE_SECONDS, PER_DOCUMENT_SECONDS, MARGIN, FLOOR_SECONDS, CEILING_SECONDS, SAMPLE = 210.0, 28.0, 1.15, 75.0, 900.0, 40


def alerts_for(watches: DataFrame, changes: DataFrame, occupations: DataFrame, institutions: DataFrame, listings: DataFrame, per_kind: int = PER_KIND) -> DataFrame:
    """alert_id, case_id, kind, key, headline, at: what is new for a watch since its mark, the newest `per_kind` of each kind.

    watches: case_id, country, lane, mark. Material changes of the lane are rules; new occupations go to work, new institutions to other lanes;
    listings (case_id, listing_id, title, first_seen_at) are the case's own. Ids are derived, so that a repeat makes the same rows.
    """

    def newest(df: DataFrame, per: list[str], key: str, headline: str, at: str) -> DataFrame:
        """The newest of each watched thing, found before watches join: what a watch has from after its mark are the first of these."""
        own = df.select(*per, F.col(key).cast("string").alias("key"), F.col(headline).alias("headline"), F.col(at).alias("at")).where("at is not null")
        order = Window.partitionBy(*per).orderBy(F.desc("at"), "key")
        return own.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_kind).drop("_n")

    def new(own: DataFrame, df: DataFrame, on: list[str], kind: str, key: str, headline: str, at: str) -> DataFrame:
        found = own.select("case_id", *(x for x in on if x != "case_id"), "mark").join(newest(df, on, key, headline, at), on).where("at > mark")
        return found.select("case_id", F.lit(kind).alias("kind"), "key", "headline", "at")

    rules = new(watches, changes.where(F.coalesce("material", F.lit(False))), ["country", "lane"], "rule", "change_id", "summary", "after_read_at")
    jobs = new(watches.where("lane = 'work'"), occupations, ["country"], "occupation", "occupation_id", "title", "first_seen_at")
    schools = new(watches.where("lane <> 'work'"), institutions, ["country"], "institution", "institution_id", "name", "first_seen_at")
    posts = new(watches, listings, ["case_id"], "listing", "listing_id", "title", "first_seen_at")
    every = rules.unionByName(jobs).unionByName(schools).unionByName(posts)
    order = Window.partitionBy("case_id", "kind").orderBy(F.desc("at"), "key")
    out = every.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_kind)
    return out.select(row_id(24, "case_id", "kind", "key").alias("alert_id"), "case_id", "kind", "key", "headline", "at")


def undelivered(alerts: DataFrame) -> DataFrame:
    """Alerts that weren't delivered; rank has the oldest of a case first."""
    order = Window.partitionBy("case_id").orderBy("created_at", "alert_id")
    return alerts.where("delivered_at is null").withColumn("rank", F.row_number().over(order))


def unseen_counts(alerts: DataFrame) -> DataFrame:
    """Alerts of a case that nobody has seen."""
    return alerts.groupBy("case_id").agg(F.count_if(F.col("seen_at").isNull()).alias("unseen"))


def tally(votes: DataFrame, options: DataFrame, balances: DataFrame) -> DataFrame:
    """proposal, option, weight (as text), voters: the last vote of a wallet counts with its balance, if that is over 0 and the option is offered.

    Balances are whole numbers of up to 38 digits. Every offered option has a row.
    """
    last = votes.groupBy("proposal", "wallet").agg(F.max_by("option", F.struct("at", "option")).alias("option"))
    own = last.join(balances.select("wallet", F.col("amount").cast("decimal(38,0)").alias("amount")), "wallet").where("amount > 0")
    sums = own.groupBy("proposal", "option").agg(F.sum("amount").cast("decimal(38,0)").alias("w"), F.count("*").alias("n"))
    out = options.join(sums, ["proposal", "option"], "left")
    return out.select("proposal", "option", F.coalesce(F.col("w").cast("string"), F.lit("0")).alias("weight"), F.coalesce("n", F.lit(0)).alias("voters"))


def expire_cases(cases: DataFrame, children: dict[str, DataFrame], now: Column) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """(cases left, children left, counts of rows that go by table) at a moment: a case past expires_at goes with all that is its."""
    gone = cases.where(F.col("expires_at") <= now).select("case_id")
    left = {name: df.join(gone, "case_id", "left_anti") for name, df in children.items()}
    counts = gone.agg(F.lit("cases").alias("table"), F.count("*").alias("n"))
    for name, df in children.items():
        counts = counts.unionByName(df.join(gone, "case_id", "left_semi").agg(F.lit(name).alias("table"), F.count("*").alias("n")))
    return cases.join(gone, "case_id", "left_anti"), left, counts


def _weight(table: dict[str, int], default: int) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), F.col("country")), F.lit(default)).cast("double")


def _share(column: str, per: Window, cap: int) -> Column:
    most = F.greatest(F.max(column).over(per), F.lit(1))
    return F.least(F.col(column) / most, F.lit(1.0)) * cap


def score_work(eligible: DataFrame, has_partner: bool = False) -> DataFrame:
    """eligible (case_id, country, n_reasons, requirements, postings) with total and place: measured terms are relative to the best of the case."""
    per = Window.partitionBy("case_id")
    total = _weight(PR_ROUTE, 4) + _weight(SELF_SERVE, 5) + _share("n_reasons", per, CAP_MATCH) + _share("requirements", per, CAP_CORPUS) + _share("postings", per, CAP_POSTINGS)
    if has_partner:
        total = total + _weight(DEPENDANTS, 4)
    return _placed(eligible.withColumn("total", total))


def score_study(eligible: DataFrame, costs: DataFrame, research: bool = False, has_partner: bool = False) -> DataFrame:
    """eligible (case_id, country, n_reasons, requirements) with total and place; costs: country, cost (null or 0 is unknown and scores 0)."""
    per = Window.partitionBy("case_id")
    own = eligible.join(costs.select("country", F.col("cost").cast("double").alias("_c")), "country", "left")
    known = F.when(F.col("_c") > 0, F.col("_c"))
    cost = F.coalesce(F.greatest(F.lit(0.0), F.min(known).over(per) / known * 2 - 1) * CAP_COST, F.lit(0.0))
    total = _weight(PR_ROUTE, 4) + _weight(SELF_SERVE, 5) + _share("n_reasons", per, CAP_MATCH) + _share("requirements", per, CAP_CORPUS) + cost
    if has_partner:
        partner = _weight(DEPENDANTS, 4)
        total = total + (F.least(F.lit(10.0), partner + 4) if research else partner)
    return _placed(own.withColumn("total", total).drop("_c"))


def _placed(df: DataFrame) -> DataFrame:
    # Rounded, so that totals that are equal but for the last bit tie.
    return df.withColumn("place", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc(F.round("total", 9)), "country")))


def bucket(documents: Column) -> Column:
    return F.when(documents <= 0, "none").when(documents <= 2, "few").when(documents <= 5, "some").otherwise("many")


def run_estimate(times: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """bucket, n, seconds, measured: the wait to tell, from the newest `sample` runs (documents, seconds, at) of like size.

    The run at round(0.9 (n - 1)) of them in order, and a margin; with fewer than three runs the constant of the bucket's least documents.
    """
    own = times.where("seconds > 0").withColumn("bucket", bucket(F.col("documents")))
    newest = Window.partitionBy("bucket").orderBy(F.desc("at"), "seconds")
    own = own.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= sample)
    out = own.groupBy("bucket").agg(F.sort_array(F.collect_list("seconds")).alias("t"), F.min("documents").alias("d"))
    n = F.size("t")
    index = F.least(n - 1, F.bround((n - 1) * 0.9).cast("int"))
    seconds = F.when(n < 3, BASE_SECONDS + PER_DOCUMENT_SECONDS * F.greatest(F.col("d"), F.lit(0))).otherwise(F.get("t", index) * MARGIN)
    return out.select("bucket", n.cast("long").alias("n"), F.greatest(F.lit(FLOOR_SECONDS), F.least(F.lit(CEILING_SECONDS), seconds)).alias("seconds"), (n >= 3).alias("measured"))


def coverage_score(requirements: DataFrame, matches: DataFrame, action: tuple[str, ...] = W.ACTION_CATEGORIES) -> DataFrame:
    """case_id, satisfiable, covered, score (floor of per cent), unverified. Requirements of action categories aren't satisfied by documents."""
    own = requirements.where(~F.col("category").isin(*action)).select("case_id", "requirement_id")
    found = matches.groupBy("case_id", "requirement_id").agg(F.count_if(~F.col("verified")).alias("_u"))
    out = own.join(found, ["case_id", "requirement_id"], "left").groupBy("case_id").agg(F.count("*").alias("satisfiable"), F.count("_u").alias("covered"), F.coalesce(F.sum("_u"), F.lit(0)).alias("unverified"))
    return out.withColumn("score", F.floor(F.col("covered") * 100 / F.col("satisfiable")).cast("int"))


def reading_order(institutions: DataFrame) -> DataFrame:
    """institution_id, country, rank, place: eligible schools by score within a country; places go to the countries in turn.

    institutions: institution_id, country, name, website, higher_ed, routes, score. Scores of different countries aren't compared. A place is the
    number of schools of smaller rank, counted per country, and the turn of the country among those that have one of this rank.
    """
    routes = F.coalesce("routes", F.array().cast("array<string>"))
    own = institutions.where((F.coalesce("website", F.lit("")) != "") & F.coalesce("higher_ed", F.lit(False)) & ((F.size(routes) == 0) | F.array_contains(routes, "Student")))
    rank = F.row_number().over(Window.partitionBy("country").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "name", "institution_id"))
    own = own.withColumn("rank", rank).select("institution_id", "country", "rank")
    sizes = own.groupBy("country").agg(F.count("*").alias("n"))
    sizes = F.broadcast(sizes.agg(F.sort_array(F.collect_list(F.struct("country", "n"))).alias("_sizes")))  # of one row: a country each
    before = F.aggregate("_sizes", F.lit(0).cast("long"), lambda s, x: s + F.least(x["n"], F.col("rank") - 1) + ((x["country"] <= F.col("country")) & (x["n"] >= F.col("rank"))).cast("long"))
    return own.crossJoin(sizes).select("institution_id", "country", "rank", before.cast("int").alias("place"))
