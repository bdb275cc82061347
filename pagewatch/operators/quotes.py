"""The quote check: what somebody proposed is kept only if its words are on the page, and each drop has its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewatch.functions import text as T
from pagewatch.functions import words as W

NO_QUOTE, NOT_ON_PAGE = "no quote given", "the quote is not on the page"
WINDOW_CHARS = 30_000
COURSES_A_PAGE = 40
CV_KINDS = ("role", "skill", "qualification", "certification", "language")


def folded_pages(pages: DataFrame, key: str = "page_id", text: str = "text", plain: bool = False) -> DataFrame:
    """key and haystack: each page folded once, before any join. plain: the text is in NFKC already."""
    return pages.select(key, (T.fold_plain if plain else T.fold)(text).alias("haystack"))


def against(proposals: DataFrame, pages: DataFrame, key: str = "page_id") -> DataFrame:
    """proposals with their page's haystack; a missing page gives null, which holds no quote.

    One shuffle on the page, of the folded text and the proposals. No pair of a proposal and another page is ever made.
    """
    return proposals.join(pages, key, "left")


def on_page(quote: Column, plain: bool = False) -> Column:
    needle = (T.fold_plain if plain else T.fold)(quote)
    return F.coalesce((needle != "") & F.col("haystack").contains(needle), F.lit(False))


def _blank(x: str) -> Column:
    return F.trim(F.coalesce(F.col(x), F.lit(""))) == ""


def check_quotes(proposals: DataFrame, pages: DataFrame, key: str = "page_id", plain: bool = False) -> DataFrame:
    """proposals (key, text, quote, ...) with kept and why. pages: key, haystack."""
    why = F.when(_blank("text") | _blank("quote"), NO_QUOTE).when(~on_page(F.col("quote"), plain), NOT_ON_PAGE)
    return against(proposals, pages, key).withColumn("why", why).withColumn("kept", F.col("why").isNull()).drop("haystack")


def check_occupations(proposals: DataFrame, pages: DataFrame, key: str = "page_id", plain: bool = False) -> DataFrame:
    """As check_quotes with title for text; the title has to be inside its quote too. The first reason that fails is given."""
    fold = T.fold_plain if plain else T.fold
    why = F.when(_blank("title") | _blank("quote"), NO_QUOTE).when(~on_page(F.col("quote"), plain), NOT_ON_PAGE).when(~fold("quote").contains(fold("title")), "the quote does not contain this occupation")
    return against(proposals, pages, key).withColumn("why", why).withColumn("kept", F.col("why").isNull()).drop("haystack")


def check_courses(proposals: DataFrame, pages: DataFrame, levels: tuple[str, ...], key: str = "page_id", order: str = "pos", most: int = COURSES_A_PAGE, plain: bool = False) -> DataFrame:
    """Courses: the first `most` proposals of a page; a level of the list; a quote on the page."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(order)) <= most
    own = proposals.withColumn("_first", first).where("_first").drop("_first")
    why = F.when(_blank("title") | _blank("quote"), NO_QUOTE).when(~F.lower("level").isin(*levels), "not a level this library knows").when(~on_page(F.col("quote"), plain), NOT_ON_PAGE)
    return against(own, pages, key).withColumn("why", why).withColumn("kept", F.col("why").isNull()).drop("haystack")


def check_course_details(details: DataFrame, pages: DataFrame, key: str = "page_id", plain: bool = False) -> DataFrame:
    """Fee and intake are kept each for its own quote: fee, fee_quote, intake, intake_quote."""
    own = against(details, pages, key)
    for field in ("fee", "intake"):
        own = own.withColumn(field, F.when(on_page(F.col(f"{field}_quote"), plain), F.col(field)))
    return own.drop("haystack")


def check_article_claims(claims: DataFrame, pages: DataFrame, plain: bool = False) -> DataFrame:
    """Claims of stories (story_id, claim_id, section, claim, quote) against the story's pages (story_id, page_index, haystack).

    The lowest page that has the quote is the claim's source, from 1. A claim's pages meet it by the story, and come back to one row a claim.
    """
    found = F.when(on_page(F.col("quote"), plain), F.col("page_index"))
    ids = [x for x in claims.columns if x != "story_id"]
    own = claims.join(pages, "story_id", "left").groupBy("story_id", *ids).agg(F.min(found).alias("_at"))
    why = F.when(_blank("claim"), "empty claim").when(_blank("quote"), NO_QUOTE).when(F.col("_at").isNull(), NOT_ON_PAGE)
    return own.withColumn("why", why).withColumn("kept", F.col("why").isNull()).withColumn("source", F.when(F.col("kept"), F.col("_at") + 1)).drop("_at")


def check_fields(fields: DataFrame, docs: DataFrame, key: str = "doc_id", kinds: tuple[str, ...] | None = None, plain: bool = False) -> DataFrame:
    """Fields read off documents (key, name, value, quote) with state: verified, unverified or dropped.

    docs: key, text_source (pdf, ocr or none), haystack. Without text nothing can be checked, and a miss in recognised text proves
    nothing: both stay, unverified. A miss in a text layer is dropped. kinds limits the names that count.
    """
    own = fields.where(~_blank("name") & ~_blank("value"))
    if kinds is not None:
        own = own.where(F.col("name").isin(*kinds))
    own = own.join(docs.select(key, "text_source", "haystack"), key, "left")
    source = F.coalesce("text_source", F.lit("none"))
    state = F.when(source == "none", "unverified").when(on_page(F.col("quote"), plain), "verified").when(source == "ocr", "unverified").otherwise("dropped")
    return own.withColumn("state", state).drop("haystack")


def check_lanes(proposals: DataFrame, pages: DataFrame, lanes: tuple[str, ...] = ("study", "work"), key: str = "page_id", plain: bool = False) -> DataFrame:
    """A row per page of proposals (key, lane, quote; lane "none" for an off-topic quote): lanes, off_topic, answered, dropped.

    An off-topic quote counts only where no lane survived.
    """
    own = against(proposals.withColumn("lane", F.lower(F.trim("lane"))), pages, key).withColumn("_ok", on_page(F.col("quote"), plain))
    kept = F.sort_array(F.collect_set(F.when(F.col("_ok") & F.col("lane").isin(*lanes), F.col("lane"))))
    off = F.max(F.when(F.col("_ok") & (F.col("lane") == "none"), F.col("quote")))
    missed = F.count_if(~F.col("_ok") & F.col("lane").isin(*lanes))
    missed_off = F.count_if(~F.col("_ok") & (F.col("lane") == "none"))
    out = own.groupBy(key).agg(kept.alias("lanes"), off.alias("_off"), missed.alias("_a"), missed_off.alias("_b"))
    none = F.size("lanes") == 0
    return out.select(key, "lanes", F.when(none, F.col("_off")).alias("off_topic"), (~none | F.col("_off").isNotNull()).alias("answered"), (F.col("_a") + F.when(none, F.col("_b")).otherwise(0)).alias("dropped"))


def off_lane_pages(sources: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Deeper government pages whose answered verdict doesn't serve the lane they are filed under: held back."""
    own = sources.join(verdicts.select("source_id", "lanes", "answered"), "source_id")
    return own.where((F.coalesce("depth", F.lit(0)) >= 1) & F.col("lane").isin("study", "work") & (F.col("kind") == "government") & F.col("answered") & ~F.expr("array_contains(lanes, lane)"))


def second_read(requirements: DataFrame, pages: DataFrame, answers: DataFrame, countries: tuple[str, ...], window: int = WINDOW_CHARS, plain: bool = False) -> DataFrame:
    """requirements with state: agreed, disputed or unverified, and open_question where the second reader disputes.

    The quote has to be inside the window that the second reader saw, else nothing was checked. Countries that weren't measured are
    left alone (null).
    """
    seen = pages.select("page_id", F.left("haystack", F.lit(window)).alias("haystack"))
    own = requirements.join(seen, "page_id", "left").join(answers.select("requirement_id", "answer"), "requirement_id", "left")
    state = F.when(~F.col("country").isin(*countries), F.lit(None)).when(~on_page(F.col("quote"), plain), "unverified").otherwise(T.read_verdict("answer"))
    return own.withColumn("state", state).withColumn("open_question", F.coalesce(F.col("state") == "disputed", F.lit(False))).drop("haystack", "answer")


def check_citations(lines: DataFrame, known: DataFrame, page: str = "page_id", cites: str = "cites", key: str = "line_id") -> DataFrame:
    """lines with the citations that are known on their page, each once and in their order, and kept: some are left. known: page, requirement_id.

    key tells lines apart. Citations are a row each and meet what is known by page and requirement, so that no list of a page's
    requirements is made; what is left comes together per line.
    """
    own = lines.select(key, page, F.posexplode(F.array_distinct(cites)).alias("_at", "requirement_id"))
    found = own.join(known.select(page, "requirement_id").distinct(), [page, "requirement_id"], "left_semi")
    left = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", "requirement_id"))).alias("_left"))
    some = F.transform(F.coalesce("_left", F.array().cast(left.schema["_left"].dataType)), lambda x: x["requirement_id"])
    return lines.join(left, key, "left").withColumn(cites, some).withColumn("kept", F.size(cites) > 0).drop("_left")


def known_topics(topics: T.Col) -> Column:
    """The topics of a guide that are on the list, in their order."""
    return F.filter(T.c(topics), lambda t: F.array_contains(T.words_in(W.GUIDE_TOPICS), t))


def check_coverage(matches: DataFrame, requirements: DataFrame, fields: DataFrame) -> DataFrame:
    """matches (case_id, requirement_id, field_id) with why: an unknown requirement, a field that wasn't uploaded, or said already.

    Once per requirement of a case: the first by field counts.
    """
    known = requirements.select("requirement_id").distinct().withColumn("_r", F.lit(True))
    own = matches.join(known, "requirement_id", "left").join(fields.select("case_id", "field_id").distinct().withColumn("_f", F.lit(True)), ["case_id", "field_id"], "left")
    why = F.when(F.col("_r").isNull(), "no such requirement").when(F.col("_f").isNull(), "no such field was uploaded")
    own = own.withColumn("why", why)
    order = F.row_number().over(Window.partitionBy("case_id", "requirement_id", F.col("why").isNull()).orderBy("field_id"))
    own = own.withColumn("why", F.when(F.col("why").isNull() & (order > 1), "said already").otherwise(F.col("why")))
    return own.withColumn("kept", F.col("why").isNull()).drop("_r", "_f")


def score_fit(matches: DataFrame, claims: DataFrame, postings: DataFrame, plain: bool = False) -> DataFrame:
    """A row per case: asked, met, score (per cent, half to even).

    matches: case_id, posting_id, asks_for, quote, met, evidence. A requirement counts if its quote is in the posting. It is met only
    if the evidence is a claim of the case, contains one or is inside one (more than two characters); else it stays, unmet.
    """
    fold = T.fold_plain if plain else T.fold
    own = matches.join(postings.select("posting_id", "haystack"), "posting_id", "left").where(~_blank("asks_for") & on_page(F.col("quote"), plain)).drop("haystack")
    own = own.withColumn("_e", fold(F.coalesce("evidence", F.lit(""))))
    known = claims.select("case_id", fold("value").alias("_claim")).distinct()
    evidence = F.col("_e")
    backs = (evidence == F.col("_claim")) | ((F.length(evidence) > 2) & (F.length("_claim") > 2) & (F.col("_claim").contains(evidence) | evidence.contains(F.col("_claim"))))
    # Evidence is looked at once a case, and tells rows apart by what they say.
    held = own.where("met and _e <> ''").select("case_id", "_e").distinct().join(known, "case_id").where(backs).select("case_id", "_e").distinct()
    own = own.join(held.withColumn("_h", F.lit(True)), ["case_id", "_e"], "left").withColumn("_held", F.coalesce("_h", F.lit(False)) & F.coalesce("met", F.lit(False)))
    out = own.groupBy("case_id").agg(F.count("*").alias("asked"), F.count_if("_held").alias("met"))
    return out.withColumn("score", F.when(F.col("asked") == 0, 0).otherwise(F.bround(F.col("met") * 100 / F.col("asked"))).cast("int"))


def invented_numbers(drafts: DataFrame, claims: DataFrame, key: str = "case_id") -> DataFrame:
    """drafts with invented: figures of two digits and more in the text that are in no claim of the case.

    Figures are rows on both sides: a draft's meet those of its case's claims by equality, and no case's figures come together.
    """
    said = claims.select(key, F.explode(T.numbers_in(F.concat_ws(" ", "value", "quote", "detail"))).alias("_n"))
    own = drafts.select(key, "text").distinct().withColumn("_n", F.explode(F.filter(F.array_distinct(T.numbers_in("text")), lambda x: F.length(x) > 1)))
    left = own.join(said, [key, "_n"], "left_anti").groupBy(F.col(key).alias("_k"), F.col("text").alias("_t")).agg(F.sort_array(F.collect_list("_n")).alias("_new"))
    out = drafts.join(left, F.col(key).eqNullSafe(F.col("_k")) & F.col("text").eqNullSafe(F.col("_t")), "left").drop("_k", "_t")
    return out.withColumn("invented", F.coalesce("_new", F.array().cast("array<string>"))).drop("_new")
