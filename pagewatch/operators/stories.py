"""Changes as stories, written fields in house style, guides, and search."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types

from pagewatch.functions import text as T
from pagewatch.functions import words as W
from pagewatch.operators.graph import components

MIN_REQUIREMENTS, MAX_REQUIREMENTS = 10, 140
#: Changes of a country's day beyond which it is parted into components.
SPLIT_ROWS = 200_000


def _stems(text: str) -> set[str]:
    out = set()
    for w in re.findall(r"[a-z0-9]+", text.lower()):
        if len(w) > 2 and w not in W.STORY_STOP:
            out.add(next((w[: -len(s)] for s in ("ing", "ed", "es", "s") if w.endswith(s) and len(w) > len(s) + 3), w))
    return out


def alike(a: set[str], b: set[str], threshold: float = 0.35) -> bool:
    shared = a & b
    return bool(shared) and any(map(_telling, shared)) and len(shared) / min(len(a), len(b)) >= threshold


def _telling(stem: str) -> bool:
    return len(stem) >= 4 and stem not in W.STORY_GENERIC


class Stories:
    """Groups of changes in the order they began. A change joins the first one that has its page or tells the same story.

    Groups are looked up by page and by telling stems, of which alike() needs one in common, so that a change meets only those that may be its.
    """

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.first: list[object] = []
        self.stems: list[set[str]] = []
        self.by_url: dict[object, int] = {}
        self.by_stem: dict[str, set[int]] = defaultdict(set)

    def add(self, change: object, url: object, summary: str | None) -> object:
        own = _stems(summary or "")
        near = set().union(*(self.by_stem[x] for x in own if x in self.by_stem and _telling(x)))
        if url in self.by_url:
            near.add(self.by_url[url])
        k = next((k for k in sorted(near) if self.by_url.get(url) == k or alike(self.stems[k], own, self.threshold)), len(self.first))
        if k == len(self.first):
            self.first.append(change)
            self.stems.append(set())
        for stem in own - self.stems[k]:
            self.by_stem[stem].add(k)
        self.stems[k] |= own
        self.by_url[url] = min(k, self.by_url.get(url, k))
        return self.first[k]


def cluster_changes(changes: DataFrame, threshold: float = 0.35, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """changes (change_id, country, source_url, summary, after_read_at) with story: the first change of the group.

    By read time, a change joins the first group of its country and day with the same page or the same story. That depends on the
    order, but a change can only join a group with which it shares the page or a stem that tells stories apart. So a country's day of more than split_rows changes is
    parted into the connected components of changes, pages and telling stems, and each component is gone through in order, row by row, in a task that
    holds its groups' stems and no rows. Smaller days are gone through whole, which gives the same. A null summary has no stems; null pages are one page.
    """
    own = changes.select("change_id", "country", "source_url", "summary", "after_read_at", F.to_date("after_read_at").alias("day"))
    schema = types.StructType([*own.schema.fields, types.StructField("story", own.schema["change_id"].dataType)])
    key = ("country", "day", "_part")
    same_day = F.col("country").eqNullSafe(F.col("_c")) & F.col("day").eqNullSafe(F.col("_d"))
    large = own.groupBy(F.col("country").alias("_c"), F.col("day").alias("_d")).count().where(F.col("count") > split_rows).drop("count")
    dealt = own.withColumn("_part", F.lit(0).cast("long"))
    if large.limit(1).count():
        dealt = own.join(large, same_day, "left_anti").withColumn("_part", F.lit(0).cast("long")).unionByName(_parted(own.join(large, same_day, "left_semi")))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, groups = None, Stories(threshold)
        for batch in batches:
            story = []
            for *place, change, url, summary in zip(*(batch[k].to_pylist() for k in (*key, "change_id", "source_url", "summary")), strict=True):
                if place != at:
                    at, groups = place, Stories(threshold)
                story.append(groups.add(change, url, summary))
            kept = batch.drop_columns(["_part"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(story, batch["change_id"].type)], names=[*kept.schema.names, "story"])

    return dealt.repartition(*key).sortWithinPartitions(*key, "after_read_at", "change_id").mapInArrow(stream, schema)


def _parted(changes: DataFrame) -> DataFrame:
    """changes with _part: a number for each connected component of changes, pages and telling stems. Equal hashes join components, which does no harm."""
    own = changes.withColumn("_node", F.xxhash64("country", "day", "change_id"))
    telling = F.filter(T.story_stems("summary"), lambda w: (F.length(w) >= 4) & ~F.array_contains(T.words_in(W.STORY_GENERIC), w))
    page = F.xxhash64("country", "day", F.lit(1), "source_url")
    shared = F.array_union(F.array(page), F.transform(telling, lambda w: F.xxhash64("country", "day", F.lit(2), w)))
    keys = own.select("_node", F.explode(shared).alias("_key")).distinct()
    links = keys.join(keys.groupBy("_key").agg(F.min("_node").alias("b")), "_key").select(F.col("_node").alias("a"), "b")
    found = components(links)
    return own.join(found.select(F.col("a").alias("_node"), F.col("b").alias("_root")), "_node", "left").withColumn("_part", F.coalesce("_root", "_node")).drop("_node", "_root")


def pending_stories(changes: DataFrame, done: DataFrame, articles: DataFrame, now: Column, days: int, threshold: float = 0.35) -> DataFrame:
    """story, country, day, changes (sorted ids), article_id of material changes of the last days that are to be written.

    done: article_id of what is written or was skipped. articles: country, day, summary; a story that one of its country and day tells is
    out. Articles meet stories of their country and day only.
    """
    own = changes.where(F.coalesce("material", F.lit(False)) & (F.col("after_read_at") >= F.date_sub(now, days)))
    told = cluster_changes(own, threshold)
    grouped = told.groupBy("country", "day", "story").agg(F.sort_array(F.collect_list(F.col("change_id").cast("string"))).alias("changes"))
    grouped = grouped.withColumn("article_id", T.article_id("changes")).join(done.select("article_id"), "article_id", "left_anti")
    # Stems are rows: a story's and an article's meet by equality, and no text of a whole story is put together.
    place = ["country", "day"]
    mine = told.select(*place, "story", F.explode(T.story_stems("summary")).alias("_w")).distinct()
    theirs = articles.select(*place, "summary").distinct().withColumn("_w", F.explode(T.story_stems("summary"))).select(*place, F.col("summary").alias("_s"), "_w").distinct()
    telling = (F.length("_w") >= 4) & ~F.array_contains(T.words_in(W.STORY_GENERIC), F.col("_w"))
    both = mine.join(theirs, [*place, "_w"]).groupBy(*place, "story", "_s").agg(F.count("*").alias("_n"), F.bool_or(telling).alias("_t"))
    both = both.join(mine.groupBy(*place, "story").agg(F.count("*").alias("_a")), [*place, "story"]).join(theirs.groupBy(*place, "_s").agg(F.count("*").alias("_b")), [*place, "_s"])
    twins = both.where(F.col("_t") & (F.col("_n") / F.least("_a", "_b") >= threshold)).select(*place, "story").distinct()
    return grouped.join(twins, [*place, "story"], "left_anti").select("story", "country", "day", "changes", "article_id")


def admin_only(groups: DataFrame, key: str = "story") -> DataFrame:
    """key, admin: all changes of a group are about hours or contact details only."""
    return groups.groupBy(key).agg(F.bool_and(T.admin_summary("summary")).alias("admin"))


def publishable(who_for: T.Col, what_changed: T.Col, dates: T.Col) -> Column:
    """Why an article can't go out by what its sections kept, or null."""
    return F.when(F.coalesce(F.size(T.c(who_for)), F.lit(0)) < 1, "no line of who it is for survived the quote check").when((F.coalesce(F.size(T.c(what_changed)), F.lit(0)) < 1) & (F.coalesce(F.size(T.c(dates)), F.lit(0)) < 1), "nothing about what changed survived the quote check")


def voice_gate(fields: DataFrame) -> DataFrame:
    """fields (doc_id, field, text) tidied, with hits and kept; quotes are never touched. A "why" or a guide's line that breaks the style is dropped."""
    tidied = F.when(F.col("field") == "quote", F.col("text")).otherwise(T.tidy("text"))
    own = fields.withColumn("text", tidied).withColumn("hits", F.when(F.col("field") == "quote", F.array().cast("array<string>")).otherwise(T.voice_hits("text")))
    return own.withColumn("kept", ~(F.col("field").isin("why", "line") & (F.size("hits") > 0)))


def lead_first(articles: DataFrame, days: int = 3) -> DataFrame:
    """articles (article_id, observed_on, groups, conditions, dates) with weight and place: the heaviest of the newest days leads, others go by date.

    A place is the number of articles of earlier days, and the rank within the day: only the days are one sorted list.
    """
    own = articles.withColumn("weight", F.col("groups") * 2 + F.col("conditions") + F.col("dates"))
    newest = own.agg(F.max("observed_on").alias("_newest"))
    own = own.crossJoin(F.broadcast(newest))  # of one row
    recent = F.col("observed_on") >= F.date_sub("_newest", days)
    lead = own.where(recent).agg(F.max_by("article_id", F.struct("weight", "observed_on", "article_id")).alias("_lead"))
    own = own.crossJoin(F.broadcast(lead))  # of one row
    own = own.withColumn("_other", (F.col("article_id") != F.col("_lead")).cast("int")).drop("_newest", "_lead")
    earlier = F.sum("_n").over(Window.orderBy("_other", F.desc("observed_on")).rowsBetween(Window.unboundedPreceding, -1))
    counts = own.groupBy("_other", "observed_on").agg(F.count("*").alias("_n"))
    days = counts.select(F.col("_other").alias("_o"), F.col("observed_on").alias("_day"), F.coalesce(earlier, F.lit(0)).alias("_earlier"))
    rank = F.row_number().over(Window.partitionBy("_other", "observed_on").orderBy("article_id"))
    placed = own.withColumn("_rank", rank).join(days, F.col("_other").eqNullSafe(F.col("_o")) & F.col("observed_on").eqNullSafe(F.col("_day")))
    return placed.withColumn("place", (F.col("_earlier") + F.col("_rank")).cast("int")).drop("_other", "_o", "_day", "_earlier", "_rank")


def guide_candidates(requirements: DataFrame, least: int = MIN_REQUIREMENTS, most: int = MAX_REQUIREMENTS) -> DataFrame:
    """guide_id, source_url, country, lane, n, fingerprint of pages with enough live requirements; of each page the first `most` by id."""
    live = requirements.where(F.col("retired_at").isNull() & (F.coalesce("source_url", F.lit("")) != ""))
    order = Window.partitionBy("source_url").orderBy("requirement_id")
    first = live.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    own = first.groupBy("source_url").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("requirement_id", "text"))).alias("_r"), F.min_by(F.struct("country", "lane"), "requirement_id").alias("_f"))
    text = F.array_join(F.transform("_r", lambda x: F.concat_ws(":", x["requirement_id"], F.coalesce(x["text"], F.lit("")))), "|")
    return own.where(F.col("n") >= least).select(F.substring(F.sha2("source_url", 256), 1, 16).alias("guide_id"), "source_url", "_f.country", "_f.lane", "n", F.substring(F.sha2(text, 256), 1, 20).alias("fingerprint"))


def stale_guides(candidates: DataFrame, guides: DataFrame) -> DataFrame:
    """Candidates without a stored guide of the same fingerprint."""
    own = candidates.join(guides.select("guide_id", F.col("fingerprint").alias("_f")), "guide_id", "left")
    return own.where(~F.col("fingerprint").eqNullSafe(F.col("_f"))).drop("_f")


def merge_requirements(requirements: DataFrame) -> DataFrame:
    """category, text, requirement_id, source_url, n_pages: one row per folded text of a category, the newest read, and how many pages say it."""
    own = requirements.withColumn("_k", T.fold_ci("text"))
    # One row per page before pages are counted.
    pages = own.groupBy("category", "_k", "source_url").agg(F.max(F.struct("read_at", "requirement_id", "text")).alias("r"))
    merged = pages.groupBy("category", "_k").agg(F.max_by(F.struct("r", "source_url"), F.struct("r", "source_url")).alias("p"), F.count("source_url").alias("n_pages"))
    return merged.select("category", "p.r.text", "p.r.requirement_id", "p.source_url", "n_pages")


def also_said(requirements: DataFrame, merged: DataFrame) -> DataFrame:
    """requirement_id (of a merged row) and also: each other page that says it, a row each, so that a sentence on very many pages is no long list."""
    key = [F.col("category"), T.fold_ci("text").alias("_k")]
    own = requirements.where("source_url is not null").select(*key, F.col("source_url").alias("also")).distinct()
    return own.join(merged.select(*key, "requirement_id", "source_url"), ["category", "_k"]).where(~F.col("also").eqNullSafe(F.col("source_url"))).select("requirement_id", "also")


def lane_requirements(requirements: DataFrame, lane: str, categories: tuple[str, ...] = W.CATEGORIES, near: DataFrame | None = None) -> DataFrame:
    """Live rows of a lane, of near pages only if a table of them is given, with rank of their category for ordering."""
    own = requirements.where(F.col("retired_at").isNull() & (F.col("lane") == lane))
    if near is not None:
        own = own.join(near.select("source_url").distinct(), "source_url", "left_semi")
    known = F.array_position(F.array(*map(F.lit, categories)), F.col("category"))
    return own.withColumn("rank", F.when(known > 0, known).otherwise(len(categories) + 1))


#: Letters from which a search word stands for all words that begin with it; the index is grouped by as many.
PREFIX = 4
POINTS = {"t": 5, "s": 2, "b": 1}


def index_documents(docs: DataFrame) -> DataFrame:
    """stem, word, doc_id, points, guide, date of documents (doc_id, kind, date, title, summary, body): the table that searches read.

    A row for each word of a document and each part that has it; stem is a word's first PREFIX letters. Stored sorted by stem and word, a search
    reads the few row groups of its words.
    """

    def part(column: str, points: int) -> Column:
        return F.transform(F.array_distinct(T.search_words(column)), lambda w: F.struct(w.alias("word"), F.lit(points).alias("points")))

    words = F.explode(F.concat(*(part(x, POINTS[f]) for x, f in (("title", "t"), ("summary", "s"), ("body", "b")))))
    own = docs.select("doc_id", (F.col("kind") == "guide").cast("int").alias("guide"), "date", words.alias("w"))
    return own.select(F.substring("w.word", 1, PREFIX).alias("stem"), "w.word", "doc_id", "w.points", "guide", "date").where("word <> ''")


def search_terms(query: str) -> list[str]:
    import unicodedata

    plain = unicodedata.normalize("NFKD", query).encode("ascii", "ignore").decode().lower()
    return [w for w in re.findall(r"[a-z0-9]+", plain) if w not in W.SEARCH_STOP][:8]


def search(docs: DataFrame, query: str, most: int = 40) -> DataFrame:
    """search_index over documents without a stored index: each is read."""
    return search_index(index_documents(docs), query, most)


def search_index(index: DataFrame, query: str, most: int = 40) -> DataFrame:
    """doc_id, score, date of documents that have all of a query's words (eight at most): prefixes of four letters and more, else whole words.

    index: index_documents' rows, as stored; only those that begin like a word of the query are read. A title counts 5, a summary 2, a body 1, each
    by prefix and once a word, and a guide 1 more. The limit is the feature.
    """
    terms = search_terms(query)
    begins, rows = _begins(terms)
    own = index.where(rows)
    every, score = F.lit(bool(terms)), F.max("guide")
    for w, b in zip(terms, begins, strict=True):
        every = every & F.bool_or(b if len(w) >= PREFIX else F.col("word") == w)
        for points in POINTS.values():
            score = score + F.when(F.bool_or(b & (F.col("points") == points)), points).otherwise(0)
    found = own.groupBy("doc_id").agg(score.alias("score"), F.max("date").alias("date"), every.alias("_every"))
    return found.where("_every").select("doc_id", "score", "date").orderBy(F.desc("score"), F.desc("date"), "doc_id").limit(most)


# A stored index in blocks: postings, and for each word and block the best that the block's documents can score by it.

#: Documents of a block, at most on average, and blocks that a search reads before it knows how far it has to go.
BLOCK_DOCS, FIRST_BLOCKS = 4096, 8


def write_index(docs: DataFrame, path: str, block_docs: int = BLOCK_DOCS) -> None:
    """Write the index of documents (as index_documents) to path: postings and blocks, both sorted by stem and word.

    A block is documents of one date, so that of equal scores the blocks of the newest come first; a date of very many documents is several. For each
    word and block: the parts that have the word in some document (a bit for each of title, summary and body), the most points that a document has by it, and the most with those of a guide.
    """
    spark = docs.sparkSession
    sizes = docs.groupBy(F.col("date").alias("_d")).agg(F.ceil(F.count("*") / block_docs).cast("int").alias("_n"))
    own = docs.join(sizes, F.col("date").eqNullSafe(F.col("_d")))
    block = F.concat_ws("/", F.coalesce(F.col("date").cast("string"), F.lit("")), F.pmod(F.xxhash64("doc_id"), "_n").cast("string"))
    rows = index_documents(own).join(own.select("doc_id", block.alias("block")), "doc_id")
    rows.repartitionByRange("stem", "word", "block").sortWithinPartitions("stem", "word", "block").write.mode("overwrite").parquet(f"{path}/postings")
    bit = F.when(F.col("points") == POINTS["t"], 4).when(F.col("points") == POINTS["s"], 2).otherwise(1)
    per_doc = spark.read.parquet(f"{path}/postings").groupBy("stem", "word", "block", "doc_id").agg(F.sum("points").cast("int").alias("points"), F.max("guide").alias("guide"), F.max("date").alias("date"), F.bit_or(bit).alias("parts"))
    blocks = per_doc.groupBy("stem", "word", "block").agg(F.bit_or("parts").alias("parts"), F.max("points").alias("points"), F.max(F.col("points") + F.col("guide")).alias("with_guide"), F.max("guide").alias("guide"), F.max("date").alias("date"))
    blocks.repartitionByRange("stem", "word").sortWithinPartitions("stem", "word").write.mode("overwrite").parquet(f"{path}/blocks")


def _begins(terms: list[str]) -> tuple[list[Column], Column]:
    """For each term, the words that begin with it; and the rows of any, by stem as well, which the scan can skip by."""
    begins = [F.col("word").startswith(w) for w in terms]
    rows = F.lit(False)
    for w, b in zip(terms, begins, strict=True):
        rows = rows | ((F.col("stem") == w[:PREFIX]) & b if len(w) >= PREFIX else F.col("stem").startswith(w) & b)
    return begins, rows


def ranked_blocks(blocks: DataFrame, query: str) -> DataFrame:
    """block, best and date of blocks in which every word of the query stands somewhere: what a document of the block can score at most, and its newest date."""
    terms = search_terms(query)
    begins, rows = _begins(terms)
    every, most, guided = F.lit(bool(terms)), [], []
    for w, b in zip(terms, begins, strict=True):
        every = every & F.bool_or(b if len(w) >= PREFIX else F.col("word") == w)
        parts = F.coalesce(F.bit_or(F.when(b, F.col("parts"))), F.lit(0))
        # Several words may begin with the term: a document has each part's points once, and no more than its words have together.
        by_parts = sum((F.when(parts.bitwiseAND(bit) > 0, POINTS[x]).otherwise(0) for bit, x in ((4, "t"), (2, "s"), (1, "b"))), F.lit(0))
        most.append(F.least(by_parts, F.coalesce(F.sum(F.when(b, F.col("points"))), F.lit(0))))
        guided.append(F.coalesce(F.sum(F.when(b, F.col("with_guide"))), F.lit(0)))
    total = sum(most, F.lit(0))
    best = F.least(total + F.max("guide"), *(total - m + g for m, g in zip(most, guided, strict=True))) if terms else F.lit(0)
    return blocks.where(rows).groupBy("block").agg(best.cast("int").alias("best"), F.max("date").alias("date"), every.alias("_every")).where("_every").drop("_every")


def search_stored(spark: SparkSession, path: str, query: str, most: int = 40, first: int = FIRST_BLOCKS) -> DataFrame:
    """search_index over an index that write_index has written, reading only blocks that can hold one of the first `most` documents.

    The blocks of the best possible score and newest date are read first; what the last of the first `most` documents found there has is then the least that a block must be
    able to reach. Blocks below it are never read. The `first` blocks and the bound, one row, come to the driver.
    """
    postings, blocks = (spark.read.parquet(f"{path}/{x}") for x in ("postings", "blocks"))
    ranked = ranked_blocks(blocks, query)
    ahead = [r["block"] for r in ranked.orderBy(F.desc("best"), F.desc("date"), "block").limit(first).collect()]
    found = search_index(postings.where(F.col("block").isin(ahead)), query, most)
    last = found.orderBy("score", "date", F.desc("doc_id")).limit(most).collect()
    rest = further_blocks(ranked, ahead, last[0] if len(last) == most else None)
    more = search_index(postings.join(rest.select("block"), "block", "left_semi"), query, most)
    return found.unionByName(more).orderBy(F.desc("score"), F.desc("date"), "doc_id").limit(most)


def further_blocks(ranked: DataFrame, ahead: list[str], last: Row | None) -> DataFrame:
    """Blocks beyond those ahead that may hold a document before the last one found; all of them where too few were found. A block without a date is looked into."""
    rest = ranked.where(~F.col("block").isin(ahead))
    if last is None:
        return rest
    reaches = (F.col("best") > last["score"]) | (F.col("best") == last["score"]) & (F.lit(last["date"]).isNull() | F.col("date").isNull() | (F.col("date") >= F.lit(last["date"])))
    return rest.where(reaches)
