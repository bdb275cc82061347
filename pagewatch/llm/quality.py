"""Quality rules: word statistics, and a hashed n-gram log-likelihood ratio of trusted text against the raw corpus."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewatch.llm.common import WHITE, hashed, materialize, mix, slices, text_batches, word_lists

SYMBOLS = b"#*$%&|<>"
#: What isn't a first byte of a code point, and white space.
NOT_CHARS = bytes(range(0x80, 0xC0)) + WHITE
BUCKETS = 1 << 16
#: Labelled documents that the target's counts and the threshold are fitted on, at most.
FIT_ROWS = 20_000
#: Log ratios are held as whole multiples of 2^-20, so that a sum doesn't depend on its order.
UNIT = 1 << 20
VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"
NAMES = [x.split()[0] for x in VERDICT.split(", ")]
P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def _grams(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, then of all pairs of neighbours; the text that each belongs to."""
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    pair = np.flatnonzero(text[1:] == text[:-1]) if len(h) > 1 else np.zeros(0, np.int64)
    two = mix(h[pair] * P1 + h[pair + 1])
    return (np.r_[mix(h), two] % np.uint64(BUCKETS)).astype(np.int64), np.r_[text, text[pair]]


def _measured(raw: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    """n_words, word_chars, n_symbols and n_dup_lines of one text."""
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), len(raw.translate(None, NOT_CHARS)), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines))


def _repeat_words(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each text the words in 3-word windows that it has twice or more."""
    if len(h) < 3:
        return np.zeros(len(starts) - 1, np.int64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    window = np.flatnonzero(text[2:] == text[:-2])
    key = mix(mix(h[window] * P1 + h[window + 1]) * P2 + h[window + 2]) + text[window].astype(np.uint64) * P1
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = window[order[np.r_[False, same] | np.r_[same, False]]] if len(order) else order
    covered = np.zeros(len(h), bool)
    for j in range(3):
        covered[twice + j] = True
    return np.bincount(text[covered], minlength=len(starts) - 1)


def _mean_ratio(h: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    gram, text = _grams(h, starts)
    n = np.bincount(text, minlength=len(starts) - 1)
    total = np.zeros(len(starts) - 1, np.int64)
    np.add.at(total, text, weights[gram])
    return np.divide(total, n, where=n > 0, out=np.zeros(len(starts) - 1))


def statistics(texts: list[str | None]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text; a null text has none of anything."""
    return judged(texts, None)


def scores(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    """Mean log ratio of a text's words and pairs; 0 for a text without words."""
    parts = [_mean_ratio(*hashed(lists), weights) for _, lists in word_lists(texts)]
    return np.concatenate(parts) if parts else np.zeros(0)


def judged(texts: list[str | None], weights: np.ndarray | None) -> dict[str, np.ndarray]:
    """statistics() and, where there are weights, scores() as score: words are split and hashed once for both."""
    rows: list[tuple[int, int, int, int]] = []
    repeats, score = [np.zeros(0, np.int64)], [np.zeros(0)]
    for first, lists in word_lists(texts):
        rows += [_measured(text.encode() if text else b"", words) for text, words in zip(texts[first:], lists, strict=False)]
        h, starts = hashed(lists)
        repeats.append(_repeat_words(h, starts))
        if weights is not None:
            score.append(_mean_ratio(h, starts, weights))
    table = np.array(rows, np.int64).reshape(-1, 4)
    out = dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines"), table.T, strict=True)) | {"n_repeat_words": np.concatenate(repeats)}
    return out if weights is None else out | {"score": np.concatenate(score)}


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        trusted = batch["trusted"].fill_null(False).to_numpy(zero_copy_only=False)
        for at, texts in slices(batch["text"]):
            for first, lists in word_lists(texts):
                gram, text = _grams(*hashed(lists))
                raw += np.bincount(gram, minlength=BUCKETS)
                target += np.bincount(gram[trusted[at + first + text]], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.record_batch({"bucket": some.astype(np.int32), "raw": raw[some], "target": target[some]})


@dataclass(frozen=True)
class Model:
    """weights: log ratio of each bucket in UNITs; threshold: least mean (in UNITs) of a document that is kept."""

    weights: np.ndarray
    threshold: float


def threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """Between the scores that parts good from bad best, counting both classes alike; of equally good cuts the lowest."""
    if not len(good) or not len(bad):
        return -np.inf
    good, bad = np.sort(good), np.sort(bad)
    cuts = np.unique(np.r_[good, bad])
    gain = np.searchsorted(bad, cuts) / len(bad) - np.searchsorted(good, cuts) / len(good)
    k = int(np.argmax(gain))
    below = cuts[k - 1] if k else cuts[k]
    return float((cuts[k] + below) / 2)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fit on all documents and on up to `rows` labelled ones, the first by a hash of their id.

    Raw counts are of every document. Target counts are of labelled documents of quality 1 that aren't toxic, four fifths of
    the sample; the threshold is set on the other fifth. Counts are smoothed by one. Without trusted documents, or without
    any to reject, every document passes.
    """
    spark = docs.sparkSession
    text_batches(spark)
    sample = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality", F.coalesce("toxic", F.lit(0)).alias("toxic"))
    sample = sample.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = sample.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)))
    sample = F.broadcast(spark.createDataFrame(sample.toPandas(), "doc_id long, quality int, toxic int, fold long"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    trusted = sample.where("quality = 1 and toxic = 0 and fold > 0").select("doc_id", F.lit(True).alias("trusted"))
    counts = own.join(F.broadcast(trusted), "doc_id", "left").select("text", "trusted").mapInArrow(_counts, "bucket int, raw long, target long")
    counts = materialize(counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")), "counts").toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[counts["bucket"]], target[counts["bucket"]] = counts["raw"], counts["target"]
    if not target.sum():
        return Model(np.zeros(BUCKETS, np.int64), -np.inf)
    ratio = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    weights = np.round(ratio * UNIT).astype(np.int64)
    held = own.join(F.broadcast(sample.where("fold = 0")), "doc_id").where("text is not null")
    shared = spark.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(scores(x, shared.value) for _, x in slices(texts))]))

    # Of repeated ids the lowest score counts: what comes to the driver is a row per sampled document.
    seen = held.select("doc_id", "quality", "toxic", score("text").alias("score"), F.length("text").alias("n")).where("n > 0")
    seen = materialize(seen.groupBy("doc_id", "quality", "toxic").agg(F.min("score").alias("score")), "held-out").toPandas()
    good = seen[(seen.quality == 1) & (seen.toxic == 0)].score.to_numpy()
    return Model(weights, threshold(good, seen[seen.quality == 0].score.to_numpy()))


def verdict(model: Model, spark: SparkSession, text: str | Column) -> Column:
    """The statistics, base_failed, score and kept of a text, as a struct: to filter by, or to select from."""
    text_batches(spark)
    shared = spark.sparkContext.broadcast(model.weights)
    least = model.threshold

    @F.arrow_udf(VERDICT)
    def of(texts: pa.Array) -> pa.Array:
        parts = [judged(x, shared.value) for _, x in slices(texts)] or [judged([], shared.value)]
        x = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        failed = (x["n_words"] < 50) | (100 * x["n_repeat_words"] > 50 * x["n_words"])
        x |= {"base_failed": failed, "kept": ~failed & (x["score"] >= least), "score": x["score"] / UNIT}
        return pa.StructArray.from_arrays([pa.array(x[k]) for k in NAMES], NAMES)

    return of(text)


def quality_rules(docs: DataFrame, model: Model, text: str = "text", id: str = "doc_id") -> DataFrame:
    """A row per document: doc_id, the statistics, base_failed, score (mean log ratio per n-gram) and kept.

    Words are [^\\x20\\x09-\\x0D]+ of the whole text. base_failed: fewer than 50 words, or over half of the words lie in
    3-word windows that the text has twice or more. kept: not base_failed, and a score of at least the model's threshold.
    A null or empty text has zeros, fails and isn't kept. Null ids and repeated rows each give their row; other columns
    aren't read; an empty table gives none. No row is shuffled.
    """
    own = docs.select(F.col(id).cast("long").alias("doc_id"), verdict(model, docs.sparkSession, F.col(text)).alias("v"))
    return own.select("doc_id", "v.*")
