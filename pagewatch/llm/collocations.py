"""Collocations by SON partitioning: shards mined completely at lowered support, their union counted again exactly.

A shard is a run of documents in one task. Per language it is mined for every phrase of up to four words that it has `local` times, where
local is the global support in proportion to the shard's part of the language's bytes, rounded up: a phrase that is frequent at all
is so in some shard. What shards found is united by hashes: a phrase stays a candidate if what is known of it and what shards may
have held back reach the support. The union becomes a bitmap of fixed size; a second pass counts, by the words themselves, each phrase that
the bitmap lets through. A full bitmap costs time, and no result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewatch.llm.common import hashes, materialize, mix, slices, text_batches

#: Words after which a shard is mined, and bytes of text that are split into words at once.
SHARD_WORDS, SPLIT_BYTES = 1 << 19, 1 << 20
#: Bytes of text whose phrases meet in one range of hashes.
RANGE_BYTES = 2 << 20
#: log2 of the bits of the candidates' bitmap: 8 MB.
BITMAP = 26
#: Words of the longest phrase.
LONGEST = 4
#: Ends of pieces become full stops, tabs spaces; no word holds either.
PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b".......... ")
P = np.uint64(0x9E3779B97F4A7C15)


def _chunks(raw: bytes) -> Iterator[bytes]:
    """Lower-cased text in parts that end where a piece does."""
    raw = raw.lower().translate(PIECES)
    at = 0
    while at < len(raw):
        end = raw.find(b".", at + SPLIT_BYTES) + 1 or len(raw)
        yield raw[at:end]
        at = end


class _Shard:
    """Words of one language as numbers in order of appearance; 0 parts pieces."""

    def __init__(self) -> None:
        self.ids: defaultdict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.ids[b"."]
        self.parts: list[np.ndarray] = []
        self.size = self.bytes = 0

    def add(self, raw: bytes) -> int:
        self.bytes += len(raw)
        added = 0
        for part in _chunks(raw):
            words = part.replace(b".", b" . ").split()
            words.append(b".")
            self.parts.append(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
            added += len(words)
        self.size += added
        return added

    def words(self) -> np.ndarray:
        self.parts = [np.concatenate([np.zeros(0, np.int32), *self.parts])]
        return self.parts[0]

    def mined(self, support: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length: (words, where each phrase that occurs `support` times stands once, how often it occurs)."""
        x = self.words()
        vocabulary = len(self.ids)
        rank = np.where(x > 0, x, -1).astype(np.int64)
        at = np.flatnonzero(rank >= 0)
        key = rank[at]
        for k in range(1, LONGEST + 1):
            order = np.argsort(key)
            new = np.flatnonzero(np.r_[True, key[order[1:]] != key[order[:-1]]]) if len(key) else np.zeros(0, np.int64)
            counts = np.diff(np.r_[new, len(key)])
            often = counts >= support
            yield k, at[order[new[often]]], counts[often]
            if k == LONGEST:
                return
            name = np.where(often, np.cumsum(often) - 1, -1)
            rank = np.full(len(x), -1, np.int64)
            rank[at[order]] = np.repeat(name, counts)
            # Both parts that lack one word have to be frequent here.
            at = np.flatnonzero((rank[:-1] >= 0) & (rank[1:] >= 0))
            at = at[at + k < len(x)]
            key = rank[at] * vocabulary + x[at + k]

    def hashed(self, lang: str, support: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """mined(), with each phrase's hash."""
        x = self.words()
        words = hashes(list(self.ids))
        seed = np.uint64(xxhash.xxh64_intdigest(lang.encode()))
        for k, at, counts in self.mined(support):
            h = np.full(len(at), seed)
            for j in range(k):
                h = mix(h * P + words[x[at + j]])
            yield k, at, counts, h

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        x = self.words()
        names = pa.array(list(self.ids), pa.binary())
        words = [names.take(pa.array(x[at + j])) for j in range(k)]
        return (pc.binary_join_element_wise(*words, b" ") if k > 1 else words[0]).cast(pa.string())


def _shards(batches: Iterator[pa.RecordBatch], shard_words: int) -> Iterator[dict[str, _Shard]]:
    """The task's documents as shards, by language."""
    held: defaultdict[str, _Shard] = defaultdict(_Shard)
    n = 0
    for batch in batches:
        langs = batch["lang"].to_pylist()
        for first, texts in slices(batch["text"]):
            for lang, text in zip(langs[first:], texts, strict=False):
                n += held[lang].add((text or "").encode())
                if n >= shard_words:
                    yield held
                    held, n = defaultdict(_Shard), 0
    if held:
        yield held


def _place(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash as its range, which is its first `bits` bits, and the 32 bits after them."""
    return (h >> np.uint64(64 - bits) if bits else np.zeros(len(h), np.uint64)), ((h << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def _bit(span: np.ndarray, low: np.ndarray, lang: str) -> np.ndarray:
    """Where the bitmap holds a hash of a language."""
    seed = np.uint64(xxhash.xxh64_intdigest(lang.encode(), 1))
    return mix(((span << np.uint64(32)) | low.astype(np.uint64)) ^ seed) >> np.uint64(64 - BITMAP)


def range_bits(size: int) -> int:
    return max(0, (size - 1) // RANGE_BYTES).bit_length()


def _local(support: int, part: int, whole: int) -> int:
    return max(1, -(-support * part // max(whole, 1)))


def _mine(support: int, sizes: dict[str, int], shard_words: int):
    """First pass: by range of hashes, each shard's locally frequent phrases and how far each passes the local support."""
    kind = np.uint16 if support < 1 << 16 else np.uint32

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shards in _shards(batches, shard_words):
            for lang, shard in shards.items():
                local = _local(support, shard.bytes, sizes[lang])
                found = [(h, c) for _, _, c, h in shard.hashed(lang, local)]
                h, c = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(h)
                span, low = _place(h[order], bits := range_bits(sizes[lang]))
                over = np.minimum(c[order] - (local - 1), support).astype(kind)
                cuts = np.searchsorted(span, np.arange((1 << bits) + 1, dtype=np.uint64))
                # A range for which the shard has nothing still has to know what the shard may have held back.
                some = [k for k in range(1 << bits) if cuts[k] < cuts[k + 1] or local > 1]
                blobs = [[x[cuts[k] : cuts[k + 1]].tobytes() for k in some] for x in (low, over)]
                yield pa.record_batch({
                    "lang": pa.array([lang] * len(some), pa.string()), "span": pa.array(some, pa.int64()), "held": pa.array([local - 1] * len(some), pa.int64()),
                    "low": pa.array(blobs[0], pa.binary()), "over": pa.array(blobs[1], pa.binary()),
                })

    return stream


def _unite(support: int):
    """Of a range: the hashes that reach the support together with what shards may have held back."""
    kind = np.uint16 if support < 1 << 16 else np.uint32

    def of(group: pa.Table) -> pa.Table:
        low = np.frombuffer(b"".join(group["low"].to_pylist()), np.uint32)
        over = np.frombuffer(b"".join(group["over"].to_pylist()), kind)
        order = np.argsort(low)
        low = low[order]
        new = np.flatnonzero(np.r_[True, low[1:] != low[:-1]]) if len(low) else np.zeros(0, np.int64)
        known = np.add.reduceat(over[order].astype(np.int64), new) if len(new) else np.zeros(0, np.int64)
        stays = low[new[known + pc.sum(group["held"]).as_py() >= support]]
        bit = _bit(np.full(len(stays), group["span"][0].as_py(), np.uint64), stays, group["lang"][0].as_py())
        return pa.table({"bit": pa.array(bit.astype(np.int64))})

    return of


def _count(sizes: dict[str, int], shard_words: int, bitmap):
    """Second pass: each shard's occurrences of every phrase that the bitmap lets through, and of words in all (phrase null)."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(bitmap.value, np.uint64)
        for shards in _shards(batches, shard_words):
            for lang, shard in shards.items():
                bits = range_bits(sizes[lang])
                total = sum(int(np.count_nonzero(x)) for x in shard.parts)
                yield pa.record_batch({"lang": pa.array([lang]), "phrase": pa.array([None], pa.string()), "k": pa.array([0], pa.int32()), "f": pa.array([total], pa.int64())})
                for k, at, counts, h in shard.hashed(lang, 1):
                    bit = _bit(*_place(h, bits), lang)
                    on = np.flatnonzero((words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1))
                    for lo in range(0, len(on), 50_000):
                        part = on[lo : lo + 50_000]
                        names = shard.phrases(at[part], k)
                        yield pa.record_batch({"lang": pa.array([lang] * len(part), pa.string()), "phrase": names, "k": pa.array([k] * len(part), pa.int32()), "f": pa.array(counts[part], pa.int64())})

    return stream


def frequent_phrases(docs: DataFrame, support: int = 30, shard_words: int = SHARD_WORDS, text: str = "text", lang: str = "lang") -> DataFrame:
    """A row for each language and phrase of one to four words that occurs `support` times in it: lang, phrase, k, f; and for each language one with k = 0 and all its words.

    Phrases are words side by side within a piece. Occurrences count everywhere, overlaps included; counts are exact. A null language is `und`,
    a null text has no words. Shards differ with the tasks that read the table; results don't.
    """
    if support < 1:
        raise ValueError("support is at least 1")
    spark = docs.sparkSession
    text_batches(spark)
    own = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    sizes = {r[0]: r[1] or 0 for r in own.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size")).toLocalIterator()}
    mined = own.mapInArrow(_mine(support, sizes, shard_words), "lang string, span long, held long, low binary, over binary")
    bits = mined.groupBy("lang", "span").applyInArrow(_unite(support), "bit long")
    masks = bits.groupBy(F.shiftright("bit", 6).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("mask")).toArrow()
    bitmap = np.zeros(1 << (BITMAP - 6), np.int64)
    bitmap[masks["at"].to_numpy()] = masks["mask"].to_numpy()
    counted = own.mapInArrow(_count(sizes, shard_words, spark.sparkContext.broadcast(bitmap.tobytes())), "lang string, phrase string, k int, f long")
    return materialize(counted.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).where((F.col("f") >= support) | (F.col("k") == 0)), "phrases")


def _words(first: str, n: str) -> Column:
    return F.expr(f"array_join(slice(ws, {first}, {n}), ' ')")


def collocations(docs: DataFrame, support: int = 30, top: int = 2000, inside: tuple[int, int] = (80, 100), shard_words: int = SHARD_WORDS, text: str = "text", lang: str = "lang") -> DataFrame:
    """Each language's first `top` phrases of two to four words: lang, rank, phrase, a, l, r, n, score.

    a is how often the phrase occurs, l and r how often its parts before and after its weakest cut do (of equal scores the first cut), n the
    words of the language, score = floor(2,000,000 a / (l + r)). A phrase inside a longer frequent one that occurs at least inside[0] of
    inside[1] times as often is left out. Order: score, a, both from the top, then the phrase by bytes. Products are decimals of 38 digits.
    Texts and languages may be null, empty, or of any length; repeated rows count as often as they stand; other columns aren't
    read, nor are ids; an empty table gives no row. Number of languages: they and their sizes are held by the driver.
    """
    phrases = frequent_phrases(docs, support, shard_words, text, lang)
    known = phrases.where("k > 0").select("lang", "phrase", "f")
    long = phrases.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("ws"))
    cuts = long.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", _words("1", "cut").alias("left"), _words("cut + 1", "k - cut").alias("right"))
    for side, n in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("f").alias(n)), ["lang", side])
    score = F.expr("(cast(a as decimal(20,0)) * 2000000bd) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    cuts = cuts.withColumn("score", score.cast("long"))
    weakest = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("c"))
    parts = long.where("k > 2").withColumn("size", F.explode(F.expr("sequence(2, k - 1)"))).withColumn("from", F.explode(F.expr("sequence(1, k - size + 1)")))
    parts = parts.select("lang", _words("from", "size").alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    over = F.expr(f"coalesce(cast(longer as decimal(20,0)) * {inside[1]} >= cast(a as decimal(20,0)) * {inside[0]}, false)")
    kept = weakest.join(parts, ["lang", "phrase"], "left").where(~over)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase")).cast("long")).where(F.col("rank") <= top)
    n = phrases.where("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "c.l", "c.r", "n", "c.score")
