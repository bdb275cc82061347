"""Substring dedup by recompression: words that lie in a long passage found anywhere else are removed.

Words get names, and in rounds runs of two and neighbouring pairs of names get names of their own. A name is a fingerprint of
what it stands for, so that every executor names equal content alike with no dictionary to hand round. Which pairs join
is decided by the two names alone, so that equal passages get equal interior symbols, all but those near their ends (`levels`).
Every window of the given width is found by the highest symbol well inside it, of several the least; for windows of 35 words 97 of 100
have one of the second round of pairs, of which there is one in five words. With the words around it that are in the window for sure
that is the window's anchor. Spark counts the anchors: one that occurs once rules out all its windows. Where all that an anchor's windows
hold is equal, its windows are repeats; the others are compared by fingerprints of all their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewatch.llm.common import hashed, materialize, mix, slices, small, text_batches, word_lists

#: Documents up to which lists of those to read again, or to cut, are broadcast (16 bytes each); beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Bases of the fingerprints of word ranges, and salts of the rounds (fixed values, odd).
BASES = (np.uint64(0x9E3779B97F4A7C17), np.uint64(0xC2B2AE3D27D4EB4F))
SALTS = (np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5), np.uint64(0x85EBCA77C2B2AE63))
#: Words of an anchor where no symbol is one.
RUN = 8
#: Seeds of the two hashes that words have: anchors stand on one, what is compared beyond them on the other.
SEEDS = (0, 1)
OCCURRENCES = "key long, ctx long, doc_id long, fp long, lo int, n int, sure boolean"


def levels(width: int) -> list[int]:
    """For each round, how far around a symbol that it makes words decide that it is one: of runs, then of pairs.

    A run of exactly two words needs the word on either side. A pair is made of two symbols of the round before. Whether those
    are symbols is settled by what may join them from outside: the longest symbol before them, and what settles that.
    A round is made if its longest symbol, with what settles it, fits into half of a window: higher ones would be so near the ends of
    windows that few are inside any, and anchors change more often.
    """
    out: list[int] = []
    settled, longest = 2, 2  # of the symbols, joined or not, after the round of runs
    if width >= 4:
        out.append(1)
    while out and 2 * (2 * settled + 2 * longest) <= width:
        out.append(settled)
        settled, longest = settled + longest, 2 * longest
    return out


class Powers:
    """Fingerprints of any range of words, in constant time, from prefix sums modulo 2^64."""

    def __init__(self, names: np.ndarray, base: np.uint64):
        n = len(names)
        back = np.uint64(pow(int(base), -1, 1 << 64))
        self.back = np.cumprod(np.r_[np.uint64(1), np.full(n, back, np.uint64)])
        power = np.cumprod(np.r_[np.uint64(1), np.full(max(n - 1, 0), base, np.uint64)])[:n]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(names * power, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def symbols(names: np.ndarray, starts: np.ndarray, rounds: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each round the symbols that it makes: names, first words and ends; none spans two documents.

    Of runs of equal names, those of exactly two join; longer runs keep single words, since a window may begin in them.
    A pair joins if a bit of the first name is 0 and of the second 1: no name can be in two pairs.
    """
    at, end = np.arange(len(names)), np.arange(1, len(names) + 1)
    last = np.zeros(len(names), bool)
    last[starts[1:][starts[1:] > starts[:-1]] - 1] = True
    out = []
    for r in range(rounds):
        joinable = ~last[:-1]
        if r == 0:
            same = joinable & (names[:-1] == names[1:])
            joined = same & ~np.r_[False, same[:-1]] & ~np.r_[same[1:], False]
        else:
            bit = (mix(names + SALTS[r % 3]) >> np.uint64(17)) & np.uint64(1) == 1
            joined = joinable & ~bit[:-1] & bit[1:]
        left = np.flatnonzero(joined)
        names, end, last = names.copy(), end.copy(), last.copy()
        names[left] = mix(names[left] * BASES[0] + mix(names[left + 1] + SALTS[r % 3]))
        end[left], last[left] = end[left + 1], last[left + 1]
        out.append((names[left], at[left], end[left]))
        keep = np.ones(len(names), bool)
        keep[left + 1] = False
        names, at, end, last = names[keep], at[keep], end[keep], last[keep]
    return out


def _least(rank: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each range p to q (not empty) where the leftmost least rank is."""
    length, best = q - p, np.empty(len(p), np.int64)
    level, argmin = 0, np.arange(len(rank))
    while len(length):
        here = (length >> level) == 1
        if here.any():
            a, b = argmin[p[here]], argmin[q[here] - (1 << level)]
            best[here] = np.where(rank[b] < rank[a], b, a)
        if (1 << (level + 1)) > length.max():
            break
        step = 1 << level
        a, b = argmin[:-step], argmin[step:]
        argmin = np.where(rank[b] < rank[a], b, a)
        level += 1
    return best


def anchors(words: np.ndarray, starts: np.ndarray, width: int):
    """Anchors of all windows of a chunk of documents: (first word, end, document, first and last window, first word of the symbol, round), and runs.

    Words are counted through the chunk. A window's anchor is a symbol of the last round that has made one inside it, with the words around that
    settle that it is one; of several the least, of equals the leftmost. A window without any is found by its least word and those that follow it
    (round -1). Windows that follow each other and share an anchor are one row. Windows of one word alone that follow each other are equal: of each such
    run the first stands for all (round -2), and runs has the others too, as (document, first window, windows).
    """
    sizes = np.diff(starts)
    per_doc = np.maximum(sizes - width + 1, 0)
    total = int(per_doc.sum())
    if not total:
        return None
    doc = np.repeat(np.arange(len(sizes)), per_doc)
    first = np.cumsum(per_doc) - per_doc
    window = np.arange(total) + np.repeat(starts[:-1] - first, per_doc)
    reach = levels(width)
    begin, stop, symbol, kind = (np.empty(total, np.int64) for _ in range(4))
    left = np.arange(total)
    for r, (names, at, end) in reversed(list(enumerate(symbols(words, starts, len(reach))))):
        own = window[left]
        p, q = np.searchsorted(at, own + reach[r]), np.searchsorted(end, own + width - reach[r], side="right")
        some = q > p
        best = _least(mix(names ^ SALTS[1]) >> np.uint64(1), p[some], q[some])
        on = left[some]
        begin[on], stop[on], symbol[on], kind[on] = at[best] - reach[r], end[best] + reach[r], at[best], r
        left = left[~some]
    run = min(RUN, width)
    best = _least(mix(words ^ SALTS[1]) >> np.uint64(1), window[left], window[left] + width - run + 1)
    begin[left], stop[left], symbol[left], kind[left] = best, best + run, best, -1
    change = np.flatnonzero(words[1:] != words[:-1]) + 1
    until_run = np.r_[change, len(words)][np.searchsorted(change, window[left], side="right")]
    alone = until_run >= window[left] + width
    one = left[alone]
    begin[one], stop[one], symbol[one], kind[one] = window[one], window[one] + run, until_run[alone], -2
    turn = np.flatnonzero(np.r_[True, (symbol[1:] != symbol[:-1]) | (kind[1:] != kind[:-1]) | (doc[1:] != doc[:-1])])
    until = np.r_[turn[1:], total] - 1
    lo, kind = window[turn], kind[turn]
    run, long = kind == -2, (kind == -2) & (until > turn)
    runs = doc[turn][long], lo[long], (until - turn + 1)[long]
    return begin[turn], stop[turn], doc[turn], lo, np.where(run, lo, window[until]), np.where(run, lo, symbol[turn]), kind, runs


def _chunk(lists, width):
    """For a chunk of documents' words: row arrays and what they are computed from."""
    words, starts = hashed(lists, SEEDS[0])
    found = anchors(words, starts, width)
    if found is None:
        return None
    begin, end, doc, lo, hi, symbol, _, runs = found
    key = Powers(words, BASES[0]).of(begin, end)
    return words, starts, symbol, doc, lo, hi, key, Powers(hashed(lists, SEEDS[1])[0], BASES[1]), runs


def _read(batch: pa.RecordBatch, width: int):
    for at, texts in slices(batch["text"]):
        for first, lists in word_lists(texts):
            if (c := _chunk(lists, width)) is None:
                continue
            _, starts, begin, doc, lo, hi, key, two, runs = c
            fps = np.array([xxhash.xxh64_intdigest((t or "").encode(), 42) for t in texts[first : first + len(lists)]], np.uint64).view(np.int64)
            of = lambda d, at=at, first=first, fps=fps: (batch["doc_id"].take(pa.array(at + first + d)), fps[d])
            yield starts, begin, doc, lo, hi, key, two, of, runs


def _occurrences(width: int):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for starts, begin, doc, lo, hi, key, two, of, (docs, first, n) in _read(batch, width):
                ctx = two.of(lo, hi + width) + mix((begin - lo).astype(np.uint64))
                rows, none = np.r_[doc, docs], np.zeros(len(docs), np.int64)
                ids, fp = of(rows)
                lows = np.r_[lo - starts[doc], first - starts[docs]].astype(np.int32)
                yield pa.record_batch({"key": np.r_[key.view(np.int64), none], "ctx": np.r_[ctx.view(np.int64), none], "doc_id": ids, "fp": fp, "lo": lows, "n": np.r_[hi - lo + 1, n].astype(np.int32), "sure": np.arange(len(rows)) >= len(doc)})

    return stream


def _windows(width: int):
    """For each anchor the fingerprints of its windows."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for starts, begin, doc, lo, hi, key, two, of, _ in _read(batch, width):
                n, (ids, fp) = hi - lo + 1, of(doc)
                offsets = np.r_[0, np.cumsum(n)]
                window = np.arange(offsets[-1]) + np.repeat(lo - offsets[:-1], n)
                own = two.of(window, window + width)
                yield pa.record_batch({"key": key.view(np.int64), "doc_id": ids, "fp": fp, "lo": (lo - starts[doc]).astype(np.int32), "before": (begin - lo).astype(np.int32), "windows": pa.ListArray.from_arrays(offsets.astype(np.int32), own.view(np.int64))})

    return stream


def repeated_ranges(docs: DataFrame, width: int) -> DataFrame:
    """Ranges of words (doc_id, fp, s, e) that windows with an equal one elsewhere cover; e is exclusive. May overlap.

    docs: doc_id long, text, fp = xxhash64(text). Rows of one id are told apart by their text. Counts are stored before they are joined, so
    that both sides of a join on a hot anchor come straight from a shuffle and adaptive execution can split it.
    """
    own = docs.select("doc_id", "text").where("text is not null")
    occ = materialize(own.mapInArrow(_occurrences(width), OCCURRENCES), "anchors")
    # Where all contexts of an anchor are equal, so are all its windows; the others' windows are looked at one by one.
    counts = occ.where("not sure").groupBy("key").agg(F.count("*").alias("c"), (F.min("ctx") != F.max("ctx")).alias("contested"))
    keys = materialize(counts.where("c > 1").select("key", "contested"), "shared-keys")
    shared = materialize(occ.where("not sure").select("key", "doc_id", "fp", "lo", "n").join(keys, "key"), "shared-anchors")
    whole = shared.where("not contested").select("doc_id", "fp", "lo", "n").union(occ.where("sure").select("doc_id", "fp", "lo", "n"))
    whole = whole.select("doc_id", "fp", F.col("lo").alias("s"), (F.col("lo") + F.col("n") - 1 + width).alias("e"))
    again = materialize(shared.where("contested").select("doc_id", "fp").distinct(), "documents-again")
    again = (small(again, BROADCAST_ROWS) or again).withColumnsRenamed({"doc_id": "i", "fp": "f"})
    reread = docs.join(again, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("fp") == F.col("f")), "left_semi").select("doc_id", "text")
    lists = reread.mapInArrow(_windows(width), "key long, doc_id long, fp long, lo int, before int, windows array<long>")
    contested = keys.where("contested").select("key")
    lists = lists.join(small(contested, BROADCAST_ROWS) or contested, "key", "left_semi")
    windows = materialize(
        lists.select("key", "doc_id", "fp", "lo", "before", F.posexplode("windows").alias("at", "w")).select("key", (F.col("before") - F.col("at")).alias("off"), "w", "doc_id", "fp", (F.col("lo") + F.col("at")).alias("s")),
        "windows",
    )
    same = ["key", "off", "w"]
    twice = materialize(windows.groupBy(*same).agg(F.count("*").alias("c")).where("c > 1").select(*same), "windows-twice")
    part = windows.join(twice, same, "left_semi").select("doc_id", "fp", "s", (F.col("s") + width).alias("e"))
    return whole.union(part)


def _cut(with_text: bool):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digest, texts = [], [], [], []
            for text, s, e in zip(batch["text"].to_pylist(), batch["s"].to_pylist(), batch["e"].to_pylist(), strict=True):
                words = text.encode().split() if text else []
                n = len(words)
                if s:
                    depth = np.zeros(n + 1, np.int32)
                    np.add.at(depth, np.array(s), 1)
                    np.add.at(depth, np.array(e), -1)
                    keep = np.cumsum(depth)[:n] == 0
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                joined = b" ".join(words)
                n_words.append(n)
                n_removed.append(n - len(words))
                digest.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    texts.append(text if n == len(words) else joined.decode())
            out = {k: batch[k] for k in batch.schema.names if k not in ("s", "e", "text")}
            out |= {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
            yield pa.RecordBatch.from_pydict(out | ({"kept_text": pa.array(texts, pa.string())} if with_text else {}))

    return stream


def remove_repeats(docs: DataFrame, text: str = "text", id: str = "doc_id", width: int = 35, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row per document: doc_id, n_words, n_removed, kept_sha256, and with_text the text that is left as kept_text.

    carry: further columns of docs that go along, together in a struct of that name.

    A word goes if some window of `width` words that covers it starts anywhere else too, in the same document or another.
    Words are [^\\x20\\x09-\\x0D]+, compared as they are. A text of which nothing goes stays as it is; of others the kept
    words are joined by one space. A null or empty text, and one shorter than the window, loses nothing (a null text stays
    null). Repeated rows are repeats of each other. Null ids are allowed. Other columns aren't read; an empty table gives none.
    """
    if width < 1:
        raise ValueError("a window has at least one word")
    text_batches(docs.sparkSession)
    own = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.struct(*carry).alias("carry") if carry else F.lit(None).alias("carry")).withColumn("fp", F.xxhash64("text"))
    # Equal rows have equal ranges: each counts once.
    ranges = repeated_ranges(own.select("doc_id", "text", "fp"), width).distinct().groupBy("doc_id", "fp").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e"))
    ranges = materialize(ranges.withColumnsRenamed({"doc_id": "i", "fp": "f"}), "ranges")
    own = own.drop("carry") if not carry else own
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("fp") == F.col("f"))
    touched = small(ranges.select("i", "f"), BROADCAST_ROWS)
    if touched is None:
        joined = own.join(ranges, same, "left")
    else:
        # The texts of documents that lose nothing stay where they are.
        whole = own.join(touched, same, "left_anti").withColumns({"s": F.lit(None).cast("array<int>"), "e": F.lit(None).cast("array<int>")})
        joined = own.join(touched, same, "left_semi").join(ranges, same).drop("i", "f").unionByName(whole)
    joined = joined.select("doc_id", "text", "s", "e", *["carry"] * bool(carry))
    schema = f"doc_id long, {f'carry {joined.schema["carry"].dataType.simpleString()}, ' if carry else ''}n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return joined.mapInArrow(_cut(with_text), schema)
