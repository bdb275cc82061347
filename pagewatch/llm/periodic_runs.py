"""Periodic runs of words: a dictionary of basic factors.

Every stretch of 2^j words of a text has a name that equal stretches share. Names of twice the length come from pairs of names, and only stretches that the text
has again go on. A run of period p shows at the level with 2^j <= p < 2^(j+1), where a stretch stands again p words on.
Occurrences at most half a stretch apart follow each other at one distance, the stretch's own period: they form a progression. Within twice the stretch's length there are few
progressions, so that each occurrence with the first of the next progressions, and the ends of progressions with each other, propose all
periods. Names tell how far a proposal reaches to both sides.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewatch.llm.common import hashed, mix, slices, text_batches, word_lists

#: Words of the shortest run, and periods of it at least.
SHORTEST, TIMES = 12, 2
#: Progressions after its own that an occurrence is compared with: gaps of over half a stretch fit four times into twice its length.
NEXT = 4
DIGESTS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _ranks(key: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places sorted by (key, place), and whether each has the key of the one before it in the same text. Places of key come in rising order."""
    order = np.argsort(key, kind="stable")
    same = np.r_[False, (key[order[1:]] == key[order[:-1]]) & (text[order[1:]] == text[order[:-1]])] if len(order) else np.zeros(0, bool)
    return order, same


def _proposals(at: np.ndarray, same: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of equal stretches `size` to 2 size - 1 words apart that may belong to a run. at: places sorted by name; same: the name goes on."""
    n = len(at)
    gap = np.diff(at, prepend=at[:1])
    chain = same & (gap <= size // 2)
    group = np.cumsum(~chain) - 1
    first = np.flatnonzero(~chain)
    last = np.r_[first[1:], n] - 1
    name = np.cumsum(~same) - 1
    a, b = [], []
    for step in range(1, NEXT + 1):
        later = group + step
        here = np.flatnonzero(later < len(first))
        there = later[here]
        ok = name[first[there]] == name[here]
        here, there = here[ok], there[ok]
        for x, y in ((here, first[there]), (last[group[here]], last[there]), (first[group[here]], first[there])):
            far = at[y] - at[x]
            good = (far >= size) & (far < 2 * size)
            a.append(at[x[good]])
            b.append(at[y[good]])
    if size == 1:
        # Half of one word is none: neighbours stand one apart as they are.
        a.append(at[:-1][same[1:] & (gap[1:] == 1)])
        b.append(at[1:][same[1:] & (gap[1:] == 1)])
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1) if a else np.zeros((2, 0), np.int64)
    return pairs[0], pairs[1]


def runs(h: np.ndarray, starts: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """Rows of (text, start, length, period) in order, of all runs of texts that lie behind each other. h: a word's hash; starts: where texts start, and the end."""
    n = len(h)
    lengths = np.diff(starts)
    text = np.repeat(np.arange(len(lengths)), lengths)
    end = np.repeat(starts[1:], lengths)
    begin = np.repeat(starts[:-1], lengths)
    levels: list[np.ndarray] = []
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = np.arange(n)
    # The same words in different texts are kept apart from the start.
    key = mix(h + mix(text.astype(np.uint64)))
    size = 1
    while len(at):
        order, same = _ranks(key, text[at])
        again = same | np.r_[same[1:], False]
        place = at[order[again]]
        same = same[again]
        names = np.full(n, -1, np.int64)
        names[place] = np.cumsum(~same) - 1
        levels.append(names)
        x, y = _proposals(place, same, size)
        a.append(x)
        b.append(y)
        at = np.sort(place)
        at = at[at + 2 * size <= end[at]]
        at = at[names[at + size] >= 0]
        key = (names[at].astype(np.uint64) << np.uint64(32)) | names[at + size].astype(np.uint64)
        size *= 2
    x, y = np.concatenate(a), np.concatenate(b)
    if not len(x):
        return np.zeros((0, 4), np.int64)
    period = y - x
    right, left = y.copy(), x.copy()
    for j in range(len(levels) - 1, -1, -1):
        size, names = 1 << j, levels[j]
        # As often as it goes: a text may hold more than the longest repeated stretch of two to the something.
        ok = right < end[y]
        while ok.any():
            k = np.flatnonzero(ok)
            p = names[right[k]]
            good = (p >= 0) & (p == names[right[k] - period[k]])
            right[k[good]] += size
            ok = np.zeros(len(x), bool)
            ok[k[good]] = right[k[good]] < end[y[k[good]]]
        ok = left - size >= begin[x]
        while ok.any():
            k = np.flatnonzero(ok)
            p = names[left[k] - size]
            good = (p >= 0) & (p == names[left[k] - size + period[k]])
            left[k[good]] -= size
            ok = np.zeros(len(x), bool)
            ok[k[good]] = left[k[good]] - size >= begin[x[k[good]]]
    length = right - left
    long = length >= np.maximum(shortest, TIMES * period)
    left, length, period = left[long], length[long], period[long]
    order = np.lexsort((period, length, left))
    left, length, period = left[order], length[order], period[order]
    # A stretch with several periods has them all as multiples of its least.
    new = np.r_[True, (left[1:] != left[:-1]) | (length[1:] != length[:-1])] if len(left) else np.zeros(0, bool)
    left, length, period = left[new], length[new], period[new]
    order = np.lexsort((period, left))
    left, length, period = left[order], length[order], period[order]
    owner = text[left]
    return np.stack([owner, left - starts[owner], length, period], axis=1)


def dropped(found: np.ndarray, n: int) -> np.ndarray:
    """Of a text of n words, those that some run of (start, length, period) holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return np.cumsum(change[:-1]) > 0


def planted(doc_id: int, words: list) -> list:
    """The words as the query reads them: of every tenth document by the checksum of its id the rest repeats a part."""
    h = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * (-(-(n - a) // p)))[: n - a]


def _digests(plant: bool, shortest: int):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            rows = []
            for base, texts in slices(batch["text"]):
                for first, lists in word_lists(texts):
                    own = ids[base + first :]
                    if plant:
                        lists = [planted(own[k], words) if own[k] is not None else words for k, words in enumerate(lists)]
                    found = runs(*hashed(lists), shortest)
                    cuts = np.searchsorted(found[:, 0], np.arange(len(lists) + 1))
                    for k, words in enumerate(lists):
                        rows.append((own[k], *_digest(words, found[cuts[k] : cuts[k + 1], 1:])))
            fields = [f.split() for f in DIGESTS.split(", ")]
            kinds = {"long": pa.int64(), "string": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])

    return stream


def _digest(words: list[bytes], found: np.ndarray) -> tuple:
    kept = words
    best = (None, None, None, None)
    if len(found):
        gone = dropped(found, len(words)).tolist()
        kept = [w for w, x in zip(words, gone, strict=True) if not x]
        start, length, period = min(found.tolist(), key=lambda r: (-r[1], r[0], r[2]))
        best = (start, length, period, 1000 * length // period)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found.tolist())
    return (len(found), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def find_runs(docs: DataFrame, text: str = "text", id: str = "doc_id", shortest: int = SHORTEST) -> DataFrame:
    """A row per run: doc_id, start, length, period (words). See run_digests."""
    text_batches(docs.sparkSession)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(range(len(batch)), np.int64)
            for base, texts in slices(batch["text"]):
                for first, lists in word_lists(texts):
                    found = runs(*hashed(lists), shortest)
                    yield pa.record_batch({"doc_id": batch["doc_id"].take(pa.array(ids[base + first + found[:, 0]])), "start": found[:, 1], "length": found[:, 2], "period": found[:, 3]})

    own = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(stream, "doc_id long, start long, length long, period long")


def run_digests(docs: DataFrame, text: str = "text", id: str = "doc_id", shortest: int = SHORTEST, plant: bool = False) -> DataFrame:
    """A row per document: doc_id, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256, collapsed_sha256.

    Words are [^\\x20\\x09-\\x0D]+ of the whole text, numbered from 0. A run is a stretch of at least `shortest` words and two of its least periods that no
    word beside it goes on. collapsed_sha256 is of the words that stay when each run keeps its first period. plant: see planted(); a document without an id is read as it is.
    A null or empty text has no words and no runs. Null ids and repeated rows each give their row; other columns aren't read; an empty table gives none. No row is shuffled: a text is
    one task's work, which grows as n log n. Words are compared by 64-bit hashes.
    """
    text_batches(docs.sparkSession)
    own = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(_digests(plant, shortest), DIGESTS)
