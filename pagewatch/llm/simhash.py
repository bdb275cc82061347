"""SimHash near-duplicates: 64-bit fingerprints linked through covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewatch.llm.common import materialize, slices, text_batches

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: A byte's bits, each in a byte of its own.
SPREAD = sum(((np.arange(256, dtype=np.uint64) >> np.uint64(j)) & np.uint64(1)) << np.uint64(8 * j) for j in range(8))
#: Fingerprints in a bucket above which the bucket is dealt out again by masks over its free bits.
BUCKET = 4096
ROWS = 200_000


def _hashes(text: str | None, width: int, seed: int) -> list[int]:
    words = text.encode().translate(LOWER).split() if text else []
    if not words:
        return []
    if len(words) < width:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    runs = zip(*(words[i:] for i in range(width)), strict=False)
    return list(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(seed)))


def _majority(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text the bits that over half of its hashes have; texts without hashes have zero."""
    out = np.zeros(len(counts), np.uint64)
    full = counts > 0
    if not full.any():
        return out
    ends = np.cumsum(counts)
    starts = ends - counts
    # Sums of 255 hashes at most fit in a byte; the sums of a text's pieces are added as integers.
    pieces = -(-counts[full] // 255)
    first = np.cumsum(pieces) - pieces
    inside = np.arange(pieces.sum()) - np.repeat(first, pieces)
    cuts = np.repeat(starts[full], pieces) + 255 * inside
    ones = np.empty((int(full.sum()), 64), np.int64)
    for lane in range(8):
        part = SPREAD[(flat >> np.uint64(8 * lane)).astype(np.uint8)]
        sums = np.add.reduceat(part, cuts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        ones[:, 8 * lane : 8 * lane + 8] = np.add.reduceat(sums, first, axis=0)
    bits = (2 * ones > counts[full, None]).astype(np.uint64)
    out[full] = (bits << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(texts: list[str | None], width: int = 3, seed: int = 42) -> np.ndarray:
    out, hashes, counts = [], [], []
    n = 0
    for text in texts:
        hashes.append(_hashes(text, width, seed))
        counts.append(len(hashes[-1]))
        n += counts[-1]
        if n > ROWS:
            out.append(_majority(np.fromiter((h for x in hashes for h in x), np.uint64, n), np.array(counts)))
            hashes, counts, n = [], [], 0
    out.append(_majority(np.fromiter((h for x in hashes for h in x), np.uint64, n), np.array(counts, np.int64)))
    return np.concatenate(out)


def fingerprint(text: str | Column, width: int = 3) -> Column:
    """A text's SimHash as a long: A-Z lowered, words, shingles of width words with repeats, XXH64 with seed 42."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0, np.int64), *(fingerprints(x, width).view(np.int64) for _, x in slices(texts))]))

    return of(text)


def masks(radius: int, bits: int = 64, among: int = (1 << 64) - 1) -> list[int]:
    """Covering masks: for any set of up to radius bits, some mask leaves all of them out.

    Bit i has the vector i mod 2^(radius+1) - 1, plus 1: one of radius + 1 binary digits. Mask v has the bits whose vector
    has an odd product with v. Up to radius vectors in radius + 1 dimensions leave some v, not 0, that is orthogonal to all.
    among: the bits to deal with; others are in no mask.
    """
    own = [i for i in range(bits) if among >> i & 1]
    span = (1 << (radius + 1)) - 1
    vector = {i: k % span + 1 for k, i in enumerate(own)}
    return [sum(1 << i for i in own if (vector[i] & v).bit_count() & 1) for v in range(1, span + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bucket_links(bucket: np.ndarray, value: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what is within the radius inside each bucket (rows sorted by bucket): at most one a row."""
    n = len(value)
    label = np.arange(n)
    if n < 2:
        return value[:0], value[:0]
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    sizes = np.diff(edge)
    size_of = np.repeat(sizes, sizes)

    def union(i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = label[i], label[j]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(label, high, low)
            while (label != label[label]).any():
                label[:] = label[label]
            open_ = label[i] != label[j]
            i, j = i[open_], j[open_]

    small = np.flatnonzero(size_of <= 64)
    for d in range(1, 64):
        i = small[small + d < n]
        i = i[bucket[i] == bucket[i + d]]
        if not len(i):
            break
        small = i
        near = np.bitwise_count(value[i] ^ value[i + d]) <= radius
        union(i[near], i[near] + d)
    for b in np.flatnonzero(sizes > 64):
        lo, hi = edge[b], edge[b + 1]
        step = max(16, 2_000_000 // (hi - lo))
        for at in range(lo, hi, step):
            rows = value[at : min(at + step, hi), None] ^ value[None, at:hi]
            i, j = np.nonzero(np.bitwise_count(rows) <= radius)
            far = i < j
            union(at + i[far], at + j[far])
    child = np.flatnonzero(label != np.arange(n))
    return value[child], value[label[child]]


def _links(rows: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """rows: keys and fp, each fp once a bucket. Buckets meet in a task, sorted, and stream through it."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(last: bool):
            nonlocal held
            table = pa.Table.from_batches(held)
            cols = [table[k].to_numpy() for k in keys]
            fp = table["fp"].to_numpy().view(np.uint64)
            new = np.zeros(len(fp), bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            bucket = np.cumsum(new)
            upto = len(fp) if last else int(np.searchsorted(bucket, bucket[-1]))
            a, b = _bucket_links(bucket[:upto], fp[:upto], radius)
            held = table.slice(upto).combine_chunks().to_batches() if upto < len(fp) else []
            return pa.record_batch({"a": a.view(np.int64), "b": b.view(np.int64)})

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) > ROWS:
                yield flush(False)
        if held:
            yield flush(True)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(stream, "a long, b long")


def near_links(values: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that join all 64-bit values of column fp within the radius, through any number of steps.

    Every pair within the radius shares a bucket of some mask. A bucket gives the links of a
    spanning forest, never all its pairs. A bucket of more than `bucket` values goes through a second set of masks over the
    bits that its own mask leaves free, so that its values differ in a quarter of the bits at most: for 64 bits
    that bounds the values of a bucket by 2^16 whatever the input.
    """
    tables = masks(radius)
    everything = (1 << 64) - 1
    key = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(tables)))
    rows = values.select("fp").distinct().select("fp", F.explode(key).alias("k")).select("k.t", "k.key", "fp")
    large = materialize(rows.groupBy("t", "key").count().where(F.col("count") > bucket).select("t", "key"), "large-buckets")
    if not large.limit(1).count():
        return _links(rows, ["t", "key"], radius)
    second = [masks(radius, among=everything & ~m) for m in tables]
    again = F.element_at(
        F.array(*(F.array(*(F.struct(F.lit(u).alias("u"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key2")) for u, m in enumerate(own))) for own in second)),
        F.col("t") + 1,
    )
    split = rows.join(large, ["t", "key"], "left_semi").select("t", "key", "fp", F.explode(again).alias("k"))
    return _links(rows.join(large, ["t", "key"], "left_anti"), ["t", "key"], radius).union(
        _links(split.select("t", "key", "k.u", "k.key2", "fp"), ["t", "key", "u", "key2"], radius)
    )


def simhash_groups(docs: DataFrame, text: str = "text", id: str = "doc_id", radius: int = 3) -> DataFrame:
    """docs' ids with fp (long), root (a fingerprint that names the group, whatever its ids) and component_id: the smallest id reachable over links of fingerprints.

    Documents of one fingerprint count as one node, so that copies cost one row. A null or empty text has the fingerprint
    zero and is linked like any other. A null id stays null and never is a component's name unless it has no other; repeated
    rows stay repeated. Other columns aren't read. An empty table gives none.
    """
    from pagewatch.llm.components import components

    text_batches(docs.sparkSession)
    own = materialize(docs.select(F.col(id).alias("doc_id"), fingerprint(F.col(text)).alias("fp")), "fingerprints")
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    star = components(near_links(own, radius))
    named = nodes.join(star.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "nodes")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "root").select("fp", "root", "component_id")
    return own.join(classes, "fp").select("doc_id", "fp", "root", "component_id")


def hex16(fp: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
