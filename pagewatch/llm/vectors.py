"""Embedding near-duplicates: randomised-rotation binary codes with stored correction factors.

A vector is turned by fixed random rotations; the signs are its code, and the product of the turned vector with its
code is the correction factor. Two codes tell the angle between their vectors within a confidence bound; code times another turned
vector, over the factor, estimates the cosine without bias, and the factor bounds the error. Pairs meet in buckets of equal code bits, several
tables of them, to which ids and codes go. Vectors and factors are fetched only for what has a partner within the codes' bound; pairs whose
estimate may reach the threshold are computed again exactly, and only those that pass are links.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewatch.llm.common import materialize, small, text_batches
from pagewatch.llm.components import components

#: Rows that a bucket has on average, and rows of a bucket beyond which its pairs of blocks go to different tasks.
BUCKET, BLOCK = 256, 2048
#: Share of the pairs at the threshold that meet in some table, at least.
RECALL = 0.985
#: Errors of an estimate that its bound allows for, in standard deviations.
WIDTH = 3.5
#: Turned dimensions that a code has, at least.
CODE = 128


@functools.lru_cache(4)
def rotations(dim: int, bits: int, seed: int = 7) -> np.ndarray:
    """Random rotations of dim dimensions on top of each other, cut off at `bits` rows."""
    rng = np.random.default_rng(seed)
    out = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-bits // dim))]
    turned = np.concatenate(out)[:bits] if out else np.zeros((0, dim))
    turned.flags.writeable = False  # a worker shares it
    return turned


def plan(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a key, tables): as many bits as buckets of BUCKET rows need, and tables for the recall at the threshold."""
    bits = max(2, math.ceil(math.log2(max(n, 1) / BUCKET))) if n > BUCKET else 0
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, 1 if bits == 0 else math.ceil(math.log(1 - recall) / math.log(1 - meet))


def _units(batch: pa.RecordBatch, column: str) -> list[np.ndarray | None]:
    """Each row's vector at length 1, in doubles; None where it is null, zero, or has nulls or what isn't finite."""
    out: list[np.ndarray | None] = []
    for x in batch[column]:
        values = x.values if x.is_valid else None
        if values is None or values.null_count or not len(values):
            out.append(None)
            continue
        v = values.to_numpy(zero_copy_only=False).astype(np.float64)
        top = np.abs(v).max()
        if not np.isfinite(top) or not top or np.isnan(v).any():
            out.append(None)
            continue
        v = v / top
        out.append(v / np.sqrt(v @ v))
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h1, h2, dims = [], [], []
        for v in _units(batch, "embedding"):
            d = hashlib.sha256((v + 0.0).tobytes()).digest() if v is not None else None
            h1.append(d and int.from_bytes(d[:8], "little", signed=True))
            h2.append(d and int.from_bytes(d[8:16], "little", signed=True))
            dims.append(0 if v is None else len(v))
        yield pa.RecordBatch.from_pydict({"vec_id": batch["vec_id"], "h1": pa.array(h1, pa.int64()), "h2": pa.array(h2, pa.int64()), "dim": pa.array(dims, pa.int32()), "embedding": batch["embedding"]})


def _size(dim: int, bits: int, tables: int) -> int:
    """Bits of a code: CODE at least, and those that the keys of all tables are read from, in whole rotations."""
    return -(-max(CODE, bits * tables) // dim) * dim


def _index(bits: int, tables: int):
    """For each vector: its code, its correction factor, and its key in each table."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _units(batch, "embedding")
            dims = np.array([len(v) for v in unit])
            codes, factors, keys = [b""] * len(unit), np.zeros(len(unit)), np.zeros((len(unit), tables), np.int64)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                size = _size(dim, bits, tables)
                z = np.stack([unit[k] for k in rows]) @ rotations(dim, size).T
                factors[rows] = np.abs(z).sum(axis=1) / size * math.sqrt(dim)
                for k, code in zip(rows.tolist(), np.packbits(z > 0, axis=1), strict=True):
                    codes[k] = code.tobytes()
                keys[rows] = _keys(z > 0, bits, tables)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), tables).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict({"node": batch["node"], "copies": batch["copies"], "dim": batch["dim"], "unit": pa.array([v.tobytes() for v in unit], pa.binary()), "code": pa.array(codes, pa.binary()), "factor": pa.array(factors, pa.float64()), "table_keys": lists})

    return stream


def _keys(signs: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The keys of all tables: the bits of a code, table by table."""
    return signs[:, : bits * tables].reshape(len(signs), tables, bits) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros((len(signs), tables), np.int64)


def _codes(rows: pa.Table, dim: int, bits: int, tables: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(rows.num_rows, -1)
    return np.unpackbits(raw, axis=1)[:, : _size(dim, bits, tables)]


def least_product(threshold: float, size: int) -> float:
    """What the product of two codes of +1 and -1 has at least, over their size, if the cosine reaches the threshold: WIDTH deviations below its mean."""
    p = math.acos(threshold) / math.pi
    return 1 - 2 * (p + WIDTH * math.sqrt(p * (1 - p) / size))


def _close_codes(rows: pa.Table, t: int, cross: bool, threshold: float, bits: int, tables: int) -> np.ndarray:
    """Rows of a bucket that have a partner within the codes' bound which they meet here first."""
    signs = _codes(rows, int(rows["dim"][0].as_py()), bits, tables)
    keys, block = _keys(signs, bits, t), rows["block"].to_numpy()
    code = signs.astype(np.float32) * 2 - 1
    m, size = code.shape
    found = np.zeros(m, bool)
    for lo in range(0, m, 256):
        hi = min(lo + 256, m)
        near = code[lo:hi] @ code[lo:].T >= least_product(threshold, size) * size
        near &= np.arange(lo, m)[None, :] > np.arange(lo, hi)[:, None]
        if cross:
            near &= block[lo:hi, None] != block[None, lo:]
        i, j = np.nonzero(near)
        for at in range(0, len(i), 100_000):
            x, y = i[at : at + 100_000] + lo, j[at : at + 100_000] + lo
            new = ~(keys[x] == keys[y]).any(axis=1)
            found[x[new]] = found[y[new]] = True
    return found


def _bucket(rows: pa.Table, t: int, cross: bool, threshold: float, bits: int, tables: int):
    """Link counts of a bucket's rows and links that span what is linked. cross: only pairs of different blocks."""
    m = rows.num_rows
    unit = np.frombuffer(b"".join(rows["unit"].to_pylist()), np.float64).reshape(m, -1)
    dim = unit.shape[1]
    signs = _codes(rows, dim, bits, tables)
    size = signs.shape[1]
    code = signs.astype(np.float32) * 2 - 1
    factor = rows["factor"].to_numpy().astype(np.float32)
    turned = (unit @ rotations(dim, size).T / math.sqrt(size / dim)).astype(np.float32)
    error = WIDTH * np.sqrt(np.maximum(1 - factor**2, 0)) / (factor * math.sqrt(size - 1))
    keys = _keys(signs, bits, t)
    copies, block = rows["copies"].to_numpy(), rows["block"].to_numpy()
    counts, label = np.zeros(m, np.int64), np.arange(m)
    for lo in range(0, m, 256):
        hi = min(lo + 256, m)
        upper = code[lo:hi] @ turned[lo:].T / (math.sqrt(size) * factor[lo:hi, None]) + error[lo:hi, None]
        again = upper >= threshold
        again &= np.arange(lo, m)[None, :] > np.arange(lo, hi)[:, None]
        if cross:
            again &= block[lo:hi, None] != block[None, lo:]
        i, j = np.nonzero(again)
        for at in range(0, len(i), 100_000):
            a, b = i[at : at + 100_000] + lo, j[at : at + 100_000] + lo
            # A pair counts in the first table in which it meets.
            new = ~(keys[a] == keys[b]).any(axis=1)
            a, b = a[new], b[new]
            new = (unit[a] * unit[b]).sum(axis=1) >= threshold
            a, b = a[new], b[new]
            np.add.at(counts, a, copies[b])
            np.add.at(counts, b, copies[a])
            while len(a):
                x, y = label[a], label[b]
                np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
                while (label != label[label]).any():
                    label[:] = label[label]
                open_ = label[a] != label[b]
                a, b = a[open_], b[open_]
    return counts, label


BUCKET_KEYS = ("t", "dim", "key", "b1", "b2")


def _by_bucket(work: Callable[[pa.Table, int, bool], pa.RecordBatch], none: pa.RecordBatch):
    """Streams rows that are sorted by bucket, and gives each bucket of two rows or more to work (with its table, and whether it crosses blocks)."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(last: bool):
            nonlocal held
            table = pa.Table.from_batches(held).combine_chunks()
            cols = [table[k].to_numpy() for k in BUCKET_KEYS]
            new = np.zeros(table.num_rows, bool)
            new[0] = True
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            cuts = [*np.flatnonzero(new).tolist(), table.num_rows]
            upto = cuts[-1] if last else cuts[-2]
            held = table.slice(upto).to_batches() if upto < table.num_rows else []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi <= upto and hi - lo > 1:
                    yield work(table.slice(lo, hi - lo).combine_chunks(), int(cols[0][lo]), bool(cols[3][lo] != cols[4][lo]))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) > 4 * BLOCK:
                yield from _joined(flush(False), none)
        if held:
            yield from _joined(flush(True), none)

    return stream


def _joined(found: Iterator[pa.RecordBatch], none: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches([none, *found]).combine_chunks()
    yield table.to_batches()[0] if table.num_rows else none


def _linked(threshold: float, bits: int, tables: int):
    def work(rows: pa.Table, t: int, cross: bool) -> pa.RecordBatch:
        counts, label = _bucket(rows, t, cross, threshold, bits, tables)
        node = rows["node"].to_numpy()
        some, child = np.flatnonzero(counts), np.flatnonzero(label != np.arange(len(label)))
        a, b = np.r_[node[some], node[child]], np.r_[node[some], node[label[child]]]
        return pa.record_batch({"a": a, "b": b, "n": np.r_[counts[some], np.zeros(len(child), np.int64)]})

    empty = np.zeros(0, np.int64)
    return _by_bucket(work, pa.record_batch({"a": empty, "b": empty, "n": empty}))


def _candidates(threshold: float, bits: int, tables: int):
    kinds = {"t": pa.int32(), "dim": pa.int32(), "key": pa.int64(), "b1": pa.int32(), "b2": pa.int32(), "block": pa.int32(), "node": pa.int64()}
    schema = pa.schema(kinds.items())

    def work(rows: pa.Table, t: int, cross: bool) -> pa.RecordBatch:
        found = rows.select(list(kinds)).cast(schema).filter(pa.array(_close_codes(rows, t, cross, threshold, bits, tables))).combine_chunks()
        return found.to_batches()[0] if found.num_rows else pa.RecordBatch.from_pylist([], schema=schema)

    return _by_bucket(work, pa.RecordBatch.from_pylist([], schema=schema))


def embedding_groups(vectors: DataFrame, id: str = "vec_id", column: str = "embedding", threshold: float = 0.95, recall: float = RECALL, rows: int = 0) -> DataFrame:
    """A row per vector: vec_id, n_links, component_id, kept.

    Two vectors are linked if they are found and their cosine, in doubles, is at least the threshold. n_links counts the other
    vectors linked directly, component_id is the smallest id reachable, kept tells that it is the vector's own. Vectors that
    are null, empty, zero, or have null or non-finite components link with nothing, nor do vectors of different length.
    Equal vectors are one node with a number of copies, so that they cost one row; they are linked to each other. A bucket of
    more than BLOCK rows is dealt out as pairs of blocks. Pairs stay inside a task; it hands on which rows have close codes, then counts and
    spanning links. Tables are planned for the number of distinct vectors, or for `rows` if that is more. Null ids and repeated rows each give
    their row; other columns aren't read; an empty table gives none.
    """
    if not 0 < threshold < 1:
        raise ValueError("the threshold lies between 0 and 1")
    text_batches(vectors.sparkSession)
    own = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("embedding"))
    own = materialize(own.mapInArrow(_digests, "vec_id long, h1 long, h2 long, dim int, embedding array<double>"), "vectors")
    nodes = own.where("dim > 0").groupBy("h1", "h2", "dim").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    bits, tables = plan(max(nodes.count(), rows), threshold, recall)
    index = materialize(nodes.select("node", "copies", "dim", "embedding").mapInArrow(_index(bits, tables), "node long, copies long, dim int, unit binary, code binary, factor double, table_keys array<long>"), "codes")
    coded = index.select("node", "dim", "code", F.posexplode("table_keys").alias("t", "key"))
    large = coded.groupBy("t", "dim", "key").count().where(F.col("count") > 2 * BLOCK)
    large = materialize(large.select("t", "dim", "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "large-buckets")
    coded = coded.join(small(large, 100_000) or large, ["t", "dim", "key"], "left")
    coded = coded.withColumn("block", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), "blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1))
    coded = coded.withColumn("o", other).withColumns({"b1": F.least("block", "o"), "b2": F.greatest("block", "o")})

    def gathered(df: DataFrame) -> DataFrame:
        return df.repartition(*BUCKET_KEYS).sortWithinPartitions(*BUCKET_KEYS, "node")

    close = gathered(coded.select(*BUCKET_KEYS, "block", "node", "code")).mapInArrow(_candidates(threshold, bits, tables), "t int, dim int, key long, b1 int, b2 int, block int, node long")
    close = materialize(close, "close-codes").join(index.select("node", "copies", "unit", "code", "factor"), "node")
    found = materialize(gathered(close.select(*BUCKET_KEYS, "block", "node", "copies", "unit", "code", "factor")).mapInArrow(_linked(threshold, bits, tables), "a long, b long, n long"), "pairs")
    counts = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    star = components(found.where("n = 0"))
    named = nodes.select("h1", "h2", "least", "copies", "node").join(star.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = materialize(named.join(counts, "node", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1), "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "root").select("h1", "h2", "n_links", "component_id")
    out = own.select("vec_id", "h1", "h2").join(classes, ["h1", "h2"], "left")
    component = F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
