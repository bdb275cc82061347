"""Approximate nearest neighbours by learned partitions.

The nearest neighbours of a bounded sample make a graph; it is cut into parts of equal size that few of its edges cross, by bisection along
the slowest wave of the graph and swaps that save edges. A small network learns which part a vector belongs to, from its own part and its neighbours'. It
places every vector in a part, and sends a query to its most probable parts, where cosines are computed exactly. How much probability these have to hold
together is read off vectors of the sample that the fit hasn't seen: the parts of their neighbours in it have to be among them as often as the recall asks for. Neighbours in
the sample lie farther off than those in the table, so that this errs on the safe side. Vectors that lie in clusters need few parts; vectors without any structure need most.
Parts are dealt out in blocks of vectors and of queries, so that no task gathers a part that has grown.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewatch.llm.common import materialize, small, text_batches

#: Vectors that a part has on average, and parts at most: beyond, parts grow and are dealt out in blocks.
PART_ROWS, MAX_PARTS = 512, 1024
#: Vectors of the sample for each part: the fit sees at most FIT_ROWS * MAX_PARTS = 32,768, the first by a hash.
FIT_ROWS = 32
#: Share of the nearest neighbours that the parts of a query hold, and vectors that this is read off, at most an eighth of the sample.
RECALL, HELD_OUT = 0.96, 1024
#: Neighbours of a vector in the graph, units of the network's hidden layer, and times that it sees the sample.
NEIGHBOURS, HIDDEN, EPOCHS = 10, 128, 40
#: Vectors and queries of a block.
BLOCK = 2048


@dataclass(frozen=True)
class Router:
    """The network. parts: how many; without weights there is one. mass: probability that the parts of a query hold together."""

    parts: int
    weights: tuple[np.ndarray, ...] = ()
    mass: float = 1.0

    def probabilities(self, unit: np.ndarray) -> np.ndarray:
        """Of each part, for unit vectors."""
        if not self.weights:
            return np.ones((len(unit), self.parts)) / self.parts
        w1, b1, w2, b2 = self.weights
        z = np.maximum(unit @ w1 + b1, 0) @ w2 + b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def nearest(unit: np.ndarray, of: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """For the rows numbered `of`: the numbers of the k rows with the largest product, itself left out."""
    out = np.zeros((len(of), min(k, len(unit) - 1)), np.int64)
    for lo in range(0, len(of), 512):
        rows = of[lo : lo + 512]
        near = unit[rows] @ unit.T
        near[np.arange(len(rows)), rows] = -np.inf
        out[lo : lo + 512] = np.argpartition(-near, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def _bisect(nodes: np.ndarray, edges: np.ndarray, share: float, rng: np.random.Generator) -> np.ndarray:
    """True for `share` of the nodes, so that few edges (pairs of positions in nodes) lie across."""
    n = len(nodes)
    a, b = edges
    degree = np.bincount(a, minlength=n) + 1.0
    root = np.sqrt(degree)
    wave = rng.standard_normal(n)
    for _ in range(60):
        wave -= root * (wave @ root) / (root @ root)
        wave = (wave + (np.bincount(a, (wave / root)[b], minlength=n) + wave / root) / root) / 2
        wave /= np.linalg.norm(wave) or 1.0
    side = np.zeros(n, bool)
    side[np.argsort(wave / root, kind="stable")[: round(n * share)]] = True
    best, least = side.copy(), int((side[a] != side[b]).sum())
    for _ in range(12):
        away = np.bincount(a, side[a] != side[b], minlength=n)
        gain = 2 * away - (degree - 1)
        inner, outer = np.flatnonzero(side), np.flatnonzero(~side)
        inner, outer = inner[np.argsort(-gain[inner], kind="stable")], outer[np.argsort(-gain[outer], kind="stable")]
        m = min(len(inner), len(outer))
        pays = int((gain[inner[:m]] + gain[outer[:m]] > 0).sum())
        if not pays:
            break
        # Half of what pays: moved together, neighbours would change places for nothing.
        move = (pays + 1) // 2
        side[inner[:move]], side[outer[:move]] = False, True
        cut = int((side[a] != side[b]).sum())
        if cut >= least:
            break
        best, least = side.copy(), cut
    return best


def partition(neighbours: np.ndarray, parts: int, seed: int = 5) -> np.ndarray:
    """A part for each node of the graph; parts differ in size by rounding only."""
    n, k = neighbours.shape
    a, b = np.repeat(np.arange(n), k), neighbours.ravel()
    both = np.unique(np.stack([np.r_[a, b], np.r_[b, a]]), axis=1)
    label, rng = np.zeros(n, np.int64), np.random.default_rng(seed)
    open_ = [(np.arange(n), both, 0, parts)]
    while open_:
        nodes, edges, first, count = open_.pop()
        if count == 1:
            label[nodes] = first
            continue
        half = count // 2
        side = _bisect(nodes, edges, half / count, rng)
        for mine, start, size in ((side, first, half), (~side, first + half, count - half)):
            place = np.cumsum(mine) - 1
            inside = mine[edges[0]] & mine[edges[1]]
            open_.append((nodes[mine], place[edges[:, inside]], start, size))
    return label


def train(unit: np.ndarray, neighbours: np.ndarray, label: np.ndarray, parts: int, seed: int = 6) -> Router:
    """A network with one hidden layer; a vector's target is half its own part and half its neighbours'."""
    n, dim = unit.shape
    rng = np.random.default_rng(seed)
    weights = [rng.standard_normal((dim, HIDDEN)) * np.sqrt(2.0), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) / np.sqrt(HIDDEN), np.zeros(parts)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for epoch in range(EPOCHS):
        rate = 0.01 * (1 - epoch / EPOCHS)
        order = rng.permutation(n)
        for lo in range(0, n, 256):
            rows = order[lo : lo + 256]
            target = np.zeros((len(rows), parts))
            target[np.arange(len(rows)), label[rows]] = 0.5
            np.add.at(target, (np.arange(len(rows))[:, None], label[neighbours[rows]]), 0.5 / neighbours.shape[1])
            w1, b1, w2, b2 = weights
            hidden = np.maximum(unit[rows] @ w1 + b1, 0)
            z = hidden @ w2 + b2
            z = np.exp(z - z.max(axis=1, keepdims=True))
            back = (z / z.sum(axis=1, keepdims=True) - target) / len(rows)
            down = (back @ w2.T) * (hidden > 0)
            step += 1
            for k, g in enumerate((unit[rows].T @ down, down.sum(axis=0), hidden.T @ back, back.sum(axis=0))):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Router(parts, tuple(weights))


def _vectors(batch: pa.RecordBatch, column: str) -> list[np.ndarray | None]:
    """Vectors in doubles, times a power of two that keeps their squares finite; None where one takes no part."""
    out: list[np.ndarray | None] = []
    for x in batch[column]:
        values = x.values if x.is_valid else None
        if values is None or not len(values) or values.null_count:
            out.append(None)
            continue
        v = values.to_numpy(zero_copy_only=False).astype(np.float64)
        top = np.abs(v).max()
        out.append(np.ldexp(v, -np.frexp(top)[1]) + 0.0 if np.isfinite(top) and top > 0 else None)
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [(k, v) for k, v in enumerate(_vectors(batch, "embedding")) if v is not None]
        keys = [hashlib.sha256(v.tobytes()).digest()[:16] for _, v in good]
        yield pa.record_batch({
            "vec_id": batch["vec_id"].take(pa.array([k for k, _ in good], pa.int64())), "key": pa.array(keys, pa.binary()),
            "dim": pa.array([len(v) for _, v in good], pa.int32()), "v": pa.array([v.tobytes() for _, v in good], pa.binary()),
        })


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def _units(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def needed_mass(router: Router, seen: np.ndarray, held: np.ndarray, top: int, recall: float) -> float:
    """Probability before the parts of the `top` neighbours among seen of vectors held out: what `recall` of them have at most."""
    part = router.probabilities(seen).argmax(axis=1)
    found = []
    for lo in range(0, len(held), 256):
        rows = held[lo : lo + 256]
        near = np.argpartition(-(rows @ seen.T), top - 1, axis=1)[:, :top]
        odds = router.probabilities(rows)
        order = np.argsort(-odds, axis=1, kind="stable")
        sorted_odds = np.take_along_axis(odds, order, axis=1)
        before = np.zeros_like(odds)
        np.put_along_axis(before, order, np.cumsum(sorted_odds, axis=1) - sorted_odds, axis=1)
        found.append(np.take_along_axis(before, part[near], axis=1).ravel())
    return float(np.quantile(np.concatenate(found), recall, method="higher"))


def fit(nodes: DataFrame, dim: int, parts: int, top: int = 5, recall: float = RECALL) -> Router:
    """Sample, graph, parts and network of the vectors of one dimension; nodes: key, dim, v."""
    if parts < 2:
        return Router(1)
    spark = nodes.sparkSession
    sample = nodes.where(F.col("dim") == dim).orderBy(F.xxhash64("key"), "key").limit(FIT_ROWS * parts).select("v").toArrow()
    unit = _units(_matrix(sample["v"]))
    held, unit = np.split(unit, [min(HELD_OUT, len(unit) // 8)])
    shared = spark.sparkContext.broadcast(unit)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = nearest(shared.value, batch["id"].to_numpy())
            lists = pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), near.shape[1]).cast(pa.list_(pa.int64()))
            yield pa.record_batch({"id": batch["id"], "near": lists})

    found = spark.range(len(unit)).mapInArrow(neighbours, "id long, near array<long>").toArrow().sort_by("id")
    graph = found["near"].combine_chunks().values.to_numpy().reshape(len(unit), -1)
    router = train(unit, graph, partition(graph, parts), parts)
    return replace(router, mass=needed_mass(router, unit, held, min(top, len(unit)), recall)) if len(held) else router


def _routed(routers: dict[int, Router], sizes: dict[int, np.ndarray] | None, least: int):
    """Rows with their part; with sizes, a row for each of the most probable parts that hold something, as many as the mass asks for and as hold `least` vectors."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            at, part = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                odds = routers[dim].probabilities(_units(_matrix(batch["v"].take(pa.array(rows)))))
                if sizes is None:
                    at.append(rows)
                    part.append(odds.argmax(axis=1))
                    continue
                order = np.argsort(np.where(sizes[dim] > 0, -odds, np.inf), axis=1, kind="stable")
                size, mass = sizes[dim][order], np.take_along_axis(odds, order, axis=1)
                take = (size > 0) & ((np.cumsum(mass, axis=1) - mass <= routers[dim].mass) | (np.cumsum(size, axis=1) - size < least))
                i, j = np.nonzero(take)
                at.append(rows[i])
                part.append(order[i, j])
            yield pa.RecordBatch.from_arrays([*(batch.take(pa.array(np.concatenate(at))).columns), pa.array(np.concatenate(part).astype(np.int32))], [*batch.schema.names, "part"])

    return stream


def _best(top: int):
    """Of a block of vectors, each query's `top` nearest: by cosine, then by least id."""

    def of(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[pa.Table] = []
        if left.num_rows and right.num_rows:
            v, q = _matrix(left["v"]), _matrix(right["v"])
            least, keys, own = left["least"].to_numpy(), left["key"].combine_chunks(), right["key"].combine_chunks()
            norm, norm_q = np.sqrt((v * v).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
            unit, keep = v / norm[:, None], min(top, len(v))
            for lo in range(0, len(q), 256):
                near = (q[lo : lo + 256] / norm_q[lo : lo + 256, None]) @ unit.T
                # What rounding may have put behind counts too; then each pair is computed on its own.
                i, j = np.nonzero(near >= np.partition(near, -keep, axis=1)[:, -keep, None] - 1e-9)
                score = np.concatenate([(q[lo + i[s : s + 50_000]] * v[j[s : s + 50_000]]).sum(axis=1) for s in range(0, len(i), 50_000)]) / (norm_q[lo + i] * norm[j])
                order = np.lexsort((least[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                first = np.r_[0, np.flatnonzero(np.diff(i)) + 1]
                place = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
                s = np.flatnonzero(place < top)
                found.append(pa.table({"query": own.take(pa.array(lo + i[s])), "key": keys.take(pa.array(j[s])), "least": least[j[s]], "score": score[s]}))
        return pa.concat_tables(found) if found else pa.table({"query": pa.array([], pa.binary()), "key": pa.array([], pa.binary()), "least": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    return of


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, top: int = 5, id: str = "vec_id", column: str = "embedding", recall: float = RECALL, part_rows: int = PART_ROWS) -> DataFrame:
    """For each query its `top` nearest vectors found: query_id, rank (int, from 1), vec_id, score.

    Both tables have an id and a vector. Nearness is the cosine in doubles, of ties the smaller id goes first; a vector with the query's own id is no candidate. Fewer than
    `top` rows come back only where fewer candidates of the query's dimension exist. Vectors that are null, empty, zero, or hold null or
    non-finite components take no part, nor do null ids. Rows that repeat id and vector count once; an id with several vectors stands for each. Equal vectors are
    searched once. Other columns aren't read; an empty table gives no row. The fit is on a sample (FIT_ROWS); every vector is indexed. recall: see needed_mass; 1 compares with all. The driver
    holds the sample, the network, and the sizes of at most MAX_PARTS parts for each dimension.
    """
    if top < 1 or not 0 < recall <= 1:
        raise ValueError("top is at least 1, and the recall over 0 and at most 1")
    spark = vectors.sparkSession
    text_batches(spark)

    def read(df: DataFrame, label: str) -> DataFrame:
        own = df.select(F.col(id).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("embedding")).where("vec_id is not null")
        return materialize(own.mapInArrow(_digests, "vec_id long, key binary, dim int, v binary"), label)

    own, asked = read(vectors, "vectors"), read(queries, "queries")
    nodes = materialize(own.groupBy("key", "dim").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v")), "nodes")
    counts = {r["dim"]: r["count"] for r in nodes.groupBy("dim").count().toLocalIterator()}
    routers = {dim: fit(nodes, dim, min(MAX_PARTS, max(1, n // part_rows)), top, recall) for dim, n in counts.items()}
    placed = materialize(nodes.mapInArrow(_routed(routers, None, 0), "key binary, dim int, least long, copies long, v binary, part int"), "parts")
    held = {dim: np.zeros(r.parts, np.int64) for dim, r in routers.items()}
    for r in placed.groupBy("dim", "part").agg(F.sum("copies").alias("ids")).toLocalIterator():
        held[r["dim"]][r["part"]] = r["ids"]
    known = asked.groupBy("key", "dim").agg(F.first("v").alias("v")).where(F.col("dim").isin(list(counts)))
    routes = materialize(known.mapInArrow(_routed(routers, held, top + 1), "key binary, dim int, v binary, part int"), "routes")

    def blocks(df: DataFrame, name: str) -> DataFrame:
        """How many blocks a part's rows make: MAX_PARTS rows for each dimension."""
        return df.groupBy("dim", "part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))

    sizes = materialize(blocks(placed, "blocks").join(blocks(routes, "query_blocks"), ["dim", "part"]), "blocks")
    sizes = small(sizes, 1_000_000) or sizes

    def dealt(df: DataFrame, mine: str, other: str, names: tuple[str, str]) -> DataFrame:
        df = df.join(sizes, ["dim", "part"]).withColumn(names[0], F.pmod(F.xxhash64("key"), F.col(mine)).cast("int"))
        return df.withColumn(names[1], F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    block = ["dim", "part", "b", "q"]
    left = dealt(placed, "blocks", "query_blocks", ("b", "q")).select(*block, "key", "least", "v")
    right = dealt(routes, "query_blocks", "blocks", ("q", "b")).select(*block, "key", "v")
    found = left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(_best(top + 1), "query binary, key binary, least long, score double")
    nearest_first = [F.desc("score"), F.col("least")]
    found = found.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy(*nearest_first))).where(F.col("_n") <= top + 1).drop("_n", "least")
    members = own.select("key", "vec_id").distinct().withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("_n") <= top + 1).drop("_n")
    ids = materialize(found, "found").join(members, "key").withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("_n") <= top + 1)
    asked = asked.select(F.col("key").alias("query"), F.col("vec_id").alias("query_id")).distinct()
    answers = asked.join(ids.select("query", "vec_id", "score"), "query").where("vec_id <> query_id")
    # By the query's vector as well: an id may stand for several.
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= top)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
