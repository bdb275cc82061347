"""Best-fit packing of tokenized documents into sequences, certified by dual-feasible-function bounds."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewatch.llm.common import materialize, slices, text_batches
from pagewatch.llm.word_ids import WordIds

#: Pieces that a task packs together, on average.
GROUP = 8192
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", grp long, bin long, offset long, fill long, least_fill long, group_bins long, group_bound long"


def _pieces(tokenizer: str, capacity: int, end_id: int):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds.get(tokenizer)
        end = end_id.to_bytes(4, "little")
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            docs = batch["doc_id"].to_pylist()
            for first, texts in slices(batch["text"]):
                rows: list[tuple] = []
                for doc, data in zip(docs[first:], ids.encode_all(texts), strict=False):
                    data += end
                    for k, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        ids.clear()

    return stream


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, at least: the best of several dual feasible functions over the lengths.

    The functions: a threshold on small items (with the free room beside items of over half), and the stepped functions
    u_k, x -> floor((k + 1) x) / k unless (k + 1) x is whole. All in whole numbers.
    """
    n = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int((n * size).sum()) // capacity)
    count, total = np.cumsum(n), np.cumsum(n * size)
    half = capacity // 2
    a = np.arange(half + 1)
    above = count[-1] - count[capacity - a]  # items over capacity - a
    middle = count[capacity - a] - count[half]  # over half, up to capacity - a
    middle_size = total[capacity - a] - total[half]
    rest = total[half] - np.where(a > 0, total[np.maximum(a - 1, 0)], 0)  # from a to half
    room = middle * capacity - middle_size
    best = max(best, int((above + middle + np.maximum(0, -(-(rest - room) // capacity))).max()))
    for k in range(1, 33):
        step = (k + 1) * size
        value = np.where(step % capacity == 0, k * size, step // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((n * value).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, in the order given (decreasing), and the bins' fills: each goes where least room is left over."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: dict[int, list[int]] = defaultdict(list)
    open_, fills = 0, []
    for i, n in enumerate(lengths.tolist()):
        fit = open_ >> n
        if fit:
            left = n + (fit & -fit).bit_length() - 1
            k = room[left].pop()
            if not room[left]:
                open_ ^= 1 << left
        else:
            left, k = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = k, fills[k]
        fills[k] += n
        if left > n:
            room[left - n].append(k)
            open_ |= 1 << (left - n)
    return bins, offsets, np.array(fills, np.int64)


def _pack(capacity: int):
    def pack(rows: pa.Table) -> pa.Table:
        by = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]
        rows = rows.take(pc.sort_indices(rows, sort_keys=by))
        lengths = rows["length"].to_numpy()
        bins, offsets, fills = best_fit(lengths, capacity)
        n = len(lengths)
        more = {"bin": bins, "offset": offsets, "fill": fills[bins], "least_fill": np.full(n, fills.min()), "group_bins": np.full(n, len(fills)), "group_bound": np.full(n, lower_bound(lengths, capacity))}
        return pa.table({k: rows[k] for k in (*(x.split()[0] for x in PIECES.split(", ")), "grp")} | {k: pa.array(v, pa.int64()) for k, v in more.items()})

    return pack


def _round(items: DataFrame, rows: int, group: int, capacity: int) -> DataFrame:
    """Deal the items to groups of about `group` rows and pack each. items is a stored table, so that a retried task deals alike."""
    groups = max(1, round(rows / group))
    dealt = items.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("grp").applyInArrow(_pack(capacity), PACKED)


def pack_documents(docs: DataFrame, tokenizer: str, text: str = "text", id: str = "doc_id", capacity: int = 2048, end_id: int = 0, group: int = GROUP, rounds: int = 3) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, group_bins, group_bound.

    A document is its token ids and then end_id; only longer ones than the capacity are cut, into full pieces and a rest.
    Groups of pieces are packed by best-fit decreasing, and dual-feasible-function bounds certify how many bins a group needs at
    least. Where a bound is missed, all bins that have room give up their pieces; where it is met, a group may still hold
    one bin that others could fill, and gives up its emptiest. These pieces are exchanged: dealt to new groups and packed again, as long as that
    saves bins, up to `rounds` times. group_bins and group_bound tell of the piece's last group.
    A null or empty text is one piece, end_id alone. Null ids and repeated rows each give their pieces; other columns
    aren't read; an empty table gives none.
    """
    text_batches(docs.sparkSession)
    own = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = materialize(own.mapInArrow(_pieces(tokenizer, capacity, end_id), PIECES), "pieces")
    names = [x.split()[0] for x in PIECES.split(", ")]
    packed = materialize(_round(pieces, pieces.count(), group, capacity), "packed-0")
    done = packed.where(F.lit(False)).withColumn("round", F.lit(0))
    for k in range(rounds):
        loose = (F.col("fill") < capacity) & ((F.col("group_bins") > F.col("group_bound")) | (F.col("fill") == F.col("least_fill")))
        n, bins = packed.where(loose).agg(F.count("*"), F.count_if(F.col("offset") == 0)).first()
        if n < 2:
            break
        again = materialize(_round(packed.where(loose).select(*names), n, group, capacity), f"packed-{k + 1}")
        if again.where("offset = 0").count() >= bins:
            break
        done = done.union(packed.where(~loose).withColumn("round", F.lit(k)))
        packed = again
    else:
        k = rounds
    every = done.union(packed.withColumn("round", F.lit(k if rounds else 0)))
    sequence = F.shiftleft(F.col("round").cast("long"), 56).bitwiseOR(F.shiftleft("grp", 24)).bitwiseOR(F.col("bin"))
    return every.select(*names, sequence.alias("sequence_id"), "offset", "group_bins", "group_bound")
