"""What the operators share: scratch tables in the cluster's shared folder, words and hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes between words: [\x20\x09-\x0D]. bytes.split() without arguments splits on exactly these.
WHITE = b" \t\n\r\x0b\x0c"
#: Words of text that one vectorised step takes at most, unless one document alone has more.
CHUNK_WORDS = 100_000
#: Rows of an Arrow batch.
BATCH_ROWS = 1024
#: Rows and bytes of an Arrow batch that become Python objects at once, unless one row alone has more.
SLICE_ROWS, SLICE_BYTES = 1024, 2 << 20

_scratch: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Only where it is unset, and only on a local master, a temporary folder takes its place.
    """
    conf = spark.sparkContext.getConf()
    if found := spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = tempfile.mkdtemp(prefix="spark-pagewatch-")
    return "file://" + _scratch[app]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pagewatch/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pagewatch_path = path
    return out


def forget(table: DataFrame) -> None:
    """Delete a table that materialize has written, once nothing reads it any more."""
    spark = table.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._pagewatch_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables. DataFrames that still read them end."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(
        f"{shared_dir(spark)}/pagewatch/{spark.sparkContext.applicationId}"
    )
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int) -> DataFrame | None:
    """df with a broadcast hint if it has at most so many rows, else None: the caller then takes the way that shuffles.

    df should be cheap to count: a table or an aggregate over one.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else None


def text_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have BATCH_ROWS rows at most: at texts of any length, a batch fits beside an executor's heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def slices(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """A column of texts in runs of bounded size: (index of the first, texts)."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(column):
        ends = np.cumsum(sizes[at : at + SLICE_ROWS])
        n = max(1, int(np.searchsorted(ends, SLICE_BYTES, side="right")))
        yield at, column.slice(at, n).to_pylist()
        at += n


def word_lists(texts: list[str | None]):
    """Groups of texts as lists of words (UTF-8 bytes): (index of the first text, lists), CHUNK_WORDS words at a time."""
    first, lists, n = 0, [], 0
    for i, text in enumerate(texts):
        words = text.encode().split() if text else []
        lists.append(words)
        n += len(words)
        if n >= CHUNK_WORDS:
            yield first, lists
            first, lists, n = i + 1, [], 0
    if lists:
        yield first, lists


def hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(seed)), np.uint64, len(words))


def hashed(lists: list[list[bytes]], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one after the other, and where each text starts, with the total at the end."""
    starts = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=starts[1:])
    flat = [w for x in lists for w in x]
    return hashes(flat, seed), starts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
