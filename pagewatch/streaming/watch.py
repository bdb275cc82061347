"""The watch as a stream of snapshot files, and the sinks that may be repeated."""

from __future__ import annotations

import datetime
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from pagewatch.functions import text as T
from pagewatch.operators.changes import SAME_MEANING, moves, same_meaning
from pagewatch.sources import bucketed

CHANGES = "source_id string, change_id string, at long, before_digest string, digest string, outcome string, added int, removed int"
#: What is kept of a source: the digest last read, the text of the version last stored (compressed), when it was read (microseconds), and when it counts as silent (milliseconds).
STATE = "digest string, text binary, at long, silent_at long"
#: transformWithState keeps its state in this store.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _ms(at: int) -> int:
    """Milliseconds of a time in microseconds, rounded up: a timer of then has the version behind it."""
    return -(-at // 1000)


class Watch(StatefulProcessor):
    """The versions of a source in the order of their time; they come once the watermark has passed them. Of a source's state, a batch reads one value and writes one, however many versions it has."""

    def __init__(self, silent_ms: int | None, threshold: float) -> None:
        self.silent_ms, self.threshold = silent_ms, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        out: list[Row] = []
        before = last = self._stored()
        versions = sorted(((r.at, r.digest, zlib.compress(r.text.encode(), 1), r.vec_before, r.vec_after) for r in rows), key=lambda x: x[:2])
        for at, digest, packed, vec_before, vec_after in versions:
            # What was read before the version last compared comes too late to be put in its place.
            if before is None or at > before[2]:
                if last is not None and last[3] is not None and last[3] < _ms(at):
                    out.append(self._silent(key[0], last))
                    last = None
                last = self._step(key[0], last, at, digest, packed, vec_before, vec_after, out)
        if last is not before:
            self.last.update(last)
            if last[3] is not None:
                self.handle.registerTimer(last[3])
        return iter(out)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        last = self._stored()
        if last is None or last[3] is None or last[3] > expiredTimerInfo.getExpiryTimeInMs():
            return iter(())
        self.last.clear()
        return iter([self._silent(key[0], last)])

    def _stored(self) -> tuple | None:
        last = self.last.get()
        return None if last is None else tuple(last)

    @staticmethod
    def _silent(source: str, last: tuple) -> Row:
        """Nothing came after it: the source has fallen silent, and nothing is kept of it. When it speaks again it begins anew."""
        return Row(source_id=source, change_id=None, at=last[2], before_digest=last[0], digest=None, outcome="silent", added=0, removed=0)

    def _step(self, source: str, last: tuple | None, at: int, digest: str, packed: bytes, vec_before: list | None, vec_after: list | None, out: list[Row]) -> tuple:
        """The state after a version; a change goes to out."""
        silent_at = None if self.silent_ms is None else _ms(at) + self.silent_ms
        if last is None or (last[0] == digest):
            return (digest, packed if last is None else last[1], at, silent_at)
        old, new = (zlib.decompress(bytes(x)).decode() for x in (last[1], packed))
        if old == new:
            return (digest, last[1], at, silent_at)
        moved = moves(*([x for x in t.split("\n") if x] for t in (old, new)))
        if same_meaning(moved["gone"], moved["come"], vec_before, vec_after, self.threshold):
            return (digest, last[1], at, silent_at)
        change = hashlib.sha256(f"{source}\n{last[0]}\n{digest}".encode()).hexdigest()[:24]
        out.append(Row(source_id=source, change_id=change, at=at, before_digest=last[0], digest=digest, outcome="changed", added=moved["added"], removed=moved["removed"]))
        return (digest, packed, at, silent_at)

    def close(self) -> None:
        pass


def stream_watch(snapshots: DataFrame, delay: str = "1 day", silent: datetime.timedelta | None = None, threshold: float = SAME_MEANING) -> DataFrame:
    """A stream of snapshots (source_id, read_at, html, and where there are any vec_before and vec_after) to a stream of change rows.

    Digest and text are made by built-in functions before the state. Versions wait, in the state of a grouping by their time, until the watermark (read_at less the delay) has passed
    them, and are then compared in the order of their time, so that files may come in any order within the delay; what comes later than that is left out. Each goes through the gates of
    the batch watch (watch_round): equal digests, equal lines and the same meaning in other words make no row. Then the digest moves; the stored text only with a change. A
    page's vectors are those of what this version removed and added.

    Of a source the state holds one text, compressed, beside what waits; of versions of a source that have one time and digest, the greatest counts. silent: where no version has come for so long after the last (by the watermark), the source gets a row with
    outcome "silent" and its state goes. A null html or source_id is no version. The session's state store has to be RocksDB (see drain, which sets it).
    """
    vectors = [F.col(x).cast("array<double>").alias(x) if x in snapshots.columns else F.lit(None).cast("array<double>").alias(x) for x in ("vec_before", "vec_after")]
    own = snapshots.where("html is not null and source_id is not null and read_at is not null").select("source_id", "read_at", T.stable_digest("html").alias("digest"), F.array_join(T.lines(T.page_text("html")), "\n").alias("text"), *vectors)
    # Waiting is Spark's own state, without Python: a grouping that has the time among its keys gives a group once, when the watermark has passed its time.
    waited = own.withWatermark("read_at", delay).groupBy("source_id", "read_at", "digest").agg(F.max(F.struct("text", "vec_before", "vec_after")).alias("version"))
    passed = waited.select("source_id", "read_at", F.unix_micros("read_at").alias("at"), "digest", "version.*")
    silent_ms = None if silent is None else silent // datetime.timedelta(milliseconds=1)
    rows = passed.groupBy("source_id").transformWithState(Watch(silent_ms, threshold), CHANGES, "append", "eventTime")
    return rows.select("source_id", "change_id", F.timestamp_micros("at").alias("read_at"), "before_digest", "digest", "outcome", "added", "removed")


def stream_upsert(path: str, key: str, at: str, schema: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges a batch into the table at path (see bucketed.merge_table) by derived ids. A batch that comes twice changes nothing.

    Only buckets that the batch touches are rewritten; what nobody reads any more is deleted two merges later.
    """

    def step(batch: DataFrame, number: int) -> None:
        own = batch.persist()  # its ids are read before its rows
        try:
            if bucketed.merge_table(path, own, key, at, schema, buckets):
                bucketed.vacuum(batch.sparkSession, path)
        finally:
            own.unpersist()

    return step


def stream_dedupe(changes: DataFrame, at: str = "after_read_at", delay: str = "7 days") -> DataFrame:
    """Change rows, each id once within the watermark."""
    return changes.withWatermark(at, delay).dropDuplicatesWithinWatermark(["change_id"])


def daily_counts(rounds: DataFrame, at: str = "started_at", delay: str = "1 day") -> DataFrame:
    """day, rounds, changed, usd per day; rows later than the watermark are left out."""
    return rounds.withWatermark(at, delay).groupBy(F.window(at, "1 day")).agg(F.count("*").alias("rounds"), F.sum("changed").alias("changed"), F.sum("usd").alias("usd")).select(F.to_date("window.start").alias("day"), "rounds", "changed", "usd")


_SAFE = re.compile(r"[^a-z0-9_]")


def drain(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Everything that a stream has now, as a table: for backfills and tests. Executors write it as Parquet beside the checkpoint; no row goes to the driver."""
    name = _SAFE.sub("_", name.lower())
    path = f"{checkpoint.rstrip('/')}-{name}"
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        query = stream.writeStream.format("parquet").queryName(name).outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        conf.set(PROVIDER, before) if before else conf.unset(PROVIDER)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
