"""Keeping the collection fresh: a journal of file events, debounced runs, and streams of events.

A poll lists the workspace by tasks and compares it with the listing before; what differs is
appended to a journal, a folder of Parquet files that any number of streams read (``events``),
with offsets that count its files and don't grow with the workspace.  A run comes when the
journal has been quiet for a while, or in any case when its oldest open event has waited for a
limit.  Nobody sleeps: what is open is told by the journal itself, so a restart inside a burst
goes on where the burst was.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.diff import changes
from ..schema import LEDGER
from ..sources.files import WorkspaceFiles
from ..sources.ignore import ignored
from ..sources.store import Conflict, Folder

#: Fixed values, in milliseconds: quiet time before a run, and age at which a write has settled.
DEBOUNCE_MS, SETTLE_MS = 1500, 500
#: Milliseconds after which a run comes although events keep coming.
LIMIT_MS = 60_000
EVENTS = "path string, op string, ts timestamp"
#: Names of events by what changed.
_OPS = {"add": "add", "change": "change", "delete": "unlink"}


def _text(ms: float) -> str:
    """A time as listings tell it."""
    at = datetime.fromtimestamp(ms / 1000, timezone.utc)
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


class Journal(Folder):
    """Events of the files under ``dirs`` of a workspace that no pattern ignores.

    The folder holds ``events/poll=N``, the listing of the last poll that found some, and notes
    that say up to which poll the events are done with.  A poll that crashes is made again:
    its events are written once more, so readers get each event at least once.
    """

    def __init__(self, spark: SparkSession, root: str, path: str, *, dirs: Iterable[str] = ("",), patterns: Iterable[str] = (), settle_ms: int = SETTLE_MS):
        super().__init__(spark, path)
        self.root, self.dirs, self.patterns, self.settle_ms = root, list(dirs), list(patterns), settle_ms
        spark.dataSource.register(WorkspaceFiles)

    def _done(self) -> int:
        """The last poll whose events are whole; -1 before the first listing."""
        polls = [int(n.split("=")[1]) for n in self._names("events") if n.startswith("poll=") and self._fs.exists(self._at(f"events/{n}/_SUCCESS"))]
        return max(polls, default=-1)

    def _listing(self, poll: int) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(f"{self.path}/files/v={poll}")

    def poll(self, now: float | None = None) -> int:
        """Look at the workspace once; the number of new events.  The first poll takes what is there as known.

        A file that was written within ``settle_ms`` counts as it was before; its event comes when it has settled.
        """
        at = (time.time() if now is None else now) * 1000
        last = self._done()
        path = F.col("file_path")
        found = self.spark.read.format("workspace_files").option("path", self.root).option("dirs", json.dumps(self.dirs)).load()
        found = found.filter(~ignored(path, self.patterns)).dropDuplicates(["file_path"])
        limit = F.lit(_text(at - self.settle_ms))
        here, fresh = found.filter(F.col("last_modified") <= limit), found.filter(F.col("last_modified") > limit)
        if last >= 0 and self.settle_ms:
            before = self._listing(last)
            listed = found.withColumn("_fresh", F.col("last_modified") > limit).join(before.withColumnRenamed("last_modified", "_was"), "file_path", "left")
            here = listed.filter(~F.col("_fresh") | F.col("_was").isNotNull()).select("file_path", F.when(F.col("_fresh"), F.col("_was")).otherwise(F.col("last_modified")).alias("last_modified"))
        elif not self.settle_ms:
            here = here.unionByName(fresh)
        n = last + 1
        here.write.mode("overwrite").parquet(f"{self.path}/files/v={n}")
        new = changes(self._listing(n), self._listing(last)).filter(F.col("op") != "same") if last >= 0 else None
        count = 0 if new is None else new.count()
        if last >= 0 and not count:
            return 0
        op = F.col("op")
        named = F.coalesce(*[F.when(op == k, v) for k, v in _OPS.items()])
        told = self.spark.createDataFrame([], EVENTS) if new is None else new.select(F.col("file_path").alias("path"), named.alias("op"), F.timestamp_millis(F.lit(int(at))).alias("ts"))
        told.write.mode("overwrite").parquet(f"{self.path}/events/poll={n}")
        for name in self._names("files"):
            if name not in (f"v={n - 1}", f"v={n}"):
                self._fs.delete(self._at(f"files/{name}"), True)
        return count

    def open(self) -> tuple[int, float, float] | None:
        """The last poll, and the times of the first and last event, of those that no run is done with; None where there are none."""
        last, note = self._done(), self.note()
        done = note["poll"] if note else 0
        if last <= done:
            return None
        rows = self.spark.read.schema(f"{EVENTS}, poll int").option("basePath", f"{self.path}/events").parquet(*[f"{self.path}/events/poll={k}" for k in range(done + 1, last + 1)])
        first, newest = rows.agg(F.min("ts"), F.max("ts")).select(*[F.unix_micros(c) / 1e6 for c in ("min(ts)", "max(ts)")]).first()
        return last, first, newest

    def close(self, poll: int) -> None:
        """Note that a run is done with all events up to ``poll``."""
        notes = self._notes()
        note = self.note()
        try:
            self._write_note({"poll": max(poll, note["poll"] if note else 0)}, note)
        except Conflict:
            return  # another one has noted as much or more, or does so at its next run
        for name in notes[:-2]:
            self._fs.delete(self._at(name), False)


def events(spark: SparkSession, path: str) -> DataFrame:
    """The events of a journal as a stream: path, op and ts."""
    return spark.readStream.schema(f"{EVENTS}, poll int").option("basePath", f"{path}/events").parquet(f"{path}/events").select("path", "op", "ts")


def sessions(events: DataFrame, gap: str = f"{DEBOUNCE_MS} milliseconds", *, ts: str = "ts", keys: tuple[str, ...] = ()) -> DataFrame:
    """Bursts of events: one row for each run of events no farther apart than ``gap``."""
    grouped = events.groupBy(F.session_window(ts, gap).alias("w"), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n_events"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")).drop("w")


class Debounce:
    """Runs after bursts: ``step`` polls once and runs if the open events are due."""

    def __init__(self, journal: Journal, run: Callable[[], object], *, gap_ms: int = DEBOUNCE_MS, limit_ms: int = LIMIT_MS, on_error: Callable[[Exception], None] | None = None):
        self.journal, self.run, self.gap, self.limit, self.on_error = journal, run, gap_ms / 1000, limit_ms / 1000, on_error
        self._open: tuple[int, float, float] | None = journal.open() if journal._done() >= 0 else None

    def step(self, now: float | None = None) -> bool:
        """True if there was a run.  A failed one is told to ``on_error``, if there is one; nothing was noted by it, so the next does its work again."""
        if self.journal.poll(now):
            self._open = self.journal.open()
        if self._open is None:
            return False
        poll, first, last = self._open
        at = time.time() if now is None else now
        if at - last < self.gap and at - first < self.limit:
            return False
        try:
            self.run()
        except Exception as e:  # noqa: BLE001
            if self.on_error is None:
                raise
            self.on_error(e)
        self.journal.close(poll)
        self._open = None
        return True


def watch(spark: SparkSession, root: str, run: Callable[[], object], checkpoint: str, *, dirs: Iterable[str] = ("",), patterns: Iterable[str] = (),
          gap_ms: int = DEBOUNCE_MS, limit_ms: int = LIMIT_MS, on_error: Callable[[Exception], None] | None = None) -> StreamingQuery:
    """Call ``run`` once after each burst of file events, when the files have been quiet for ``gap_ms``, or ``limit_ms`` after the burst began.

    Only files under ``dirs`` that no pattern ignores make events; the root is a folder or a path
    in a store.  A query that ticks does a step of the journal in ``checkpoint``/journal each
    time; steps don't overlap.
    """
    steps = Debounce(Journal(spark, root, f"{checkpoint}/journal", dirs=dirs, patterns=patterns), run, gap_ms=gap_ms, limit_ms=limit_ms, on_error=on_error)
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    return ticks.writeStream.trigger(processingTime=f"{SETTLE_MS} milliseconds").option("checkpointLocation", f"{checkpoint}/ticks").foreachBatch(lambda *_: steps.step()).start()
