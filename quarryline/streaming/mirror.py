"""A directory mirror: file observations in, changes of the mirrored documents out.

Observations say that a path was seen with a content, or is gone.  They may
come in any order and more than once.  Two keyed states with event-time
timers turn them into changes:

* By path: what the mirror knows of it, and its latest observation.  When no
  newer one can come any more, ``settle`` after it, the two are compared, and
  the observation becomes what is known.  Saving a file ten times is one
  change, and so is a deletion that is followed by a new file of that name.
* By content: files that appeared and files that vanished.  Within ``window``
  the first that appeared (by position) and the last that vanished (likewise)
  of one content are paired: a rename in one folder, or a move.  Only these
  two are held; any other is a creation or a deletion at once, so a content
  that very many files share is no large state.

``complete`` mirrors take the stream as a listing of the whole tree, so a
known path that isn't seen until ``complete`` is gone.  Otherwise only a
``gone`` observation deletes.

The watermark must allow for the disorder of the input (``late``); what is
later than that is dropped by Spark.  A stream that has ended needs a tick: an
observation with a null path, whose time moves the watermark on.

Edge cases: a null content never pairs; a ``gone`` path that isn't known is no
change; equal times of one path go by position, then ``gone`` last; unchanged
files are reported, as a batch difference does.  The state knows document ids
only of the documents that it began with: later changes carry the id where the
path is still theirs, others leave it null for the document table to fill.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarryline.operators.changes import parent_folder

#: An observation: ``content_hash`` of a seen path, ``gone``, its place in the listing, and when it was made.
OBSERVATION = "source_path string, content_hash string, size_bytes long, gone boolean, position long, at timestamp"
#: What is known of a path.
KNOWN = "source_path string, document_id string, content_hash string, position long"
_STEP = "change string, source_path string, content_hash string, old_hash string, document_id string, size_bytes long, position long, old_position long, at timestamp, link string"
_CHANGE = "change string, source_path string, content_hash string, document_id string, previous_path string, size_bytes long, at timestamp"


class PathState(StatefulProcessor):
    """Known content and latest observation of one path; a change when the observation has settled."""

    def __init__(self, settle_ms: int, complete_ms: int | None):
        self.settle_ms, self.complete_ms = settle_ms, complete_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "document_id string, content_hash string, position long")
        self.last = handle.getValueState("last", "at long, position long, gone boolean, content_hash string, size_bytes long")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        row = initialState
        self.known.update((row["document_id"], row["content_hash"], row["position"]))
        if self.complete_ms is not None:
            self.handle.registerTimer(self.complete_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        if not key[0]:
            return iter(())  # a tick
        held = self.last.get() if self.last.exists() else None
        best = tuple(held) if held else None
        for r in rows:
            seen = (int(r["at"].timestamp() * 1000), r["position"] or 0, bool(r["gone"]), r["content_hash"], r["size_bytes"])
            if best is None or seen[:3] >= best[:3]:
                best = seen
        if best is not None and best != (tuple(held) if held else None):
            if self.complete_ms is None:
                if held:
                    self.handle.deleteTimer(held[0] + self.settle_ms)
                self.handle.registerTimer(best[0] + self.settle_ms)
            elif not held and not self.known.exists():
                self.handle.registerTimer(self.complete_ms)
            self.last.update(best)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        path, due = key[0], expiredTimerInfo.getExpiryTimeInMs()
        known = self.known.get() if self.known.exists() else None
        last = self.last.get() if self.last.exists() else None
        if last is None and self.complete_ms is None:
            return
        here = last is not None and not last[2]
        at = datetime.fromtimestamp(due / 1000, UTC).replace(tzinfo=None)
        own = known or (None, None, None)
        seen = last or (None, None, None, None, None)
        kind = ("unchanged" if known[1] == seen[3] else "modified") if here and known else "created" if here else "deleted" if known else None
        if here:
            self.known.update((own[0], seen[3], seen[1]))
        else:
            self.known.clear()
        self.last.clear()
        if kind:
            # Only what appears or vanishes is paired by content.
            link = {"created": seen[3], "deleted": own[1]}.get(kind)
            yield Row(
                change=kind, source_path=path, content_hash=seen[3] if here else None, old_hash=own[1], document_id=own[0], size_bytes=seen[4] if here else None,
                position=seen[1], old_position=own[2], at=at, link=f"content {link}" if link is not None else f"path {path}",
            )


class ContentState(StatefulProcessor):
    """The first file that appeared and the last that vanished of one content, until they are paired or alone."""

    def __init__(self, window_ms: int):
        self.window_ms = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "position long, source_path string, content_hash string, size_bytes long")
        self.gone = handle.getValueState("gone", "position long, document_id string, source_path string")
        self.due = handle.getValueState("due", "at long")

    @staticmethod
    def created(x: tuple, at) -> Row:
        return Row(change="created", source_path=x[1], content_hash=x[2], document_id=None, previous_path=None, size_bytes=x[3], at=at)

    @staticmethod
    def deleted(x: tuple, at) -> Row:
        return Row(change="deleted", source_path=x[2], content_hash=None, document_id=x[1], previous_path=None, size_bytes=None, at=at)

    def paired(self, first: tuple | None, gone: tuple | None, at: datetime) -> Iterator[Row]:
        if first and gone:
            yield Row(change="relocated", source_path=first[1], content_hash=first[2], document_id=gone[1], previous_path=gone[2], size_bytes=first[3], at=at)
        elif first:
            yield self.created(first, at)
        elif gone:
            yield self.deleted(gone, at)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        if not key[0].startswith("content "):
            for r in rows:
                yield Row(change=r["change"], source_path=r["source_path"], content_hash=r["content_hash"], document_id=r["document_id"], previous_path=None, size_bytes=r["size_bytes"], at=r["at"])
            return
        first = tuple(self.first.get()) if self.first.exists() else None
        gone = tuple(self.gone.get()) if self.gone.exists() else None
        old = due = self.due.get()[0] if self.due.exists() else None
        order = lambda x: (x[0], x[1] or "", x[2])
        for r in sorted(rows, key=lambda r: r["at"]):  # of one micro-batch
            ms = int(r["at"].timestamp() * 1000)
            if due is not None and ms > due:  # what is held had its time
                yield from self.paired(first, gone, r["at"])
                first = gone = None
            due = ms + self.window_ms
            if r["change"] == "created":
                new = (r["position"] or 0, r["source_path"], r["content_hash"], r["size_bytes"])
                first, other = (new, first) if first is None or new[:2] < first[:2] else (first, new)
                if other:
                    yield self.created(other, r["at"])
            else:
                new = (r["old_position"] or 0, r["document_id"], r["source_path"])
                gone, other = (new, gone) if gone is None or order(new) > order(gone) else (gone, new)
                if other:
                    yield self.deleted(other, r["at"])
        for state, value in ((self.first, first), (self.gone, gone)):
            state.update(value) if value else state.clear()
        if due != old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.due.update((due,))
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        at = datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, UTC).replace(tzinfo=None)
        first = tuple(self.first.get()) if self.first.exists() else None
        gone = tuple(self.gone.get()) if self.gone.exists() else None
        for state in (self.first, self.gone, self.due):
            state.clear()
        yield from self.paired(first, gone, at)


def mirror_changes(observations: DataFrame, known: DataFrame, settle_seconds: int = 10, window_seconds: int = 60, late: str = "1 hour", complete_ms: int | None = None) -> DataFrame:
    """Changes (change_type, source_path, content_hash, document_id, previous_path, size_bytes, at) from a stream of observations.

    ``known`` (source_path, document_id, content_hash, position) is read when
    the stream first starts; after a restart the checkpoint's state holds.
    ``complete_ms`` is the time at which a full listing has ended.
    """
    timed = observations.withWatermark("at", late).withColumn("source_path", F.coalesce("source_path", F.lit("")))
    begun = known.select("source_path", "document_id", "content_hash", F.col("position").cast("long").alias("position")).groupBy("source_path")
    steps = timed.groupBy("source_path").transformWithState(
        PathState(settle_seconds * 1000, complete_ms), outputStructType=_STEP, outputMode="Append", timeMode="EventTime", initialState=begun, eventTimeColumnName="at"
    )
    steps = steps.where(F.col("source_path") != "")
    paired = steps.groupBy("link").transformWithState(ContentState(window_seconds * 1000), outputStructType=_CHANGE, outputMode="Append", timeMode="EventTime", eventTimeColumnName="at")
    same = parent_folder(F.col("source_path")) == parent_folder(F.col("previous_path"))
    kind = F.when(F.col("change") != "relocated", F.col("change")).when(same, "renamed").otherwise("moved")
    return paired.select(kind.alias("change_type"), "source_path", "content_hash", "document_id", "previous_path", "size_bytes", "at")


#: Keyed state with timers needs this state store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store for streams started here; the session's own setting is put back."""
    before = spark.conf.get(*STORE[:1], None)
    spark.conf.set(*STORE)
    try:
        yield
    finally:
        spark.conf.set(STORE[0], before) if before else spark.conf.unset(STORE[0])


def tick(spark: SparkSession, at: datetime) -> DataFrame:
    """An observation of nothing, which moves the watermark to ``at``."""
    return spark.createDataFrame([(None, None, None, None, None, at)], OBSERVATION)


def replay(known: DataFrame, folder: str, files_per_batch: int = 100, **options) -> DataFrame:
    """The changes of all observations below ``folder``/observations (Parquet), kept in ``folder``/changes.

    What an earlier replay of the folder has read isn't read again: its state
    is in ``folder``/checkpoint.
    """
    spark = known.sparkSession
    seen = spark.readStream.schema(OBSERVATION).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/observations")
    with rocksdb(spark):
        changes = mirror_changes(seen, known, **options)
        query = changes.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/changes").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(changes.schema).parquet(f"{folder}/changes")


def folders_above(path: Column) -> Column:
    """All folders that a path lies in, from the top."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def pruned_folders(changes: DataFrame, documents: DataFrame) -> DataFrame:
    """(folder) of those that changes left without any file: above a path that went, and above no active document."""
    left = changes.where("change_type IN ('deleted', 'moved', 'renamed')").select(F.when(F.col("change_type") == "deleted", F.col("source_path")).otherwise(F.col("previous_path")).alias("path"))
    inside = F.instr("path", "/") > 0
    empty = left.where(inside).select(F.explode(folders_above(F.col("path"))).alias("folder")).distinct()
    live = documents.where("status = 'active'").select(F.col("source_path").alias("path")).where(inside).select(F.explode(folders_above(F.col("path"))).alias("folder")).distinct()
    return empty.join(live, "folder", "left_anti")
