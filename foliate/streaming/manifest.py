"""A folder's manifest as keyed state: scans come as a stream, and each file's last version stays."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What is kept of a file, and what a change tells.
FILE = "version_number int, name string, content string, status string, scan long, gone_at long"
CHANGE = "folder string, file_id string, scan long, change string, version_number int, name string, status string"


def told(key: tuple, file_id: str, scan: int, change: str, after: tuple) -> Row:
    return Row(folder=key[0], file_id=file_id, scan=scan, change=change, version_number=after[0], name=after[1], status=after[3])


class Manifest(StatefulProcessor):
    """The files of one bucket of a folder; a file's state is read and written alone, so that a folder may be of any size."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getMapState("files", "file_id string", FILE)
        self.ended = handle.getValueState("ended", "scan long")

    def seen(self, r: Row) -> tuple[str, tuple]:
        """The change that a file's row makes, and the file after it."""
        old = self.files.getValue((r.file_id,)) if self.files.containsKey((r.file_id,)) else None
        version, name, content, status = old[:4] if old else (0, None, None, None)
        if not r.supported:
            return "skipped", (version, name or r.name, content, "skipped", r.scan, None)
        if status in (None, "source_deleted") or version == 0:
            return "new", (version + 1, r.name, r.content, "active", r.scan, None)
        if r.content == content:
            return "unchanged", (version, r.name, content, "active", r.scan, None)
        return "changed", (version + 1, r.name, r.content, "active", r.scan, None)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        ended = self.ended.get()[0] if self.ended.exists() else -1
        # A bucket's rows of one batch; a scan's end comes behind its files.
        for r in sorted(rows, key=lambda r: (r.scan, r.file_id is None, r.file_id or "")):
            if r.scan <= ended:
                continue  # a scan that came late, or again
            if r.file_id is not None:
                change, after = self.seen(r)
                self.files.updateValue((r.file_id,), after)
                yield told(key, r.file_id, r.scan, change, after)
                continue
            if r.complete:
                at = int(r.at.timestamp() * 1000)
                gone = [(k[0], v) for k, v in self.files.iterator() if v[4] < r.scan and v[3] != "source_deleted"]
                for file_id, v in gone:
                    after = (v[0], v[1], v[2], "source_deleted", v[4], at)
                    self.files.updateValue((file_id,), after)
                    yield told(key, file_id, r.scan, "deleted", after)
                if gone:
                    self.handle.registerTimer(at + self.keep_ms)
            ended = r.scan
        self.ended.update((ended,))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        """Files gone for long are forgotten."""
        until = expiredTimerInfo.getExpiryTimeInMs() - self.keep_ms
        for k in [k for k, v in self.files.iterator() if v[3] == "source_deleted" and v[5] is not None and v[5] <= until]:
            self.files.removeKey(k)
        return iter([])

    def close(self) -> None:
        pass


def manifest_changes(scans: DataFrame, buckets: int = 32, keep: str = "30 days", late: str = "1 hour") -> DataFrame:
    """M7, T9 and T4 on a stream: (folder, file_id, scan, change, version_number, name, status) for each file that a scan sees or misses.

    ``scans``: folder, file_id, scan (number, rising), at (time), name, supported, content (its hash), complete. A row without a
    file_id ends its scan. A file with other content than before gets the next version, one with the same keeps it under its new
    name; files that a complete scan has not seen are marked as deleted, and forgotten ``keep`` later, when the watermark passes.
    Rows of a scan that has ended, late or repeated ones, change nothing. The ends of scans go to all ``buckets`` of a folder, over
    which its files are dealt. State is held in RocksDB, which the session must name as its state store.
    """
    keep_ms = scans.sparkSession.sql(f"select cast(unix_millis(timestamp '1970-01-01 00:00:00Z' + interval {keep}) as long)").first()[0]
    every = F.sequence(F.lit(0), F.lit(buckets - 1))
    own = F.array(F.pmod(F.xxhash64("file_id"), F.lit(buckets)).cast("int"))
    x = scans.withWatermark("at", late).withColumn("bucket", F.explode(F.when(F.col("file_id").isNull(), every).otherwise(own)))
    return x.groupBy("folder", "bucket").transformWithState(Manifest(keep_ms), CHANGE, "Update", "EventTime")
