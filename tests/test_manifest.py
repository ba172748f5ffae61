"""The stateful manifest: a stream of scans against the plain result."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from foliate.streaming.manifest import manifest_changes

SCAN = "folder string, file_id string, scan long, at timestamp, name string, supported boolean, content string, complete boolean"
START = datetime.datetime(2024, 1, 1)


def plain(scans):
    """(folder, file_id) -> (version, name, status) after the scans in the order in which they end."""
    files, ended = {}, {}
    for folder, number, rows, complete in scans:
        if number <= ended.get(folder, -1):
            continue
        for file_id, name, supported, content in rows:
            v, n, c, s, _ = files.get((folder, file_id), (0, None, None, None, None))
            if not supported:
                files[folder, file_id] = (v, n or name, c, "skipped", number)
            else:
                v = v + 1 if v == 0 or s == "source_deleted" or c != content else v
                files[folder, file_id] = (v, name, content, "active", number)
        if complete:
            for k, (v, n, c, s, last) in list(files.items()):
                if k[0] == folder and last < number:
                    files[k] = (v, n, c, "source_deleted", last)
        ended[folder] = number
    return {k: (v, n, s) for k, (v, n, _, s, _) in files.items()}


def rows_of(folder, number, rows, complete):
    at = START + datetime.timedelta(days=number)
    return [(folder, f, number, at, name, ok, content, None) for f, name, ok, content in rows] + [(folder, None, number, at, None, None, None, complete)]


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def test_scans_as_a_stream(rocks, tmp_path):
    r = random.Random(2)
    scans = []
    for number in range(6):
        for folder in ("a", "b"):
            rows = [(f"f{i}", f"n{i}-{r.randint(0, 1)}", r.random() < 0.9, r.choice("xy")) for i in range(12) if r.random() < 0.7]
            scans.append((folder, number, rows, r.random() < 0.7))
    scans.append(("a", 2, [("f0", "late", True, "z"), ("new", "late", True, "z")], True))  # ended long ago
    scans.append(scans[-2])  # again
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    changes = manifest_changes(rocks.readStream.schema(SCAN).option("maxFilesPerTrigger", 1).parquet(str(source)), buckets=3)
    for i in range(0, len(scans), 5):  # each of these is a run, which goes on where the last one ended
        rows = [x for s in scans[i : i + 5] for x in rows_of(*s)]
        rocks.createDataFrame(rows, SCAN).coalesce(1).write.mode("append").parquet(str(source))
        q = changes.writeStream.foreachBatch(lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("append").parquet(str(out))).outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert q.awaitTermination(200)
    last = rocks.read.parquet(str(out)).groupBy("folder", "file_id").agg(F.max_by(F.struct("version_number", "name", "status"), F.struct("batch", "scan", (F.col("change") == "deleted").cast("int"))).alias("x"))
    assert {(x.folder, x.file_id): tuple(x.x) for x in last.collect()} == plain(scans)
