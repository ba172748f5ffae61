"""What several operators need: the shared folder, lineage cuts, byte-bounded batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


#: Where ``cut`` wrote each frame that it gave.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where neither the setting nor a checkpoint folder exists, a local master
    (tests) gets a new local folder; a cluster is refused, as its executors
    would not see each other's files.
    """
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="foliate-checkpoint-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str) -> None:
    """Writes ``df`` to ``path``; what it has shuffled is deleted then, and not when the driver happens to collect its garbage, which may be late."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends here."""
    path = new_path(df.sparkSession, "cut")
    write(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table by its path, wherever Spark reads it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(*cuts: DataFrame) -> None:
    """Delete what ``cut`` wrote for these frames; only for those that no later plan reads."""
    for df in cuts:
        if path := _paths.pop(df, None):
            remove(df.sparkSession, path)


def free() -> None:
    """Gives back to the system what a worker's last task has left: workers are reused, and idle ones count as an executor's memory."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_arrow(rows: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``rows.mapInArrow``, with the worker's memory freed at the end of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            free()

    return rows.mapInArrow(run, schema)


def fresh(columns: Iterable[str], name: str) -> str:
    """``name``, lengthened until no column has it (Spark's names are equal whatever their case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def by_bytes(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose ``column`` (strings) holds about ``limit`` bytes, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes.astype(np.int64)) // limit
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)
