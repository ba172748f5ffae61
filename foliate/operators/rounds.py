"""Lineage cuts for operators that work in rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where the frames of this session's rounds stand, by the frame's id.
_places: dict[int, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the context's checkpoint folder; a local master without either gets a new one, a cluster an error."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if known is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="foliate-rounds-"))
        known = sc.getCheckpointDir()
    return known.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` from a table in the shared folder, so that the next round doesn't work it out again and survives lost executors."""
    place = f"{shared_folder(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(place)
    out = df.sparkSession.read.schema(df.schema).parquet(place)
    _places[id(out)] = place
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes the tables of frames that no later plan reads."""
    for df in frames:
        if place := _places.pop(id(df), None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
