"""Token-id output: Parquet list columns, dictionary or delta encoded, and readers of parts of it."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliate.llm.shared import by_bytes, cut, map_arrow
from foliate.llm.tokenizer import encoder, with_end


def in_id_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, text), in ascending id order over the partitions and in each; equal ids meet in one."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartitionByRange(n, "id").sortWithinPartitions("id", "text")


def write_tokens(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, batch_bytes: int = 8 << 20) -> None:
    """Write a row (part, row, id, n_tokens, ids) for each row of ``docs`` to Parquet files at ``path``.

    ``ids`` is the whole text's encoding with ``end_id`` after it (a null text:
    the end alone). Files follow ascending id: ``part`` numbers the ranges of
    ids, ``row`` the rows in a range; nulls come first, equal ids are ordered by
    text. The list column is dictionary encoded, and delta encoded beyond the
    dictionary's size; row groups and pages are bounded and pages are indexed,
    so that a reader can take one id's page or the columns without ``ids`` alone.
    An empty table gives files without rows.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, row = encoder(vocabulary), 0
        for whole in batches:
            for b in by_bytes(whole, "text", batch_bytes):
                flat, n = with_end(*lib.encode(b.column("text")), end_id)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(flat.view("<i4")))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(n))), b.column("id"), pa.array(n), lists], ["row", "id", "n_tokens", "ids"])
                row += len(n)

    rows = in_id_order(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    out = map_arrow(rows, encode, f"row long, id {kind}, n_tokens long, ids array<int>")
    out.select(F.spark_partition_id().alias("part"), "row", "id", "n_tokens", "ids").write.options(
        **{"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary": "true", "parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes)}
    ).parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = True, first=None, last=None) -> DataFrame:
    """The rows written by ``write_tokens``, those with ids from ``first`` to ``last`` if given.

    Without ``ids`` the list column is not read. As rows stand in order of their
    ids, a range of them reads the row groups and pages that hold it and no others.
    """
    df = spark.read.parquet(path)
    df = df if first is None else df.where(F.col("id") >= first)
    df = df if last is None else df.where(F.col("id") <= last)
    return df if ids else df.drop("ids")


def token_digests(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """From the files at ``path``: id, start (ids of all rows before it), n_tokens, ids_crc32, one row per row written."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            at = lists.offsets.to_numpy()
            raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False).view(np.uint8).reshape(-1))
            crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("row"), b.column("id"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["part", "row", "id", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path).select("part", "row", "id", "ids")
    kind = rows.schema["id"].dataType.simpleString()
    small = cut(map_arrow(rows, digest, f"part int, row long, id {kind}, n_tokens long, ids_crc32 long"))
    # One row for each range of ids: as many as the write had partitions.
    totals = small.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    placed = small.withColumn("upto", F.sum("n_tokens").over(inside)).join(before, "part")
    return placed.select(F.col("id").alias(id_col), (F.col("base") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")
