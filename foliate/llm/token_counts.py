"""Token counts: lengths of whole texts' encodings, from Arrow batches balanced by bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.shared import by_bytes, map_arrow
from foliate.llm.tokenizer import encoder


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, batch_bytes: int = 8 << 20) -> DataFrame:
    """One row per row of ``docs``: its id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    Special strings inside a text are handled as the library does by default;
    no begin or end token is added and nothing is cut. A null text counts as
    empty (0 bytes, 0 tokens). Repeated rows and ids give repeated rows; other
    columns of ``docs`` are left out, whatever their names. An empty table gives
    none. No shuffle: each task handles its own rows, in slices of about
    ``batch_bytes`` of text; texts beyond that are encoded in chunks cut at
    boundaries that no token spans.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = encoder(vocabulary)
        for whole in batches:
            for b in by_bytes(whole, "text", batch_bytes):
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), pa.array(lib.encode(b.column("text"))[1])], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    out = map_arrow(rows, count, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
