"""Texts scored by a Kneser-Ney model over bytes whose grams stay tables: none is broadcast.

Every byte is told apart but letters A-Z from a-z and the six ASCII white spaces
from each other. Documents are dealt into blocks; each block asks for the grams
that it holds, gets their log-probabilities from the whole corpus, and scores its
documents with those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.ppm import PRIME, add, joined, lists
from foliate.llm.shared import by_bytes, cut, drop, free, map_arrow

SPACE, WIDTH = 32, 8
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[9:14] = SPACE
#: Different grams that a task of the count holds before it gives them on.
HELD = 1 << 21


def byte_grams(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram, latest byte lowest, that ends at each byte of each text and after it, end to end; and where each text begins. White space stands before and after a text."""
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]]
    sizes, n = np.diff(at), np.arange(len(texts))
    b = np.full(len(data) + len(texts) * order, SPACE, dtype=np.uint8)
    b[np.arange(len(data)) + np.repeat(n * order + order - 1, sizes)] = FOLD[data]
    b = b.astype(np.int64)
    code = np.zeros(max(len(b) - order + 1, 0), dtype=np.int64)
    for k in range(order):
        code <<= WIDTH
        code |= b[k : k + len(code)]
    return code[np.arange(len(data) + len(texts)) + np.repeat(n * (order - 1), sizes + 1)], at[:-1] - at[0] + n


def slices(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows with a text, in slices of about ``limit`` bytes."""
    return by_bytes(batch.filter(pc.greater(pc.fill_null(pc.binary_length(batch.column("text")), 0), 0)), "text", limit)


def byte_counts(rows: DataFrame, order: int) -> DataFrame:
    """(lang, gram, c): how often each gram occurs, from rows (model, text); a task adds up what it sees, then Spark does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def given(names: list[str]) -> Iterator[pa.RecordBatch]:
            for name in names:
                keys, n = held.pop(name)[0]
                yield pa.RecordBatch.from_arrays([pa.repeat(name, len(keys)), pa.array(keys), pa.array(n)], ["lang", "gram", "c"])

        for whole in batches:
            for b in slices(whole, 4 << 20):
                for name in pc.unique(b.column("model")).to_pylist():
                    codes, _ = byte_grams(b.filter(pc.equal(b.column("model"), name)).column("text"), order)
                    had = held.setdefault(name, [])
                    had.append(np.unique(codes, return_counts=True))
                    if sum(len(x) for x, _ in had[1:]) > HELD:
                        had[:] = [add(*map(np.concatenate, zip(*had)))]
                        if len(had[0][0]) > HELD:
                            yield from given([name])
        for had in held.values():
            had[:] = [add(*map(np.concatenate, zip(*had)))]
        yield from given(list(held))

    part = map_arrow(rows.select("model", "text"), run, "lang string, gram long, c long")
    return part.groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def crossed(c: DataFrame) -> DataFrame:
    """(lang, gram, c) for each half: all grams of both, with their counts in the other; a half is the last letter of ``lang``."""
    own = F.substring("lang", -1, 1)
    other = F.concat(F.expr("left(lang, length(lang) - 1)"), F.when(own == "0", "1").otherwise("0"))
    rows = c.select(other.alias("lang"), "gram", "c").unionAll(c.select("lang", "gram", F.lit(0).cast("long").alias("c")))
    return rows.groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def deliver(parts: pa.Table, model: pa.Table) -> pa.Table:
    """The grams of each block's part of a bucket with their log-probabilities."""
    keys, values = joined(model["grams"])[0].to_numpy(), joined(model["lp"])[0].to_numpy()
    held, at = joined(parts["grams"])
    return pa.table({"model": parts["model"], "block": parts["block"], "grams": lists(held, at), "lp": lists(values[np.searchsorted(keys, held.to_numpy())], at)})


def scored(rows: DataFrame, lp: Callable[[DataFrame], DataFrame], counts: Callable, names: list[str], order: int, block_bytes: int, rounds: int = 4) -> DataFrame:
    """(id, lang, ``names``, logp) of each of ``rows`` (id, lang, model, text), written to the shared folder.

    ``logp`` is the mean log10 probability over a text's bytes and its end, null
    for an empty or null text; ``counts`` gives a text's values of ``names``;
    ``lp`` makes (lang, gram, logp) from (lang, gram, c). The texts of each model are
    dealt by their hash into halves, so that equal ones lie in one, and each half
    is scored by the counts of the other. Rows are
    dealt by a hash of id and text into blocks of about ``block_bytes``, which
    bound a task's memory. Blocks are scored in ``rounds``, as what a round has
    shuffled is deleted when it ends: all rows are scored, but not all at once on disk.
    """
    rows = rows.withColumn("model", F.concat("model", F.lit("/"), F.pmod(F.xxhash64("text"), F.lit(2)).cast("string")))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(-(-size // block_bytes), 1)
    buckets = max(12, blocks // 8)

    def by_bucket(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bucket = keys % PRIME % buckets
        by = np.argsort(bucket, kind="stable")
        return keys[by], np.searchsorted(bucket[by], np.arange(buckets + 1))

    def shelf(t: pa.Table) -> pa.Table:
        t = t.sort_by("gram")
        return pa.table({"model": t["lang"][:1], "bucket": t["bucket"][:1], "grams": lists(t["gram"].to_numpy(), np.array([0, len(t)])), "lp": lists(t["logp"].to_numpy().astype(np.float32), np.array([0, len(t)]))})

    def asked(docs: pa.Table) -> pa.Table:
        keys = [np.zeros(0, np.int64)]
        for whole in docs.to_batches():
            keys += [np.unique(byte_grams(b.column("text"), order)[0]) for b in slices(whole, 2 << 20)]
        grams, at = by_bucket(np.unique(np.concatenate(keys)))
        free()
        return pa.table({"model": pa.repeat(docs["model"][0], buckets), "block": pa.repeat(docs["block"][0], buckets), "bucket": pa.array(np.arange(buckets), pa.int32()), "grams": lists(grams, at)}).filter(pa.array(np.diff(at) > 0))

    def apply(docs: pa.Table, model: pa.Table) -> pa.Table:
        values, found = joined(model["lp"])[0].to_numpy(), pd.Index(joined(model["grams"])[0].to_numpy())
        docs = docs.append_column("at", pa.array(np.arange(len(docs))))
        logp = np.full(len(docs), np.nan)
        for whole in docs.to_batches():
            for b in slices(whole, 2 << 20):
                g, begin = byte_grams(b.column("text"), order)
                logp[b.column("at").to_numpy()] = np.add.reduceat(values[found.get_indexer(g)].astype(np.float64), begin) / np.diff(begin, append=len(g))
        base = np.array([counts(x) for x in docs["text"].to_pylist()], dtype=np.int64).reshape(len(docs), len(names))
        del found
        free()
        return pa.table({"id": docs["id"], "lang": docs["lang"], **{x: pa.array(base[:, k]) for k, x in enumerate(names)}, "logp": pa.array(logp, from_pandas=True)})

    counted = cut(byte_counts(rows, order))
    corpus = cut(crossed(counted))
    dealt = lp(corpus).withColumn("bucket", (F.col("gram") % PRIME % buckets).cast("int"))
    shelves = cut(dealt.groupBy("lang", "bucket").applyInArrow(shelf, "model string, bucket int, grams array<long>, lp array<float>"))
    drop(counted, corpus)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))
    schema, out = f"id {rows.schema['id'].dataType.simpleString()}, lang string, {', '.join(f'{x} long' for x in names)}, logp double", None
    rounds = min(rounds, blocks)
    for k in range(rounds):
        own = rows.where(F.col("block") % rounds == k)
        parts = own.groupBy("model", "block").applyInArrow(asked, "model string, block int, bucket int, grams array<long>")
        held = parts.groupBy("model", "bucket").cogroup(shelves.groupBy("model", "bucket")).applyInArrow(deliver, "model string, block int, grams array<long>, lp array<float>")
        done = cut(own.groupBy("model", "block").cogroup(held.groupBy("model", "block")).applyInArrow(apply, schema))
        out = out.unionAll(done) if out is not None else done
    drop(shelves)
    return out
