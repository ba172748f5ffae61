"""LM scoring: prediction by partial matching over bytes, with escapes and symbol exclusion.

The trie of byte contexts is kept as tables, a row for each gram and each
context; nothing of it is broadcast. Documents are dealt into blocks. Each block
asks for the grams and words that it holds, gets their log-probabilities and
counts from the whole corpus, and scores its documents with those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.llm.shared import cut, drop, free

#: Bytes of context. A gram, a context and the byte after it, is one long, the latest byte lowest.
ORDER = 5
END = b"\n"


def split(texts: pa.Array | pa.ChunkedArray) -> tuple[pa.ListArray, pa.DictionaryArray, np.ndarray]:
    """The words of each text, ASCII-lower-cased and split on the six ASCII white spaces; all words, numbered; and how many each text has."""
    texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    flat, at = words.flatten(), words.offsets.to_numpy()
    real = pc.not_equal(flat, "")
    upto = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))[at - at[0]]
    flat = flat.filter(real)
    return pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), flat), flat.dictionary_encode(), np.diff(upto)


def grams(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The grams of each text's bytes, words joined by spaces, and of its end, end to end; and where each text begins."""
    joined = pc.binary_join(words, pa.scalar(" ", pa.large_string()))
    joined = pa.concat_arrays([joined])
    at, data = np.frombuffer(joined.buffers()[1], dtype=np.int64)[: len(joined) + 1], joined.buffers()[2]
    sizes, n = np.diff(at), np.arange(len(joined))
    # Before each text stand ORDER ends, after it one.
    b = np.full(int(at[-1]) + len(joined) * (ORDER + 1), ord(END), dtype=np.uint8)
    if data is not None:
        b[np.arange(at[-1]) + np.repeat(n * (ORDER + 1) + ORDER, sizes)] = np.frombuffer(data, dtype=np.uint8)[: at[-1]]
    b = b.astype(np.int64)
    code = np.zeros(max(len(b) - ORDER, 0), dtype=np.int64)
    for k in range(ORDER + 1):
        code = code << 8 | b[k : k + len(code)]
    begin = np.cumsum(sizes + 1) - sizes - 1
    return code[np.arange(int((sizes + 1).sum())) + np.repeat(n * ORDER, sizes + 1)], begin


def in_parts(counts: np.ndarray, size: int = 1 << 19) -> Iterator[slice]:
    """Runs of texts of about ``size`` words."""
    block = np.cumsum(counts + 1) // size
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(counts)]
    return (slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a)


def by_bucket(words: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of different words by bucket, then by their bytes, and where each bucket begins: the same for the same set anywhere."""
    order = pc.sort_indices(words).to_numpy().astype(np.int64)
    words = pa.concat_arrays([words])
    at = np.frombuffer(words.buffers()[1], dtype=np.int64)[: len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[: at[-1]].astype(np.int64)
    place = np.arange(len(data)) - np.repeat(at[:-1], np.diff(at))
    sums = np.add.reduceat(data * (place * 2_654_435_761 % 1_000_003 + 1), at[:-1]) if len(words) else np.zeros(0, np.int64)
    bucket = sums % PRIME % buckets
    order = order[np.argsort(bucket[order], kind="stable")]
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def add(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, sorted, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


#: Grams and words are dealt into buckets by a remainder by a prime.
PRIME = 1_000_003
PART = "block int, bucket int, words array<binary>, counts array<long>, grams array<long>, gram_counts array<long>, tokens long, ends long"


def lists(values: np.ndarray | pa.Array, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def block_parts(buckets: int, docs: pa.Table) -> pa.Table:
    """What a block holds: for each bucket its words and grams with training counts; in bucket 0 also its training tokens and ends."""
    trained = docs["trained"].to_numpy(zero_copy_only=False).astype(bool)
    words, code, sizes = split(docs["text"])
    counts = np.bincount(code.indices.to_numpy()[np.repeat(trained, sizes)], minlength=len(code.dictionary))
    keys, key_counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for part in in_parts(sizes):
        codes, begin = grams(words[part])
        train = np.repeat(trained[part], np.diff(begin, append=len(codes)))
        for own, t in ((codes[train], 1), (codes[~train], 0)):
            u, n = np.unique(own, return_counts=True)
            keys.append(u)
            key_counts.append(n * t)
    keys, key_counts = add(np.concatenate(keys), np.concatenate(key_counts))
    order, at = by_bucket(code.dictionary, buckets)
    dealt = keys % PRIME % buckets
    by = np.argsort(dealt, kind="stable")
    gram_at = np.searchsorted(dealt[by], np.arange(buckets + 1))
    first = np.arange(buckets) == 0
    free()
    out = pa.table({
        "block": pa.array(np.full(buckets, docs["block"][0].as_py()), pa.int32()), "bucket": pa.array(np.arange(buckets), pa.int32()),
        "words": lists(code.dictionary.take(pa.array(order)).cast(pa.large_binary()).cast(pa.binary()), at), "counts": lists(counts[order], at),
        "grams": lists(keys[by], gram_at), "gram_counts": lists(key_counts[by], gram_at),
        "tokens": pa.array(np.where(first, int(counts.sum() + trained.sum()), None), pa.int64()), "ends": pa.array(np.where(first, int(trained.sum()), None), pa.int64()),
    })
    return out.filter(pa.array(first | (np.diff(at) > 0) | (np.diff(gram_at) > 0)))


MERGED = "block int, bucket int, counts array<long>, grams array<long>, gram_counts array<long>, tokens long"


def joined(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """All values of a column of lists, end to end, and where each list begins and the last ends."""
    whole = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    at = whole.offsets.to_numpy()
    return whole.flatten(), at - at[0]


def merge_bucket(parts: pa.Table) -> pa.Table:
    """The corpus' count of each word of each block's part of a bucket; in block -1 its grams' counts, and in tokens the words seen in training."""
    words, at = joined(parts["words"])
    code = words.dictionary_encode()
    index = code.indices.to_numpy()
    total = np.bincount(index, weights=joined(parts["counts"])[0].to_numpy(), minlength=len(code.dictionary)).astype(np.int64)
    keys, counts = add(joined(parts["grams"])[0].to_numpy(), joined(parts["gram_counts"])[0].to_numpy())
    none, n = np.zeros(0, np.int64), len(parts)
    return pa.table({
        "block": pa.concat_arrays([*parts["block"].chunks, pa.array([-1], pa.int32())]), "bucket": pa.array(np.full(n + 1, parts["bucket"][0].as_py()), pa.int32()),
        "counts": lists(np.concatenate((total[index], none)), np.append(at, at[-1])),
        "grams": lists(keys, np.append(np.zeros(n + 1), len(keys))), "gram_counts": lists(counts, np.append(np.zeros(n + 1), len(keys))),
        "tokens": pa.array([None] * n + [int((total > 0).sum())], pa.int64()),
    })


def deliver(parts: pa.Table, lp: pa.Table) -> pa.Table:
    """The grams of each block's part of a bucket with their log-probabilities."""
    keys, values = lp["gram"].to_numpy(), lp["lp"].to_numpy()
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    held, at = joined(parts["grams"])
    return pa.table({"block": parts["block"], "grams": lists(held, at), "lp": lists(values[np.searchsorted(keys, held.to_numpy())], at)})


def low(code: str | Column, size: int) -> Column:
    """The latest ``size`` bytes."""
    return (F.col(code) if isinstance(code, str) else code).bitwiseAND(F.lit((1 << 8 * size) - 1))


def log_probabilities(corpus: DataFrame) -> DataFrame:
    """(gram, lp): log10 probability of each gram's last byte in its context, from (gram, c).

    At a context with T counts of D bytes a byte seen n times has n / (T + D), an
    escape D / (T + D) (method C). After an escape the bytes of the longer
    context are excluded from the shorter: its T and D are lessened by theirs.
    Below the empty context the bytes not yet excluded are equally likely.
    """
    corpus = cut(corpus)
    level = {ORDER: corpus.where("c > 0").select("gram", "c")}
    for k in range(ORDER - 1, -1, -1):  # k bytes of context
        level[k] = cut(level[k + 1].groupBy(low("gram", k + 1).alias("gram")).agg(F.sum("c").alias("c")))
    node = {k: level[k].groupBy(F.shiftright("gram", 8).alias("ctx")).agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("d")) for k in range(ORDER + 1)}
    for k in range(ORDER + 1):
        if k:  # what is left at the parent when the bytes seen here are excluded
            lower = level[k - 1].select(F.col("gram").alias("lower"), F.col("c").alias("n"))
            used = level[k].withColumn("lower", low("gram", k)).join(lower, "lower").groupBy(F.shiftright("gram", 8).alias("ctx")).agg(F.sum("n").alias("used"))
            parent = node[k - 1].select(F.col("ctx").alias("up"), F.col("t").alias("pt"), F.col("d").alias("pd"))
            x = node[k].join(used, "ctx").withColumn("up", low("ctx", k - 1)).join(parent, "up")
            node[k] = x.select("ctx", "t", "d", (F.col("pt") - F.col("used")).alias("xt"), (F.col("pd") - F.col("d")).alias("xd"))
        else:
            node[k] = node[k].select("ctx", "t", "d", F.lit(0).cast("long").alias("xt"), (256 - F.col("d")).alias("xd"))
        node[k] = cut(node[k])
    # t and d: what the next context has left; nothing is excluded before the first that is known.
    x = corpus.select("gram", F.lit(0.0).alias("lp"), F.lit(False).alias("done"), F.lit(None).cast("long").alias("t"), F.lit(None).cast("long").alias("d"))
    for k in range(ORDER, -1, -1):
        at = node[k].select("ctx", F.col("t").alias("nt"), F.col("d").alias("nd"), "xt", "xd")
        here = level[k].select(F.col("gram").alias("tail"), "c")
        x = x.withColumn("ctx", low(F.shiftright("gram", 8), k)).withColumn("tail", low("gram", k + 1)).join(at, "ctx", "left").join(here, "tail", "left")
        known = F.col("nt").isNotNull() & ~F.col("done")
        t, d = F.coalesce("t", "nt"), F.coalesce("d", "nd")
        hit = known & F.col("c").isNotNull()
        miss = known & F.col("c").isNull()
        gain = F.when(hit, F.log10(F.col("c") / (t + d))).when(miss & (d > 0), F.log10(d / (t + d))).otherwise(F.lit(0.0))
        x = x.select("gram", (F.col("lp") + gain).alias("lp"), (F.col("done") | hit).alias("done"), F.when(miss, F.col("xt")).otherwise(F.col("t")).alias("t"), F.when(miss, F.col("xd")).otherwise(F.col("d")).alias("d"))
    rest = F.log10(F.greatest(F.coalesce("d", F.lit(256)), F.lit(1)).cast("double"))
    lp = cut(x.select("gram", F.when(F.col("done"), F.col("lp")).otherwise(F.col("lp") - rest).alias("lp")))
    drop(corpus, *level.values(), *node.values())
    return lp


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """A row for each row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32 of the id as text has remainder 2 by 7 are held out, the
    rest train both models. Texts (a null counts as empty) become ASCII-lower-cased
    words and an end. ``base_score`` is the add-one unigram's log10 probability of
    those tokens, ``score`` that of the byte model for the words, joined by
    spaces, and the end; its contexts are ``ORDER`` bytes at most and its counts
    cover every training row. Rows are dealt by a hash of id and text into blocks
    of about ``block_bytes`` of text, which bounds the memory of a task (a block's
    texts and what they hold; a single longer text is a block's whole content),
    and grams and words into a bucket for every eight blocks. Rows that share an
    id are scored each; a null id counts as empty text for the split. An empty
    table gives no rows.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    blocks = max(-(-size // block_bytes), 1)
    buckets = max(12, blocks // 8)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.pmod(F.xxhash64(key, F.col(text_col)), F.lit(blocks)).cast("int").alias("block"), F.col(id_col).alias("id"), (F.crc32(key.cast("binary")) % 7 != 2).alias("trained"), F.col(text_col).alias("text"))
    parts = cut(rows.groupBy("block").applyInArrow(lambda t: block_parts(buckets, t), PART))
    merged = cut(parts.groupBy("bucket").applyInArrow(merge_bucket, MERGED))
    sums = parts.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("ends"), F.lit(0)).alias("e")).first()
    total, ends = sums.n, sums.e
    distinct = merged.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0] + (ends > 0)
    corpus = merged.where("block < 0").select(F.explode(F.arrays_zip("grams", "gram_counts")).alias("g")).select(F.col("g.grams").alias("gram"), F.col("g.gram_counts").alias("c"))
    lp = log_probabilities(corpus).withColumn("bucket", (F.col("gram") % PRIME % buckets).cast("int"))
    dealt = parts.select("block", "bucket", "grams").groupBy("bucket").cogroup(lp.groupBy("bucket")).applyInArrow(deliver, "block int, grams array<long>, lp array<double>")
    model = dealt.withColumns({"bucket": F.lit(None).cast("int"), "counts": F.lit(None).cast("array<long>")}).unionByName(merged.where("block >= 0").select("block", "bucket", "counts"), allowMissingColumns=True)

    def apply(docs: pa.Table, model: pa.Table) -> pa.Table:
        if not len(docs):
            return pa.table({n: pa.array([], k) for n, k in (("id", docs["id"].type), ("trained", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})
        held = model.filter(pc.is_valid(model["grams"]))
        codes, values = (joined(held[n])[0].to_numpy() for n in ("grams", "lp"))
        found = pd.Index(codes)
        words, code, sizes = split(docs["text"])
        order, at = by_bucket(code.dictionary, buckets)
        count = np.zeros(len(order), dtype=np.float64)
        own = model.filter(pc.is_valid(model["counts"]))
        for k, c in zip(own["bucket"].to_pylist(), own["counts"]):
            count[order[at[k] : at[k + 1]]] = c.values.to_numpy()
        count = count[code.indices.to_numpy()]
        floor, begin = np.log10(float(total + distinct + 1)), np.cumsum(sizes) - sizes
        upto = lambda x: np.concatenate(([0], np.cumsum(x)))
        each = lambda x: upto(x)[begin + sizes] - upto(x)[begin]
        base = np.array([np.log10(count[b : b + n] + 1).sum() for b, n in zip(begin.tolist(), sizes.tolist(), strict=True)])
        base += np.log10(ends + 1.0) - (sizes + 1) * floor
        score = []
        for part in in_parts(sizes):
            g, first = grams(words[part])
            score.append(np.add.reduceat(values[found.get_indexer(g)], first))
        del words, code, found
        free()
        return pa.table({"id": docs["id"], "trained": docs["trained"], "n_tokens": pa.array(sizes + 1), "n_known": pa.array(each(count > 0).astype(np.int64) + int(ends > 0)), "base_score": pa.array(base), "score": pa.array(np.concatenate(score))})

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.groupBy("block").cogroup(model.groupBy("block")).applyInArrow(apply, f"id {kind}, trained boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
