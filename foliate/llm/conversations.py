"""Prefix trie of conversations: what conversations that begin alike share, by smallest-member ownership.

A node is a sequence of first turns, named by its depth and by sums of its turns'
hashes, so that running sums name all prefixes of a conversation at once. The
smallest member of a node owns it; members thin out downwards, so a conversation
owns the nodes of its path from some depth on, a suffix. What a subtree saves is
then a sum over its members: the bytes of a member's turns from the node on, less
those from the first that it owns. One group-by of all prefixes sums these, the
children and the leaves. Turns travel as hashes and lengths only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.llm.shared import cut, drop, map_arrow

#: Turns of a conversation that one task adds up, and ids that end at a node that are put together as one text.
BLOCK = 4096


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, x, y, size): the turns in order from 0, as two hashes of role and text and the text's bytes.

    Turns are ordered by number, nulls first; those with equal numbers by hash. They are sorted over all conversations at once
    and counted by partition, so that a long conversation is dealt over many tasks.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    slim = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(role, text).alias("x"), F.xxhash64(F.lit("second"), text, role).alias("y"), F.octet_length(text).cast("long").alias("size"))
    order = [F.col("turn").asc_nulls_first(), "x", "y"]
    slim = cut(slim)
    part = F.spark_partition_id().alias("part")
    parts = max(1, int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # The last key deals out turns that repeat another one wholly.
    dealt = cut(slim.repartitionByRange(parts, "conv_id", *order, F.rand(7)).select("*", part))
    drop(slim)
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    split = counts.join(counts.groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select("conv_id"), "conv_id", "left_semi")
    # Two conversations at most cross into or out of a partition: a bounded table.
    offsets = cut(split.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    own = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)) - 1
    out = dealt.join(F.broadcast(offsets), ["conv_id", "part"], "left")
    return out.select("conv_id", (own + F.coalesce("offset", F.lit(0))).alias("at"), "x", "y", "size")


def rebuilt(turns: DataFrame, share: int = 5, most: int = 9) -> DataFrame:
    """(conv_id, depth, x, y, size) of turns (conv_id, at, x, y, size): each conversation c begins with the first h turns of
    conversation c - c % ``share``, h being the checksum of c as text modulo ``most``, and goes on with its own after its first h.
    """
    turns = cut(turns)
    head = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most)).alias("h")
    lengths = cut(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")))
    base = lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("theirs"))
    ids = lengths.select("conv_id", head, (F.col("conv_id") - F.pmod("conv_id", F.lit(share))).alias("base")).join(base.hint("merge"), "base", "left")
    ids = cut(ids.select("conv_id", "h", "base", F.least("h", F.coalesce("theirs", F.lit(0))).alias("kept")))
    first = turns.where(F.col("at") < most - 1).where(F.pmod("conv_id", F.lit(share)) == 0).withColumnRenamed("conv_id", "base")
    taken = ids.join(first.hint("merge"), "base").where("at < h").select("conv_id", (F.col("at") + 1).alias("depth"), "x", "y", "size")
    own = turns.join(ids.hint("merge"), "conv_id").where("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("kept") + 1).alias("depth"), "x", "y", "size")
    root = ids.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(0).cast("long").alias("size"))
    out = cut(root.unionAll(taken).unionAll(own))
    drop(turns, lengths, ids)
    return out


def halves(x: Column) -> list[Column]:
    """A hash as two numbers of 32 bits, whose sums don't overflow."""
    return [F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF))]


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, p, q, size, upto) of turns (conv_id, depth, x, y, size): two hashes of all turns up to each, and their bytes.

    Sums run within blocks of BLOCK turns, to which the sums of the blocks before are added.
    """
    hashes = [F.xxhash64("depth", "x", "y"), F.xxhash64("y", "depth", "x")]
    parts = {f"s{i}": c for i, c in enumerate(c for h in hashes for c in halves(h))}
    names = [*parts, "upto"]
    rows = turns.withColumns(parts).withColumn("upto", F.col("size")).withColumn("block", F.floor(F.col("depth") / BLOCK))
    blocks = rows.where(F.col("block") >= 0).groupBy("conv_id", "block").agg(*[F.sum(n).alias(n) for n in names])
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("conv_id", "block", *[F.sum(n).over(before).alias(f"before_{n}") for n in names]).where("block > 0")
    within = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(offsets.hint("merge"), ["conv_id", "block"], "left")
    sums = [(F.sum(n).over(within) + F.coalesce(f"before_{n}", F.lit(0))).alias(n) for n in names]
    out = out.select("conv_id", "depth", "size", *sums)
    return out.select("conv_id", "depth", F.xxhash64("depth", *list(parts)).alias("p"), F.xxhash64(*list(parts), "depth").alias("q"), "size", "upto")


def digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p, q, sha) of sorted batches of (p, q, part, ids): the SHA-256 of each node's ids, joined by commas. One node is open at a time."""
    node, sha, rows = None, None, []
    schema = pa.schema([("p", pa.int64()), ("q", pa.int64()), ("sha", pa.string())])
    for batch in batches:
        for p, q, ids in zip(*(batch.column(c).to_pylist() for c in ("p", "q", "ids")), strict=True):
            if (p, q) == node:
                sha.update(b"," + ids.encode())
                continue
            if node:
                rows.append((*node, sha.hexdigest()))
            node, sha = (p, q), hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [()] * 3, schema, strict=True)], schema=schema)
        rows = []
    if node:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*node, sha.hexdigest()), schema, strict=True)], schema=schema)


def ends_digests(ends: DataFrame) -> DataFrame:
    """(p, q, sha) of rows (p, q, conv_id): SHA-256 of each node's decimal ids in ascending order, joined by commas.

    Ids of one range of BLOCK numbers are put together first. A hash is worked out from its text's beginning to its end, so the
    ranges of one node stream through one task, in order and one at a time.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    texts = ends.groupBy("p", "q", F.floor(F.col("conv_id") / BLOCK).alias("part")).agg(ids.alias("ids"))
    return map_arrow(texts.repartition("p", "q").sortWithinPartitions("p", "q", "part"), digest_rows, "p bigint, q bigint, sha string")


def trie_nodes(turns: DataFrame) -> DataFrame:
    """The trie's nodes, of turns (conv_id, depth, x, y, size) numbered from 1, with a row of depth 0 for each conversation.

    A row has conv_id (the smallest member), depth, parent_conv_id (the parent's; null at the root), n_convs (members), n_children,
    n_leaves (nodes without children in its subtree, itself included), saved_tokens (over its subtree, each node's members but
    one times its last turn's bytes) and ends_sha256 (of the ids of the conversations that end here). No conversations give no
    nodes, not even a root.
    """
    rows = cut(prefixes(turns))
    last = cut(rows.groupBy("conv_id").agg(F.max("depth").alias("last"), F.max("upto").alias("total")))
    # Ends are added up beside members, so that a node without children is one whose members all end there.
    steps = rows.select("p", "q", "depth", "conv_id").join(last.select("conv_id", "last").hint("merge"), "conv_id")
    nodes = cut(steps.groupBy("p", "q", "depth").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.count_if(F.col("depth") == F.col("last")).alias("ends")))
    owned = cut(nodes.groupBy("owner").agg(F.min("depth").alias("own"), F.max((F.col("ends") == F.col("n_convs")).cast("long")).alias("leaf")))
    first = rows.join(owned.select(F.col("owner").alias("conv_id"), F.col("own").alias("depth")).hint("merge"), ["conv_id", "depth"]).select("conv_id", (F.col("upto") - F.col("size")).alias("shared"))
    each = cut(last.join(owned.withColumnRenamed("owner", "conv_id").hint("merge"), "conv_id", "left").join(first.hint("merge"), "conv_id", "left").select("conv_id", "last", "own", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("shared", "total").alias("shared")))
    members = rows.join(each.hint("merge"), "conv_id")
    saved = F.greatest(F.lit(0), F.col("shared") - F.col("upto") + F.col("size"))
    child = (F.col("own") <= F.col("depth") + 1) & (F.col("depth") < F.col("last"))
    sums = members.groupBy("p", "q").agg(F.count_if(child).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens"))
    # The owner of an owned path's first node has its parent elsewhere, further down it is its own.
    above = rows.join(owned.select(F.col("owner").alias("conv_id"), (F.col("own") - 1).alias("depth")).hint("merge"), ["conv_id", "depth"]).select(F.col("conv_id").alias("owner"), (F.col("depth") + 1).alias("depth"), "p", "q")
    above = above.join(nodes.select("p", "q", F.col("owner").alias("parent")).hint("merge"), ["p", "q"]).select("owner", "depth", "parent")
    digests = ends_digests(steps.where("depth = last").select("p", "q", "conv_id"))
    out = nodes.join(sums.hint("merge"), ["p", "q"]).join(digests.hint("merge"), ["p", "q"], "left").join(above.hint("merge"), ["owner", "depth"], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "owner"))
    return out.select(F.col("owner").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The nodes (as in ``trie_nodes``) of conversations (conv_id, turn, role, text), rebuilt so that some begin alike.

    Null roles and texts are empty, turns with a null number come first, rows without an id are left out. Turns with equal numbers
    have a fixed order (by hash), and repeated rows are turns like others; other columns play no part.
    """
    return trie_nodes(rebuilt(turns_of(conversations)))
