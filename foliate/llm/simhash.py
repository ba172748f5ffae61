"""SimHash near-duplicates: anchors from a covering code, fingerprints replicated to those near them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliate.llm.components import components
from foliate.llm.shared import by_bytes, cut, drop, map_arrow

#: Most differing bits of a link. Of two 32-bit halves, one then differs in two bits at most.
BITS = 4
#: For each syndrome of the (31, 26) Hamming code: the error patterns of weight 1 and 2 that have it.
PATTERNS = np.array([[1 << (s - 1)] + [1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, 32) if i != s and i < i ^ s] for s in range(1, 32)], dtype=np.int64)
#: Syndrome of each byte at each of a half's four byte positions (the 32nd bit is left out).
SYNDROME = np.array([[int(np.bitwise_xor.reduce([8 * p + k + 1 for k in range(8) if x >> k & 1 and 8 * p + k < 31] or [0])) for x in range(256)] for p in range(4)], dtype=np.int64)


def fingerprint(text: str | None, words: int, block: int = 1 << 15) -> int:
    """A bit is 1 if it is set in over half the XXH64 hashes (seed 42) of the text's word shingles."""
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return 0
    line, n = b" ".join(found), max(len(found) - words + 1, 1)
    ends = np.cumsum([len(x) + 1 for x in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(words, len(found)) - 1 :].tolist()
    ones, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, block):
        hashes = np.array([digest(line[i:j], 42) for i, j in zip(starts[at : at + block], ends[at : at + block], strict=True)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_bytes(whole, "text"):
                fp = [fingerprint(x, words) for x in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp, pa.int64())], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, index of the fingerprint) for each anchor within reach, for each half.

    The anchors are the codewords of the perfect (31, 26) code, of covering
    radius 1. Two fingerprints that differ in two bits of a half have a midpoint
    one bit from either, whose anchor is one bit from it; so replicating both to
    the anchors within the radius plus half the threshold, two bits, lets them
    meet. That is 16 anchors at most where one-sided replication takes 156.
    """
    keys, rows = [], []
    for half in range(2):
        x = fp.astype("<i8").view("<u8") >> np.uint64(32 * half) & np.uint64(0x7FFFFFFF)
        x = x.astype(np.int64)
        s = SYNDROME[0][x & 255] ^ SYNDROME[1][x >> 8 & 255] ^ SYNDROME[2][x >> 16 & 255] ^ SYNDROME[3][x >> 24 & 255]
        own, near = np.flatnonzero(s == 0), np.flatnonzero(s)
        keys += [x[own] | half << 31, (x[near, None] ^ PATTERNS[s[near] - 1] | half << 31).ravel()]
        rows += [own, np.repeat(near, PATTERNS.shape[1])]
    return np.concatenate(keys), np.concatenate(rows)


def forest(fp: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that connect what the links of ``fp`` connect, one fewer than members for each component."""
    out, left = [], fp
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            x = stack.pop()
            near = np.bitwise_count((left ^ x).view(np.uint64)) <= bits
            if near.any():
                out += [(int(y), int(x)) for y in left[near]]
                stack += list(left[near])
                left = left[~near]
    return out


def linked(batches: Iterator[pa.RecordBatch], bits: int, small: int = 8) -> Iterator[pa.RecordBatch]:
    """Links (a, b) inside each group of rows (grp, fp) that come sorted by group."""
    held_g, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def work(g: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.diff(g, prepend=g[0] - 1))
        sizes = np.diff(starts, append=len(g))
        a, b = [], []
        few = np.repeat(sizes <= small, sizes)
        for s in range(1, small):
            i = np.flatnonzero(few[:-s] & (g[s:] == g[:-s])) if len(g) > s else []
            if not len(i):
                break
            i = i[np.bitwise_count((f[i] ^ f[i + s]).view(np.uint64)) <= bits]
            a.append(f[i])
            b.append(f[i + s])
        many = [forest(f[i : i + n], bits) for i, n in zip(starts.tolist(), sizes.tolist(), strict=True) if n > small]
        pairs = np.array([p for x in many for p in x], dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([*a, pairs[:, 0]])), pa.array(np.concatenate([*b, pairs[:, 1]]))], ["a", "b"])

    for batch in batches:
        g = np.concatenate((held_g, batch.column("grp").to_numpy()))
        f = np.concatenate((held_f, batch.column("fp").to_numpy()))
        if not len(g):
            continue
        last = int(np.searchsorted(g, g[-1]))
        if last:
            yield work(g[:last], f[:last])
        held_g, held_f = g[last:], f[last:]
    if len(held_g):
        yield work(held_g, held_f)


def links(distinct: DataFrame, bits: int = BITS, block: int = 4096) -> DataFrame:
    """Links (a, b) that connect all of ``distinct.fp`` that differ in ``bits`` bits or fewer.

    Fingerprints meet at anchors. An anchor with more than ``block`` of them is
    split into blocks, and each pair of blocks is a group of its own.
    """
    if bits > BITS:
        raise ValueError(f"the anchors cover {BITS} differing bits at most")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy()
            for at in range(0, len(fp), 1 << 14):
                keys, rows = anchors(fp[at : at + (1 << 14)])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[at : at + (1 << 14)][rows])], ["anchor", "fp"])

    met = map_arrow(distinct.select("fp"), near, "anchor long, fp long")
    met = met.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("anchor"))).where("n > 1")
    met = met.withColumn("blocks", F.ceil(F.col("n") / block)).withColumn("own", F.pmod(F.xxhash64("fp"), "blocks"))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    met = met.select("anchor", "fp", "own", others)
    group = F.shiftleft("anchor", 30).bitwiseOR(F.shiftleft(F.least("own", "other"), 15)).bitwiseOR(F.greatest("own", "other"))
    met = met.select(group.alias("grp"), "fp").repartition("grp").sortWithinPartitions("grp")
    return map_arrow(met, lambda batches: linked(batches, bits), "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = BITS) -> DataFrame:
    """A row for each row of ``docs``: id, fingerprint (16 hex digits), component_id (smallest id reachable).

    ASCII letters are lower-cased; shingles are ``words`` words, repeats
    included, or the whole sequence where it is shorter; no words (null, empty)
    give fingerprint zero, which links like any other. Equal fingerprints are
    one node, so that a group of copies costs one; null ids are never a
    component's id unless it has no other. Other columns are left out.
    """
    rows = cut(fingerprints(docs, id_col, text_col, words))
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(links(nodes, bits))
    rooted = cut(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    lowest = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = cut(rooted.join(lowest, "root").select("fp", "component_id"))
    drop(nodes, roots, rooted, lowest)
    out = rows.join(named, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
