"""Packing: documents laid end to end and cut into sequences by dynamic programming.

Cuts fall at document ends, at sentence ends and, inside long stretches without
either, on a grid. With f(j) the least cost of the ids before cut j,

    f(j) = penalty(j) + min over i, p_j - limit <= p_i < p_j, of f(i) + each + padding(p_j - p_i)

Padding is limit - length, so the minimum is that of f(i) + p_i over a sliding
window, which a monotone queue gives in constant time; lengths at a power of two
have no padding and are tried besides.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.shared import by_bytes, map_arrow
from foliate.llm.token_output import in_id_order
from foliate.llm.tokenizer import encoder, with_end

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut_points(doc_ends: np.ndarray, sentence_ends: np.ndarray, grid: int, sentence_cost: float, grid_cost: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a sequence may end, ascending, and the penalty of each."""
    marks = np.union1d(doc_ends, sentence_ends)
    gaps = np.diff(marks, prepend=0)
    wide = np.flatnonzero(gaps > grid)
    extra = [np.arange(marks[k] - gaps[k] + grid, marks[k], grid) for k in wide.tolist()]
    points = np.union1d(marks, np.concatenate(extra)) if extra else marks
    cost = np.full(len(points), grid_cost)
    cost[np.searchsorted(points, sentence_ends)] = sentence_cost
    cost[np.searchsorted(points, doc_ends)] = 0.0
    return points, cost


def best_cuts(points: np.ndarray, cost: np.ndarray, limit: int, each: float = 1.0) -> list[int]:
    """The positions, last included, at which the sequences of a least-cost packing end."""
    at = np.concatenate(([0], points))
    pos, f, back = at.tolist(), [0.0], [-1]
    # For each position those that a power of two lies before it.
    exact: list[list[int]] = [[] for _ in pos]
    for w in [w for k in range(7, 12) if (w := 1 << k) < limit]:
        k = np.searchsorted(at, at - w)
        for j in np.flatnonzero(at[k] == at - w).tolist():
            exact[j].append(int(k[j]))
    keys, held, head = [0.0], [0], 0  # the queue: its keys ascend
    for j, penalty in enumerate(cost.tolist(), 1):
        p = pos[j]
        low = p - limit
        while pos[held[head]] < low:
            head += 1
        least, i = keys[head] + limit - p, held[head]
        for k in exact[j]:
            if f[k] < least:
                least, i = f[k], k
        least += each + penalty
        f.append(least)
        back.append(i)
        key = least + p
        while len(keys) > head and keys[-1] >= key:
            keys.pop()
            held.pop()
        keys.append(key)
        held.append(j)
    out, j = [], len(pos) - 1
    while j > 0:
        out.append(pos[j])
        j = back[j]
    return out[::-1]


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, end_id: int = 0, block_tokens: int = 1 << 18, grid: int = 32, sentence_cost: float = 0.5, grid_cost: float = 4.0, batch_bytes: int = 8 << 20, known_bytes: int = 12 << 20) -> DataFrame:
    """A row for each piece of a document: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents, each its whole text's ids and ``end_id``, are taken in ascending
    id order (nulls first, equal ids by text; a null text has the end alone) by
    ranges of ids, one for each partition, and packed in blocks of about
    ``block_tokens`` ids, of which the last sequence is carried into the next.
    Every id lies in exactly one piece; sequences hold at most ``limit`` ids.
    Sequence ids ascend with document ids but leave gaps between partitions.
    An empty table gives no rows; other columns are left out. A worker encodes
    about ``batch_bytes`` of text at a time and remembers ``known_bytes`` of pieces,
    which change its memory and time, not the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = encoder(vocabulary, known_bytes)
        sequence = TaskContext.get().partitionId() << 40
        keys: list = []  # of the documents at hand
        parts: list[np.ndarray] = []  # their ids, end to end
        sizes: list[np.ndarray] = []  # how many ids each has here
        done = 0  # ids of the first document that earlier blocks hold

        def block(last: bool) -> pa.RecordBatch:
            nonlocal sequence, keys, parts, sizes, done
            flat, lengths = np.concatenate(parts), np.concatenate(sizes)
            ends = np.cumsum(lengths)
            starts = ends - lengths
            points, cost = cut_points(ends, np.flatnonzero(lib.sentence_end[flat]) + 1, grid, sentence_cost, grid_cost)
            stops = best_cuts(points, cost, limit)
            if not last and len(stops) > 1:
                stops.pop()
            upto = stops[-1]
            edges = np.union1d(starts[starts < upto], np.array([0, *stops], dtype=np.int64))
            a, b = edges[:-1], edges[1:]
            doc = np.searchsorted(starts, a, side="right") - 1
            seq = np.searchsorted(stops, a, side="right")
            skipped = np.where(doc == 0, done, 0)
            begin = np.concatenate(([0], stops))[seq]
            view = memoryview(flat.view(np.uint8))
            crc = [zlib.crc32(view[4 * i : 4 * j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
            columns = [a - starts[doc] + skipped, b - a, np.array(crc, dtype=np.int64), lengths[doc] + skipped, sequence + seq.astype(np.int64), a - begin]
            out = pa.RecordBatch.from_arrays([pa.array([keys[i] for i in doc.tolist()], kind), *map(pa.array, columns)], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            sequence += len(stops)
            k = int(np.searchsorted(ends, upto, side="right"))  # documents that are wholly packed
            if k < len(keys):
                cut = upto - int(starts[k])
                done = cut + (done if k == 0 else 0)
                sizes = [np.concatenate(([lengths[k] - cut], lengths[k + 1 :]))]
            else:
                done, sizes = 0, []
            keys, parts = keys[k:], [flat[upto:].copy()]
            return out

        for whole in batches:
            kind = whole.column("id").type
            for part in by_bytes(whole, "text", batch_bytes):
                ids, n = with_end(*lib.encode(part.column("text")), end_id)
                names, ends = part.column("id").to_pylist(), np.cumsum(n)
                at = 0
                while at < len(n):  # documents up to the block's size, one at least
                    before = int(ends[at] - n[at])
                    room = block_tokens - sum(map(len, parts))
                    to = min(max(int(np.searchsorted(ends, before + room)) + 1, at + 1), len(n))
                    keys += names[at:to]
                    parts.append(ids[before : int(ends[to - 1])])
                    sizes.append(n[at:to])
                    at = to
                    if sum(map(len, parts)) >= block_tokens:
                        yield block(last=False)
        while keys:
            yield block(last=True)

    rows = in_id_order(docs, id_col, text_col)
    out = map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, {SCHEMA}")
    return out.select(F.col("id").alias(id_col), *[c.split()[0] for c in SCHEMA.split(", ")])
