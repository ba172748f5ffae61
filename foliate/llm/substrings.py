"""Substring dedup: words under windows that occur twice go, found by level-wise doubling.

Lengths double from a third of the window: 12, 24 and 35 words for windows of 35.
At the first length one gram is looked at for each window, its anchor: the
leftmost gram with the least hash. Equal windows have equal anchors at the same
place, so no repeat is missed, and about one word in twelve starts an anchor.
Anchors whose gram occurs once end there. Of the others, those whose whole span
(the words of all windows that they anchor) occurs twice are settled: all these
windows repeat. The rest, one for each different span, are extended to twice the
length on the side that a window has room on, then, where that repeats, to the
window itself. No candidates at a length end the search.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.llm.shared import by_bytes, cut, drop, fresh, map_arrow

#: An odd base and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Texts are hashed in pieces of about so many bytes, which bounds memory.
PIECE = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each number's bits over all 64 (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2 and so on; those of usual texts are kept."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, PIECE + PIECE // 8), base, np.uint64)
        known[0] = 1
        np.cumprod(known, out=known)
        if n <= 2 * PIECE:
            _powers[base] = known
    return known[:n]


class Sums(NamedTuple):
    """Running sums of numbers, each times its place's power of BASE; the difference of two is a hash of what is between them."""

    sums: np.ndarray
    inverse: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Sums:
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * powers(BASE, len(x)), out=sums[1:])
        return cls(sums, powers(INVERSE, len(x) + 1))

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def separators(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes."""
    word = np.concatenate(([False], ~separators(data), [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], edge[1::2]


def pieces(text: bytes) -> Iterator[bytes]:
    """``text`` in pieces that end behind a separator, of PIECE bytes or the first word's end after that."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end < len(text):
            found = np.flatnonzero(separators(np.frombuffer(text[end : end + PIECE], np.uint8)))
            if len(found):
                end += int(found[0]) + 1
                break
            end = min(len(text), end + PIECE)
        yield text[at:end]
        at = end
    yield text[at:]


LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of ``text`` starts, and a hash of it."""
    starts, hashes, at = [], [], 0
    for piece in pieces(text):
        data = np.frombuffer(piece, np.uint8)
        start, end = word_places(data)
        starts.append(start + at)
        hashes.append(Sums.of(LETTERS[data]).between(start, end))
        at += len(piece)
    return np.concatenate(starts), np.concatenate(hashes)


class Words(NamedTuple):
    """The words of several texts, one after another: hashes, the text that each is in, and each text's first word."""

    sums: Sums
    text: np.ndarray
    first: np.ndarray


def words_of(texts: pa.Array) -> Words:
    """Words of texts; null has none."""
    parts = [b"" if x is None else x for x in texts.cast(pa.binary()).to_pylist()]
    starts, hashes = word_hashes(b"\n".join(parts))
    begins = np.cumsum([0, *(len(x) + 1 for x in parts)])
    first = np.searchsorted(starts, begins)
    return Words(Sums.of(hashes), np.repeat(np.arange(len(parts)), np.diff(first)), first)


def gram_length(window: int) -> int:
    """The length at which doubling begins: whatever window holds such a gram has room for as much again on one side."""
    if window < 2:
        raise ValueError("a window has two words or more")
    return (window + 1) // 3


def anchors(words: Words, window: int) -> tuple[np.ndarray, ...]:
    """Of each anchor: word where it starts, first window and last window that it anchors, hashes of its gram and of its span."""
    n, gram = len(words.text), gram_length(window)
    if n < window:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    at = np.arange(n - gram + 1)
    grams = words.sums.between(at, at + gram)
    starts = np.flatnonzero(words.text[: n - window + 1] == words.text[window - 1 :])
    view = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)
    anchor = np.concatenate([starts[i : i + 65536] + view[starts[i : i + 65536]].argmin(1) for i in range(0, len(starts), 65536)] or [starts])
    new = np.flatnonzero(np.diff(anchor, prepend=-1))
    last = np.append(new[1:], len(anchor)) - 1 if len(new) else new
    a, lo, hi = anchor[new], starts[new], starts[last]
    span = mix(words.sums.between(lo, hi + window) ^ (a - lo).astype(np.uint64))
    return a, lo, hi, grams[a], span


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def anchor_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(id, t, a, lo, n, gram, span) of batches of (id, t, text)."""
    for whole in batches:
        for batch in by_bytes(whole, "text", PIECE):
            words = words_of(batch.column("text"))
            a, lo, hi, gram, span = anchors(words, window)
            row = words.text[a]
            own = batch.select(["id", "t"]).take(pa.array(row))
            numbers = [pa.array((x).astype(np.int32)) for x in (a - words.first[row], a - lo, hi - lo + 1)]
            yield pa.RecordBatch.from_arrays([*own.columns, *numbers, signed(gram), signed(span)], names=["id", "t", "a", "lo", "n", "gram", "span"])


def doubled_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(id, t, gram, a, side, twice, windows) of batches of (id, t, text, found): for each anchor found and each side, left (0) or
    right (1), on which its windows have room, the hash of twice the gram and those of its windows in order, the last of which starts at ``p``."""
    gram = gram_length(window)
    for whole in batches:
        for batch in by_bytes(whole, "text", PIECE):
            words = words_of(batch.column("text"))
            found = batch.column("found")
            sizes = np.diff(found.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), sizes)
            flat = found.flatten()
            field = lambda name, kind=np.int64: flat.field(name).to_numpy(zero_copy_only=False).astype(kind)  # noqa: E731, B023
            a = field("a") + words.first[row]
            lo, n = a - field("lo"), field("n")
            for side in (0, 1):
                p, q = (lo, np.minimum(lo + n - 1, a - gram)) if side == 0 else (np.maximum(lo, a - gram + 1), lo + n - 1)
                k = np.flatnonzero(p <= q)
                if not len(k):
                    continue
                begin = a[k] - gram if side == 0 else a[k]
                count = q[k] - p[k] + 1
                offsets = np.concatenate(([0], np.cumsum(count)))
                at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], count) + np.repeat(p[k], count)
                windows = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), signed(words.sums.between(at, at + window)))
                own = batch.select(["id", "t"]).take(pa.array(row[k]))
                place = [pa.array(x.astype(np.int32)) for x in ((a - words.first[row])[k], (p - words.first[row])[k])]
                yield pa.RecordBatch.from_arrays([*own.columns, signed(field("gram")[k]), *place, pa.array(np.full(len(k), side, np.int32)), signed(words.sums.between(begin, begin + 2 * gram)), windows], names=["id", "t", "gram", "a", "p", "side", "twice", "windows"])


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    """The rows whose key occurs twice or more. Keys are counted before they are joined, so that a hot one is split by the join."""
    twice = cut(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n_")).where("n_ > 1").select(*key))
    return rows.join(twice.hint("merge"), list(key), "left_semi")


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t, text): rows that share id and text share ``t`` too, and have the same words to remove."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["id"].eqNullSafe(b["id"]) & (a["t"] == b["t"])


def repeated_spans(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, spans) of documents with repeats: spans is the sorted array of (start, end), numbers of words under windows that
    also start elsewhere, in the same document or another; ``t`` is the text's hash.

    Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. Rows that share id and
    text have one row here; null and empty texts and those shorter than a window repeat nothing; an empty table gives none.
    Spans overlap. Windows are equal if a gram of theirs and the window have equal 64-bit hashes.
    """
    gram_length(window)  # refuses a window too short
    docs = numbered(docs, id_col, text_col)
    kind = docs.schema["id"].dataType.simpleString()
    found = cut(map_arrow(docs, lambda b: anchor_rows(b, window), f"id {kind}, t bigint, a int, lo int, n int, gram bigint, span bigint"))
    grams = cut(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n_"), F.min("span").alias("x"), F.max("span").alias("y")).where("n_ > 1").select("gram", (F.col("x") != F.col("y")).alias("several")))
    live = cut(found.join(grams.hint("merge"), "gram"))
    drop(found, grams)
    whole = lambda rows: rows.select("id", "t", (F.col("a") - F.col("lo")).alias("start"), (F.col("a") - F.col("lo") + F.col("n") + (window - 1)).alias("end"))
    marks = [whole(live.where("not several"))]
    open_ = live.where("several")
    spans = cut(open_.groupBy("gram", "span").agg(F.count(F.lit(1)).alias("many"), F.min(F.struct("id", "t", "a", "lo", "n")).alias("one")))
    marks.append(whole(open_.join(spans.where("many > 1").select("gram", "span").hint("merge"), ["gram", "span"], "left_semi")))
    own = spans.select("one.id", "one.t", F.struct("one.a", "one.lo", "one.n", "gram").alias("x")).groupBy("id", "t").agg(F.collect_list("x").alias("found"))
    own = cut(own)
    # Rows that share id and text come several times; as their spans are settled, that marks nothing else.
    texts = docs.join(own.hint("merge"), same_row(docs, own)).select(docs["id"], docs["t"], "text", "found")
    twice = cut(map_arrow(texts, lambda b: doubled_rows(b, window), f"id {kind}, t bigint, gram bigint, a int, p int, side int, twice bigint, windows array<bigint>"))
    drop(own)
    each = repeated(twice, "gram", "side", "twice").select("id", "t", "gram", "a", "p", F.posexplode("windows").alias("i", "window"))
    each = cut(each.select("id", "t", "gram", (F.col("p") + F.col("i")).alias("start"), (F.col("a") - F.col("p") - F.col("i")).alias("o"), "window"))
    drop(twice)
    marks.append(repeated(each, "gram", "o", "window").select("id", "t", "start", (F.col("start") + window).alias("end")))
    all_marks = marks[0].unionAll(marks[1]).unionAll(marks[2]).distinct()
    out = cut(all_marks.groupBy("id", "t").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")))
    drop(live, spans, each)
    return out


def kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, n_words, n_removed, kept) of batches of (row, text, spans)."""
    for whole in batches:
        for batch in by_bytes(whole, "text", PIECE):
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans"), strict=True):
                words = (text or b"").split()
                covered = np.zeros(len(words) + 1, np.int64)
                if spans.is_valid:
                    edges = spans.values
                    np.add.at(covered, edges.field("start").to_numpy(zero_copy_only=False), 1)
                    np.add.at(covered, edges.field("end").to_numpy(zero_copy_only=False), -1)
                left = np.flatnonzero(np.cumsum(covered)[:-1] == 0)
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(words if len(left) == len(words) else [words[i] for i in left.tolist()]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["row", "n_words", "n_removed", "kept"])


def drop_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its text less all repeated windows' words: the kept words, joined by one space, and the new columns
    ``n_words`` and ``n_removed``, lengthened if they clash.

    A null or empty text becomes empty. Repeated rows stay, each less its repeats (which is all of it, if it has a window's
    words); an empty table gives no rows.
    """
    spans = repeated_spans(docs, window, id_col, text_col)
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    x = docs.select(rest.alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    # What is removed grows with the documents, so the join is a shuffle at every size.
    x = x.join(spans.hint("merge"), same_row(x, spans), "left").select("row", "text", "spans")
    out = map_arrow(x, kept_rows, f"row {x.schema['row'].dataType.simpleString()}, n_words bigint, n_removed bigint, kept string")
    n_words, n_removed = (fresh(docs.columns, c) for c in ("n_words", "n_removed"))
    return out.select(*[F.col("kept").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns], F.col("n_words").alias(n_words), F.col("n_removed").alias(n_removed))
