"""Spelling variants: words one letter apart, found by distance-one automata over trie shards.

The words are sorted into shards of bounded size, each a trie in depth-first
order (how much a word shares with the one before it, and the rest). The shards
are broadcast a few at a time; a task walks a shard with each word's automaton
of distance one, depth first: along the word itself as long as the trie has it,
and from each node on that path by one insertion, deletion or replacement into
the rest of the word. Of the words accepted only their number and the best one
leave the task.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.llm.shared import by_bytes, cut, drop, map_arrow
from foliate.llm.substrings import pieces

#: Runs of letters in texts whose A-Z are lower-cased.
RUN = re.compile("[a-zÀ-ÿ]+")
#: UTF-8 bytes of words in a shard (a longer word is alone in its shard), and shards that are broadcast together.
SHARD_BYTES, SHARDS_AT_ONCE = 1 << 20, 8
#: Words that a task counts before it hands its counts on.
COUNTED_AT_ONCE = 200_000


def spelled(run: str, id_crc: int, drop_one_in: int) -> str:
    """The run, less one letter where the checksum of ``<id>:<run>`` is a multiple of ``drop_one_in``."""
    h = zlib.crc32(run.encode(), id_crc)
    if h % drop_one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_rows(batches: Iterator[pa.RecordBatch], min_length: int, drop_one_in: int | None) -> Iterator[pa.RecordBatch]:
    """(word, n) of batches of (id, text), counted over up to COUNTED_AT_ONCE words."""
    counts: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
        counts.clear()
        return made

    for whole in batches:
        for batch in by_bytes(whole, "text"):
            for name, text in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                crc = zlib.crc32(f"{'' if name is None else name}:".encode())
                for piece in pieces(text or b""):
                    for run, n in Counter(RUN.findall(piece.lower().decode())).items():  # bytes lower A-Z alone
                        word = run if drop_one_in is None else spelled(run, crc, drop_one_in)
                        if len(word) >= min_length:
                            counts[word] += n
                    if len(counts) >= COUNTED_AT_ONCE:
                        yield out()
    yield out()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5, min_count: int = 3, drop_one_in: int | None = None) -> DataFrame:
    """(word, n) of the words of ``min_length`` letters and ``min_count`` occurrences or more in all texts.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased. With ``drop_one_in`` k, a run whose checksum
    with its document's id is a multiple of k loses one letter (a null id is written as nothing). Null and empty texts have no
    words; every row counts, repeated ones too; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    parts = map_arrow(rows, lambda b: count_rows(b, min_length, drop_one_in), "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(low, high, shared, rests, counts) of sorted batches of (word, n)."""
    low, last, size = "", "", 0
    shared: list[int] = []
    rests: list[str] = []
    counts: list[int] = []

    def out() -> pa.RecordBatch:
        row = {"low": low, "high": last, "shared": shared, "rests": rests, "counts": counts}
        return pa.RecordBatch.from_pylist([row], pa.schema([("low", pa.string()), ("high", pa.string()), ("shared", pa.list_(pa.int32())), ("rests", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]))

    for batch in batches:
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            if rests and size + len(word.encode()) > SHARD_BYTES:
                yield out()
                shared, rests, counts, size = [], [], [], 0
            if not rests:
                low, last = word, ""
            k = len(os.path.commonprefix([last, word]))
            shared.append(k)
            rests.append(word[k:])
            counts.append(n)
            size, last = size + len(word.encode()), word
    if rests:
        yield out()


#: A trie's node: by letter the next node, or the one word's rest and number if there is one word only; by "" the number of the word that ends here.
Node = dict


def trie(shared: list[int], rests: list[str]) -> tuple[Node, list[str]]:
    """The trie of a shard, and its words in order."""
    root: Node = {}
    path, words, word = [root], [], ""
    for k, (s, rest) in enumerate(zip(shared, rests, strict=True)):
        word = word[:s] + rest
        del path[s + 1 :]
        for c in word[s : max(s, shared[k + 1] if k + 1 < len(shared) else 0)]:
            path.append(path[-1].setdefault(c, {}))
        left = word[len(path) - 1 :]
        if left:
            path[-1][left[0]] = (left[1:], k)
        else:
            path[-1][""] = k
        words.append(word)
    return root, words


def ends(node: Node | tuple[str, int], word: str, i: int) -> int | None:
    """The number of the word that ``word[i:]`` leads to from a node."""
    for j in range(i, len(word)):
        if type(node) is tuple:
            return node[1] if len(word) - j == len(node[0]) and word.endswith(node[0]) else None
        node = node.get(word[j])
        if node is None:
            return None
    if type(node) is tuple:
        return None if node[0] else node[1]
    return node.get("")


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one insertion, deletion or replacement lies between two texts."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = len(os.path.commonprefix([a, b]))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def near(root: Node, word: str) -> list[int]:
    """Numbers of the trie's words that are one edit away from ``word``, each once."""
    out, node = [], root
    for i in range(len(word) + 1):
        if type(node) is tuple:
            # An edit further up in a run of one letter may have led here before.
            return [*out, node[1]] if node[1] not in out and one_edit(node[0], word[i:]) else out
        c, before = word[i : i + 1], word[i - 1] if i else ""
        # Of equal edits in a run of one letter, the first is taken.
        if c and c != before and (k := ends(node, word, i + 1)) is not None:
            out.append(k)
        after = word[i + 1 : i + 2]
        for x, child in node.items():
            if not x:
                continue
            leaf = type(child) is tuple
            if x != before and (leaf or c in child) and (k := ends(child, word, i)) is not None:
                out.append(k)
            if c and x != c and (leaf or after in child) and (k := ends(child, word, i + 1)) is not None:
                out.append(k)
        node = node.get(c) if c else None
        if node is None:
            break
    return out


#: The shard that this worker walked last: tasks that follow mostly walk the same.
_last: dict[tuple[str, int], tuple[Node, list[str], list[int]]] = {}


def near_rows(batches: Iterator[pa.RecordBatch], shards: Broadcast, name: str, at: int) -> Iterator[pa.RecordBatch]:
    """(word, n_near, best_n, best) of batches of (word), for words near one of those of shard ``at`` of the group called ``name``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        if (name, at) not in _last:
            _last.clear()
            shared, rests, counts = shards.value[at]
            _last[name, at] = (*trie(shared, rests), counts)
        root, words, counts = _last[name, at]
        rows = []
        for word in batch.column("word").to_pylist():
            if found := near(root, word):
                best = min(found, key=lambda k: (-counts[k], k))
                rows.append((word, len(found), counts[best], words[best]))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "best_n", "best"])


def may_reach(low: str, high: str) -> Column:
    """Whether a word's automaton may get past what all words of a shard begin with."""
    prefix = os.path.commonprefix([low, high])
    if len(prefix) < 3:
        return F.lit(True)
    return F.levenshtein(F.substring("word", 1, len(prefix)), F.lit(prefix), 2) >= 0


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have near ones: how many, and of the most frequent (ties: first) count and text.

    ``words`` has (word, n), each word once, without nulls; an empty table gives no rows.
    """
    spark = words.sparkSession
    size = words.agg(F.sum(F.octet_length("word"))).first()[0] or 0
    ordered = words.select("word", "n").repartitionByRange(1 + size // SHARD_BYTES, "word").sortWithinPartitions("word")
    shards = cut(map_arrow(ordered, shard_rows, "low string, high string, shared array<int>, rests array<string>, counts array<bigint>"))
    dealt = cut(words.select("word").repartition(1 + size // (SHARD_BYTES // 4), "word"))
    bounds = [r[0] for r in shards.select("low").orderBy("low").collect()]  # one word for each MB of words
    found = None
    for k in range(0, len(bounds), SHARDS_AT_ONCE):
        some = shards.where(F.col("low") >= bounds[k])
        if k + SHARDS_AT_ONCE < len(bounds):
            some = some.where(F.col("low") < bounds[k + SHARDS_AT_ONCE])
        rows = some.collect()
        sent = spark.sparkContext.broadcast([(r.shared, r.rests, r.counts) for r in rows])
        name = uuid.uuid4().hex
        each = [map_arrow(dealt.where(may_reach(r.low, r.high)), lambda b, at=at, name=name, sent=sent: near_rows(b, sent, name, at), "word string, n_near bigint, best_n bigint, best string") for at, r in enumerate(rows)]
        whole = each[0]
        for x in each[1:]:
            whole = whole.unionAll(x)
        part = cut(whole)
        sent.destroy()
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = spark.createDataFrame([], "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    out = cut(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("best_n"), "b.best"))
    drop(shards, dealt)
    return out


def tops(links: DataFrame) -> DataFrame:
    """(word, top): the last of the chain that begins at each word of (word, form). Each round doubles how far a word has looked."""
    up = cut(links.select("word", F.col("form").alias("top")))
    while True:
        ahead = up.select(F.col("word").alias("top"), F.col("top").alias("next"))
        longer = cut(up.join(ahead.hint("merge"), "top", "left").select("word", F.coalesce("next", "top").alias("top"), F.col("next").isNotNull().alias("moved")))
        drop(up)
        if not longer.where("moved").head(1):
            return longer.select("word", "top")
        up = longer


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5, min_count: int = 3, drop_one_in: int | None = None, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of ``word_counts``.

    ``n_near`` counts the words exactly one inserted, deleted or replaced letter away. ``form`` is the most frequent of them (ties:
    the first in order of code points) if it occurs ``ratio`` times as often as the word or more, else null; ``root`` follows forms
    to the last. Nulls, repeats, empty and long texts as in ``word_counts``.
    """
    if ratio < 2:
        raise ValueError("forms must be twice as frequent or more, so that each chain of them ends")
    words = cut(word_counts(docs, id_col, text_col, min_length, min_count, drop_one_in))
    found = neighbours(words)
    is_form = F.col("best_n") >= ratio * F.col("n")
    formed = cut(words.join(found.hint("merge"), "word", "left").select("word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n")))
    drop(words, found)
    top = tops(formed.where("form is not null"))
    return formed.join(top.hint("merge"), "word", "left").select("word", "form", F.coalesce("top", "word").alias("root"), "n", "n_near", "form_n")
