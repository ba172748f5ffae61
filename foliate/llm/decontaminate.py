"""Benchmark decontamination: latent semantic retrieval of passages, then subsequence and answer checks.

Term weights come from all documents. The latent space is that of a distributed
randomised SVD of TF-IDF passages, those of the documents and those of the
benchmark, at a rank well below the number of passages. Every window of every
document is projected and compared by cosine; what comes near is verified.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.llm.shared import by_bytes, free, map_arrow

#: ASCII that is neither a letter nor a digit separates words.
SPLIT = np.array([c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)], dtype=np.uint8)
SENTENCE = re.compile(r"(?<=[.!?])\s+")
PASSAGE, OVERSAMPLE = 30, 10
#: The latent space has a dimension for so many passages, and ``MOST`` dimensions at most.
PER_DIMENSION, MOST = 4, 128
#: About so many bytes of text are looked at at a time.
SLICE = 1 << 20


def words(texts: pa.Array) -> pa.ListArray:
    """The words of each text, lower-cased; a null has none. Between separators there may be empty words."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    low = pa.concat_arrays([low])  # from the buffers' start
    data = low.buffers()[2]
    raw = SPLIT[np.frombuffer(data, dtype=np.uint8)] if data is not None else np.zeros(0, np.uint8)
    plain = pa.LargeStringArray.from_buffers(len(low), low.buffers()[1], pa.py_buffer(raw))
    return pc.split_pattern(plain, " ")


def words_of(text: str | None) -> list[str]:
    return [w for w in words(pa.array([text], pa.string())).flatten().to_pylist() if w]


def word_ids(texts: pa.Array, vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All words' numbers in ``vocab``, -1 for others, end to end, and how many each text has."""
    lists = words(texts)
    flat, at = lists.flatten(), lists.offsets.to_numpy()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    upto = np.concatenate(([0], np.cumsum(real)))
    ids = pc.fill_null(pc.index_in(flat, value_set=vocab), -1).to_numpy(zero_copy_only=False)
    return ids[real].astype(np.int64), np.diff(upto[at - at[0]])


def passages(n: int, size: int = PASSAGE) -> list[tuple[int, int]]:
    """Even parts, of at most ``size`` words, of an item of ``n`` words."""
    k = max(-(-n // size), 1)
    cuts = [round(i * n / k) for i in range(k + 1)]
    return list(zip(cuts[:-1], cuts[1:]))


def blocks(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and text of each run of ``PASSAGE`` words (the last of a text may be shorter) of texts end to end."""
    count = -(-sizes // PASSAGE)
    text = np.repeat(np.arange(len(sizes)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return (np.cumsum(sizes) - sizes)[text] + k * PASSAGE, text


def sums(rows: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of the rows from each begin to the next; zero where there are none."""
    out = np.zeros((len(begin), *rows.shape[1:]), rows.dtype)
    some = np.flatnonzero(np.diff(begin, append=len(rows)) > 0)
    if len(some):
        out[some] = np.add.reduceat(rows, begin[some], axis=0)
    return out


@dataclass
class Index:
    """A slice of the benchmark, as broadcast: its size is bounded by the slice's."""

    vocab: list[str]
    idf: np.ndarray
    content: np.ndarray  # whether a term is one of the rarer ones
    items: list  # item ids
    sequences: list[list[int]]  # word ids of each passage
    owner: list[int]  # the item of each passage
    answers: list[set[int]]  # of each item
    latent: np.ndarray  # terms x rank, weighted
    near: np.ndarray  # passages x rank, unit rows


def document_frequencies(docs: DataFrame, vocab: list[str]) -> tuple[np.ndarray, int]:
    """In how many of all rows (text) each term occurs, and the number of rows."""
    known, size = docs.sparkSession.sparkContext.broadcast(vocab), len(vocab) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, names = np.zeros(size, dtype=np.int64), pa.array(known.value, pa.large_string())
        for whole in batches:
            for b in by_bytes(whole, "text", SLICE):
                ids, n = word_ids(b.column("text"), names)
                text = np.repeat(np.arange(len(n)), n)[ids >= 0]
                total += np.bincount(np.unique(text * size + ids[ids >= 0]) % size, minlength=size)
                total[-1] += b.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    got = map_arrow(docs, run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    known.destroy()
    df = np.zeros(size, dtype=np.int64)
    df[got["term"].to_numpy()] = got["n"].to_numpy()
    return df[:-1], int(df[-1])


def weighted(begin: np.ndarray, term: np.ndarray, at: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, term, value) of unit TF-IDF vectors; passage k has the terms ``at`` positions from ``begin[k]`` on."""
    key, count = np.unique((np.searchsorted(begin, at, side="right") - 1) * len(idf) + term, return_counts=True)
    row, t = key // len(idf), key % len(idf)
    value = count * idf[t]
    return row, t, value / np.sqrt(np.bincount(row, value**2, minlength=len(begin)))[row]


def latent_terms(docs: DataFrame, vocab: list[str], idf: np.ndarray, content: np.ndarray, bench: tuple[np.ndarray, np.ndarray, np.ndarray], rank: int) -> np.ndarray:
    """Leading right singular vectors (terms x rank) of the TF-IDF passages of documents and benchmark.

    Spark multiplies the passages' matrix A and its transpose by a random matrix:
    each task gives its part of A'A R, summed by term; from this one sketch come
    the eigenvectors of A'A (the Nystroem form of the randomised SVD). Documents
    and benchmark weigh the same in total, so that the directions are those of
    the corpus' language as far as the benchmark's passages use it.
    """
    spark, size, wide = docs.sparkSession, len(vocab), rank + OVERSAMPLE
    test = np.random.default_rng(42).standard_normal((size, wide)).astype(np.float32)
    given = spark.sparkContext.broadcast((vocab, idf, content, test))

    def product(row: np.ndarray, term: np.ndarray, value: np.ndarray, test: np.ndarray) -> np.ndarray:
        """A'A R of the passages whose entries are (row, term, value), sorted by row."""
        value = value.astype(np.float32)[:, None]
        begin = np.flatnonzero(np.diff(row, prepend=-1))
        image = np.repeat(sums(test[term] * value, begin), np.diff(begin, append=len(row)), axis=0) * value
        order = np.argsort(term, kind="stable")
        begin = np.flatnonzero(np.diff(term[order], prepend=-1))
        out = np.zeros((len(test), test.shape[1]))
        out[term[order][begin]] = sums(image[order], begin)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, idf, content, test = given.value
        names, total, n = pa.array(names, pa.large_string()), np.zeros((len(idf), test.shape[1])), 0
        rare = np.append(content, False)
        for whole in batches:
            for b in by_bytes(whole, "text", SLICE):
                ids, count = word_ids(b.column("text"), names)
                at = np.flatnonzero(rare[ids])
                if len(at):
                    row, term, value = weighted(blocks(count)[0], ids[at], at, idf)
                    total += product(row, term, value, test)
                    n += len(np.unique(row))
        at = np.flatnonzero(total.any(axis=1))
        vectors = pa.FixedSizeListArray.from_arrays(pa.array(total[at].ravel()), total.shape[1]).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int64()), pa.concat_arrays([vectors, pa.array([[float(n)]], pa.list_(pa.float64()))])], ["term", "v"])

    got = map_arrow(docs, run, "term long, v array<double>").select("term", F.posexplode("v").alias("k", "x")).groupBy("term", "k").agg(F.sum("x").alias("x")).toArrow()
    given.destroy()
    term, k, x = (got[c].to_numpy() for c in ("term", "k", "x"))
    own, n = np.zeros((size, wide)), max(x[term < 0].sum(), 1.0)
    own[term[term >= 0], k[term >= 0]] = x[term >= 0] / n
    y = own + product(*bench, test) / max(len(np.unique(bench[0])), 1)
    shift = 1e-7 * np.linalg.norm(y)
    y += shift * test
    core = test.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-10 * max(values[-1], 1e-300)
    u, _, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    return u[:, :rank]


def build(texts: DataFrame, items: list[tuple], content_idf: float) -> Index:
    """The index of ``items`` (id, text), with weights over the rows of ``texts``."""
    split = [(i, words_of(t), SENTENCE.split((t or "").strip())[-1]) for i, t in items]
    split = [x for x in split if x[1]]
    vocab: dict[str, int] = {}
    for _, w, _ in split:
        for x in w:
            vocab.setdefault(x, len(vocab))
    names = list(vocab)
    df, n = document_frequencies(texts, names)
    idf = np.log((n + 1.0) / (df + 1.0)) + 0.1
    sequences, owner, answers = [], [], []
    for k, (_, w, last) in enumerate(split):
        s = [vocab[x] for x in w]
        for a, b in passages(len(s)):
            sequences.append(s[a:b])
            owner.append(k)
        end = {vocab[x] for x in words_of(last) if x in vocab} or set(s)
        answers.append(set(sorted(end, key=lambda t: (-idf[t], t))[:3]))
    content = idf >= content_idf
    for s in sequences:
        if not content[s].any():
            content[s] = True
    if not sequences:
        return Index([], idf, content, [], [], [], [], np.zeros((0, 1)), np.zeros((0, 1)))
    flat, sizes = np.concatenate(sequences), np.array([len(s) for s in sequences])
    at = np.flatnonzero(content[flat])
    bench = weighted(np.cumsum(sizes) - sizes, flat[at], at, idf)
    basis = latent_terms(texts, names, idf, content, bench, min(max(len(sequences) // PER_DIMENSION, 1), MOST, len(names))).astype(np.float32)
    near = sums(basis[bench[1]] * bench[2].astype(np.float32)[:, None], np.flatnonzero(np.diff(bench[0], prepend=-1)))
    near /= np.linalg.norm(near, axis=1, keepdims=True) + 1e-12
    return Index(names, idf, content, [i for i, _, _ in split], sequences, owner, answers, basis * idf.astype(np.float32)[:, None], near)


def common(masks: dict[int, int], n: int, ids: list[int]) -> int:
    """Length of the longest common subsequence of a sequence, as bit masks of its positions, and ``ids``."""
    row = full = (1 << n) - 1
    for i in ids:
        if i in masks:
            u = row & masks[i]
            row = (row + u) | (row - u)
    return n - (row & full).bit_count()


def masks_of(s: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, i in enumerate(s):
        out[i] = out.get(i, 0) | 1 << k
    return out


class Search:
    """Matches of texts with an index: for each text and item the share of the item's words found."""

    def __init__(self, index: Index, cosine: float, verbatim: float, paraphrase: float) -> None:
        self.x, self.cosine, self.verbatim, self.paraphrase = index, cosine, verbatim, paraphrase
        self.vocab = pa.array(index.vocab, pa.large_string())
        self.all = [(masks_of(s), len(s)) for s in index.sequences]
        only = [[i for i in s if index.content[i]] for s in index.sequences]
        self.only = [(masks_of(s), len(s)) for s in only]
        self.content = np.append(index.content, False)  # -1 is a word of no item
        self.words = np.bincount(index.owner, weights=[len(s) for s in index.sequences], minlength=len(index.items)) if index.items else np.zeros(0)
        self.least = np.array([paraphrase * n for _, n in self.only])  # content words that a window needs

    def shares(self, p: int, terms: list[int], ids: list[int]) -> float:
        """The share of passage ``p`` found: of its content words in ``terms``, or of all in ``ids``, whichever is less; 0 if under the least."""
        inside, n = self.only[p]
        # No longer than the passage's words that the window holds at all.
        if sum(inside[k].bit_count() for k in inside.keys() & set(terms)) < self.paraphrase * n:
            return 0.0
        share = common(inside, n, terms) / n
        if share >= self.paraphrase:
            share = min(share, common(*self.all[p], ids) / self.all[p][1])
        return share if share >= self.paraphrase else 0.0

    def match(self, texts: pa.Array) -> list[tuple[int, int, float, float, float, str]]:
        """(text, item, share, passage_share, cosine, kind) of each match in ``texts``."""
        x = self.x
        if not x.items:
            return []
        flat, sizes = word_ids(texts, self.vocab)
        at = np.flatnonzero(self.content[flat])
        terms = flat[at]
        begin, text = blocks(sizes)
        if not len(begin):
            return []
        # A window is a block and the next of the same text, if there is one.
        two = np.append(text[1:] == text[:-1], False)
        alone = np.append(True, text[1:] != text[:-1]) & ~two
        first = np.flatnonzero(two | alone)
        last = first + two[first]
        edge = np.append(np.searchsorted(at, begin), len(at))
        part = sums(x.latent[terms], edge[:-1])
        ends = np.append(begin[1:], len(flat))
        some = np.flatnonzero(edge[last + 1] - edge[first] >= self.least.min())
        best: dict[tuple[int, int], tuple[float, float, bool]] = {}
        for chunk in np.array_split(some, max(len(some) // 4096, 1)):
            f, e = first[chunk], last[chunk]
            z = part[f] + np.where((e > f)[:, None], part[e], 0)
            z /= np.linalg.norm(z, axis=1, keepdims=True) + 1e-12
            cos, size = z @ x.near.T, edge[e + 1] - edge[f]
            now = -1
            for r, p in zip(*map(np.ndarray.tolist, np.nonzero((cos >= self.cosine) & (size[:, None] >= self.least[None, :])))):
                if r != now:
                    now = r
                    terms_w, ids_w = terms[edge[f[r]] : edge[e[r] + 1]].tolist(), flat[begin[f[r]] : ends[e[r]]].tolist()
                if share := self.shares(p, terms_w, ids_w):
                    said = x.answers[x.owner[p]] <= set(ids_w)
                    t = int(text[f[r]])
                    old = best.get((t, p), (0.0, 0.0, False))
                    best[t, p] = (max(old[0], share), max(old[1], float(cos[r, p])), old[2] or said)
        found: dict[tuple[int, int], list] = {}
        for (t, p), (share, cos_p, said) in best.items():
            f = found.setdefault((t, x.owner[p]), [0.0, 0.0, 0.0, False])
            f[0] += share * self.all[p][1]
            f[1], f[2] = max(f[1], share), max(f[2], cos_p)
            f[3] |= said
        out = []
        for (t, o), (got, passage, cos_o, said) in sorted(found.items()):
            share = got / self.words[o]
            kind = "verbatim" if share >= self.verbatim else "paraphrase" if share >= self.paraphrase and said else "passage" if passage >= self.verbatim else None
            if kind:
                out.append((t, o, share, passage, cos_o, kind))
        return out


def slices(benchmark: DataFrame, item_col: str, text_col: str, slice_bytes: int) -> Iterator[list[tuple]]:
    """The benchmark's items in slices of about ``slice_bytes``, each of which may be broadcast."""
    rows = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(-(-total // slice_bytes), 1)
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield sorted(((r.i, r.t) for r in part.collect()), key=lambda r: (str(r[0]), r[1] or ""))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", cosine: float = 0.4, verbatim: float = 0.75, paraphrase: float = 0.5, content_idf: float = 3.0, slice_bytes: int = 1 << 20) -> DataFrame:
    """(id, item, share, passage_share, cosine, kind) of each document that holds a benchmark item.

    Items are cut into passages of at most 30 words, documents into overlapping
    windows of 60. A window is a candidate for a passage at ``cosine`` or more in
    the latent space of the content words (idf of ``content_idf`` or more; all
    words of a passage without any). The longest common subsequence, over content
    words and over all words, gives the share of the passage found. An item is
    held verbatim at a share of ``verbatim``; as a paraphrase at ``paraphrase``
    with its answer, the three rarest words of its last sentence; as a passage
    if one of its passages is held at ``verbatim``. Whole texts are searched.
    Null and empty texts hold nothing, items without words are in none; rows of
    ``docs`` or items that share an id are searched each; of equal passages each
    is found; other columns are left out; an empty table on either side gives no
    rows. The benchmark is read by the driver in slices of ``slice_bytes``, three
    passes over the documents for each.
    """
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = rows.schema["id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    for items in slices(benchmark, item_col, item_text_col, slice_bytes):
        index = spark.sparkContext.broadcast(build(rows.select("text"), items, content_idf))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            search = Search(index.value, cosine, verbatim, paraphrase)
            for whole in batches:
                for b in by_bytes(whole, "text", SLICE):
                    if m := search.match(b.column("text")):
                        t, o, *rest = zip(*m)
                        yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(t)), pa.array([index.value.items[k] for k in o]), *map(pa.array, rest)], ["id", "item", "share", "passage_share", "cosine", "kind"])

        found = map_arrow(rows, run, f"id {kinds[0]}, item {kinds[1]}, share double, passage_share double, cosine double, kind string")
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "share", "passage_share", "cosine", "kind")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", cosine: float = 0.4, verbatim: float = 0.75, paraphrase: float = 0.5, content_idf: float = 3.0, slice_bytes: int = 1 << 20) -> DataFrame:
    """``docs``, all its columns, without the rows that ``matches`` would give; nulls, repeats and empty tables as there. No shuffle."""
    spark, texts = docs.sparkSession, docs.select(F.col(text_col).alias("text"))
    for items in slices(benchmark, item_col, item_text_col, slice_bytes):
        index = spark.sparkContext.broadcast(build(texts, items, content_idf))
        docs = docs.where(~holds(index, cosine, verbatim, paraphrase)(F.col(text_col)))
    return docs


def holds(index: Broadcast, cosine: float, verbatim: float, paraphrase: float) -> Callable[[Column], Column]:
    """Whether a text holds an item of ``index``."""

    @F.arrow_udf("boolean")
    def held(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        search = Search(index.value, cosine, verbatim, paraphrase)
        for s in parts:
            hit, at = np.zeros(len(s), dtype=bool), 0
            for b in by_bytes(pa.RecordBatch.from_arrays([s], ["text"]), "text", SLICE):
                hit[[at + t for t, *_ in search.match(b.column("text"))]] = True
                at += b.num_rows
            yield pa.array(hit)
        free()

    return held
