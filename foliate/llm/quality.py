"""Quality rules: counts of each text, and bands of n-gram perplexity for each language.

There are two modified Kneser-Ney models. That of the query and, from
``LEAST_BYTES`` of text on, of the pipeline is over bytes with
contexts of ``CONTEXT`` bytes; its grams stay tables (``byte_model``), and each
half of the texts is scored by the model of the other. The other, for few texts,
is of order 3 over characters, of which every ASCII letter, digit and sign has a
class of its own and others share 58 classes by their code points; 128 classes
and a few models bound its size by proof (2**21 grams for each model), so that it
may be broadcast however large the corpus is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.llm import byte_model
from foliate.llm.shared import by_bytes, cut, drop, map_arrow

#: Bytes of context in the model of bytes.
CONTEXT = 5
#: With less text than this, about half of a text's grams of bytes or fewer are in the other half of the texts (57 % at 256 KB, 46 % at 128 KB, 15 % at 16 KB).
LEAST_BYTES = 1 << 18
#: Discounts of that model are no less, as it meets grams that it has not counted.
LEAST_DISCOUNT = 0.1
ORDER, WIDTH = 3, 7
CLASSES = 1 << WIDTH
SYMBOLS = re.compile(r"[#*$%&|<>]")
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


#: Rows of bands, one for each language, that may be broadcast; beyond, the join is shuffled.
BROADCAST_ROWS = 1 << 16


def class_table() -> np.ndarray:
    """Class of each ASCII character: white space 0, a-z 1-26 in either case, digits 27-36, signs 37-68, controls 69."""
    t = np.full(128, 69, dtype=np.int32)
    for c in range(26):
        t[97 + c] = t[65 + c] = 1 + c
    t[[9, 10, 11, 12, 13, 32]] = 0
    t[48:58] = np.arange(27, 37)
    signs = [c for c in range(33, 127) if not chr(c).isalnum()]
    t[signs] = 37 + np.arange(len(signs))
    return t


TABLE = class_table()


def grams(text: str) -> np.ndarray:
    """The code of the gram that ends at each character of ``text`` and at its end; white space stands before the text."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<i4")
    c = np.zeros(len(points) + ORDER, dtype=np.int32)
    c[ORDER - 1 : -1] = np.where(points < 128, TABLE[np.minimum(points, 127)], 70 + points % 58)
    n = len(c) - ORDER + 1
    return reduce(lambda code, k: code << WIDTH | c[k : k + n], range(1, ORDER), c[:n])


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text; all 0 for a null."""
    if not text:
        return 0, 0, 0, 0, 0
    w = text.encode().split()  # on the six ASCII white spaces
    chars = len(text) - sum(map(text.count, "\t\n\v\f\r "))
    lines = [x for x in text.split("\n") if x.strip("\t\v\f\r ")]
    three = list(zip(w, w[1:], w[2:]))
    repeated = 0
    if len(set(three)) < len(three):
        seen: dict = {}
        for x in three:
            seen[x] = seen.get(x, 0) + 1
        upto = 0
        for i, x in enumerate(three):
            if seen[x] > 1:
                repeated += i + 3 - max(upto, i)
                upto = i + 3
    return len(w), chars, len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated


def model_of(lang: Column, known: tuple[str, ...]) -> Column:
    """Rows of other or no languages share one model."""
    return F.when(lang.isin(*known), lang).otherwise(F.lit(""))


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, c): how often each gram occurs, from rows (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_bytes(whole, "text", 1 << 20):
                by: dict[str, list[np.ndarray]] = {}
                for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                    if text:
                        by.setdefault(lang, []).append(grams(text))
                for lang, codes in by.items():
                    g, c = np.unique(np.concatenate(codes), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.astype(np.int64)), pa.array(c)], ["lang", "gram", "c"])

    part = map_arrow(docs, run, "lang string, gram long, c long")
    return part.groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def kneser_ney(c: DataFrame, order: int = ORDER, width: int = WIDTH, least: float = 0.0, keep: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """(lang, gram, logp): log10 probability of each gram's last class given those before it.

    Interpolated modified Kneser-Ney: the highest order uses counts, lower orders
    the number of different classes before a gram; the three discounts of each
    order come from its counts of counts. All classes share the last step.
    A gram with the count 0 is no part of the model, but gets its probability,
    which is over 0 if no discount is under a ``least`` over 0.
    ``keep`` gets each table that later steps read more than once.
    """
    levels = [c]
    for k in range(order - 1, 0, -1):  # of k classes: the different classes that come before
        levels.append(keep(levels[-1].groupBy("lang", (F.col("gram") % (1 << width * k)).alias("gram")).agg(F.count(F.when(F.col("c") > 0, 1)).alias("c"))))
    p = None
    for k, level in enumerate(reversed(levels), 1):
        n = [F.count(F.when(F.col("c") == r, 1)) for r in (1, 2, 3, 4)]
        stats = level.groupBy("lang").agg(*[x.cast("double").alias(f"n{r}") for r, x in enumerate(n, 1)])
        y = F.coalesce(F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0.0)), F.lit(0.5))
        d = [F.greatest(F.lit(least), F.least(F.lit(float(r)), F.coalesce(r - (r + 1) * y * F.col(f"n{r + 1}") / F.nullif(F.col(f"n{r}"), F.lit(0.0)), F.lit(0.5)))) for r in (1, 2, 3)]
        stats = stats.select("lang", *[x.alias(f"d{r}") for r, x in enumerate(d, 1)])
        x = level.join(F.broadcast(stats), "lang").withColumn("d", F.when(F.col("c") == 0, 0.0).when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        of = Window.partitionBy("lang", F.shiftright("gram", width))
        total = F.nullif(F.sum("c").over(of), F.lit(0))
        x = x.select("lang", "gram", F.coalesce((F.col("c") - F.col("d")) / total, F.lit(0.0)).alias("own"), F.coalesce(F.sum("d").over(of) / total, F.lit(1.0)).alias("gamma"))
        if p is None:
            p = x.select("lang", "gram", (F.col("own") + F.col("gamma") / (1 << width)).alias("p"))
        else:
            lower = p.select("lang", F.col("gram").alias("tail"), F.col("p").alias("q"))
            x = x.withColumn("tail", F.col("gram") % (1 << width * (k - 1))).join(lower, ["lang", "tail"])
            p = x.select("lang", "gram", (F.col("own") + F.col("gamma") * F.col("q")).alias("p"))
    return p.select("lang", "gram", F.log10("p").alias("logp"))


def hash_arrays(model: DataFrame, known: tuple[str, ...]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Sorted gram codes and their log10 probabilities, by language: 2**21 entries each at most."""
    rows = model.where(F.col("lang").isin("", *known)).toArrow()
    lang, gram, logp = rows["lang"].to_numpy(), rows["gram"].to_numpy(), rows["logp"].to_numpy()
    out = {}
    for x in ("", *known):
        at = np.flatnonzero(lang == x)
        at = at[np.argsort(gram[at])]
        out[x] = gram[at].astype(np.int32), logp[at].astype(np.float32)
    return out


def class_scores(text: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """(id, lang, counts of BASE, logp) of each of ``text`` (id, lang, model, text), by the model of classes, written to the shared folder."""
    model = text.sparkSession.sparkContext.broadcast(hash_arrays(kneser_ney(cut(gram_counts(text.select(F.col("model").alias("lang"), "text")))), languages))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_bytes(whole, "text", 2 << 20):
                texts, models = b.column("text").to_pylist(), b.column("model").to_pylist()
                base = np.array([counts(x) for x in texts], dtype=np.int64)
                logp = np.full(len(texts), np.nan)
                for i, (name, x) in enumerate(zip(models, texts, strict=True)):
                    if x:
                        keys, values = model.value[name]
                        logp[i] = values[np.searchsorted(keys, grams(x))].mean(dtype=np.float64)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("lang"), *[pa.array(base[:, k]) for k in range(len(BASE))], pa.array(logp, from_pandas=True)], ["id", "lang", *BASE, "logp"])

    rows = cut(map_arrow(text, score, f"id {text.schema['id'].dataType.simpleString()}, lang string, {', '.join(f'{x} long' for x in BASE)}, logp double"))
    model.destroy()
    return rows


def byte_scores(text: DataFrame, context: int, block_bytes: int) -> DataFrame:
    """As ``class_scores``, by the model of bytes."""
    kept: list[DataFrame] = []

    def keep(x: DataFrame) -> DataFrame:
        kept.append(cut(x))
        return kept[-1]

    rows = byte_model.scored(text, lambda c: kneser_ney(c, context + 1, byte_model.WIDTH, LEAST_DISCOUNT, keep), counts, BASE, context + 1, block_bytes)
    drop(*kept)
    return rows


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", languages: tuple[str, ...] = ("de", "en", "es", "fr"), reach: float = 10.0, least_width: float = 0.002, min_words: int = 50, most_repeated: int = 50, context: int | None = None, block_bytes: int = 32 << 20) -> DataFrame:
    """A row for each row of ``docs``: id, the counts of BASE, base_failed, logp, lower, upper, kept.

    base_failed: under ``min_words`` words, or over ``most_repeated`` percent of
    them in repeated three-word windows. ``logp`` is minus the text's log10
    perplexity (mean over characters). Every language that occurs has its band:
    its median of logp, taken over all its rows that pass the base, minus and
    plus ``reach`` times the distance from the median to the quartile on that
    side (``least_width`` at least). A row is kept if it passes the base and lies
    in the band. Model, medians and quartiles cover all rows; ``languages`` have
    a model each, all others share one. A null text has no words and fails; rows
    without a language are one language; rows that share an id are judged each.
    Other columns are left out; an empty table gives no rows.

    With a ``context`` (6 at most) the model is over bytes, has that many before
    each, and the mean is over a text's bytes and its end; a text is scored by
    the model of the other half of the texts, dealt by a hash of the text, as with
    such contexts it would vouch for itself. With 0, the model is of all texts, over
    classes of characters. None is ``CONTEXT``, or 0 if all texts have less than
    ``LEAST_BYTES``. Blocks of ``block_bytes`` bound a task of the model of bytes.
    """
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(""))
    text = docs.select(F.col(id_col).alias("id"), lang.alias("lang"), model_of(lang, languages).alias("model"), F.col(text_col).alias("text"))
    if context is None:
        size = text.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        context = CONTEXT if size >= LEAST_BYTES else 0
    rows = byte_scores(text, context, block_bytes) if context else class_scores(text, languages)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    q = rows.where("not base_failed").groupBy("lang").agg(F.percentile_approx("logp", [0.25, 0.5, 0.75], 1000).alias("q"))
    side = lambda i, j: reach * F.greatest(F.col("q")[i] - F.col("q")[j], F.lit(least_width))
    bands = cut(q.select("lang", (F.col("q")[1] - side(1, 0)).alias("lower"), (F.col("q")[1] + side(2, 1)).alias("upper")))
    out = rows.join(F.broadcast(bands) if bands.count() <= BROADCAST_ROWS else bands, "lang", "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("logp").between(F.col("lower"), F.col("upper")), F.lit(False))
    return out.select(F.col("id").alias(id_col), *BASE, "base_failed", kept.alias("kept"), "logp", "lower", "upper")
