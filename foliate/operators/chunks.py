"""Text into lines, articles and bounded chunks, as folds in the JVM."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions import text as t
from foliate.operators.windows import fresh


def pack(parts: Column, limit: int, sep: str, size=F.length, extra: int = 0, joined: bool = True) -> Column:
    """Parts packed greedily, in order, into groups of at most ``limit``.

    A part opens a new group if the current one is not empty and would outgrow
    the limit; a part over the limit stands alone. Gives an array of texts
    (``joined``) or of arrays of parts.
    """

    def step(s: Column, p: Column) -> Column:
        cost = size(p).cast("long") + extra
        gap = F.when(s["n"] > 0, F.lit(len(sep))).otherwise(F.lit(0))
        full = (s["i"] > s["open"]) & (s["n"] + gap + cost > limit)
        # Only where a group ends is kept, so that a step copies nothing.
        breaks = F.when(full, F.concat(s["breaks"], F.array(s["i"]))).otherwise(s["breaks"])
        return F.struct(breaks.alias("breaks"), F.when(full, s["i"]).otherwise(s["open"]).alias("open"), (s["i"] + 1).alias("i"), F.when(full, cost).otherwise(s["n"] + gap + cost).alias("n"))

    def cut(ps: Column) -> Column:
        begin = F.struct(F.array().cast("array<int>").alias("breaks"), F.lit(0).alias("open"), F.lit(0).alias("i"), F.lit(0).cast("long").alias("n"))
        spans = lambda br: F.zip_with(F.concat(F.array(F.lit(0)), br), F.concat(br, F.array(F.size(ps))), lambda x, y: F.slice(ps, x + 1, y - x))
        return F.when(F.size(ps) > 0, F.transform(F.array(F.aggregate(ps, begin, step, lambda s: s["breaks"])), spans)[0]).otherwise(F.slice(F.array(ps), 1, 0))

    groups = F.transform(F.array(parts), cut)[0]  # the parts are worked out once
    return F.transform(groups, lambda g: F.array_join(g, sep)) if joined else groups


def batches(rows: DataFrame, by: str, order: str, size: str, limit: int) -> DataFrame:
    """W7 over rows: (by, batch, n, sizes): each group's sizes in ``order``, packed greedily into batches of at most ``limit``.

    A group's rows, keys and sizes only, stream through one task in order, as
    every batch depends on the one before; nothing is held but the open batch.
    Nulls in ``order`` come first; a null size counts as 0.
    """
    import pyarrow as pa

    kind = rows.schema[by].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, held, out, begun = None, 0, [], [], False

        def full() -> None:
            nonlocal held, n
            out.append((key, number, len(held), ",".join(map(str, held))))
            held, n = [], 0

        number = 0
        for part in parts:
            for k, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if not begun or k != key:
                    if held:
                        full()
                    key, number, begun = k, 0, True
                if held and n + v > limit:
                    full()
                    number += 1
                held.append(v)
                n += v
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (part.schema.field(0).type, pa.int32(), pa.int32(), pa.string()), strict=True)], [by, "batch", "n", "sizes"])
                out.clear()
            schema = part.schema
        if held:
            full()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (schema.field(0).type, pa.int32(), pa.int32(), pa.string()), strict=True)], [by, "batch", "n", "sizes"])

    sorted_rows = rows.select(by, F.coalesce(size, F.lit(0)).cast("long").alias("size"), order).repartition(by).sortWithinPartitions(by, order, "size").select(by, "size")
    return sorted_rows.mapInArrow(run, f"{by} {kind}, batch int, n int, sizes string")


def split_long(part: Column, limit: int) -> Column:
    """A part over ``limit`` cut, again and again, at the last space within it (at the limit without one)."""
    begin = F.struct(F.array().cast("array<string>").alias("done"), part.alias("rest"))

    def step(s: Column, _: Column) -> Column:
        head = F.left(s["rest"], F.lit(limit + 1))
        space = F.length(head) - F.instr(F.reverse(head), " ")
        at = F.when((F.instr(head, " ") > 0) & (space > 0), space).otherwise(F.lit(limit))
        long = F.length(s["rest"]) > limit
        done = F.when(long, F.concat(s["done"], F.array(F.trim(F.substring(s["rest"], F.lit(1), at))))).otherwise(s["done"])
        return F.struct(done.alias("done"), F.when(long, F.trim(F.substring(s["rest"], at + 1, F.length(s["rest"])))).otherwise(s["rest"]).alias("rest"))

    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.length(part) * 2 / limit).cast("int") + 1))
    cut = F.aggregate(rounds, begin, step, lambda s: F.filter(F.concat(s["done"], F.array(s["rest"])), lambda x: x != ""))
    return F.when(F.length(part) <= limit, F.array(part)).otherwise(cut)


def chunks(df: DataFrame, text: str, limit: int = 4000, sep: str = "\n") -> DataFrame:
    """(…, chunk_index, chunk) of each text: its lines, trimmed, blank ones left out, packed."""
    lines = F.filter(F.transform(F.split(text, "\\R"), F.trim), lambda x: x != "")
    parts = F.flatten(F.transform(lines, lambda x: split_long(x, limit)))
    return df.select(*[c for c in df.columns if c != text], F.posexplode(pack(parts, limit, sep)).alias("chunk_index", "chunk"))


def articles(df: DataFrame, text: str, heading: str) -> DataFrame:
    """(…, position, number, body) between headings; ``heading`` is a pattern of a line with one group, the number."""
    form = f"(?m)^{heading}$"
    numbers, bodies = F.regexp_extract_all(text, F.lit(form), F.lit(1)), F.slice(F.split(text, form), F.lit(2), F.lit(1 << 30))
    zipped = F.arrays_zip(numbers.alias("number"), F.transform(bodies, lambda b: F.regexp_replace(b, "^\\s+|\\s+$", "")).alias("body"))
    return df.select(*[c for c in df.columns if c != text], F.posexplode(zipped).alias("position", "a")).select("*", "a.number", "a.body").drop("a")


# Names of an office file's parts, which are no content.
LOW_VALUE = ["root entry", "compobj", "summaryinformation", "document summaryinformation", "microsoft project", "projectdata"]
SCHEDULE_DATE = r"\b[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}\b"


def tidy(x: Column) -> Column:
    """Control characters and white space as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[\x00-\x08\x0b-\x1f\x7f]+", " "), r"(?U)\s+", " "))


def clean_lines(df: DataFrame, key: str, text: str, shortest: int = 3, longest: int = 500) -> DataFrame:
    """(key, line_no, line): tidy lines of useful length and content, each once for a key, case ignored.

    Useful is a line with two letters of any script or four digits that is not
    the name of a file's part. Null texts have no lines.
    """
    x = df.select(key, F.posexplode(F.split(text, "\\R")).alias("line_no", "raw")).select(key, "line_no", tidy(F.col("raw")).alias("line"))
    told = F.col("line").rlike(r"\p{L}\P{L}*\p{L}|(?:\p{Nd}\P{Nd}*){3}\p{Nd}")
    useful = F.length("line").between(shortest, longest) & told & ~F.lower("line").isin(*LOW_VALUE)
    return x.where(useful).groupBy(key, F.lower("line").alias("low")).agg(F.min(F.struct("line_no", "line")).alias("f")).select(key, "f.*")


def schedule_lines(lines: DataFrame, key: str, terms: list[str], most: int = 500, fallback: int = 300) -> DataFrame:
    """Of lines (key, line_no, line) those with a term or a date, the first ``most``; the first ``fallback`` of all where there are none."""
    low = F.lower("line")
    hit = reduce(lambda a, b: a | b, [low.contains(w) for w in terms], low.rlike(SCHEDULE_DATE))
    own = Window.partitionBy(key)
    h, any_, rank, every = (fresh(lines.columns, n) for n in ("hit", "any_hit", "hit_rank", "line_rank"))
    x = lines.withColumn(h, hit).withColumns({any_: F.max(hit).over(own), every: F.row_number().over(own.orderBy("line_no"))})
    x = x.withColumn(rank, F.row_number().over(Window.partitionBy(key, h).orderBy("line_no")))
    kept = F.when(F.col(any_), F.col(h) & (F.col(rank) <= most)).otherwise(F.col(every) <= fallback)
    return x.where(kept).drop(h, any_, rank, every)


def placed_chunks(blocks: DataFrame, keys: list[str], place: str, text: str, limit: int = 4000, sep: str = "\n\n") -> DataFrame:
    """(keys, chunk_index, start, end, chunk): blocks (paragraphs, rows, lines) with their places, packed in order of place.

    A block over ``limit`` is cut; each part keeps the block's place. ``start``
    and ``end`` are the places of a chunk's first and last part. Blank blocks go.
    """
    part = F.transform(split_long(F.trim(F.col(text)), limit), lambda p: F.struct(F.col(place).alias("at"), p.alias("part")))
    rows = blocks.where(F.trim(F.coalesce(text, F.lit(""))) != "").select(*keys, F.posexplode(part).alias("n", "p")).select(*keys, "n", "p.*")
    held = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "n", "part"))).alias("ps"))
    groups = pack(F.col("ps"), limit, sep, size=lambda p: F.length(p["part"]), joined=False)
    x = held.select(*keys, F.posexplode(groups).alias("chunk_index", "g"))
    at = F.transform("g", lambda p: p["at"])
    return x.select(*keys, "chunk_index", F.array_min(at).alias("start"), F.array_max(at).alias("end"), F.array_join(F.transform("g", lambda p: p["part"]), sep).alias("chunk"))


def page_text(pages: DataFrame, keys: list[str], page: str, text: str, header: str = "--- Faqe {} ---") -> DataFrame:
    """(keys, text): a document's pages with text in their order, each under its number."""
    before, after = header.split("{}")
    row = F.struct(F.col(page).alias("n"), F.concat(F.lit(before), F.col(page).cast("string"), F.lit(after + "\n"), F.col(text)).alias("t"))
    kept = pages.where(F.trim(F.coalesce(text, F.lit(""))) != "")
    return kept.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["t"]), "\n\n").alias("text"))


def stored_chunks(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """``stored`` chunks (key, chunk_index, chunk) with those of the documents in ``fresh`` replaced: blank ones left out, numbered from 0."""
    number = F.row_number().over(Window.partitionBy(key).orderBy("chunk_index", "chunk")) - 1
    new = fresh.where(F.trim(F.coalesce("chunk", F.lit(""))) != "").select(key, number.alias("chunk_index"), "chunk")
    return stored.join(fresh.select(key).distinct(), key, "left_anti").select(key, "chunk_index", "chunk").unionByName(new)


def parse_status(suffix: Column, texts: Column, methods: Column, pages: Column) -> Column:
    """Of a document's chunks (arrays of texts and extraction methods): read with recognition, read, to be recognised, or empty."""
    readable = F.filter(F.arrays_zip(texts.alias("t"), methods.alias("m")), lambda c: F.trim(F.coalesce(c["t"], F.lit(""))) != "")
    seen = F.exists(readable, lambda c: F.coalesce(c["m"] == "tesseract_tsv", F.lit(False)))
    image = suffix.isin(".pdf", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp")
    return F.when(seen, "parsed_with_ocr").when(F.size(readable) > 0, "parsed").when(image & (F.coalesce(pages, F.lit(0)) > 0), "needs_ocr").otherwise("empty")


def is_parsed(status: Column) -> Column:
    """A document that was read; a missing status is none."""
    return F.coalesce(status.isin("parsed", "parsed_with_ocr"), F.lit(False))


def excerpt(text: Column, size: int = 20_000) -> Column:
    """The lines that are not blank, without white space at their ends, ``size`` characters at most. Null becomes empty."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\R"), lambda x: F.trim(x) != "")
    return F.left(F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"\s+$", "")), "\n"), F.lit(size))


def relevant_excerpt(text: Column, terms: list[str], size: int, first: int = 8, least: int = 8, alike: int = 140) -> Column:
    """The ``first`` lines of ``least`` characters or more and those with a term, of ones that begin alike the first; ``size`` characters at most."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\R"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: F.length(x) >= least)
    told = F.filter(lines, lambda x: reduce(lambda a, b: a | b, [F.lower(x).contains(w) for w in terms]))
    keys = F.transform(told, lambda x: F.left(F.lower(x), F.lit(alike)))
    once = F.filter(told, lambda x, i: F.array_position(keys, F.left(F.lower(x), F.lit(alike))) == i + 1)
    begin = F.slice(lines, 1, first)
    return F.left(F.array_join(F.concat(begin, F.array_except(once, begin)), "\n"), F.lit(size))


def ocr_lines(words: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Words (left, top, width, height, conf, text, word_num) into lines: box, length-weighted confidence, text.

    Words of a line stand from left to right, then from the top. Blank words and those without a confidence of ``least`` are left out.
    """
    good = words.where((F.col("conf") >= least) & (F.trim("text") != ""))
    weight = F.greatest(F.lit(1), F.length("text"))
    return good.groupBy(*keys).agg(
        F.min("left").alias("left"), F.min("top").alias("top"), F.max(F.col("left") + F.col("width")).alias("right"), F.max(F.col("top") + F.col("height")).alias("bottom"),
        F.round(F.sum(F.col("conf") * weight) / F.sum(weight), 2).alias("confidence"), F.count(F.lit(1)).alias("n_words"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "top", "word_num", "text"))), lambda w: w["text"]), " ").alias("line"),
    )


def line_of(words: Column, least: float) -> Column:
    """As ``ocr_lines``, of a line's words that stand in one array of structs; null if none are left. No word is shuffled by itself."""
    good = F.filter(words, lambda w: (w["conf"] >= least) & (F.trim(w["text"]) != ""))

    def whole(w: Column) -> Column:
        weight = F.greatest(F.lit(1), F.length(w["text"]))
        places = [w[c].alias(c) for c in ("left", "top", "word_num", "text")]
        return F.struct(*places, (w["left"] + w["width"]).alias("right"), (w["top"] + w["height"]).alias("bottom"), weight.alias("weight"), (w["conf"] * weight).cast("double").alias("weighted"))

    def of(g: Column) -> Column:
        total = lambda c: F.aggregate(g[c], F.lit(0.0), lambda s, x: s + x)
        return F.when(F.size(g) > 0, F.struct(
            F.array_min(g["left"]).alias("left"), F.array_min(g["top"]).alias("top"), F.array_max(g["right"]).alias("right"), F.array_max(g["bottom"]).alias("bottom"),
            F.round(total("weighted") / total("weight"), 2).alias("confidence"), F.size(g).cast("long").alias("n_words"), F.array_join(g["text"], " ").alias("line"),
        ))

    # Sorted by place first: the other fields only follow.
    return t.let(F.array_sort(F.transform(good, whole)), of)


def recognised_words(rows: DataFrame) -> DataFrame:
    """The words (level 5) of a recognition's rows, with white space squeezed and missing places and sizes as 0."""
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("left", "top", "width", "height", "block_num", "par_num", "line_num", "word_num")}
    return rows.where("level = 5").withColumns(zero).withColumn("text", t.squeeze(F.coalesce("text", F.lit(""))))


def recognised_pages(rows: DataFrame, page: list[str], least: float) -> DataFrame:
    """(page, accepted, rejected, confidence, width, height) of recognised pages.

    ``rows``: page, level, block_num, par_num, line_num, word_num, left, top, width, height, conf, text. Level 1 tells the page's
    size. Words with text count as accepted, or as rejected without a confidence of ``least``.
    """
    w = recognised_words(rows)
    text, good = F.col("text") != "", F.coalesce(F.col("conf") >= least, F.lit(False))
    weight = F.when(text & good, F.greatest(F.lit(1), F.length("text")))
    counts = w.groupBy(*page).agg(F.count_if(text & good).alias("accepted"), F.count_if(text & ~good).alias("rejected"), F.round(F.sum(F.when(text & good, F.col("conf")) * weight) / F.sum(weight), 2).alias("confidence"))
    sizes = rows.where("level = 1").groupBy(*page).agg(F.max(F.nullif("width", F.lit(0))).alias("width"), F.max(F.nullif("height", F.lit(0))).alias("height"))
    pages = rows.select(*page).distinct()
    return pages.join(counts, page, "left").join(sizes, page, "left").fillna(0, ["accepted", "rejected"])


def recognised_chunks(rows: DataFrame, page: list[str], least: float, limit: int = 4000) -> DataFrame:
    """(page, chunk_index, chunk, left, top, right, bottom, confidence, regions) of recognised pages.

    Lines (block, paragraph, line) stand from the top, then from the left, and are packed in that order, long ones cut at spaces; a
    part keeps its line's box and confidence. A chunk has the box around its parts and their confidence, weighted by length;
    ``regions`` are its parts' boxes, confidences and numbers of words. A page's lines are folded together, as each chunk begins
    where the one before ends.
    """
    own = [*page, "block_num", "par_num", "line_num"]
    lines = ocr_lines(recognised_words(rows), own, least)
    part = F.struct("top", "left", "block_num", "par_num", "line_num", "right", "bottom", "confidence", "n_words", "line")
    held = lines.groupBy(*page).agg(F.array_sort(F.collect_list(part)).alias("lines"))
    cut = lambda x: F.transform(split_long(x["line"], limit), lambda s: F.struct(s.alias("text"), *[x[c].alias(c) for c in ("left", "top", "right", "bottom", "confidence", "n_words")]))
    groups = pack(F.flatten(F.transform("lines", cut)), limit, "\n", size=lambda p: F.length(p["text"]), joined=False)
    x = held.select(*page, F.posexplode(groups).alias("chunk_index", "g"))
    of = lambda c: F.transform("g", lambda p: p[c])
    weight = F.transform("g", lambda p: F.greatest(F.lit(1), F.length(p["text"])))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    confidence = F.round(total(F.zip_with(of("confidence"), weight, lambda c, w: c * w)) / total(weight), 2)
    regions = F.transform("g", lambda p: F.struct(*[p[c].alias(c) for c in ("left", "top", "right", "bottom", "confidence", "n_words")]))
    return x.select(*page, "chunk_index", F.array_join(of("text"), "\n").alias("chunk"), F.array_min(of("left")).alias("left"), F.array_min(of("top")).alias("top"), F.array_max(of("right")).alias("right"), F.array_max(of("bottom")).alias("bottom"), confidence.alias("confidence"), regions.alias("regions"))
