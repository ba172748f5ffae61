"""Line dedup: an edit-distance join of lines by segments, and classes of lines that it links.

A line is split into threshold-plus-one segments. Two lines within the threshold
share a segment unchanged, shifted by no more than the threshold allows; so each
line is indexed by its segments and probes, for each length that a partner may
have, the substrings that could be that partner's segments (length-aware,
multi-match-aware selection). What meets is verified by a banded bit-parallel
edit distance. Everything is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.llm.components import components
from foliate.llm.shared import cut, drop, fresh

#: Rows of 8 bytes that may be broadcast; beyond, the join is shuffled.
BROADCAST_ROWS = 1 << 20


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line): the text's \\n-separated lines, trimmed of blanks at both ends."""
    split = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "raw"))
    return split.select("id", "line_no", F.trim(F.col("raw"), F.lit(" \t\r\v\f")).alias("line"))


def substrings(edits: int) -> list[tuple[int, int, int]]:
    """(shorter, segment, shift) of all that a line looks up: its own segments, shift and shorter 0, and its probes."""
    out, parts = [], edits + 1
    for shorter in range(edits + 1):
        for i in range(parts):
            out += [(shorter, i, s) for s in range(max(-i, shorter - edits + i), min(i, shorter + edits - i) + 1)]
    return out


def substring_keys(lines: DataFrame, edits: int, odd: int) -> DataFrame:
    """(h, line, key, indexed) of (h, line, size): each line's own segments, and the substrings that it probes besides, of odd or of even segments.

    The list of substrings is exploded before it is applied, so that the
    generated code is one small loop.
    """
    parts = edits + 1
    each = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("shorter", "i", "s"), x, strict=True)]) for x in substrings(edits) if x[1] % 2 == odd])
    x = lines.select("h", "line", "size", F.explode(each).alias("k")).select("h", "line", (F.col("size") - F.col("k.shorter")).alias("length"), "k.*")
    x = x.withColumn("base", F.expr(f"cast(length div {parts} as int)")).withColumn("odd", F.lit(parts) - F.col("length") % parts)
    start = F.col("i") * F.col("base") + F.greatest(F.lit(0), F.col("i") - F.col("odd")) + F.col("s") + 1
    piece = F.substring(F.col("line"), start, F.col("base") + (F.col("i") >= F.col("odd")).cast("int"))
    return x.select("h", "line", F.xxhash64("i", "length", piece).alias("key"), ((F.col("shorter") == 0) & (F.col("s") == 0)).alias("indexed"))


def within(x: Column, y: Column, edits: int) -> Column:
    """Whether arrays ``x`` and ``y`` of characters are ``edits`` or fewer edits apart.

    Bit-parallel over a band of 2 * edits + 1 diagonals: bit o of set e says that
    the first j + o - edits characters of ``x`` are e edits from the first j of
    ``y``. A step keeps matches and adds substitutions, insertions (shift down)
    and deletions (shift up), for all diagonals of a set at once.
    """
    band = (1 << 2 * edits + 1) - 1
    pad = F.array_repeat(F.lit(""), edits)
    wide = F.concat(pad, x, pad)
    begin = [sum(1 << edits + k for k in range(e + 1)) for e in range(edits + 1)]
    names = [f"r{e}" for e in range(edits + 1)]
    first = F.struct(F.lit(0).alias("j"), *[F.lit(b & band).alias(n) for n, b in zip(names, begin, strict=True)])

    def step(s: Column, c: Column) -> Column:
        same = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.get(wide, s["j"] + o) == c, F.lit(1 << o)).otherwise(F.lit(0)) for o in range(2 * edits + 1)])
        # The characters that match are worked out once for a step, then used by each set.
        return F.aggregate(F.array(same), s, lambda t, m: next_sets(t, m))

    def next_sets(t: Column, m: Column) -> Column:
        new = [t[names[0]].bitwiseAND(m)]
        for e in range(1, edits + 1):
            before = t[names[e - 1]]
            x = t[names[e]].bitwiseAND(m).bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(new[-1], 1))
            new.append(x.bitwiseAND(F.lit(band)))
        return F.struct((t["j"] + 1).alias("j"), *[v.alias(n) for n, v in zip(names, new, strict=True)])

    last = F.aggregate(y, first, step)[names[-1]]
    at = F.size(x) - F.size(y) + edits
    return F.when(at.between(0, 2 * edits), F.call_function("shiftright", last, at).bitwiseAND(F.lit(1)) == 1).otherwise(F.lit(False))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)``, with ``x`` worked out once however often ``f`` names it."""
    return F.transform(F.array(x), f)[0]


def common_prefix(x: Column, y: Column, most: Column) -> Column:
    """Length, up to ``most``, of what two texts begin with alike (at most 2**17 - 1, which is enough to spare work)."""
    powers = F.array(*[F.lit(1 << k) for k in range(16, -1, -1)])
    longer = lambda p, w: (p + w <= most) & (F.substring(x, p + 1, w) == F.substring(y, p + 1, w))
    return F.aggregate(powers, F.lit(0), lambda p, w: F.when(longer(p, w), p + w).otherwise(p))


def lines_within(x: Column, y: Column, edits: int) -> Column:
    """Whether two lines, which differ in length by ``edits`` at most, are that many edits apart: what both begin and end with is left out."""

    def middle(p: Column, s: Column) -> Column:
        mx, my = (F.substring(t, p + 1, F.length(t) - p - s) for t in (x, y))
        return F.when(F.least(F.length(mx), F.length(my)) <= 0, F.lit(True)).otherwise(within(F.split(mx, ""), F.split(my, ""), edits))

    least = F.least(F.length(x), F.length(y))
    return let(common_prefix(x, y, least), lambda p: let(common_prefix(F.reverse(x), F.reverse(y), least - p), lambda s: middle(p, s)))


def pieces_kept(x: Column, y: Column, edits: int, parts: int = 8) -> Column:
    """Whether all but ``edits`` of ``parts`` even pieces of ``x`` are somewhere in ``y``, as they are if so many edits lie between."""
    width = F.expr(f"cast(length(x) div {parts} as int)")
    return reduce(lambda n, k: n + y.contains(F.substring(x, width * k + 1, width)).cast("int"), range(parts), F.lit(0)) >= parts - edits


def letter_counts(line: Column) -> Column:
    return F.array(*[F.length(line) - F.length(F.replace(line, F.lit(c), F.lit(""))) for c in "abcdefghijklmnopqrstuvwxyz0123456789"])


def few(keys: DataFrame) -> DataFrame:
    """``keys``, which are read from a table, broadcast while they are few."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def meetings(lines: DataFrame, edits: int, odd: int) -> DataFrame:
    """(key, h, indexed) of each substring that different lines of (h, line, size) share, one of them as its segment."""
    rows = substring_keys(lines, edits, odd).select("key", "h", "indexed")
    shared = rows.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.max("indexed").alias("i"))
    keys = cut(shared.where("lo <> hi and i").select("key"))
    out = cut(rows.join(few(keys), "key", "left_semi").groupBy("key", "h").agg(F.max("indexed").alias("indexed")))
    drop(keys)
    return out


def line_links(lines: DataFrame, edits: int) -> DataFrame:
    """Links (a, b) of hashes, a < b, of different lines of (h, line, size) within ``edits`` edits.

    Substrings meet in two rounds, half of them each, as they are the most that
    line dedup shuffles, and without their lines, whose texts come to those left.
    """
    halves = [meetings(lines, edits, odd) for odd in (0, 1)]
    held = reduce(DataFrame.unionAll, halves)
    hashes = cut(held.select("h").distinct())
    texts = lines.join(few(hashes), "h", "left_semi").groupBy("h").agg(F.first("line").alias("line"))
    met = cut(held.join(texts.withColumn("n", letter_counts(F.lower("line"))), "h"))
    drop(hashes, *halves)
    a = met.where("indexed").select("key", F.col("h").alias("a"), F.col("line").alias("x"), F.col("n").alias("nx"))
    b = met.select("key", F.col("h").alias("b"), F.col("line").alias("y"), F.col("n").alias("ny"), "indexed")
    # An edit changes the counts of letters by two at most, and one piece; this spares most verifications.
    apart = F.aggregate(F.zip_with("nx", "ny", lambda p, q: F.abs(p - q)), F.lit(0), lambda s, v: s + v)
    alike = F.when(apart <= 2 * edits, pieces_kept(F.col("x"), F.col("y"), edits)).otherwise(F.lit(False))
    near = F.when(alike, lines_within(F.col("x"), F.col("y"), edits)).otherwise(F.lit(False))
    once = (F.col("a") < F.col("b")) | ((F.col("a") != F.col("b")) & ~F.col("indexed"))
    pairs = a.join(b, (a.key == b.key) & once & near)
    out = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    drop(met)
    return out


def first_lines(lines: DataFrame) -> DataFrame:
    """(h, first, lo, hi): the first place of each hash of (id, line_no, h, g), and the least and largest second hash."""
    return cut(lines.groupBy("h").agg(F.min(F.struct("id", "line_no")).alias("first"), F.min("g").alias("lo"), F.max("g").alias("hi")))


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 2, min_chars: int = 20) -> DataFrame:
    """(id, line_no, class_id, class_line_no, links) of each line that is not blank.

    A class holds lines that are equal, or linked through lines ``edits`` or fewer
    edits apart, over the whole table; it is named by its first line in order of
    id and line number (nulls first). Only lines of ``min_chars`` characters or
    more are linked by edits: so few edits make other words of shorter ones.
    ``links`` counts the different lines that a line is linked to. Lines are equal
    if two 64-bit hashes of them are. Null and empty texts have no lines here; rows
    that share an id share their line numbers; an empty table gives no rows.
    """
    return classified(docs, id_col, text_col, edits, min_chars)[0]


def classified(docs: DataFrame, id_col: str, text_col: str, edits: int, min_chars: int) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of ``line_classes``, and the tables to drop when these have been read."""
    lines = lines_of(docs, id_col, text_col).where("line <> ''").withColumn("size", F.length("line"))
    lines = cut(lines.withColumns({"h": F.xxhash64("line"), "g": F.xxhash64(F.lit("second"), "line")}))  # split once; it is read three times
    first = first_lines(lines)
    if first.where("lo <> hi").head(1):  # different lines with one hash get others
        clash = first.where("lo <> hi").select("h", F.lit(True).alias("clash"))
        again = cut(lines.join(clash, "h", "left").withColumn("h", F.when(F.col("clash"), F.xxhash64("h", "g")).otherwise(F.col("h"))).drop("clash"))
        drop(lines, first)
        lines, first = again, first_lines(again)
    links = line_links(lines.where(F.col("size") >= min_chars).select("h", "line", "size"), edits)
    roots = components(links)
    rooted = cut(first.join(roots, F.col("h") == F.col("node"), "left").select("h", "first", F.coalesce("root", "h").alias("root")))
    head = cut(rooted.groupBy("root").agg(F.min("first").alias("head")))
    degree = cut(links.select(F.col("a").alias("h")).unionAll(links.select(F.col("b").alias("h"))).groupBy("h").agg(F.count(F.lit(1)).alias("links")))
    named = cut(rooted.join(head, "root").select("h", "head").join(degree, "h", "left").select("h", "head", F.coalesce("links", F.lit(0)).alias("links")))
    drop(first, links, roots, rooted, head, degree)
    out = lines.select("id", "line_no", "h").join(named, "h")
    return out.select("id", "line_no", F.col("head.id").alias("class_id"), F.col("head.line_no").alias("class_line_no"), "links"), [lines, named]


def is_repeat(x: Column, doc: Column) -> Column:
    """Whether a line (line_no, class_id, class_line_no) of ``doc`` is not the first of its class."""
    return ~(doc.eqNullSafe(x["class_id"]) & (x["line_no"] == x["class_line_no"]))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 2, min_chars: int = 20) -> DataFrame:
    """A row for each id with lines to remove, written to the shared folder: id, removed (array of line_no).

    All lines of a class but its first are removed. Rows that share an id share
    their lines' numbers: a line that is first in one of them stays in all.
    """
    c, read = classified(docs, id_col, text_col, edits, min_chars)
    out = c.where(is_repeat(F.struct("line_no", "class_id", "class_line_no"), F.col("id")))
    out = cut(out.groupBy("id").agg(F.array_sort(F.collect_set("line_no")).alias("removed")))
    drop(*read)
    return out


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 2, min_chars: int = 20) -> DataFrame:
    """A row for each row of ``docs``: id, n_lines, n_removed, n_links, removed_lines, first_docs, class_docs.

    ``removed_lines`` numbers the lines that repeat an earlier one exactly or
    nearly; ``first_docs`` names, in the same order, the documents with the
    first line of their classes. ``class_docs`` does so for every line that is
    not blank, and ``n_links`` adds up how many different lines each of these is
    linked to. A null text has no lines, an empty one has one, which is blank.
    Rows that share an id share their lines. Other columns are left out.
    """
    line = F.struct("line_no", "class_id", "class_line_no", "links")
    c, read = classified(docs, id_col, text_col, edits, min_chars)
    own = cut(c.groupBy(F.col("id").alias("own_id")).agg(F.array_sort(F.collect_set(line)).alias("lines")))
    drop(*read)
    rows = docs.select(F.col(id_col).alias("id"), F.greatest(F.coalesce(F.size(F.split(text_col, "\n")), F.lit(0)), F.lit(0)).alias("n"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.join(own, F.col("id").eqNullSafe(F.col("own_id")), "left")
    out = out.withColumn("lines", F.coalesce("lines", F.array().cast(f"array<struct<line_no:int,class_id:{kind},class_line_no:int,links:bigint>>")))
    out = out.withColumn("gone", F.filter("lines", lambda x: is_repeat(x, F.col("id"))))
    each = lambda c, f: F.transform(c, lambda x: x[f])
    links = F.aggregate(each("lines", "links"), F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), links.alias("n_links"), each("gone", "line_no").alias("removed_lines"), each("gone", "class_id").alias("first_docs"), each("lines", "class_id").alias("class_docs"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 2, min_chars: int = 20) -> DataFrame:
    """``docs``, all its columns, with the text less its repeated lines; rows whose lines all go are dropped.

    Rows without lines to remove, null and empty texts included, are unchanged;
    repeated rows and ids as in ``line_classes``; an empty table gives no rows.
    """
    gone_id, gone, left = (fresh(docs.columns, n) for n in ("gone_id", "gone", "left_lines"))
    found = repeated_lines(docs, id_col, text_col, edits, min_chars).toDF(gone_id, gone)
    # What is removed grows with the documents, so the join is a shuffle at every size.
    x = docs.join(found.hint("merge"), F.col(id_col).eqNullSafe(F.col(gone_id)), "left")
    x = x.withColumn(left, F.when(F.col(gone).isNotNull(), F.filter(F.split(text_col, "\n"), lambda v, i: ~F.array_contains(F.col(gone), i))))
    x = x.where(F.col(gone).isNull() | F.exists(left, lambda v: F.trim(v, F.lit(" \t\r\v\f")) != ""))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    return x.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
