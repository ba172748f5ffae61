"""Text functions as Column expressions: normalisers, parsers, token tests and value equivalences.

Accents are folded for the Latin letters that decompose; a letter that does not
decompose (ß, ø) stays, or goes where a normaliser keeps ASCII only. A null gives
null throughout, and an empty text an empty one, unless a function says else.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters whose canonical decomposition begins with an ASCII letter, and that letter.
FOLDED = {chr(c): d[0] for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isascii()}


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)``, with ``x`` worked out once however often ``f`` names it."""
    return F.transform(F.array(x), f)[0]


def fold(x: Column) -> Column:
    """Without accents; a text of ASCII alone, as its length in bytes tells, is left as it is."""
    return F.when(F.octet_length(x) > F.length(x), F.translate(x, "".join(FOLDED), "".join(FOLDED.values()))).otherwise(x)


def ascii_only(x: Column) -> Column:
    return F.regexp_replace(fold(x), "[^\\x00-\\x7F]", "")


def squeeze(x: Column) -> Column:
    """Runs of white space become one space, none at the ends; single spaces need no replacement."""
    return F.trim(F.regexp_replace(x, "(?U)\\s{2,}|[^\\S ]", " "))


def class_text(x: Column) -> Column:
    """S1, for classification: ASCII, lower case, - and _ as spaces."""
    return squeeze(F.translate(F.lower(ascii_only(x)), "-_", "  "))


def file_name(x: Column, default: str = "document", suffix: str = "") -> Column:
    """The last path part as a safe ASCII name; ``suffix`` is put where it lacks."""
    base = F.lower(ascii_only(F.element_at(F.split(x, r"[/\\]"), -1)))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(base, "[^a-z0-9._-]+", "-"), "-+", "-"), "^[-._]+|[-._]+$", "")
    named = F.when(clean == "", F.lit(default + suffix)).otherwise(clean)
    return F.when(named.endswith(suffix), named).otherwise(F.concat(named, F.lit(suffix))) if suffix else named


def field_key(x: Column, size: int = 128) -> Column:
    """Folded, lower case, other runs as one underscore, at most ``size`` characters."""
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(fold(x)), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit(size))


def plain_value(x: Column) -> Column:
    """Folded, lower case, white space squeezed, punctuation kept."""
    return squeeze(F.lower(fold(x)))


def question_text(x: Column) -> Column:
    """Letters, digits and slashes."""
    return squeeze(F.regexp_replace(F.lower(fold(x)), "[^a-z0-9/]+", " "))


def alnum_text(x: Column) -> Column:
    """Letters and digits."""
    return squeeze(F.regexp_replace(F.lower(fold(x)), "[^a-z0-9]+", " "))


def compact(x: Column) -> Column:
    """Lower case without white space, accents kept."""
    return F.regexp_replace(F.lower(x), "(?U)\\s+", "")


def without_labels(x: Column, labels: list[str]) -> Column:
    """S9 without the given words."""
    words = F.filter(F.split(alnum_text(x), " "), lambda w: ~w.isin(*labels))
    return F.array_join(words, " ")


def field_name(x: Column, size: int = 128) -> Column:
    """Lower case, hyphens and white space as underscores, accents kept."""
    return F.left(F.replace(squeeze(F.replace(F.lower(x), F.lit("-"), F.lit(" "))), F.lit(" "), F.lit("_")), F.lit(size))


def clipped(x: Column, size: int) -> Column:
    """At most ``size`` characters, the last an ellipsis where it was longer."""
    return F.when(F.length(x) > size, F.concat(F.rtrim(F.left(x, F.lit(size - 1))), F.lit("…"))).otherwise(x)


def money(x: Column) -> Column:
    """An amount in either convention as a double; null for what is none.

    With both separators the last one is the decimal mark. Several dots alone, or
    one kind whose last mark stands before exactly three characters, are thousands
    marks; else the mark is a decimal one.
    """
    s = F.regexp_replace(x, "[^0-9,.-]", "")
    dots, commas = (F.length(s) - F.length(F.replace(s, F.lit(c), F.lit(""))) for c in ".,")
    no_dots, no_commas = F.replace(s, F.lit("."), F.lit("")), F.replace(s, F.lit(","), F.lit(""))
    last_dot, last_comma = F.length(s) - F.instr(F.reverse(s), "."), F.length(s) - F.instr(F.reverse(s), ",")
    points = lambda v: F.replace(v, F.lit(","), F.lit("."))
    plain = (
        F.when((dots > 1) & (commas == 0), no_dots)
        .when((dots > 0) & (commas > 0), F.when(last_comma > last_dot, points(no_dots)).otherwise(no_commas))
        .when(commas > 0, F.when(s.rlike(",[^,]{3}$"), no_commas).otherwise(points(s)))
        .when((dots > 0) & s.rlike("[.][^.]{3}$"), no_dots)
        .otherwise(s)
    )
    return plain.try_cast("double")


def day_first(x: Column) -> Column:
    """A text that is day, month and year with one kind of separator, as a date."""
    return F.when(x.rlike(r"^[0-9]{1,2}([./-])[0-9]{1,2}\1[0-9]{4}$"), F.try_to_timestamp(F.regexp_replace(x, "[/-]", "."), F.lit("d.M.yyyy")).cast("date"))


def day(x: Column) -> Column:
    """Day first with dots, slashes or hyphens, or year-month-day; else the first day, month and year inside; null if that is no calendar day."""
    s = F.trim(x)
    iso = F.when(s.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_timestamp(s, F.lit("yyyy-M-d")).cast("date"))
    return F.coalesce(day_first(s), iso, day_first(F.regexp_extract(x, r"\b[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}\b", 0)))


def days(x: Column) -> Column:
    """Every valid d.m.y of the text as dd.mm.yyyy; years of 1900 to 2099, those of two digits in 20yy."""
    found = F.regexp_extract_all(x, F.lit(r"\b[0-3]?[0-9][./-][01]?[0-9][./-](?:19|20)?[0-9]{2}\b"), F.lit(0))
    full = F.transform(found, lambda d: F.regexp_replace(F.regexp_replace(d, "[/-]", "."), r"\.([0-9]{2})$", ".20$1"))
    valid = F.filter(F.transform(full, lambda d: F.try_to_timestamp(d, F.lit("d.M.yyyy"))), lambda d: d.isNotNull())
    return F.transform(valid, lambda d: F.date_format(d, "dd.MM.yyyy"))


def day_or_last(x: Column) -> Column:
    """For sorting; what is no date comes last."""
    return F.coalesce(day(x), F.to_date(F.lit("9999-12-31")))


def natural_key(x: Column) -> Column:
    """Digits padded, so that numbers sort as numbers."""
    parts = F.regexp_extract_all(F.lower(x), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 12, "0")).otherwise(p)), "")


def query_tokens(x: Column, stop: list[str], least: int = 3) -> Column:
    """Words of the normalised question, stop words and short ones left out, repeats kept."""
    return F.filter(F.split(question_text(x), " "), lambda w: (F.length(w) >= least) & ~w.isin(*stop))


def token_matches(token: Column | str, text: Column) -> Column:
    """Inside the text, or a word of five letters or more of the text begins the token (the other way round is inside)."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    if isinstance(token, str):
        begins = [padded.contains(f" {token[:n]} ") for n in range(5, len(token))]
        return reduce(lambda a, b: a | b, begins, text.contains(token))
    sizes = F.filter(F.sequence(F.lit(5), F.greatest(F.length(token), F.lit(5))), lambda n: n < F.length(token))
    return text.contains(token) | F.exists(sizes, lambda n: padded.contains(F.concat(F.lit(" "), F.left(token, n), F.lit(" "))))


def number_set(x: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit("[0-9]+"), F.lit(0))))


def same_or_within(a: Column, b: Column, least: int = 8) -> Column:
    """Equal, or one of ``least`` characters or more inside the other."""
    return (a == b) | ((F.least(F.length(a), F.length(b)) >= least) & (a.contains(b) | b.contains(a)))


# Words that say little about a value.
LOW_SIGNAL = ["bashkia", "date", "dat", "fshati", "kol", "leje", "ndertimi", "nr", "prot", "rep", "shpk"]


def telling(x: Column) -> Column:
    """Words of three letters or more of a normalised text that are not of low signal, repeats kept."""
    return F.filter(F.split(x, " "), lambda w: (F.length(w) >= 3) & ~w.isin(*LOW_SIGNAL))


def within(a: Column, b: Column) -> Column:
    """Whether all of array ``a`` is in ``b``."""
    return F.size(F.array_except(a, b)) == 0


def same_numbers_or_tokens(a: Column, b: Column) -> Column:
    """Equal; or two or more numbers, all the same; or all telling words of one in the other. Empty texts equal nothing."""
    x, y = alnum_text(a), alnum_text(b)
    nx, ny, wx, wy = number_set(x), number_set(y), telling(x), telling(y)
    words = (F.size(wx) > 0) & (F.size(wy) > 0) & (within(wx, wy) | within(wy, wx))
    return (x != "") & (y != "") & ((x == y) | ((F.size(nx) >= 2) & (nx == ny)) | words)


def company_words(x: Column) -> Column:
    """Words of S8, "sh p k" as one and "port" read as "prot"."""
    s = F.regexp_replace(F.regexp_replace(question_text(x), r"\bsh p k\b", "shpk"), r"\bport\b", "prot")
    return F.filter(F.split(s, " "), lambda w: w != "")


def token_subset(a: Column, b: Column) -> Column:
    """The words of one are all words of the other; empty texts equal nothing."""
    x, y = company_words(a), company_words(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & (within(x, y) | within(y, x))


def inside_or_numbers(a: Column, b: Column) -> Column:
    """One inside the other (S10), or, with two numbers or more in the first, the numbers of one all in the other; empty texts equal nothing."""
    x, y = compact(a), compact(b)
    nx, ny = number_set(x), number_set(y)
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x) | ((F.size(nx) >= 2) & (within(nx, ny) | within(ny, nx))))


def value_in_text(value: Column, text: Column, least: int = 3) -> Column:
    """Inside (S9); or two different numbers or more, all in the text; or ``least`` of its telling words (all, if it has fewer)."""
    v, t = alnum_text(value), alnum_text(text)
    numbers, words = number_set(v), telling(v)
    said = F.size(F.filter(words, lambda w: t.contains(w)))
    return ((v != "") & t.contains(v)) | ((F.size(numbers) >= 2) & within(numbers, number_set(t))) | ((F.size(words) > 0) & (said >= F.least(F.lit(least), F.size(words))))


def or_default(x: Column, default: float) -> Column:
    """A missing value and zero both become ``default``."""
    return F.when(x.isNull() | (x == 0), F.lit(default)).otherwise(x)


def clamp(x: Column) -> Column:
    """Into [0, 1]; what is no number becomes 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x.cast("double"), F.lit(0.0))))


def estimated_tokens(chars: Column) -> Column:
    """Four characters a token, one at least."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(chars / 4))


# P19, what keys and tokens look like.
SECRETS = [r"\bsk-[A-Za-z0-9_-]{16,}\b", r"\bgsk_[A-Za-z0-9_-]{16,}\b", r"\bAIza[A-Za-z0-9_-]{20,}\b", r"\b[0-9]{8,}:[A-Za-z0-9_-]{24,}\b", r"(?i)\b(?:api[_ -]?key|token|secret|celes|çeles|çelës)\b\s*(?:=|:|eshte|është)?\s*[A-Za-z0-9_.-]{20,}"]
REDACTED = "[REDACTED_SECRET]"


def has_secret(x: Column) -> Column:
    return reduce(lambda a, b: a | b, [x.rlike(p) for p in SECRETS])


def redacted(x: Column) -> Column:
    return reduce(lambda v, p: F.regexp_replace(v, p, REDACTED), SECRETS, x)
