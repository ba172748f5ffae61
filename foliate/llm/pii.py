"""PII: validated values replaced by keyed permutations within their own format, in DataFrame functions only.

A Feistel network, whose round function is SHA-256 over the key, the round and
the other half, permutes the values of a format among themselves: equal values
get equal pseudonyms in every document, different values different ones.
"""

from __future__ import annotations

import hmac
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.llm.shared import fresh

# Length of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT ST",
    26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
#: What may be a value; each kind is validated afterwards.
FORMS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(f"(?:{'|'.join(c.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + r"|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "phone": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{2,14}){1,5}(?![0-9])|(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}([./-])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([./-])[0-9]{1,2}\2[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2})(?![0-9/-])(?!\.[0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])(?!\.[0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}|[ -]?[0-9]{6}[ -]?[0-9]{4,5})(?![0-9A-Za-z])",
}
ROUNDS = 6
#: Days by first day, number of days, and a Feistel network's two halves that cover them.
NEAR = ("1900-01-01", 73170, 271, 270)  # to 2100-05-01
FAR = ("0001-01-01", 3652059, 1893, 1891)  # to 9999-12-31, without the days of NEAR
SHORT = ("2000-01-01", 36525, 487, 75)  # two-digit years


def subkey(key: str, kind: str) -> str:
    """A kind's own key. Only these stand in plans and event logs; the key itself can't be had from them."""
    return hmac.new(key.encode(), kind.encode(), "sha256").hexdigest()


def every_form() -> str:
    """One pattern for all kinds; the two separators of dates are its only groups."""
    return "|".join(FORMS.values())


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)``, with ``x`` worked out once however often ``f`` names it."""
    return F.transform(F.array(x), f)[0]


def number(key: str, rnd: Column, half: Column, size: int | Column) -> Column:
    """The round function's value below ``size``."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), rnd.cast("string"), half.cast("string")).cast("binary"), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.lit(size) if isinstance(size, int) else size)


def feistel_number(x: Column, high: int, low: int, key: str) -> Column:
    """A permutation of 0 .. high * low - 1."""
    begin = F.struct(F.floor(x / low).alias("h"), F.pmod(x, F.lit(low)).cast("long").alias("l"))

    def step(s: Column, r: Column) -> Column:
        h = F.when(r % 2 == 0, F.pmod(s["h"] + number(key, r, s["l"], high), F.lit(high))).otherwise(s["h"])
        l = F.when(r % 2 == 1, F.pmod(s["l"] + number(key, r, s["h"], low), F.lit(low))).otherwise(s["l"])  # noqa: E741
        return F.struct(h.alias("h"), l.alias("l"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, step, lambda s: s["h"] * low + s["l"])


def turned(half: Column, other: Column, rnd: Column, key: str) -> Column:
    """``half``, each letter or digit moved on within its alphabet by an amount that ``other`` decides."""

    def move(c: Column, i: Column) -> Column:
        code = F.ascii(c)
        first = F.when(c.between("0", "9"), 48).when(c.between("a", "z"), 97).when(c.between("A", "Z"), 65)
        size = F.when(code < 58, F.lit(10)).otherwise(F.lit(26))
        to = F.pmod(code - first + number(key, rnd, F.concat_ws("|", i.cast("string"), other), size), size)
        return F.when(first.isNull(), c).otherwise(F.chr((first + to).cast("long")))

    return F.array_join(F.transform(F.split(half, ""), move), "")


def feistel_text(x: Column, key: str) -> Column:
    """A permutation of the ASCII letters and digits of ``x`` that keeps each one's alphabet and all else."""
    middle = F.ceil(F.length(x) / 2).cast("int")
    begin = F.struct(F.substring(x, F.lit(1), middle).alias("a"), F.substring(x, middle + 1, F.length(x)).alias("b"))

    def step(s: Column, r: Column) -> Column:
        a = F.when(r % 2 == 0, turned(s["a"], s["b"], r, key)).otherwise(s["a"])
        b = F.when(r % 2 == 1, turned(s["b"], s["a"], r, key)).otherwise(s["b"])
        return F.struct(a.alias("a"), b.alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, step, lambda s: F.concat(s["a"], s["b"]))


def refilled(form: Column, core: Column, fits: str) -> Column:
    """``form`` with its characters of class ``fits`` replaced, in turn, by those of ``core``."""
    rank = lambda i: F.length(F.regexp_replace(F.substring(form, F.lit(1), i + 1), f"[^{fits}]", ""))
    return let(core, lambda k: F.array_join(F.transform(F.split(form, ""), lambda c, i: F.when(c.rlike(f"[{fits}]"), F.substring(k, rank(i), F.lit(1))).otherwise(c)), ""))


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def card(v: Column, key: str) -> Column:
    """Luhn-valid numbers of 13 to 19 digits stay Luhn-valid."""
    d = digits(v)
    body = feistel_text(F.substring(d, F.lit(1), F.length(d) - 1), subkey(key, "card"))
    checked = let(body, lambda b: F.filter(F.array(*[F.concat(b, F.lit(str(k))) for k in range(10)]), lambda n: F.call_function("luhn_check", n))[0])
    return F.when(F.length(d).between(13, 19) & F.call_function("luhn_check", d), refilled(v, checked, "0-9"))


def ip(v: Column, key: str) -> Column:
    o = F.transform(F.split(v, r"\."), lambda x: x.cast("long"))
    new = feistel_number(((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3], 65536, 65536, subkey(key, "ip"))
    dotted = let(new, lambda x: F.concat_ws(".", *[F.pmod(F.shiftrightunsigned(x, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]))
    return F.when(F.forall(o, lambda b: b < 256), dotted)


def ssn(v: Column, key: str) -> Column:
    """Numbers outside the ranges that are never issued; the permutation is walked until it is back among them."""
    good = lambda d: ~(d.startswith("9") | d.startswith("000") | d.startswith("666") | (F.substring(d, 4, 2) == "00") | d.endswith("0000"))
    turn = lambda d: feistel_text(d, subkey(key, "ssn"))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(16)), turn(digits(v)), lambda d, _: F.when(good(d), d).otherwise(turn(d)))
    return F.when(good(digits(v)), refilled(v, walk, "0-9"))


def phone(v: Column, key: str) -> Column:
    """8 to 15 digits after a plus, of which the country code stays; or ten, an area code and an exchange that begin with 2 to 9, of which the area code stays."""
    code = F.when(v.rlike(r"^\+[0-9]{1,3}[^0-9]"), F.regexp_extract(v, r"^\+[0-9]+", 0)).otherwise(F.regexp_extract(v, r"^\+(?:[17]|[0-9]{2})", 0))
    rest = F.substring(v, F.length(code) + 1, F.length(v))
    abroad = F.when(F.length(digits(v)).between(8, 15), F.concat(code, refilled(rest, feistel_text(digits(rest), subkey(key, "phone")), "0-9")))
    d = digits(v)
    first, last = F.substring(d, 1, 3), F.substring(d, 4, 7).try_cast("long")
    home = F.when(d.rlike("^[2-9]..[2-9]") & (F.length(d) == 10), refilled(v, F.concat(first, (feistel_number(last - 2_000_000, 3200, 2500, subkey(key, "phone")) + 2_000_000).cast("string")), "0-9"))
    return F.when(v.startswith("+"), abroad).otherwise(home)


def mod97(v: Column) -> Column:
    return F.aggregate(F.split(v, ""), F.lit(0), lambda s, c: F.pmod(F.when(c.between("0", "9"), s * 10 + F.ascii(c) - 48).otherwise(s * 100 + F.ascii(c) - 55), F.lit(97)).cast("int"))


def iban(v: Column, key: str) -> Column:
    """Numbers whose check digits hold get new ones that hold."""
    s = F.regexp_replace(v, " ", "")
    land, body = F.substring(s, 1, 2), F.substring(s, F.lit(5), F.length(s))
    new = feistel_text(body, subkey(key, "iban"))
    core = let(new, lambda n: F.concat(land, F.lpad((98 - mod97(F.concat(n, land, F.lit("00")))).cast("string"), 2, "0"), n))
    valid = F.length(s).between(15, 34) & (mod97(F.concat(body, F.substring(s, 1, 4))) == 1)
    return F.when(valid, refilled(v, core, "A-Z0-9"))


def turned_day(day: Column, late: Column, span: tuple[str, int, int, int], key: str, apart: bool = False) -> Column:
    """``day`` permuted among the days of ``span`` (without those of NEAR if ``apart``), or among those after the 12th of a month if ``late``.

    The permutation of the covering range is walked until it is back among them.
    """
    first, size, high, low = span
    start = F.lit(first).cast("date")
    skip = F.datediff(F.lit(NEAR[0]).cast("date"), start)
    own = F.datediff(day, start)
    n = F.when(own >= skip + NEAR[1], own - NEAR[1]).otherwise(own) if apart else own
    size -= NEAR[1] if apart else 0
    to_day = lambda k: F.date_add(start, (F.when(k >= skip, k + NEAR[1]).otherwise(k) if apart else k).cast("int"))
    turn = lambda k: feistel_number(k, high, low, key)
    fits = lambda k: F.when(k >= size, F.lit(False)).otherwise(~late | (F.dayofmonth(to_day(k)) > 12))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(60)), turn(n.cast("long")), lambda k, _: F.when(fits(k), k).otherwise(turn(k)))
    return let(walk, lambda k: F.when(fits(k), to_day(k)))


def date(v: Column, key: str) -> Column:
    """Calendar days: year first; with slashes month/day/year, or day/month/year where that is no day; else day first, or month first where that is none.

    Days of 1900-01-01 to 2100-05-01 and all others are permuted among
    themselves; so are days that only the second reading gives, and days with
    two-digit years (slashes only, read as 20yy). Days and months of one digit
    give such without zeros before them.
    """
    sep = F.regexp_extract(v, "[./-]", 0)
    p = F.split(v, "[./-]")
    day_of = lambda y, m, d: F.try_to_timestamp(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    short = F.length(p[2]) == 2
    year = F.when(short, F.concat(F.lit("20"), p[2])).otherwise(p[2])
    us, eu = day_of(year, p[0], p[1]), day_of(year, p[1], p[0])
    iso = v.rlike("^[0-9]{4}")
    begin = F.when(iso, F.struct(day_of(p[0], p[1], p[2]).alias("day"), F.lit("ymd").alias("order"), F.lit(False).alias("late"))).when(
        sep == "/", F.struct(F.coalesce(us, eu).alias("day"), F.when(us.isNull(), "dmy").otherwise("mdy").alias("order"), us.isNull().alias("late"))
    ).otherwise(F.struct(F.coalesce(eu, us).alias("day"), F.when(eu.isNull(), "mdy").otherwise("dmy").alias("order"), eu.isNull().alias("late")))
    near = lambda d: F.datediff(d, F.lit(NEAR[0]).cast("date")).between(0, NEAR[1] - 1)
    new = lambda s: F.when(short & ~iso, turned_day(s["day"], s["late"], SHORT, subkey(key, "date2"))).when(near(s["day"]), turned_day(s["day"], s["late"], NEAR, subkey(key, "date"))).otherwise(turned_day(s["day"], s["late"], FAR, subkey(key, "far date"), True))
    bare = v.rlike("^[0-9]{4}[./-][0-9][./-]|[./-][0-9]$|^[0-9][./-]|[./-][0-9][./-]")

    def shown(d: Column, s: Column) -> Column:
        day, month = F.when(bare, F.dayofmonth(d).cast("string")).otherwise(F.lpad(F.dayofmonth(d).cast("string"), 2, "0")), F.when(bare, F.month(d).cast("string")).otherwise(F.lpad(F.month(d).cast("string"), 2, "0"))
        y = F.lpad(F.year(d).cast("string"), 4, "0")
        y = F.when(short & ~iso, F.substring(y, 3, 2)).otherwise(y)
        return F.when(s["order"] == "ymd", F.concat_ws(sep_lit, y, month, day)).when(s["order"] == "mdy", F.concat_ws(sep_lit, month, day, y)).otherwise(F.concat_ws(sep_lit, day, month, y))

    sep_lit = "-"
    return let(begin, lambda s: F.when(s["day"].isNotNull(), let(new(s), lambda d: F.replace(shown(d, s), F.lit("-"), sep))))


def email(v: Column, key: str) -> Column:
    """The local part is permuted, the domain stays."""
    local = F.substring_index(v, "@", 1)
    return F.concat(feistel_text(local, subkey(key, "email")), F.lit("@"), F.substring_index(v, "@", -1))


def pseudonym(v: Column, key: str) -> Column:
    """(kind, new) of a possible value; new is null where it is not valid."""
    of = {"email": email, "iban": iban, "phone": phone, "ssn": ssn, "date": date, "ip": ip, "card": card}
    kind = reduce(lambda c, k: c.when(v.rlike(f"^(?:{FORMS[k]})$"), F.lit(k)), FORMS, F.when(F.lit(False), F.lit("")))
    new = lambda x: reduce(lambda c, k: c.when(x == k, of[k](v, key)), FORMS, F.when(F.lit(False), F.lit("")))
    return let(kind, lambda x: F.struct(x.alias("kind"), v.alias("old"), new(x).alias("new")))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", values_col: str = "pii_values") -> DataFrame:
    """``docs`` with validated values in the text replaced, and a column of (kind, new) for each, in order.

    Emails, IBANs, phone numbers with a plus or of the North American form, US
    social security numbers, dates, IPv4 addresses and card numbers. Values that
    fail their check (Luhn, mod 97, calendar, octets, issued ranges) are left as
    they are. A null text stays null and has no values, an empty one has none;
    texts of any length are done whole, repeated rows and ids each by
    themselves with equal results; an empty table gives none. The other columns
    are unchanged, whatever their names (``values_col`` replaces a column of
    that name). No shuffle and no Python on the executors.
    """
    form = every_form()
    found, valid = fresh([*docs.columns, values_col], "found"), fresh([*docs.columns, values_col], "valid")
    values = F.when(F.col(text_col).rlike("[0-9@]"), F.transform(F.regexp_extract_all(text_col, F.lit(form), F.lit(0)), lambda v: pseudonym(v, key)))
    x = docs.withColumn(found, values)
    gaps = F.split(text_col, form, -1)
    joined = F.array_join(F.zip_with(gaps, found, lambda g, f: F.concat(g, F.coalesce(f["new"], f["old"], F.lit("")))), "")
    kept = F.transform(F.filter(found, lambda f: f["new"].isNotNull()), lambda f: F.struct(f["kind"].alias("kind"), f["new"].alias("new")))
    x = x.withColumn(valid, F.coalesce(kept, F.array().cast("array<struct<kind:string,new:string>>")))
    text = F.when(F.size(valid) > 0, joined).otherwise(F.col(text_col))
    columns = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != values_col]
    return x.select(*columns, F.col(valid).alias(values_col))


def pii_report(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs`` with a value: id (null or repeated as it is), n_values, kinds (sorted), pseudonyms (in order), text (with them)."""
    x = pseudonymise(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), key, "text", "v").where(F.size("v") > 0)
    kinds = F.array_sort(F.array_distinct(F.transform("v", lambda f: f["kind"])))
    return x.select(F.col("id").alias(id_col), F.size("v").cast("long").alias("n_values"), kinds.alias("kinds"), F.transform("v", lambda f: f["new"]).alias("pseudonyms"), F.col("text").alias(text_col))
