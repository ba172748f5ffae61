"""Display texts, labels, replacements and JSON reading as Column expressions. Nulls give null unless a function says else."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliate.functions import text as t
from foliate.functions.fields import PLACEHOLDER

# Place names and how they are shown.
PLACES = {"Mallakaster": "Mallakastër", "Tirane": "Tiranë", "Vlore": "Vlorë", "Korce": "Korçë"}
LICENCE = r"(?i)(?:li[cç](?:enc(?:e|ë)|ens[ëe])?|li[cç]\.?|license)\s*(?:profesionale\s*)?(?:nr\.?\s*)?[:.]?\s*([A-Z]{1,4}[\s.-]*\d{2,6}(?:/\d+)?)"


def party_name(x: Column) -> Column:
    """A company or person without file endings, labels and quotes, 120 characters at most; null if under three are left or it is a placeholder."""
    v = t.squeeze(F.replace(x, F.lit("_"), F.lit(" ")))
    v = F.regexp_replace(v, r"(?i)\b(?:docx?|pdf|kontrat[ëe]?)\b.*$", "")
    v = F.trim(F.regexp_replace(v, r"(?i)^(?:me\s+)", ""), F.lit(" ,.;:-"))
    v = F.trim(F.regexp_replace(v, r"(?i)^(z|znj|ing|ark)\.\s*", "$1. "), F.lit('"“” ,.;:-'))
    return F.when((F.length(v) >= 3) & ~v.rlike(PLACEHOLDER), F.left(v, F.lit(120)))


def licence_number(x: Column) -> Column:
    """Upper case, no white space, points as hyphens."""
    return F.replace(F.regexp_replace(F.upper(x), r"\s+", ""), F.lit("."), F.lit("-"))


def money_text(x: Column) -> Column:
    """The digits with points between thousands; a text without digits as it is."""
    d = F.regexp_replace(F.regexp_replace(x, "[^0-9]", ""), "^0+(?=[0-9])", "")
    return F.when(d == "", x).otherwise(F.regexp_replace(d, r"(?<=[0-9])(?=(?:[0-9]{3})+$)", "."))


def instant(x: Column) -> Column:
    """An ISO date and time, Z or an offset at its end, as a timestamp; null for what is none."""
    return F.try_to_timestamp(F.trim(x))


def local_date(x: Column, zone: str = "Europe/Tirane") -> Column:
    """The day in a time zone, as dd.mm.yyyy; times without a zone are UTC. Null becomes empty."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(x, zone), "dd.MM.yyyy"), F.lit(""))


def with_units(x: Column) -> Column:
    """Square metres and kg/cm² with their signs, decimal points for commas in them."""
    number = r"(\d+(?:[.,]\d+)?)"
    point = lambda v: F.regexp_replace(v, r"(\d),(\d+ m²)", "$1.$2")
    v = F.regexp_replace(t.squeeze(x), rf"(?i)\b{number}\s*\(\s*{number}\s*m\s*(?:2|²)?\s*podrum\s*\)", "$1 m², nga të cilat $2 m² podrum")
    v = F.regexp_replace(v, rf"(?i)\b{number}\s*m\s*(?:2\b|²(?!\w))", "$1 m²")
    return F.regexp_replace(point(v), r"(?i)\bkg/cm\s*(?:2\b|²(?!\w))", "kg/cm²")


def with_places(x: Column) -> Column:
    """Place names as they are shown."""
    return reduce(lambda v, kv: F.regexp_replace(v, rf"\b{kv[0]}\b", kv[1]), PLACES.items(), x)


def mass_text(x: Column) -> Column:
    """A number in kilograms with commas between thousands, up to three decimals; what is no number gets the unit only."""
    n = F.replace(F.replace(x, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    shown = F.regexp_replace(F.regexp_replace(F.format_number(n, 3), "0+$", ""), r"\.$", "")
    return F.concat(F.when(n.isNull(), x).otherwise(shown), F.lit(" kg"))


def listed(x: Column, last: str = "dhe") -> Column:
    """The texts of an array with commas, a word before the last; empty ones left out, empty for none."""
    v = F.filter(x, lambda y: y != "")
    n = F.size(v)
    return F.when(n <= 1, F.array_join(v, "")).otherwise(F.concat(F.array_join(F.slice(v, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(f" {last} "), F.element_at(v, -1)))


def with_suffix(name: Column, suffix: str) -> Column:
    """The last path part's ending replaced, or put where there is none."""
    return F.when(name.rlike(r"[^/]\.[^./]+$"), F.regexp_replace(name, r"\.[^./]+$", suffix)).otherwise(F.concat(name, F.lit(suffix)))


def safe_component(x: Column, default: str = "dokument") -> Column:
    """One path part: slashes as underscores; a default for what is no name."""
    v = F.trim(F.translate(x, "/\\\x00", "__"))
    return F.when(v.isin("", ".", ".."), F.lit(default)).otherwise(v)


def folder_id(x: Column, hosts: tuple[str, ...]) -> Column:
    """A folder's id, bare or in the path or query of an https address of one of ``hosts``; else null."""
    raw = F.trim(x)
    shaped = lambda v: F.when(v.rlike("^[A-Za-z0-9_-]{10,200}$"), v)
    host = F.regexp_extract(raw, r"^https://([^/?#]+)", 1)
    path = F.regexp_extract(raw, r"^https://[^/?#]+[^?#]*?/(?:drive/(?:u/[0-9]+/)?folders|folders)/([A-Za-z0-9_-]+)", 1)
    query = F.regexp_extract(raw, r"^[^?#]*\?(?:[^#]*&)?id=([^&#]*)", 1)
    return F.coalesce(shaped(raw), F.when(host.isin(*hosts), shaped(F.when(path != "", path).otherwise(query))))


def source_label(name: Column, page_start: Column, page_end: Column, paragraph_start: Column, paragraph_end: Column, row_start: Column, row_end: Column, chunk_index: Column) -> Column:
    """A file name and where in it: pages, else paragraphs, else rows, else the number of the fragment."""
    s = lambda c: c.cast("string")
    span = lambda a, b, one, many: F.when(F.coalesce(b, a) != a, F.concat(name, F.lit(many), s(a), F.lit("-"), s(b))).otherwise(F.concat(name, F.lit(one), s(a)))
    rows = F.concat(name, F.lit(", rreshtat "), s(row_start), F.lit("-"), s(F.coalesce(row_end, row_start)))
    return (
        F.when(page_start.isNotNull(), span(page_start, page_end, ", fq. ", ", fq. "))
        .when(paragraph_start.isNotNull(), span(paragraph_start, paragraph_end, ", paragrafi ", ", paragrafët "))
        .when(row_start.isNotNull(), rows)
        .otherwise(F.concat(name, F.lit(", fragmenti "), s(chunk_index + 1)))
    )


def law_label(code: Column, article: Column, shown: dict[str, str] | None = None) -> Column:
    """A law's code, or how it is shown, and its article if there is one."""
    base = code if not shown else F.coalesce(F.create_map(*[F.lit(v) for kv in shown.items() for v in kv])[code], code)
    return F.when(F.coalesce(article, F.lit("")) != "", F.concat(base, F.lit(", Neni "), article)).otherwise(base)


def replaced_value(text: Column, old: Column, new: Column) -> Column:
    """``old`` in ``text`` by ``new``; a number only where no digit stands beside it. Empty or equal values change nothing."""
    bare = F.regexp_replace(text, F.concat(F.lit("(?<![0-9])"), old, F.lit("(?![0-9])")), F.regexp_replace(new, r"([\\$])", r"\\$1"))
    idle = (F.coalesce(old, F.lit("")) == "") | (F.coalesce(new, F.lit("")) == "") | (old == new)
    return F.when(idle, text).when(old.rlike("^[0-9]+$"), bare).otherwise(F.replace(text, old, new))


def without_references(x: Column, shown: str = "burimi përkatës") -> Column:
    """Names of evidence in a text by a plain word."""
    return F.regexp_replace(x, r"\b(?:claim|chunk|law|dossier):[a-zA-Z0-9_.:-]+", shown)


def canonical_hash(**values: Column) -> Column:
    """SHA-256 of the JSON object of ``values`` with sorted keys and nothing between; a missing value is written as null."""
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(F.substring(F.to_json(F.array(v.cast("string"))), F.lit(2), F.length(F.to_json(F.array(v.cast("string")))) - 2), F.lit("null"))) for k, v in sorted(values.items())]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).cast("binary"), 256)


def limit_of(provider: Column, model: Column, exact: dict[tuple[str, str], int], by_provider: dict[str, int], default: int) -> Column:
    """The limit of a provider's model, else the provider's, else ``default``."""
    p = F.lower(F.trim(F.coalesce(provider, F.lit(""))))
    key = F.concat(p, F.lit("\x00"), F.trim(F.coalesce(model, F.lit(""))))
    table = lambda d, k: F.create_map(*[F.lit(v) for kv in d.items() for v in kv])[k]
    return F.coalesce(table({f"{a}\x00{b}": n for (a, b), n in exact.items()}, key), table(by_provider, p), F.lit(default))


def braces(x: Column) -> Column:
    """The first balanced braces of a text, strings left alone; null if none closes."""
    held = F.substring(x, F.instr(x, "{"), F.length(x))
    begin = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(a: Column, c: Column) -> Column:
        plain = ~a["escaped"]
        quoted = F.when(plain & (c == '"'), ~a["quoted"]).otherwise(a["quoted"])
        depth = a["depth"] + F.when(plain & ~a["quoted"] & (c == "{"), 1).when(plain & ~a["quoted"] & (c == "}"), -1).otherwise(0)
        ends = plain & ~a["quoted"] & (c == "}") & (depth == 0) & (a["end"] == 0)
        return F.struct(depth.alias("depth"), quoted.alias("quoted"), (plain & a["quoted"] & (c == "\\")).alias("escaped"), (a["n"] + 1).alias("n"), F.when(ends, a["n"] + 1).otherwise(a["end"]).alias("end"))

    end = F.aggregate(F.split(held, ""), begin, step, lambda a: a["end"])
    return F.when((F.instr(x, "{") > 0) & (end > 0), F.substring(held, F.lit(1), end))


def json_object(x: Column) -> Column:
    """The text of the JSON object that a reply is, holds in a fence, or holds somewhere; null if that is no object.

    The whole reply is parsed first, its fence taken off; only where that is no JSON are its first balanced braces looked for.
    """
    s = F.trim(x)
    bare = F.when(s.startswith("```"), F.trim(F.regexp_replace(F.regexp_replace(s, r"^```[^\n]*\n?", ""), r"\n?```\s*$", ""))).otherwise(s)
    is_object = lambda v: F.schema_of_variant(F.try_parse_json(v)).startswith("OBJECT")
    part = F.when(F.try_parse_json(bare).isNull(), braces(bare)).otherwise(bare)
    return t.let(part, lambda p: F.when(is_object(p), p))


def json_value(x: Column) -> Column:
    """The reply's JSON object as a VARIANT, which ``variant_get`` reads by path."""
    return F.try_parse_json(json_object(x))


def merged(a: Column, b: Column) -> Column:
    """Two maps as one; where both have a key the second counts. A null map is empty."""
    none = F.create_map().cast("map<string,string>")
    x, y = F.coalesce(a, none), F.coalesce(b, none)
    return F.map_concat(F.map_filter(x, lambda k, _: ~F.map_contains_key(y, k)), y)
