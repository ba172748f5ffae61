"""Facts from text: keyword lines, labelled values, permits, amounts, metrics, property and dates; then who may state what.

Each takes rows with a text and gives a row for each fact found, in order. Null
and empty texts give none; rows that share an id are read each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions import fields, labels
from foliate.functions import text as t
from foliate.operators.windows import first_of, top_of

# Keywords and confidence of each category of K3.
KEYWORDS = {
    "object_name": (["objekti", "emertimi i objektit", "emertesa e objektit"], 0.76),
    "location": (["vendndodh", "adresa", "bashkia", "zona kadastrale", "zk "], 0.72),
    "investor": (["investitor", "zhvillues", "porosites", "porositës"], 0.72),
    "contractor": (["sipermarres", "sipërmarrës", "kontraktor", "subjekti ndertues"], 0.72),
    "supervisor": (["mbikeqyres", "mbikëqyrës", "mbikqyres", "supervizor"], 0.72),
    "kolaudator": (["kolaudator", "kolaudues", "kolaudimi kryhet"], 0.74),
    "designer": (["projektues", "hartues i projektit", "studio projektuese"], 0.7),
    "permit": (["leje ndertimi", "leje ndërtimi", "leje zhvillimi", "vendim nr"], 0.8),
    "timeline": (["fillim", "perfundim", "përfundim", "afati", "date", "datë"], 0.62),
    "technical_metrics": (["siperfaq", "sipërfaq", "kate", "lartesi", "lartësi", "distanc"], 0.68),
    "economic_values": (["vlera", "preventiv", "situacion", "lek", "kontrates", "kontratës"], 0.66),
}
FORMAL = ["leje", "vendim", "fillim", "perfundim", "afati"]
ANY_DATE, ANY_NUMBER = r"\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b", r"(?iu)\b(?:nr\.?|num[eë]r)\s*[:.\-]?\s*[A-Za-z0-9/_-]+"
#: A word's edge where only ASCII letters, digits and _ are of words, as in SQL: there a number may begin after an accented letter.
ASCII_EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
# Labels of K4, what stands after them, and the confidence.
LABELS = {
    "object_name": (r"(?i)(?:em[eë]rtimi\s+i\s+objektit|emri\s+i\s+objektit|p[eë]r\s+objektin|objektin?|objekti)\s*[:\-]\s*(.+)", 0.94),
    "location": (r"(?i)(?:vend(?:n)?dodhja\s+e\s+objektit|adresa)\s*[:\-]\s*(.+)", 0.92),
    "investor": (r"(?i)(?:investitor(?:i)?|zhvillues(?:i)?|porosit[eë]s(?:i)?)\s*[:\-]\s*(.+)", 0.93),
    "contractor": (r"(?i)(?:zbatuesi|sip[eë]rmarr[eë]si|subjekti\s+nd[eë]rtues)\s*[:\-]\s*(.+)", 0.93),
    "supervisor": (r"(?i)(?:mbik[eë]qyr[eë]si(?:\s+i\s+punimeve)?|supervizori)\s*[:\-]\s*(.+)", 0.93),
    "kolaudator": (r"(?i)kolaudatori(?:\s+i\s+punimeve)?\s*[:\-]\s*(.+)", 0.95),
    "designer": (r"(?i)(?:projektuesi|studio\s+projektuese)\s*[:\-]\s*(.+)", 0.88),
}
#: Words one of which each label's pattern needs, in a normalised line: what lacks them is not searched.
LABEL_WORDS = {
    "object_name": ["objekt"], "location": ["dodhja", "adresa"], "investor": ["investitor", "zhvillues", "porosit"], "contractor": ["zbatuesi", "rmarr", "subjekti"],
    "supervisor": ["mbik", "supervizori"], "kolaudator": ["kolaudatori"], "designer": ["projektuesi", "studio"],
}
# Metrics of K6 and their units.
METRICS = {
    "site_area": (r"(?i)sip[eë]rfaq(?:ja|e)\s+(?:e\s+)?(?:truallit|tok[eë]s)\s+q[eë]\s+zhvillohet[^\d]{0,50}(\d+(?:[.,]\d+)?)\s*m(?:2|²)", "m²"),
    "footprint_area": (r"(?i)sip[eë]rfaq(?:ja|e)[^\n]{0,50}(?:z[eë]n[eë]|zene)\s+nga\s+struktura[^\d]{0,30}(\d+(?:[.,]\d+)?)\s*m(?:2|²)", "m²"),
    "total_construction_area": (r"(?i)sip[eë]rfaq(?:ja|e)\s+e\s+p[eë]rgjithshme\s+e\s+nd[eë]rtimit[^\d]{0,40}(\d+(?:[.,]\d+)?)", "m²"),
    "maximum_height": (r"(?i)lart[eë]sia\s+maksimale[^\d]{0,50}(\d+(?:[.,]\d+)?)\s*m\b", "m"),
    "floors_above_ground": (r"(?i)numri\s+i\s+kateve\s+mbi\s+nivelin\s+e\s+tok[eë]s[^\d]{0,20}(\d+)", "kate"),
    "floors_below_ground": (r"(?i)numri\s+i\s+kateve\s+n[eë]n\s+nivelin\s+e\s+tok[eë]s[^\d]{0,20}(\d+)", "kate"),
    "soil_bearing_capacity": (r"(?i)ngarkesa\s+e\s+lejuar[^\d]{0,40}(\d+(?:[.,]\d+)?)\s*kg/cm2", "kg/cm²"),
    "seismic_intensity": (r"(?i)sizmicitet[^\d]{0,30}(\d+(?:[.,]\d+)?)\s*ball", "ballë"),
}
#: The word that each metric's pattern needs, in lower case.
METRIC_WORDS = {
    "site_area": "zhvillohet", "footprint_area": "struktura", "total_construction_area": "rgjithshme", "maximum_height": "maksimale", "floors_above_ground": "nivelin", "floors_below_ground": "nivelin",
    "soil_bearing_capacity": "ngarkesa", "seismic_intensity": "sizmicitet",
}
# Property numbers of K6, how they are written and, at the end, the word that the pattern needs.
PROPERTY = [
    ("property_number", r"(?i)pasuria\s+(?:me\s+)?nr\.?\s*[:.]?\s*([A-Za-z0-9/-]+)", "Pasuria nr. ", "pasuria"),
    ("property_number", r"(?i)nr\.?\s*pasuris[eë]\s*:\s*([A-Za-z0-9/-]+)", "Pasuria nr. ", "pasuris"),
    ("cadastral_zone", r"(?i)zon(?:a|en)\s+kadastrale\s+(?:me\s+)?nr\.?\s*[:.]?\s*(\d+)", "Zona kadastrale nr. ", "kadastrale"),
    ("cadastral_zone", r"(?i)nr\.?\s*z\.?\s*k\.?\s*:\s*(\d+)", "Zona kadastrale nr. ", "nr"),
]
PLACES = [rf"(?i)\b({first}\s+[^,.;\n]{{2,60}},\s*Bashkia\s+[^,.;\n]{{2,60}})" for first in ("Fshati", "Lagj(?:ja|ia)")]
PLACE_WORDS = ["fshati", "lagj"]
MONEY = r"(?i)\b(\d{1,3}(?:[.,\s]\d{3})+|\d{4,})\s*(?:lek(?:e|ë)?|all)\b"
DECISION = r"(?i)vendim\s*(?:nr\.?\s*)?[:.]?\s*([0-9]+(?:[/.-][A-Za-z0-9]+)*)"
PERMIT = r"(?i)leje(?:s|n|\s+e)?\s+(?:s[eë]\s+)?(?:nd[eë]rtimi(?:t)?|zhvillimi(?:t)?)\s*(?:nr\.?\s*)?[:.]?\s*([0-9]+(?:[/.-][A-Za-z0-9]+)*)"
PROTOCOL = r"(?i)(?:nr\.?\s*)?([A-Za-z0-9]+(?:/[A-Za-z0-9]+)+)\s*prot\.?"
NIPT = r"(?i)\bNIPT\s*[:.]?\s*([A-Z]\d{8}[A-Z])\b"
# Roles of K5, the words that name them and how their licences begin.
ROLES = {"contractor": (["zbatues", "sipermarres", "subjekti ndertues"], ["NZ"]), "supervisor": (["mbikeqyres", "mbikqyres", "supervizor"], ["MK"]), "kolaudator": (["kolaudator"], ["MK"]), "designer": (["projektues", "arkitekt", "konstruktor"], ["A", "N"])}


def fact(field: str | Column, value: Column, evidence: Column, confidence: float, when: Column | None = None) -> Column:
    """A fact, or null where ``when`` is false or there is no value."""
    f = F.lit(field) if isinstance(field, str) else field

    def of(v: Column) -> Column:
        out = F.struct(f.alias("field"), v.alias("value"), F.left(t.squeeze(evidence), F.lit(300)).alias("evidence"), F.lit(confidence).alias("extraction"))
        there = v.isNotNull() & (v != "")
        return F.when(there if when is None else there & F.coalesce(when, F.lit(False)), out)

    return t.let(value, of)


FACTS = "array<struct<field:string,value:string,evidence:string,extraction:double>>"


def only(when: Column, facts: Column) -> Column:
    """The facts of lines that may state some; the rest isn't searched."""
    return F.when(F.coalesce(when, F.lit(False)), facts).otherwise(F.array().cast(FACTS))


def group(x: Column, pattern: str, n: int = 1) -> Column:
    """What a pattern's group matches first; null where it does not."""
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, n))


def found(rows: DataFrame, facts: Column) -> DataFrame:
    """A row for each fact of an array: the rows' columns, its place ``n``, field, value, evidence, extraction."""
    kept = F.filter(facts, lambda f: f.isNotNull())
    return rows.select("*", F.posexplode(kept).alias("n", "fact")).select("*", "fact.*").drop("fact")


def numbered(step: int, facts: Column) -> Column:
    """An array's facts with their step and their place among those that are there."""
    return F.transform(F.filter(facts, lambda f: f.isNotNull()), lambda f, i: F.struct(F.lit(step).alias("step"), i.alias("n"), *[f[c].alias(c) for c in ("field", "value", "evidence", "extraction")]))


def text_lines(docs: DataFrame, text_col: str, least: int, most: int, clip: int | None = None) -> DataFrame:
    """A row for each line of ``least`` characters or more, white space squeezed, with its place: the first ``most`` of a text, cut at ``clip``."""
    lines = F.filter(F.transform(F.split(text_col, r"\R"), t.squeeze), lambda x: F.length(x) >= least)
    cut = F.transform(F.slice(lines, 1, most), lambda x: F.left(x, F.lit(clip)) if clip else x)
    return docs.select("*", F.posexplode(cut).alias("line_no", "line"))


def after_separator(line: Column, size: int = 220) -> Column:
    """What stands after the first colon, else hyphen, else dash, if three characters or more do; else the line."""
    part = lambda c: F.when(line.contains(c) & (F.length(F.trim(F.substring(line, F.instr(line, c) + 1, F.length(line)))) >= 3), F.trim(F.substring(line, F.instr(line, c) + 1, F.length(line))))
    return F.left(F.coalesce(part(":"), part("-"), part("–"), line), F.lit(size))


def keyword_facts(lines: DataFrame, keywords: dict[str, tuple[list[str], float]] | None = None, formal: list[str] | None = None, edge: str = r"\b") -> DataFrame:
    """K3: a row (category, value, extraction, snippet) for each line (line) and category whose keywords it holds.

    A line with a date or a number and a formal word is a formal reference too. ``edge`` is the pattern of a word's edge at dates and
    numbers; by default accented letters are of words.
    """
    said = t.plain_value(F.col("line"))
    words = lambda ws: [F.translate(F.lit(w), "".join(t.FOLDED), "".join(t.FOLDED.values())) for w in ws]
    holds = lambda ws: reduce(lambda a, b: a | b, [said.contains(w) for w in words(ws)])
    one = lambda name, conf, when: F.when(when, F.struct(F.lit(name).alias("category"), F.lit(conf).alias("extraction")))
    each = [one(name, conf, holds(ws)) for name, (ws, conf) in (keywords or KEYWORDS).items()]
    line = F.col("line")
    each.append(one("formal_references", 0.68, holds(formal or FORMAL) & (line.rlike(ANY_DATE.replace(r"\b", edge)) | line.rlike(ANY_NUMBER.replace(r"\b", edge)))))
    hits = F.filter(F.array(*each), lambda x: x.isNotNull())
    out = lines.select("*", F.explode(hits).alias("hit"))
    return out.select("*", "hit.category", after_separator(line).alias("value"), "hit.extraction", F.left("line", F.lit(220)).alias("snippet")).drop("hit")


def capped_facts(facts: DataFrame, order: list[str], most: int = 8) -> DataFrame:
    """The first ``most`` facts of each category in ``order``, of those with equal values (S7) the first."""
    by = [F.col(c) for c in order]
    return top_of(first_of(facts, ["category", t.plain_value(F.col("value"))], by), ["category"], by, most, "rank")


def labelled_array(line: Column, said: Column) -> Column:
    value = lambda f, p: F.when(fields.any_of(said, LABEL_WORDS[f]), fields.clean_value(F.lit(f), group(line, p)))
    return only(line.contains(":") | line.contains("-"), F.array(*[fact(f, value(f, p), line, conf) for f, (p, conf) in LABELS.items()]))


def labelled_facts(lines: DataFrame) -> DataFrame:
    """K4: a fact for each label in a line (line), its value cleaned."""
    return found(lines, t.let(t.plain_value(F.col("line")), lambda s: labelled_array(F.col("line"), s)))


def all_that(text: Column, lower: Column, word: str, pattern: str) -> Column:
    """All that a pattern's first group matches, in texts that hold a word which the pattern needs."""
    return F.when(lower.contains(word), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).otherwise(F.array().cast("array<string>"))


def places_array(text: Column, lower: Column) -> Column:
    each = [F.transform(all_that(text, lower, w, p), lambda x: fact("location", fields.clean_value(F.lit("location"), x), x, 0.88)) for w, p in zip(PLACE_WORDS, PLACES, strict=True)]
    return only(lower.contains("bashkia"), F.concat(*each))


def places(docs: DataFrame, text_col: str) -> DataFrame:
    """K5: every village or quarter with its municipality in a text."""
    return found(docs, t.let(F.lower(text_col), lambda s: places_array(F.col(text_col), s)))


def role_array(said: Column, near: Column) -> Column:
    """Facts of a line's first role (K5) from the lines ``near`` it."""

    def of(role: Column, near: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(near, F.lit(labels.LICENCE), F.lit(1)), labels.licence_number)
        fits = lambda n: reduce(lambda a, kv: a | ((role == kv[0]) & reduce(lambda x, y: x | y, [n.startswith(b) for b in kv[1][1]])), ROLES.items(), F.lit(False))
        licence = fact(F.concat(role, F.lit("_license")), F.get(F.filter(numbers, fits), F.lit(0)), near, 0.94)
        nipt = fact("contractor_nipt", F.when(role == "contractor", F.upper(group(near, NIPT))), near, 0.96)
        return F.array(licence, nipt)

    role = reduce(lambda c, kv: c.when(fields.any_of(said, kv[1][0]), F.lit(kv[0])), ROLES.items(), F.when(F.lit(False), F.lit("")))
    return t.let(role, lambda r: only(r.isNotNull(), t.let(near, lambda v: of(r, v))))


def role_facts(lines: DataFrame, by: list[str]) -> DataFrame:
    """K5: licences, and the contractor's tax number, in a line (line, line_no) that names a role, the one before it and the two after; the first role counts."""
    near = F.concat_ws(" ", "_before", "line", "_after", "_second")
    return found(with_neighbours(lines, by), t.let(t.plain_value(F.col("line")), lambda s: role_array(s, near))).drop("_before", "_after", "_second")


def with_neighbours(lines: DataFrame, by: list[str]) -> DataFrame:
    """Lines (line, line_no) with the one before and the two after."""
    w = Window.partitionBy(*by).orderBy("line_no")
    return lines.withColumns({"_before": F.lag("line", 1).over(w), "_after": F.lead("line", 1).over(w), "_second": F.lead("line", 2).over(w)})


def permit_array(line: Column, said: Column) -> Column:
    named = fields.any_of(said, ["leje ndertimi", "leja e ndertimit", "leje zhvill", "leja e zhvill"])
    of = F.when(said.contains("zhvill"), "development_permit_").otherwise("construction_permit_")
    number, protocol = F.coalesce(F.when(said.contains("vendim"), group(line, DECISION)), group(line, PERMIT)), F.when(said.contains("prot"), group(line, PROTOCOL))
    name = lambda part: F.concat(of, F.lit(part))
    return only(named, F.array(
        fact(name("number"), F.concat(F.lit("Nr. "), number), line, 0.97),
        fact(name("protocol"), F.concat(F.lit("Nr. Prot. "), protocol), line, 0.97),
        fact(name("date"), F.try_element_at(t.days(line), F.lit(-1)), line, 0.95),
    ))


def permit_facts(lines: DataFrame) -> DataFrame:
    """K6: number, protocol and last date of a permit that a line (line) names."""
    return found(lines, permit_array(F.col("line"), t.plain_value(F.col("line"))))


def amount_array(line: Column, said: Column) -> Column:
    field = F.when(fields.any_of(said, ["preventiv", "kontrakt"]), "planned_value").when(fields.any_of(said, ["situacion", "perfundimtar"]), "final_value").when(said.contains("vlera e objektit"), "planned_value")
    value = F.concat(labels.money_text(group(line, MONEY)), F.lit(" lekë"))
    return only(said.contains("vler") & field.isNotNull(), F.array(fact(field, value, line, 0.9)))


def amount_facts(lines: DataFrame) -> DataFrame:
    """K6: planned and final values in a line (line) with an amount of money."""
    return found(lines, amount_array(F.col("line"), t.plain_value(F.col("line"))))


# Words of table lines that give an area, the first that a line holds counts.
TABLE_AREAS = [("site_area", ["siperfaqja e tokes qe zhvillohet"]), ("footprint_area", ["siperfaqja e objektit te ri", "zene nga struktura"]), ("total_construction_area", ["siperfaqja e pergjithshme e ndertimit"])]
BASEMENT = r"(?i)(\d+(?:[.,]\d+)?)\s*m(?:2|²)?\s*podrum"


def table_array(line: Column, said: Column) -> Column:
    field = reduce(lambda c, x: c.when(fields.any_of(said, x[1]), F.lit(x[0])), TABLE_AREAS, F.when(F.lit(False), F.lit("")))
    metres = lambda n: F.concat(F.replace(n, F.lit(","), F.lit(".")), F.lit(" m²"))
    area = fact(field, metres(group(line, r"\b(\d+(?:[.,]\d+)?)\b")), line, 0.93)
    return only(field.isNotNull(), F.array(area, fact("basement_area", metres(group(line, BASEMENT)), line, 0.92, field == "total_construction_area")))


def table_facts(lines: DataFrame) -> DataFrame:
    """K6: areas in lines (line) of tables, the line's first number, and the basement's beside the total."""
    return found(lines, table_array(F.col("line"), t.plain_value(F.col("line"))))


def metric_array(text: Column, lower: Column) -> Column:
    metric = lambda f, u: lambda x: fact(f, F.concat(F.replace(x, F.lit(","), F.lit(".")), F.lit(f" {u}")), x, 0.9)
    number = lambda f, s: lambda x: fact(f, F.concat(F.lit(s), x), x, 0.92)
    metrics = [F.transform(all_that(text, lower, METRIC_WORDS[f], p), metric(f, u)) for f, (p, u) in METRICS.items()]
    numbers = [F.transform(all_that(text, lower, w, p), number(f, s)) for f, p, s, w in PROPERTY]
    told = reduce(lambda a, w: a | lower.contains(w), sorted({*METRIC_WORDS.values(), *[x[3] for x in PROPERTY]}), F.lit(False))
    return only(told, F.concat(*metrics, *numbers))


def metric_facts(docs: DataFrame, text_col: str) -> DataFrame:
    """K6: areas, heights, floors and ground values in a text, and its property numbers."""
    return found(docs, t.let(F.lower(text_col), lambda s: metric_array(F.col(text_col), s)))


def timeline_array(line: Column, said: Column) -> Column:
    field = F.when(fields.any_of(said, ["fillim", "fillu"]) & said.contains("punim"), "start_date").when(said.contains("perfund") & said.contains("punim"), "completion_date")
    return only(field.isNotNull(), F.array(fact(field, F.get(t.days(line), F.lit(0)), line, 0.92)))


def timeline_facts(lines: DataFrame) -> DataFrame:
    """K6: start and completion of works in a line (line) with a date."""
    return found(lines, timeline_array(F.col("line"), t.plain_value(F.col("line"))))


def line_array(line: Column, said: Column) -> Column:
    return F.concat(labelled_array(line, said), permit_array(line, said), amount_array(line, said), table_array(line, said), timeline_array(line, said))


def line_facts(lines: DataFrame) -> DataFrame:
    """K4 and K6: all facts that a line (line) states by itself, in one pass: each line is normalised once, and its facts exploded once."""
    line = F.col("line")
    return found(lines, t.let(t.plain_value(line), lambda s: line_array(line, s)))


def stated(lines: DataFrame, by: list[str], whole: bool = False) -> DataFrame:
    """K4 to K6 over lines (line, line_no): the columns of ``lines``, step, n, field, value, evidence, extraction.

    Steps: 0 what ``line_facts`` finds, 2 ``role_facts``, and, where lines are ``whole`` texts, 3 ``metric_facts`` and 4 ``places``.
    All but the roles come from one pass before any shuffle, which only the lines beside a role need.
    """
    line = F.col("line")
    # Needed words have no white space or accents, so that they stand in the normalised line too.
    each = lambda s: F.concat(numbered(0, line_array(line, s)), *(told_arrays(line, s) if whole else []))
    own = lines.select("*", F.explode(t.let(t.plain_value(line), each)).alias("fact")).select(*lines.columns, "fact.*")
    roles = role_facts(lines, by).withColumn("step", F.lit(2))
    return own.unionByName(roles)


def told_arrays(text: Column, lower: Column) -> list[Column]:
    return [numbered(3, metric_array(text, lower)), numbered(4, places_array(text, lower))]


def told(docs: DataFrame, text_col: str) -> DataFrame:
    """K5 and K6 of whole texts in one pass, as ``stated`` gives them: step 3 what ``metric_facts`` finds, 4 ``places``."""
    facts = t.let(F.lower(text_col), lambda s: F.concat(*told_arrays(F.col(text_col), s)))
    return docs.select("*", F.explode(facts).alias("fact")).select("*", "fact.*").drop("fact")


# Roles of parties to a contract by words of its name or first page, and how lines name the party.
CONTRACT_ROLES = [("kolaudator", ["kolaudator"]), ("supervisor", ["mbikeqyres", "mbikqyres", "supervizor"]), ("contractor", ["sipermarres", "sipemarr", "zbatues"])]
CONTRACT_KINDS = ["contract_and_related_acts", "supervisor_contract", "unknown"]
PARTY_OF = {"contractor": "(?:sip[eë]rmarr[eë]s(?:i|in)?|zbatues(?:i|in)?)", "supervisor": "(?:mbik[eë]qyr[eë]s(?:i|in)?|supervizor(?:i|in)?)", "kolaudator": "(?:kolaudator(?:i|in)?)"}
PARTY = r"(?:\s+i\s+punimeve)?\s*(?:[:\-]|me\s+)?\s*((?:z\.?|znj\.?|ing\.?|ark\.?)?\s*[A-ZÇË][^,;\n]{2,90}(?:sh\.?\s*p\.?\s*k\.?)?)"
NAMED_PARTY = r"(?iu)\bme\s+((?:z\.?|znj\.?)?\s*[A-ZÇË][A-Za-zÇËËçë.'\s-]{2,80})"
DEED, DAY = r".{0,80}?(?:dat[eë]|date)\s*[:.]?\s*", r"([0-3]?\d[./-][01]?\d[./-](?:19|20)?\d{2})"
REPERTORY_FIRST = r"(?i)(?:nr\.?\s*)?(?:rep\.?|repertori)\s*[:.]?\s*(\d{1,8}).{0,80}?(?:nr\.?\s*)?(?:kol\.?|koleksioni)\s*[:.]?\s*(\d{1,8})"
NUMBER_FIRST = r"(?i)(?:nr\.?\s*)?(\d{1,8})\s*(?:rep\.?|repertori).{0,80}?(?:nr\.?\s*)?(\d{1,8})\s*(?:kol\.?|koleksioni)"


def contract_role(filename: Column, kind: Column, text: Column) -> Column:
    """K5: whose contract a document is, by its name, its type, or the first page of one that speaks of a contract; else null."""
    by_words = lambda said: reduce(lambda c, x: c.when(fields.any_of(said, x[1]), F.lit(x[0])), CONTRACT_ROLES, F.when(F.lit(False), F.lit("")))
    blank, kind = F.lit(""), F.coalesce(kind, F.lit(""))
    page = t.plain_value(F.left(F.coalesce(text, blank), F.lit(2500)))
    paged = t.let(page, lambda p: F.when(p.contains("kontrat"), by_words(p)))
    return F.coalesce(t.let(t.plain_value(F.coalesce(filename, blank)), by_words), F.when(kind == "supervisor_contract", "supervisor").when(kind.isin(*CONTRACT_KINDS), paged))


def contract_reference(text: Column) -> Column:
    """K5: a deed's numbers of repertory and collection, and its day where one follows, in the first 5,000 characters."""
    short = F.left(t.squeeze(F.coalesce(text, F.lit(""))), F.lit(5000))

    def of(s: Column) -> Column:
        dated = lambda p: F.when(s.rlike(p + DEED + DAY), t.let(F.regexp_extract(s, p + DEED + DAY, 3), lambda d: F.concat(numbers(p + DEED + DAY), F.lit(", datë "), F.coalesce(F.get(t.days(d), F.lit(0)), d))))
        numbers = lambda p: F.concat(F.lit("Nr. Rep. "), F.regexp_extract(s, p, 1), F.lit(", Nr. Kol. "), F.regexp_extract(s, p, 2))
        return F.coalesce(dated(REPERTORY_FIRST), dated(NUMBER_FIRST), F.when(s.rlike(NUMBER_FIRST), numbers(NUMBER_FIRST)))

    return t.let(short, of)


def contract_facts(docs: DataFrame, by: list[str], filename: str, kind: str, text: str, first: int = 80) -> DataFrame:
    """K5: the party of a contract, from its file name or else from its ``first`` lines, and its reference: by, n, field, value, evidence, extraction."""
    x = docs.withColumn("role", contract_role(F.col(filename), F.col(kind), F.col(text))).where("role is not null")
    stem = F.regexp_replace(F.trim(F.regexp_replace(F.replace(F.coalesce(filename, F.lit("")), F.lit("_"), F.lit(" ")), r"\.[A-Za-z0-9]{2,5}$", "")), r"^\s*\d+(?:\.\d+)*\s*", "")
    lines = F.slice(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\R"), t.squeeze), lambda v: F.length(v) >= 3), 1, first)
    in_line = lambda p: F.get(F.filter(F.transform(F.filter(lines, lambda v: v.rlike(p)), lambda v: labels.party_name(F.regexp_extract(v, p, 1))), lambda v: v.isNotNull()), F.lit(0))
    lined = reduce(lambda c, r: c.when(F.col("role") == r, in_line(f"(?i){PARTY_OF[r]}{PARTY}")), PARTY_OF, F.when(F.lit(False), F.lit("")))
    party = F.coalesce(labels.party_name(group(stem, NAMED_PARTY)), lined)
    reference = contract_reference(F.col(text))
    facts = F.array(fact(F.col("role"), party, F.coalesce(filename, F.lit("")), 0.91), t.let(reference, lambda r: fact(F.concat("role", F.lit("_contract_reference")), r, r, 0.92)))
    return found(x.select(*by, "role", filename, text), facts).select(*by, "n", "field", "value", "evidence", "extraction")


def admitted(facts: DataFrame, by: list[str], order: list[str], kind: Column | None = None) -> DataFrame:
    """Facts (field, value, evidence) of 2 to 280 characters that are no placeholders and that the document's type may state.

    Of those of one document (``by``) and field with equal values (S6) the first in ``order`` stays.
    """
    rows = facts.withColumn("value", F.trim(t.squeeze(F.col("value")), F.lit(" ;,."))).where(F.length("value").between(2, 280) & ~F.col("value").rlike(fields.PLACEHOLDER))
    if kind is not None:
        rows = rows.where(fields.admissible(F.col("field"), None, F.col("value"), F.col("evidence"), kind))
    return first_of(rows, [*by, "field", fields.fact_value(F.col("field"), F.col("value"))], order)


def scoped_facts(facts: DataFrame, canonical: list[str], by: list[str], order: list[str], most: int = 60, most_supporting: int = 80) -> DataFrame:
    """Facts (field, value) that are not canonical, by scope, the first of equal ones in a document (``by``), up to the scope's limit."""
    rows = facts.where(~F.col("field").isin(*canonical)).withColumn("scope", fields.fact_scope(F.col("field")))
    rows = first_of(rows, ["scope", "field", fields.fact_value(F.col("field"), F.col("value")), *by], order)
    # The larger limit is one number, so that tasks cut each scope before the shuffle.
    ranked = top_of(rows, ["scope"], ["field", *order], max(most, most_supporting), "rank")
    return ranked.where(F.col("rank") <= F.when(F.col("scope") == "supporting_facts", most_supporting).otherwise(most))


# Phases of K15 by document type, and words of the lines that date them.
PHASES = {
    "site_handover_act": "site_handover", "start_works_notification": "works_start", "start_works_notification_letter": "works_start", "start_works_minutes": "works_start", "site_setup_control_act": "site_setup",
    "setting_out_act": "setting_out", "structure_setting_out_control_act": "setting_out", "foundation_completion_and_level_0_00_control_act": "foundations", "level_0_00_control_act": "level_0_00",
    "structural_frame_completion_control_act": "structural_frame", "facade_and_finishing_completion_control_act": "facade_finishes", "external_system_completion_control_act": "external_systems",
    "completion_minutes": "works_completion", "start_interruption_extension_completion_minutes": "contract_timeline",
}
PHASE_WORDS = {"works_start": ["fillim", "fillo", "nis"], "works_completion": ["perfund"], "foundations": ["theme", "0.00"], "structural_frame": ["karabina", "struktur"], "facade_finishes": ["fasad", "rifinitur"], "external_systems": ["sistem", "rrjet", "jasht"], "setting_out": ["piket"], "site_setup": ["kantier"]}
OBSERVED = ["punime mask", "prova laborator", "marka e betonit", "certifikat", "konform", "kuota 0.00", "themele", "karabina", "fasad", "rifinitur", "rrjet", "matje", "defekt"]


def chronology(docs: DataFrame, lines: DataFrame, by: str) -> DataFrame:
    """Documents (by, kind) of a phase with the phase's day and the line that gives it.

    Of the lines (by, line_no, line) with a day that name no permit, protocol or
    contract, the first with a word of the phase, else the first; null without any.
    """
    said = t.plain_value(F.col("line"))
    phased = docs.withColumn("phase", fields.lookup(PHASES, F.col("kind"))).where("phase is not null")
    dated = lines.select(by, "line_no", "line", F.get(t.days(F.col("line")), F.lit(0)).alias("day"), said.alias("_said")).where("day is not null").where(~fields.any_of(F.col("_said"), ["leje", "prot", "kontrate"]))
    told = reduce(lambda a, kv: a | ((F.col("phase") == kv[0]) & fields.any_of(F.col("_said"), kv[1])), PHASE_WORDS.items(), F.lit(False))
    best = dated.join(phased.select(by, "phase"), by).groupBy(by).agg(F.min_by(F.struct("day", F.left("line", F.lit(260)).alias("evidence")), F.struct((~told).alias("later"), "line_no")).alias("_b"))
    return phased.join(best, by, "left").select(by, "kind", "phase", "_b.day", "_b.evidence")


def observations(lines: DataFrame, by: str, each: int = 5, size: int = 360, words: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Of each document the first ``each`` lines (by, line_no, line) that speak of works and their quality; ``most`` in all, by document and line."""
    x = lines.where(fields.any_of(t.plain_value(F.col("line")), words or OBSERVED)).withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy("line_no")))
    x = x.where(F.col("n") <= each).select(by, "line_no", F.left("line", F.lit(size)).alias("statement"), "n")
    return x if most is None else x.orderBy(by, "line_no").limit(most)
