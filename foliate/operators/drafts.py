"""Drafts of a report: their checks against the dossier, corrections as an edit script, restored sections, and the gate.

A draft is one row: draft_id, title, summary, signature, sections (array of code, title, body) and ledger (array of claim_id,
section_code, statement, claim_type, level, evidence_ids, confidence). That is one report, a dozen sections; its script of edits is
folded over it in order, as each edit sees what the ones before have left. Null texts and arrays are empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions import fields
from foliate.functions import text as t
from foliate.operators import evidence
from foliate.operators.verification import LIMITS, raised

SECTION = "struct<code:string,title:string,body:string>"
CLAIM = "struct<claim_id:string,section_code:string,statement:string,claim_type:string,level:string,evidence_ids:array<string>,confidence:double>"
#: What an issue tells beside draft_id, code and severity; those that a check doesn't know are null.
ISSUE = {
    "place": "int", "n": "bigint", "claim_id": "string", "field": "string", "register": "string", "old": "string", "new": "string", "required": "string", "section_code": "string", "section_title": "string",
    "statement": "string", "required_values": "array<string>", "evidence_ids": "array<string>", "sources": "array<string>", "other_sources": "array<string>",
}
# Facts that a report names and those in its table, and fields whose other values block it.
CORE = ["object_name", "location", "investor", "owner", "contractor", "supervisor", "kolaudator"]
TABLE = [*CORE, "supervisor_license", "kolaudator_license"]
BLOCKING = ["location", "investor", "owner", "contractor", "supervisor", "kolaudator", *fields.PERMIT_FIELDS, "property_number", "cadastral_zone"]
# Where a missing detail goes, by what its field holds or its register, and how it is named.
PLACES = [
    ("permit", "permits_property_licenses", "legal_and_administrative", "Baza ligjore dhe administrative"), ("contract", "contracts_and_economics", "parties_and_contracts", "Palët dhe marrëdhëniet kontraktore"),
    ("date", "construction_chronology", "execution_and_chronology", "Kronologjia e punimeve"), (None, "materials_and_tests", "quality_and_hidden_works", "Materialet, provat dhe cilësia"),
]
ELSEWHERE = ("design_and_parameters", "Të dhënat teknike të objektit")
NAMED = {
    "construction_permit_number": "Leja e ndërtimit", "construction_permit_protocol": "Protokolli i lejes së ndërtimit", "construction_permit_date": "Data e lejes së ndërtimit",
    "development_permit_number": "Leja e zhvillimit", "development_permit_protocol": "Protokolli i lejes së zhvillimit", "development_permit_date": "Data e lejes së zhvillimit",
    "contractor_contract_reference": "Referenca e kontratës së sipërmarrjes", "supervisor_contract_reference": "Referenca e kontratës së mbikëqyrjes", "kolaudator_contract_reference": "Referenca e kontratës së kolaudimit",
}
MATERIAL, MATERIAL_TITLE, MATERIAL_WORDS = "quality_and_hidden_works", "Materialet, armatura dhe kontrolli i cilësisë", ["material", "quality", "cilësi", "armatur", "prova"]
LANGUAGE = "CLAIM-CONCLUSION-LEVEL-LANGUAGE"
DOUBTED, RESERVED = "Nga dokumentacioni i administruar nuk provohet plotësisht se ", "Me rezervë dhe sipas dokumentacionit të administruar, "
#: Sections of a whole report, and issues that decide on it.
LEAST, MOST, DECIDING = 10, 12, 8


def strip(x: Column) -> Column:
    """Without white space at both ends; null is empty."""
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)^\s+|\s+$", "")


def texts(x: Column) -> Column:
    """The array of a column of texts, empty for null."""
    return F.coalesce(x, F.array().cast("array<string>"))


def public_text(draft: Column | None = None) -> Column:
    """All that a draft shows: title, summary, signature, and each section's title and body."""
    each = F.flatten(F.transform("sections", lambda s: F.array(F.coalesce(s["title"], F.lit("")), F.coalesce(s["body"], F.lit("")))))
    head = F.array(*[F.coalesce(F.col(c), F.lit("")) for c in ("title", "summary", "signature")])
    return F.array_join(F.concat(head, F.coalesce(each, F.array().cast("array<string>"))), "\n")


# --- checks


def present(values: DataFrame, shown: DataFrame, key: list[str]) -> DataFrame:
    """S39 for many values: those (draft_id, key, value) that their draft's text (draft_id, text) holds, as (draft_id, key).

    A value holds if ``least`` of its telling words (three, or as many as it has) are inside words of the text, or two different
    numbers or more and all are numbers of it; one without telling words if the text holds it as a whole. Each text travels once, to
    its draft's values; a telling word has no space, so it is inside a word if it is in the text.
    """
    said = shown.select("draft_id", t.alnum_text(F.coalesce("text", F.lit(""))).alias("said"))
    x = values.select("draft_id", F.struct(*key).alias("asked"), t.alnum_text(F.coalesce("value", F.lit(""))).alias("v")).where("v <> ''")
    x = x.withColumns({"numbers": t.number_set(F.col("v")), "words": t.telling(F.col("v"))})
    told = F.size(F.filter("words", lambda w: F.col("said").contains(w)))
    by_words = (F.size("words") > 0) & (told >= F.least(F.lit(3), F.size("words")))
    by_numbers = (F.size("numbers") >= 2) & (F.size(F.array_except("numbers", F.regexp_extract_all("said", F.lit("[0-9]+"), F.lit(0)))) == 0)
    bare = (F.size("words") == 0) & F.col("said").contains(F.col("v"))
    return x.join(said, "draft_id").where(by_words | by_numbers | bare).select("draft_id", "asked").distinct().select("draft_id", "asked.*")


def issue(rows: DataFrame, code: str, place: int, severity: str | Column = "major", **known: Column | str) -> DataFrame:
    """Issues of one code: what is known of them, the rest null. ``place`` orders codes, ``n`` the issues of one."""
    level = F.lit(severity) if isinstance(severity, str) else severity
    rest = {**{name: F.lit(None) for name in ISSUE}, "place": F.lit(place), "n": F.lit(0), **known}
    return rows.select("draft_id", F.lit(code).alias("code"), level.alias("severity"), *[(F.col(v) if isinstance(v, str) else v).cast(ISSUE[name]).alias(name) for name, v in rest.items()])


def fact_issues(drafts: DataFrame, facts: DataFrame) -> DataFrame:
    """Core facts (draft_id, field, value) that a draft doesn't name."""
    core = facts.where(F.col("field").isin(*CORE) & (strip(F.col("value")) != ""))
    shown = drafts.select("draft_id", public_text().alias("text"))
    missing = core.join(drafts.select("draft_id"), "draft_id", "left_semi").join(present(core, shown, ["field"]), ["draft_id", "field"], "left_anti")
    return issue(missing, "PUBLIC-CANONICAL-FACT-OMITTED", 3, "minor", field="field")


def table_issues(drafts: DataFrame, facts: DataFrame, current: DataFrame, versions: DataFrame) -> DataFrame:
    """Facts of the report's table whose evidence (evidence_id, is_current) isn't current or is none; nothing where a project has no ``versions`` (draft_id)."""
    x = facts.where(F.col("field").isin(*TABLE) & (strip(F.col("value")) != "")).join(drafts.select("draft_id"), "draft_id", "left_semi").join(versions.select("draft_id").distinct(), "draft_id", "left_semi")
    x = x.withColumn("evidence_id", F.concat(F.lit("canonical:"), "field")).join(current.where("is_current").select("draft_id", "evidence_id").distinct(), ["draft_id", "evidence_id"], "left_anti")
    return issue(x, "PUBLIC-TABLE-FACT-NOT-CURRENT", 2, field="field", evidence_ids=F.array("evidence_id"))


def conflict_issues(drafts: DataFrame, conflicts: DataFrame, facts: DataFrame) -> DataFrame:
    """Conflicts of which a draft names another value and not the selected one.

    ``conflicts``: draft_id, n, field, selected, alternatives (array of values, best first), sources, other_sources. The first such
    alternative counts. It matters (major) for fields that block a report.
    """
    shown = drafts.select("draft_id", public_text().alias("text"))
    key = ["n", "at"]
    each = conflicts.select("draft_id", "n", "field", "selected", "sources", "other_sources", F.posexplode("alternatives").alias("at", "value")).where(F.coalesce("value", F.lit("")) != "")
    each = each.where(~F.coalesce(t.same_numbers_or_tokens(F.col("selected"), F.col("value")), F.lit(False)))
    used = each.join(present(each, shown, key), ["draft_id", *key], "left_semi")
    chosen = conflicts.select("draft_id", "n", F.col("selected").alias("value"))
    used = used.join(present(chosen, shown, ["n"]), ["draft_id", "n"], "left_anti")
    first = used.groupBy("draft_id", "n").agg(F.min_by(F.struct("field", "selected", "value", "sources", "other_sources"), "at").alias("c")).select("draft_id", "n", "c.*")
    known = facts.select("draft_id", "field", F.lit(True).alias("known")).distinct()
    x = first.join(known, ["draft_id", "field"], "left")
    ids = F.when(F.col("known"), F.array(F.concat(F.lit("canonical:"), "field"))).otherwise(F.array().cast("array<string>"))
    severity = F.when(F.col("field").isin(*BLOCKING), "major").otherwise("minor")
    return issue(x, "PUBLIC-CONFLICT-ALTERNATIVE-USED", 4, severity, n="n", field="field", old="value", new="selected", evidence_ids=ids, sources="sources", other_sources="other_sources")


def detail_issues(drafts: DataFrame, details: DataFrame, most: int = 18) -> DataFrame:
    """Details that must be given (draft_id, n, field, register, value, evidence_id, must_include, sources), the first ``most``, and aren't."""
    x = details.where(F.col("must_include") & (F.col("n") < most) & (F.coalesce("value", F.lit("")) != ""))
    x = x.join(drafts.select("draft_id"), "draft_id", "left_semi").join(present(x, drafts.select("draft_id", public_text().alias("text")), ["n"]), ["draft_id", "n"], "left_anti")
    return issue(x, "PUBLIC-DETAIL-MISSING", 5, n="n", field="field", register="register", required="value", evidence_ids=F.array("evidence_id"), sources="sources")


def material_issues(drafts: DataFrame, material: DataFrame) -> DataFrame:
    """Drafts without all amounts of their material (draft_id, quantities, statement, evidence_ids), and claims of theirs that say nothing of it: phrases, or numbers alone."""
    x = material.join(drafts, "draft_id", "left_semi").withColumn("quantities", F.filter(F.transform(texts(F.col("quantities")), strip), lambda v: v != ""))
    each = x.select("draft_id", F.posexplode("quantities").alias("at", "value"))
    lacks = each.join(present(each, drafts.select("draft_id", public_text().alias("text")), ["at"]), ["draft_id", "at"], "left_anti").select("draft_id").distinct()
    missing = issue(x.join(lacks, "draft_id"), "PUBLIC-SECTION-EVIDENCE-MISSING", 6, section_code=F.lit(MATERIAL), section_title=F.lit(MATERIAL_TITLE), statement="statement", required_values="quantities", evidence_ids="evidence_ids")
    claims = drafts.join(x.select("draft_id", F.col("statement").alias("told"), F.col("evidence_ids").alias("ids")), "draft_id").select("draft_id", "told", "ids", F.posexplode("ledger").alias("n", "claim"))
    claims = claims.withColumn("said", strip(F.col("claim.statement"))).where("said <> ''")
    empty = issue(claims.where(evidence.boilerplate(F.col("said"))), "PUBLIC-MATERIAL-GENERIC", 7, n=F.col("n"), claim_id=F.col("claim.claim_id"), section_code=F.col("claim.section_code"), statement="said", evidence_ids="ids")
    bare = issue(claims.where(evidence.numbers_alone(F.col("said"))), "PUBLIC-CONTEXTLESS-NUMERIC-LIST", 7, n=F.col("n"), claim_id=F.col("claim.claim_id"), section_code=F.col("claim.section_code"), statement="said")
    return missing.unionByName(empty).unionByName(bare)


def ledger_missing(drafts: DataFrame) -> DataFrame:
    """Drafts without claims."""
    return issue(drafts.where(F.coalesce(F.size("ledger"), F.lit(0)) <= 0), "PUBLIC-CLAIM-LEDGER-MISSING", 1)


def language_issues(drafts: DataFrame) -> DataFrame:
    """Claims of a qualified or unproven level that don't say so (only those with evidence are checked)."""
    claims = drafts.select("draft_id", F.posexplode("ledger").alias("n", "claim")).select("draft_id", "n", "claim.*")
    said = t.alnum_text(F.coalesce("statement", F.lit("")))
    bounded = (F.coalesce("claim_type", F.lit("")) == "qualification") | said.rlike(LIMITS)
    lacks = (F.size(texts(F.col("evidence_ids"))) > 0) & F.col("level").isin("qualified", "not_proven") & ~bounded
    found = raised(claims.withColumn("key", F.struct("draft_id", "n", "claim_id")), {LANGUAGE: lacks}, "key")
    return issue(found.select("key.*"), LANGUAGE, 1, n="n", claim_id="claim_id")


# --- edits


def replaced(x: Column, old: Column, new: Column) -> Column:
    return F.when((old == "") | (new == "") | (old == new), x).otherwise(F.replace(x, old, new))


PERMIT_WORDS = r"(?iU)\b((?:leje|lejes?)\s+(?:s[eë]\s+)?nd[eë]rtimit\s+)(?:nr\.?\s*)?\Q"
PERMIT_REST = r"\E(?:\s*,\s*(?:protokoll|prot\.?)\s*(?:nr\.?\s*)?[\w./-]+)?(?:\s*,\s*dat[eë]?\s*[\d./-]+)?"


def enforced_value(x: Column, field: Column, old: Column, new: Column) -> Column:
    """A value by the selected one; of a permit's fields the whole reference to the permit, where there is one."""
    pattern = F.concat(F.lit(PERMIT_WORDS), F.replace(old, F.lit("\\E"), F.lit("")), F.lit(PERMIT_REST))
    whole = F.regexp_replace(x, pattern, F.concat(F.lit("$1"), F.regexp_replace(new, r"([\\$])", r"\\$1")))
    usable = (old != "") & (new != "") & (old != new)
    return F.when(usable & field.isin(*fields.PERMIT_FIELDS) & F.rlike(x, pattern), whole).otherwise(replaced(x, old, new))


def packed(x: Column) -> Column:
    """Letters a to z and digits alone."""
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", "")


def without_paragraph(body: Column, statement: Column) -> Column:
    """A body without the paragraphs that are the statement, else without the statement inside them."""

    def of(parts: Column) -> Column:
        kept = F.filter(parts, lambda p: p != statement)
        inside = strip(F.regexp_replace(F.replace(body, statement, F.lit("")), r"\n{3,}", "\n\n"))
        return F.when(F.size(kept) < F.size(parts), F.array_join(F.filter(kept, lambda p: p != ""), "\n\n")).otherwise(inside)

    return t.let(F.transform(F.split(body, "\n\n"), strip), of)


def scripted(drafts: DataFrame, edits: DataFrame, *known: str) -> DataFrame:
    """Drafts with their edits (draft_id, place, n and the known columns) as the array ``script`` in order; empty where there are none. Null texts and arrays of drafts are made empty."""
    one = F.struct(F.col("place").cast("int").alias("place"), F.col("n").cast("long").alias("n"), *[texts(F.col(c)).alias(c) if c in ("values", "ids") else strip(F.col(c)).alias(c) for c in known])
    held = edits.groupBy("draft_id").agg(F.array_sort(F.collect_list(one)).alias("script"))
    kind = held.schema["script"].dataType.simpleString()
    x = drafts.join(held, "draft_id", "left").withColumn("script", F.coalesce("script", F.array().cast(kind)))
    empty = lambda c, of: F.coalesce(F.col(c), F.array()).cast(f"array<{of}>")
    return x.withColumns({"summary": F.coalesce("summary", F.lit("")), "signature": F.coalesce("signature", F.lit("")), "sections": empty("sections", SECTION), "ledger": empty("ledger", CLAIM)})


def swapped(drafts: DataFrame, edits: DataFrame, value) -> DataFrame:
    """Drafts whose texts and claims have values (old) replaced by others (new), edit by edit; a claim that changes cites the edit's ids.

    ``value`` gives a text after an edit. The texts of a draft don't depend on each other here, so each has its own fold.
    """
    x = scripted(drafts, edits, "field", "old", "new", "ids")
    folded = lambda v: F.aggregate("script", F.coalesce(v, F.lit("")), value)
    section = lambda s: F.struct(s["code"].alias("code"), folded(s["title"]).alias("title"), folded(s["body"]).alias("body"))

    def cited(a: Column, e: Column) -> Column:
        return t.let(value(a["said"], e), lambda n: F.struct(n.alias("said"), F.when(n == a["said"], a["ids"]).otherwise(F.array_distinct(F.concat(a["ids"], e["ids"]))).alias("ids")))

    def claim(c: Column) -> Column:
        begin = F.struct(F.coalesce(c["statement"], F.lit("")).alias("said"), texts(c["evidence_ids"]).alias("ids"))
        return t.let(F.aggregate("script", begin, cited), lambda a: F.struct(c["claim_id"], c["section_code"], a["said"], c["claim_type"], c["level"], a["ids"], c["confidence"]).cast(CLAIM))

    return x.withColumns({"summary": folded(F.col("summary")), "signature": folded(F.col("signature")), "sections": F.transform("sections", section), "ledger": F.transform("ledger", claim)}).select(*drafts.columns)


def added(drafts: DataFrame, edits: DataFrame, kind: str) -> DataFrame:
    """Drafts with statements that they lack, each at the end of its section (a new one, if there is none) and as a proven claim.

    Of kind ``detail``: a field's value (required), which goes to the section of that code. Of kind ``evidence``: a statement with
    several values, which goes to the first section that has the code or speaks of material. A value is lacking if the letters and
    digits of summary, signature and bodies don't hold it; each edit sees what the ones before have added.
    """
    x = scripted(drafts, edits, "field", "required", "section_code", "section_title", "statement", "values", "ids")
    head = F.concat("summary", F.lit(" "), "signature", F.lit(" "))
    begin = F.struct(F.col("sections"), F.col("ledger"), packed(F.concat(head, F.array_join(F.transform("sections", lambda s: F.coalesce(s["body"], F.lit(""))), " "))).alias("shown"))
    holds = lambda d, v: d["shown"].contains(packed(v))  # noqa: E731  nothing is in every draft
    blank = F.lit("")
    spoken = lambda s: F.lower(F.concat_ws(" ", F.coalesce(s["code"], blank), F.coalesce(s["title"], blank)))

    def lacks(d: Column, e: Column) -> Column:
        if kind == "detail":
            return (e["field"] != "") & (e["required"] != "") & ~holds(d, e["required"])
        return (e["statement"] != "") & ~((F.size(e["values"]) > 0) & F.forall(e["values"], lambda v: holds(d, v)))

    def fits(s: Column, e: Column) -> Column:
        own = F.coalesce(s["code"], blank) if kind == "detail" else F.lower(F.coalesce(s["code"], blank))
        return own == e["section_code"] if kind == "detail" else (own == e["section_code"]) | fields.any_of(spoken(s), MATERIAL_WORDS)

    def put(d: Column, e: Column, at: Column) -> Column:
        each = F.transform(d["sections"], lambda s, i: F.when(i + 1 == at, F.struct(s["code"].alias("code"), s["title"].alias("title"), strip(F.concat(strip(s["body"]), F.lit("\n\n"), e["statement"])).alias("body"))).otherwise(s))
        new = F.array(F.struct(e["section_code"], e["section_title"], e["statement"]).cast(SECTION))
        code = F.when((F.lit(kind) == "evidence") & (at > 0), F.coalesce(F.nullif(F.get(d["sections"], (at - 1).cast("int"))["code"], blank), e["section_code"])).otherwise(e["section_code"])
        name = F.concat(F.lit("deterministic_detail:"), e["field"], F.lit(":")) if kind == "detail" else F.lit("deterministic_section_evidence:")
        claim = F.struct(F.concat(name, F.size(d["ledger"]).cast("string")), code, e["statement"], F.lit("documented_fact"), F.lit("proven"), e["ids"], F.lit(1.0)).cast(CLAIM)
        return F.struct(F.when(at > 0, each).otherwise(F.concat(d["sections"], new)).alias("sections"), F.concat(d["ledger"], F.array(claim)).alias("ledger"), F.concat(d["shown"], packed(e["statement"])).alias("shown"))

    def step(d: Column, e: Column) -> Column:
        at = F.array_position(F.transform(d["sections"], lambda s: fits(s, e)), F.lit(True))
        return F.when(lacks(d, e), t.let(at, lambda n: put(d, e, n))).otherwise(d)

    x = x.withColumn("after", F.aggregate("script", begin, step))
    return x.select(*[F.col(f"after.{c}").alias(c) if c in ("sections", "ledger") else F.col(f"`{c}`") for c in drafts.columns])


def without_noise(drafts: DataFrame, what: DataFrame) -> DataFrame:
    """Drafts without the claims that say nothing, and without these statements in summary and bodies. ``what``: draft_id, generic, numeric (which kinds go)."""
    x = drafts.join(what, "draft_id", "left")
    on = lambda c: F.coalesce(c, F.lit(False))
    noisy = lambda s: (on("generic") & evidence.boilerplate(s)) | (on("numeric") & evidence.numbers_alone(s))
    any_kind = on("generic") | on("numeric")
    claims = F.transform(F.coalesce("ledger", F.array().cast(f"array<{CLAIM}>")), lambda c: F.struct(c.alias("claim"), t.let(strip(c["statement"]), lambda s: F.when(noisy(s), s)).alias("gone")))
    x = x.withColumn("claims", F.when(any_kind, claims))
    x = x.withColumn("gone", F.transform(F.filter("claims", lambda c: F.coalesce(c["gone"], F.lit("")) != ""), lambda c: c["gone"]))
    clean = lambda body: F.aggregate("gone", body, without_paragraph)
    section = lambda s: F.struct(s["code"].alias("code"), s["title"].alias("title"), clean(s["body"]).alias("body"))
    after = {"summary": clean(F.col("summary")), "sections": F.transform("sections", section), "ledger": F.transform(F.filter("claims", lambda c: c["gone"].isNull()), lambda c: c["claim"])}
    return x.select(*[F.when(any_kind, after[c]).otherwise(F.col(c)).alias(c) if c in after else F.col(f"`{c}`") for c in drafts.columns])


def enforced(drafts: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Drafts in which other values of blocking fields are replaced by the selected ones.

    ``conflicts`` as in ``conflict_issues``; each alternative that isn't equivalent counts, in order. Claims that change cite the fact.
    """
    x = conflicts.where(F.col("field").isin(*BLOCKING) & (strip(F.col("selected")) != "")).select("draft_id", "n", "field", "selected", F.posexplode("alternatives").alias("at", "value"))
    x = x.where((strip(F.col("value")) != "") & ~F.coalesce(t.same_numbers_or_tokens(F.col("selected"), F.col("value")), F.lit(False)))
    edits = x.select("draft_id", F.col("n").alias("place"), F.col("at").alias("n"), "field", F.col("value").alias("old"), F.col("selected").alias("new"), F.array(F.concat(F.lit("canonical:"), "field")).alias("ids"))
    return swapped(drafts, edits, lambda v, e: enforced_value(v, e["field"], e["old"], e["new"]))


def corrected(drafts: DataFrame, issues: DataFrame) -> DataFrame:
    """Drafts after what their major issues ask for: values replaced, then details added, then noise removed, then the section's evidence added.

    Once the issues are mended they are raised no more, and another run changes nothing.
    """
    x = issues.where("severity = 'major'")
    of = lambda *codes: x.where(F.col("code").isin(*[f"PUBLIC-{c}" for c in codes]))
    field, register = F.coalesce("field", F.lit("")), F.coalesce("register", F.lit(""))
    fits = lambda word, own: (register == own) | (field.contains(word) if word else F.lit(False))
    place = lambda i: reduce(lambda c, p: c.when(fits(p[0], p[1]), F.lit(p[i])), PLACES, F.when(F.lit(False), F.lit(""))).otherwise(F.lit(ELSEWHERE[i - 2]))
    plain = F.replace(field, F.lit("_"), F.lit(" "))
    label = F.coalesce(fields.lookup(NAMED, field), F.concat(F.upper(F.left(plain, F.lit(1))), F.lower(F.substring(plain, 2, 10_000))))
    ids, none = F.col("evidence_ids").alias("ids"), F.lit(None).cast("string")
    swaps = of("CONFLICT-ALTERNATIVE-USED").select("draft_id", "place", "n", "field", "old", "new", ids)
    details = of("DETAIL-MISSING").select("draft_id", "place", "n", "field", "required", place(2).alias("section_code"), place(3).alias("section_title"), F.concat(label, F.lit(": "), strip(F.col("required")), F.lit(".")).alias("statement"), F.lit(None).cast("array<string>").alias("values"), ids)
    noise = of("MATERIAL-GENERIC", "CONTEXTLESS-NUMERIC-LIST").groupBy("draft_id").agg(F.bool_or(F.col("code") == "PUBLIC-MATERIAL-GENERIC").alias("generic"), F.bool_or(F.col("code") != "PUBLIC-MATERIAL-GENERIC").alias("numeric"))
    proof = of("SECTION-EVIDENCE-MISSING").select("draft_id", "place", "n", none.alias("field"), none.alias("required"), F.coalesce("section_code", F.lit(MATERIAL)).alias("section_code"), F.coalesce("section_title", F.lit(MATERIAL_TITLE)).alias("section_title"), "statement", F.col("required_values").alias("values"), ids)
    out = swapped(drafts, swaps, lambda v, e: replaced(v, e["old"], e["new"]))
    return added(without_noise(added(out, details, "detail"), noise), proof, "evidence")


def restored(drafts: DataFrame, originals: DataFrame) -> DataFrame:
    """Drafts with the sections of their originals, in that order: the corrected one of the same code (of several the last), else the original.

    That holds where the original has LEAST to MOST sections; other drafts stay as they are. Claims must then stand in the public
    text; those of restored sections come from the original ledger, each statement once.
    """
    o = originals.select("draft_id", F.col("sections").alias("old_sections"), F.col("ledger").alias("old_ledger"))
    x = drafts.join(o, "draft_id", "left")
    empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(f"array<{kind}>"))
    x = x.withColumns({"old_sections": empty("old_sections", SECTION), "old_ledger": empty("old_ledger", CLAIM), "sections": empty("sections", SECTION), "ledger": empty("ledger", CLAIM)})
    own = lambda s: F.filter("sections", lambda n: (n["code"] == s["code"]) & (F.coalesce(n["code"], F.lit("")) != ""))
    final = F.transform("old_sections", lambda s: F.coalesce(F.try_element_at(own(s), F.lit(-1)), s))
    codes = F.transform(F.filter("old_sections", lambda s: F.size(own(s)) == 0), lambda s: F.coalesce(s["code"], F.lit("")))
    x = x.withColumns({"final": final, "codes": codes})
    parts = F.flatten(F.transform("final", lambda s: F.filter(F.transform(F.split(F.coalesce(s["body"], F.lit("")), "\n\n"), strip), lambda p: p != "")))
    x = x.withColumn("may", F.concat(parts, F.filter(F.array(strip(F.col("summary"))), lambda p: p != "")))
    stands = lambda c: F.array_contains("may", strip(c["statement"]))
    back = lambda c: F.array_contains("codes", F.coalesce(c["section_code"], F.lit("")))
    kept = F.filter("ledger", lambda c: stands(c) & ~back(c))
    known = lambda claims, c: F.exists(claims, lambda k: strip(k["statement"]) == strip(c["statement"]))
    aligned = F.aggregate(F.filter("old_ledger", lambda c: back(c) & stands(c)), kept, lambda got, c: F.when(known(got, c), got).otherwise(F.concat(got, F.array(c))))
    whole = F.size("old_sections").between(LEAST, MOST)
    x = x.withColumns({"ledger": F.when(whole, aligned).otherwise(F.col("ledger")), "sections": F.when(whole, F.col("final")).otherwise(F.col("sections"))})
    return x.select(*[F.col(f"`{c}`") for c in drafts.columns])


def deciding(issues: DataFrame) -> DataFrame:
    """The first major issues of each draft, which decide on it."""
    order = Window.partitionBy("draft_id").orderBy("place", "n", "code")
    return issues.where("severity = 'major'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= DECIDING)


def repaired(drafts: DataFrame, issues: DataFrame) -> DataFrame:
    """Drafts whose deciding issues are of language alone, with limiting words before the claims named by them (all, if none is), in the ledger and the text."""
    x = deciding(issues).groupBy("draft_id").agg(F.bool_and(F.col("code") == LANGUAGE).alias("only"), F.array_distinct(F.collect_list(F.nullif(strip(F.col("claim_id")), F.lit("")))).alias("ids"))
    x = drafts.join(x.where("only").select("draft_id", "ids"), "draft_id", "left")
    begin = F.struct(F.coalesce("summary", F.lit("")), F.coalesce("sections", F.array().cast(f"array<{SECTION}>")), F.array().cast(f"array<{CLAIM}>")).cast(f"struct<summary:string,sections:array<{SECTION}>,ledger:array<{CLAIM}>>")

    def step(d: Column, c: Column) -> Column:
        said = strip(c["statement"])
        limited = F.translate(said, "ëËçÇ", "eEcC").rlike("(?iU)" + LIMITS)
        named = (F.size("ids") == 0) | F.array_contains("ids", strip(c["claim_id"]))
        lacks = named & c["level"].isin("qualified", "not_proven") & (said != "") & ~limited
        new = F.when(strip(c["level"]) == "not_proven", F.concat(F.lit(DOUBTED), F.lower(F.left(said, F.lit(1))), F.substring(said, 2, 1_000_000))).otherwise(F.concat(F.lit(RESERVED), said))
        put = lambda v: F.when(F.coalesce(lacks, F.lit(False)), F.replace(v, said, new)).otherwise(v)
        sections = F.transform(d["sections"], lambda s: F.struct(s["code"].alias("code"), s["title"].alias("title"), put(s["body"]).alias("body")))
        claim = F.struct(c["claim_id"], c["section_code"], F.when(F.coalesce(lacks, F.lit(False)), new).otherwise(c["statement"]), c["claim_type"], c["level"], c["evidence_ids"], c["confidence"]).cast(CLAIM)
        return F.struct(put(d["summary"]).alias("summary"), sections.alias("sections"), F.concat(d["ledger"], F.array(claim)).alias("ledger"))

    after = F.aggregate(F.coalesce("ledger", F.array().cast(f"array<{CLAIM}>")), begin, step)
    x = x.withColumn("after", F.when(F.col("ids").isNotNull(), after))
    return x.select(*[F.when(F.col("after").isNotNull(), F.col(f"after.{c}")).otherwise(F.col(c)).alias(c) if c in ("summary", "sections", "ledger") else F.col(f"`{c}`") for c in drafts.columns])


def issue_text() -> Column:
    """An issue as the gate tells it: its code, and for some its field and values."""
    c, dash = F.col, lambda x: F.when(x == "", "-").otherwise(x)
    short = lambda col: t.clipped(t.squeeze(F.coalesce(col, F.lit(""))), 90)
    field = F.when(F.coalesce("field", F.lit("")) == "", "unknown_field").otherwise(c("field"))
    names = lambda col: F.array_join(F.transform(F.slice(F.filter(texts(c(col)), lambda s: strip(s) != ""), 1, 3), lambda s: t.clipped(t.squeeze(s), 70)), "; ")
    of = lambda label, col: F.when(names(col) != "", F.concat(F.lit(f", {label}="), names(col))).otherwise(F.lit(""))
    detail = F.concat("code", F.lit("[field="), field, F.lit(", required="), dash(short("required")), of("sources", "sources"), F.lit("]"))
    used = F.concat("code", F.lit("[field="), field, F.lit(", canonical="), dash(short("new")), F.lit(", used="), dash(short("old")), of("canonical_sources", "sources"), of("used_sources", "other_sources"), F.lit("]"))
    return F.when(c("code") == "PUBLIC-TABLE-FACT-NOT-CURRENT", F.concat("code", F.lit("[field="), field, F.lit("]"))).when(c("code") == "PUBLIC-DETAIL-MISSING", detail).when(c("code") == "PUBLIC-CONFLICT-ALTERNATIVE-USED", used).otherwise(c("code"))


def gate(drafts: DataFrame, issues: DataFrame) -> DataFrame:
    """(draft_id, publishable, detail) of each draft: not with major issues, the first of which are told."""
    told = deciding(issues).groupBy("draft_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", issue_text().alias("told")))), lambda x: x["told"]), " | ").alias("detail"))
    return drafts.select("draft_id").join(told, "draft_id", "left").select("draft_id", F.col("detail").isNull().alias("publishable"), "detail")
