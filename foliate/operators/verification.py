"""Checks of a draft's claims: each gives a frame of issues (code, severity, claim_id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions import fields
from foliate.functions import text as t
from foliate.operators.evidence import DIRECT

# Kinds of claims and levels of conclusions.
TYPES, LEVELS = ["documented_fact", "professional_inference", "qualification"], ["proven", "qualified", "not_proven"]
# Words of inspections, of authorisations, and of limits, in normalised text.
INSPECTION = r"\b(?:nga|gjate)\s+(?:inspektimi|verifikimi)\s+(?:fizik|ne terren)|\bu konstatua\s+ne\s+terren|\bmatjet\s+e\s+kryera\s+nga\s+kolaudatori"
AUTHORISATION = r"\b(?:autorizohet|lejohet|miratohet|pranohet)\s+(?:per\s+)?(?:perdorim|shfrytezim)\b|\bstruktura\s+eshte\s+(?:e\s+pranuar|funksionale)\b|\bpunimet\s+jane\s+pranuar\b|\bobjekti\s+eshte\s+(?:i\s+pranuar|funksional)\b"
LIMITS = r"\b(?:nuk\s+(?:rezulton|provohet|vertetohet|konfirmohet)|(?:nga|sipas|referuar)\s+dokumentacionit|bazuar\s+ne\s+dokumentacion|ne\s+baze\s+te\s+dokumentacionit|pa\s+u\s+verifikuar|mbetet\s+per\s+t\s+u\s+verifikuar|per\s+t\s+u\s+verifikuar|kerkon\s+verifikim|duhet\s+verifikuar|me\s+rezerv[eë]|e\s+kufizuar|projekt-akt)\b"
INTERNAL = r"(?i)\b(?:verified_findings|consistency_review|document_type|parse_status|langgraph|workflow|checklist|ai model|model ai)\b"
# Claims that need evidence of certain registers: one of each group.
SENSITIVE = {
    "CLAIM-COMPLETION-EVIDENCE": (r"\b(?:punimet|objekti)\b.{0,60}\b(?:jane|eshte|u)\s+(?:perfunduar|realizuar\s+teresisht)\b", [["construction_chronology", "declarations_and_conclusions"]]),
    "CLAIM-CONFORMITY-EVIDENCE": (r"\b(?:konform|ne perputhje me|perputhet me)\b", [["declarations_and_conclusions"], ["technical_works", "project_parameters"]]),
    "CLAIM-MEASUREMENT-EVIDENCE": (r"\bmatjet?\s+(?:perfundimtare|faktike|e kryera)\b", [["project_parameters", "technical_works", "declarations_and_conclusions"]]),
    "CLAIM-TEST-EVIDENCE": (r"\b(?:provat?|testet?|certifikatat?)\b.{0,50}\b(?:konfirmojne|vertetojne|deshmojne|rezultojne)\b", [["materials_and_tests"]]),
    "CLAIM-SUITABILITY-EVIDENCE": (r"\b(?:i pershtatshem per shfrytezim|i gatshem per shfrytezim|mund te merret ne perdorim)\b", [["declarations_and_conclusions"], ["technical_works"], ["materials_and_tests"]]),
}


def raised(rows: DataFrame, checks: dict[str, Column] | list[tuple[str, Column]], key: str = "claim_id", severity: str = "major") -> DataFrame:
    """(code, severity, key): an issue for each check that holds for a row, in order; a code may have several checks."""
    pairs = checks.items() if isinstance(checks, dict) else checks
    codes = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in pairs]), lambda x: x.isNotNull())
    return rows.select(F.explode(codes).alias("code"), F.lit(severity).alias("severity"), key)


def limited(statement: Column, kind: Column) -> Column:
    """Whether a statement (S9) is a qualification or says its limits."""
    return F.coalesce(kind == "qualification", F.lit(False)) | statement.rlike(LIMITS)


def claim_issues(claims: DataFrame, cited: DataFrame, items: DataFrame, registers: DataFrame) -> DataFrame:
    """The checks of single claims (claim_id, statement, claim_type, level, confidence).

    ``cited``: claim_id, evidence_id. ``items``: evidence_id, kind, is_current.
    ``registers``: claim_id, register (J17). A claim without evidence is checked
    no further. Claims that share an id are checked each, with all that id cites.
    """
    e = cited.distinct().join(items.select("evidence_id", "kind", "is_current"), "evidence_id", "left")
    e = e.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind").isNull()).alias("unknown"), F.count_if(F.col("kind").isNotNull() & ~F.col("is_current")).alias("stale"), F.count_if(F.col("kind").isin(*DIRECT)).alias("direct"), F.count("kind").alias("known"))
    r = registers.groupBy("claim_id").agg(F.collect_set("register").alias("registers"))
    x = claims.join(e, "claim_id", "left").join(r, "claim_id", "left").withColumn("registers", F.coalesce("registers", F.array().cast("array<string>"))).withColumn("said", t.alnum_text(F.coalesce("statement", F.lit(""))))
    c, kind, level = F.col, F.coalesce("claim_type", F.lit("")), F.coalesce("level", F.lit(""))
    cites, bounded = F.coalesce(c("n"), F.lit(0)) > 0, limited(c("said"), c("claim_type"))
    checks = {
        "CLAIM-TEXT-MISSING": F.trim(F.coalesce("statement", F.lit(""))) == "",
        "CLAIM-TYPE-INVALID": ~kind.isin(*TYPES),
        "CLAIM-CONCLUSION-LEVEL-INVALID": ~level.isin(*LEVELS),
        "CLAIM-CONFIDENCE-INVALID": ~F.coalesce(c("confidence").between(0, 1), F.lit(False)),
        "CLAIM-EVIDENCE-MISSING": ~cites,
        "CLAIM-EVIDENCE-UNKNOWN": cites & (c("unknown") > 0),
        "CLAIM-EVIDENCE-NOT-CURRENT": cites & (c("stale") > 0),
        "CLAIM-FACT-WITHOUT-DIRECT-EVIDENCE": cites & (kind == "documented_fact") & (c("known") > 0) & (c("direct") == 0),
        "CLAIM-PHYSICAL-INSPECTION-UNSUPPORTED": cites & c("said").rlike(INSPECTION),
        "CLAIM-CONCLUSION-LEVEL-LANGUAGE": cites & level.isin("qualified", "not_proven") & ~bounded,
        "CLAIM-UNSIGNED-AUTHORIZATION": cites & c("said").rlike(AUTHORISATION),
    }
    mismatch = [(kind == "qualification") & (level == "proven"), (level == "not_proven") & (kind != "qualification")]
    for code, (pattern, groups) in SENSITIVE.items():
        hit = cites & c("said").rlike(pattern) & ~bounded
        mismatch.append(hit & (level != "proven"))
        lacks = ~reduce(lambda a, b: a & b, [F.arrays_overlap("registers", F.array(*map(F.lit, g))) for g in groups])
        checks[code] = hit & lacks
    return raised(x, [*checks.items(), *[("CLAIM-CONCLUSION-LEVEL-MISMATCH", m) for m in mismatch]])


def id_issues(claims: DataFrame, order: list[str]) -> DataFrame:
    """Claims without an id, and every one after the first with the same."""
    blank = F.trim(F.coalesce(F.col("claim_id").cast("string"), F.lit(""))) == ""
    again = F.row_number().over(Window.partitionBy("claim_id").orderBy(*order)) > 1
    return raised(claims.withColumn("_again", again), {"CLAIM-ID-MISSING": blank, "CLAIM-ID-DUPLICATE": ~blank & F.col("_again")})


def uncatalogued(paragraphs: DataFrame, claims: DataFrame) -> DataFrame:
    """Paragraphs (paragraph_id, text) whose words (S9) are no claim's statement; blank ones need none."""
    said = claims.select(t.alnum_text(F.col("statement")).alias("_said")).where("_said <> ''").distinct()
    x = paragraphs.withColumn("_said", t.alnum_text(F.coalesce("text", F.lit("")))).where("_said <> ''").join(said, "_said", "left_anti")
    return x.select(F.lit("PUBLIC-CLAIM-UNCATALOGUED").alias("code"), F.lit("major").alias("severity"), "paragraph_id")


def shape_issues(sections: DataFrame, drafts: DataFrame, least: int = 10, most: int = 12) -> DataFrame:
    """Drafts (draft_id, summary) and their sections (draft_id, code, title, body): placeholders, internal terms, numbers of sections, summary, empty and repeated sections."""
    c = F.col
    bad = lambda x, p: F.coalesce(x, F.lit("")).rlike(p)
    s = sections.groupBy("draft_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(bad(c("title"), fields.PLACEHOLDER) | bad(c("body"), fields.PLACEHOLDER)).alias("holes"), F.bool_or(bad(c("title"), INTERNAL) | bad(c("body"), INTERNAL)).alias("inner"),
        F.count_if(F.trim(F.coalesce("body", F.lit(""))) == "").alias("empty"), (F.count(F.nullif(F.trim("code"), F.lit(""))) - F.countDistinct(F.nullif(F.trim("code"), F.lit("")))).alias("again"),
    )
    x = drafts.join(s, "draft_id", "left")
    false = lambda n: F.coalesce(c(n), F.lit(False))
    whole = raised(x, {"PUBLIC-PLACEHOLDER": false("holes") | bad(c("summary"), fields.PLACEHOLDER), "PUBLIC-INTERNAL-TERMS": false("inner") | bad(c("summary"), INTERNAL), "PUBLIC-STRUCTURE-INVALID": ~F.coalesce(c("n").between(least, most), F.lit(False)), "PUBLIC-SUMMARY-MISSING": F.trim(F.coalesce("summary", F.lit(""))) == ""}, "draft_id")
    times = lambda code, n: x.where(F.col(n) > 0).select(F.lit(code).alias("code"), F.lit("major").alias("severity"), "draft_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))).alias("_n")).drop("_n")
    return whole.unionByName(times("PUBLIC-SECTION-EMPTY", "empty")).unionByName(times("PUBLIC-SECTION-DUPLICATE", "again"))


def summary(issues: DataFrame) -> DataFrame:
    """Counts of issues, of those that are major, of claims with major ones, and whether the draft may be published."""
    major = F.col("severity") == "major"
    return issues.agg(F.count(F.lit(1)).alias("issues"), F.count_if(major).alias("major"), F.countDistinct(F.when(major, F.col("claim_id"))).alias("claims"), (F.count_if(major) == 0).alias("publishable"))


def verified_findings(findings: DataFrame, evidence: str = "evidence") -> DataFrame:
    """Findings with evidence (a map), marked; those without go."""
    return findings.where(F.size(F.coalesce(F.col(evidence), F.create_map().cast("map<string,string>"))) > 0).withColumn("evidence_verified", F.lit(True))


def grounded(answers: DataFrame, cited: DataFrame, items: DataFrame) -> DataFrame:
    """Answers (answer_id, answer, certainty) with ``verdict``: refused for unknown or missing evidence or for evidence of nothing found, else the certainty, conflicted if a cited item (evidence_id, is_conflicted) is.

    ``cited``: answer_id, evidence_id.
    """
    e = cited.distinct().join(items.select("evidence_id", "is_conflicted"), "evidence_id", "left").groupBy("answer_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("is_conflicted").isNull()).alias("_unknown"), F.bool_or(F.coalesce("is_conflicted", F.lit(False))).alias("_hot"))
    n, none = F.coalesce("_n", F.lit(0)), F.col("certainty") == "not_found"
    verdict = F.when(F.coalesce("_unknown", F.lit(0)) > 0, "unknown evidence").when(~none & (n == 0), "no evidence").when(none & (n > 0), "evidence of nothing").when(F.coalesce("_hot", F.lit(False)), "conflicted").otherwise(F.col("certainty"))
    return answers.join(e, "answer_id", "left").withColumn("verdict", verdict).drop("_n", "_unknown", "_hot")


def placeholder_lines(docs: DataFrame, text_col: str, most: int = 3, size: int = 220) -> DataFrame:
    """Documents with placeholders and their first ``most`` lines that hold one."""
    lines = F.filter(F.split(text_col, r"\R"), lambda x: x.rlike(fields.PLACEHOLDER))
    x = docs.where(F.col(text_col).rlike(fields.PLACEHOLDER))
    return x.withColumn("lines", F.transform(F.slice(lines, 1, most), lambda s: F.left(t.squeeze(s), F.lit(size))))


def several_values(facts: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Categories of facts (category, value) with more than one normalised value (S11), and how many."""
    x = facts.withColumn("_v", t.without_labels(F.col("value"), labels or [])).where("_v <> ''")
    return x.groupBy("category").agg(F.countDistinct("_v").alias("n_values")).where("n_values > 1")


def document_issues(docs: DataFrame, most: int = 20) -> DataFrame:
    """(code, n, names) for documents (name, kind, status) of an unknown kind and for those whose text could not be read; the first ``most`` names by order. No row for none."""
    unknown = F.coalesce("kind", F.lit("unknown")) == "unknown"
    unread = ~F.coalesce(F.col("status").isin("parsed", "parsed_with_ocr"), F.lit(False))
    codes = F.filter(F.array(F.when(unknown, F.lit("DOCUMENTS-UNKNOWN")), F.when(unread, F.lit("DOCUMENTS-UNREADABLE"))), lambda x: x.isNotNull())
    x = docs.select("name", F.explode(codes).alias("code"))
    first = x.withColumn("rank", F.row_number().over(Window.partitionBy("code").orderBy("name"))).where(F.col("rank") <= most)
    names = first.groupBy("code").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return x.groupBy("code").agg(F.count(F.lit(1)).alias("n")).join(names, "code").select("code", "n", "names")
