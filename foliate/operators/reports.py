"""Reports: what a prompt asks for, findings in order, what a writer gets of a dossier, and the report's payload."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions import text as t

# K35, actions in order, each with phrases any of which asks for it, or a pattern, in normalised text.
ACTIONS = [
    ("list_projects", ["projektet e mia", "shfaq projektet", "listo projektet"], None),
    ("create_project", [], r"\b(krijo|hap|shto)\b.{0,30}\bprojekt"),
    ("select_project", [], r"\b(zgjidh|perdor|aktivizo)\b.{0,35}\bprojekt"),
    ("show_active_project", ["projekti aktiv", "cili projekt eshte aktiv"], None),
    ("get_status", ["status", "progres", "ku ka arritur"], None),
    ("show_drive_folder", ["folderi i lidhur", "shfaq folderin drive"], None),
    ("bind_drive_folder", ["lidh folder", "vendos folder", "ruaj folder"], None),
    ("check_drive_folder", ["kontrollo folderin drive", "kontrollo aksesin drive", "drive preflight"], None),
    ("sync_drive_folder", ["sinkronizo drive", "sinkronizo folderin", "perditeso nga drive"], None),
    ("select_ai_model", [], r"\b(ndrysho|zgjidh|perdor|vendos)\b.{0,30}\bmodel"),
    ("import_attachment", ["importo", "ngarko", "perpuno dosjen", "lexo dosjen", "hap zip"], None),
    ("import_drive_folder", ["importo", "ngarko", "perpuno dosjen", "lexo dosjen", "hap zip"], None),
    ("estimate_kolaudim", [], r"\b(gjenero|harto|pergatit|krijo|nis|dua)\b.{0,45}\b(kolaudim|aktin? e kolaudimit|akt kolaudimi)"),
    ("generate_kolaudim", [], r"\b(gjenero|harto|pergatit|krijo|nis|dua)\b.{0,45}\b(kolaudim|aktin? e kolaudimit|akt kolaudimi)"),
    ("upload_report_to_drive", ["ruaje aty", "ngarkoje aty", "ruaje ne folder", "ngarkoje ne folder", "google drive"], None),
    ("deliver_latest_report", ["ma dergo pdf", "dergo pdf", "raportin e fundit", "raportet"], None),
]
# What needs a link to a folder, and what an attachment; how questions begin, and words of a dossier.
WITH_FOLDER, WITH_FILE, FOLDER = ["bind_drive_folder", "import_drive_folder", "upload_report_to_drive"], ["import_attachment"], "drive.google.com"
QUESTION = r"^(kush|cili|cila|cilat|cfare|sa|kur|ku|a ka|a eshte|me trego|shpjego)"
DOSSIER = ["dosje", "dokument", "sipermarres", "investitor", "mbikqyres", "kolaudator", "leje", "kontrate", "punime", "ndertim", "vkm", "ligj", "vlere", "date"]
ESTIMATE = "estimate_kolaudim"
# Recommendations, and the payload's notice.
NONE_FOUND, BY_A_PERSON, TO_COMPLETE = "Pa gjetje të rëndësishme", "Kërkohet shqyrtim njerëzor", "Kërkohet plotësim dokumentacioni"
NOTICE = "Projekt-akt profesional. Hyn në fuqi vetëm pas kontrollit, plotësimit dhe nënshkrimit nga profesionistët përgjegjës."


def intent_hints(prompt: Column, has_attachment: Column) -> Column:
    """The actions that a prompt asks for, in their order; a question about a dossier only where nothing else is asked (an estimate aside).

    A null prompt asks for nothing, a null mark is no attachment.
    """
    prompt, attached = F.coalesce(prompt, F.lit("")), F.coalesce(has_attachment, F.lit(False))
    folder = F.lower(prompt).contains(FOLDER)
    any_of = lambda s, words: reduce(lambda a, b: a | b, [s.contains(w) for w in words])

    def asked(s: Column) -> Column:
        hits = []
        for name, words, pattern in ACTIONS:
            hit = s.rlike(pattern) if pattern else any_of(s, words)
            hit = hit & folder if name in WITH_FOLDER else hit & attached if name in WITH_FILE else hit
            hits.append(F.when(hit, F.lit(name)))
        told = F.filter(F.array(*hits), lambda a: a.isNotNull())
        about = s.rlike(QUESTION) & any_of(s, DOSSIER)
        alone = lambda found: F.size(F.filter(found, lambda a: a != ESTIMATE)) == 0
        return t.let(told, lambda found: F.when(alone(found) & about, F.concat(found, F.array(F.lit("answer_project_question")))).otherwise(found))

    return t.let(t.alnum_text(prompt), asked)


def ordered_findings(findings: DataFrame, by: list[str]) -> DataFrame:
    """O3: findings (by, severity, rule, created_at) with their ``place``: by severity as a word, rule and time, nulls last, as a database sorts them."""
    order = [F.asc_nulls_last("severity"), F.asc_nulls_last("rule"), F.asc_nulls_last("created_at")]
    return findings.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def clean_list(x: Column, most: int) -> Column:
    """The first ``most`` texts of an array that are not blank, trimmed; null is empty."""
    return F.slice(F.filter(F.transform(F.coalesce(x, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: F.coalesce(v, F.lit("")) != ""), 1, most)


def compact_facts(facts: DataFrame) -> DataFrame:
    """What a writer gets of canonical facts: evidence id, up to 8 supporting ids, value, level, 6 sources, 2 excerpts of 220 characters and 2 alternatives of 3 sources.

    ``facts``: field, value, level, sources, supporting, evidence (array of source, snippet), alternatives (array of value, sources).
    Null arrays are empty.
    """
    evidence = F.transform(F.slice(F.coalesce("evidence", F.array()).cast("array<struct<source:string,snippet:string>>"), 1, 2), lambda e: F.struct(e["source"].alias("source"), t.clipped(F.trim(F.coalesce(e["snippet"], F.lit(""))), 220).alias("snippet")))
    others = F.transform(F.slice(F.coalesce("alternatives", F.array()).cast("array<struct<value:string,sources:array<string>>>"), 1, 2), lambda a: F.struct(a["value"].alias("value"), clean_list(a["sources"], 3).alias("sources")))
    return facts.select("field", F.concat(F.lit("canonical:"), "field").alias("evidence_id"), clean_list(F.col("supporting"), 8).alias("supporting"), "value", "level", clean_list(F.col("sources"), 6).alias("sources"), evidence.alias("evidence"), others.alias("alternatives"))


def report_parts(findings: DataFrame, by: list[str]) -> DataFrame:
    """Of each report (by) with findings (by, severity, required_action): how many, the recommendation and the distinct required actions, sorted."""
    actions = F.array_sort(F.collect_set(F.nullif("required_action", F.lit(""))))  # one report's actions
    critical = F.coalesce(F.bool_or(F.col("severity") == "critical"), F.lit(False))
    return findings.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when(critical, BY_A_PERSON).otherwise(TO_COMPLETE).alias("recommendation"), actions.alias("required_actions"))


def report_payload(reports: DataFrame, findings: DataFrame, facts: DataFrame, by: list[str]) -> DataFrame:
    """(by, recommendation, required_actions, payload) of each report; the payload is JSON with its keys in order.

    ``reports``: by, title, generated_at, total, classified, status, reason, summary, signature and sections (array of code, title,
    body) of the draft, null where there is none. ``facts``: by, field, value; blank ones are left out, and they stand in order of
    field. Without a draft's summary the counts of files and findings are told. The reason is given only for what is not drafted.
    """
    known = facts.where(F.coalesce("value", F.lit("")) != "").groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("facts"))
    x = reports.join(known, by, "left").join(report_parts(findings, by), by, "left")
    n = F.coalesce("n", F.lit(0))
    s = lambda v: v.cast("string")
    none = F.concat(F.lit("U kontrolluan "), s(F.col("total")), F.lit(" dokumente. Nuk u identifikuan mungesa dokumentacioni nga rregullat e aplikuara."))
    some = F.concat(F.lit("U kontrolluan "), s(F.col("total")), F.lit(" dokumente, prej të cilave "), s(F.col("classified")), F.lit(" u klasifikuan. Sistemi identifikoi "), s(n), F.lit(" gjetje të hapura për plotësim dokumentacioni sipas rregullave të validuara."))
    told = F.coalesce(F.nullif(F.trim(F.coalesce("summary", F.lit(""))), F.lit("")), F.when(n == 0, none).otherwise(some))
    status = F.coalesce(F.nullif("status", F.lit("")), F.lit("not_generated"))
    sections = F.transform(F.coalesce("sections", F.array()).cast("array<struct<code:string,title:string,body:string>>"), lambda v: F.struct(v["code"].alias("code"), v["title"].alias("title"), v["body"].alias("body")))
    project = F.coalesce("facts", F.create_map().cast("map<string,string>"))
    reason = F.when(status != "drafted", F.nullif("reason", F.lit("")))
    payload = F.to_json(F.struct("title", F.date_format("generated_at", "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at"), project.alias("project"), status.alias("status"), told.alias("executive_summary"), sections.alias("sections"), F.coalesce("signature", F.lit("")).alias("signature_note"), F.lit(NOTICE).alias("notice"), reason.alias("reason")))
    return x.select(*by, F.coalesce("recommendation", F.lit(NONE_FOUND)).alias("recommendation"), F.coalesce("required_actions", F.array().cast("array<string>")).alias("required_actions"), payload.alias("payload"))
