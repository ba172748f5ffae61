"""Evidence ranked for a question: what the question asks, what evidence is worth, and quotas of requests."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions import fields
from foliate.functions.text import question_text, token_matches, token_subset

# What each kind of evidence adds to a score.
KIND = {"claim": 4.0, "dossier": 3.5, "law": 2.5, "chunk": 0.5}
# What in a question asks for what (K22); of those in "all", one of each tuple must occur.
INTENTS = {
    "chronology": [("kronolog", "fazave", "filluar", "perfunduar punimet", "data e fillimit", "data e perfundimit")],
    "foundation_completion": [("themele",), ("perfund", "prov", "dokument")],
    "hidden_works": [("maskuar", "maskuara", "hidden works")],
    "conflicts": [("konflikt", "mosperputh", "te ndryshme")],
    "missing": [("mungon", "mungojne", "nuk rezulton", "nuk provohet", "paprovuar")],
    "law": [("vkm", "ligj", "neni", "rregull")],
    "document_list": [("cilat dokumente", "cilet dokumente")],
}
SECTIONS = {
    "execution_and_chronology": ("kronolog", "faza", "fillim", "perfund", "themele", "karabina", "fasad"),
    "quality_and_hidden_works": ("mask", "material", "prove", "analiza", "beton", "hekur", "armim"),
    "parties_and_contracts": ("kontrat", "investitor", "sipermarres", "mbikqyres", "kolaudator"),
    "completion_and_conclusion": ("mung", "nuk rezulton", "perfundimtar"),
}
HIDDEN = ["hidden works", "mask", "beton", "armim", "plint", "kolon", "trar"]
DATED, LISTED = ["date", "data", "fillim", "perfund"], ["start", "completion", "schedule", "njoftim", "perfundim"]
# Other words for a field in questions.
FIELD_WORDS = {
    "object_name": "objekt emri objektit ndertese projekti", "location": "vendndodhje adrese zone bashki fshat", "investor": "investitor zhvillues pronari", "developer": "zhvillues investitor",
    "contractor": "sipermarres zbatues kompania e ndertimit", "supervisor": "mbikqyres mbikeqyres", "kolaudator": "kolaudator auditues teknik", "designer": "projektues arkitekt",
    "contract_date": "data e kontrates date kontrate kontrate",
    "contractor_contract_reference": "kontrata e sipermarrjes kontrata e sipermarresit kontrate sipermarrje data e kontrates se sipermarresit",
    "supervisor_contract_reference": "kontrata e mbikqyresit kontrate mbikqyrje data e kontrates se mbikqyresit",
    "kolaudator_contract_reference": "kontrata e kolaudatorit kontrate kolaudimi data e kontrates se kolaudatorit",
    "construction_permit_number": "leje ndertimi numer leje protokoll", "construction_permit_date": "date leje leje ndertimi", "construction_permit_protocol": "protokoll leje ndertimi",
    "start_date": "fillim punimesh data e fillimit", "completion_date": "perfundim punimesh data e perfundimit", "planned_value": "vlere kontrate vlere preventivi kosto",
    "final_value": "vlere perfundimtare situacion kosto perfundimtare", "cadastral_zone": "zone kadastrale zona kadastrale", "total_construction_area": "siperfaqe ndertimi siperfaqe totale",
    "project_chronology": "kronologji faza ndertimi fillim punimesh perfundim punimesh data akti data procesverbali",
    "missing_core_fields": "mungon mungojne nuk provohet nuk rezulton e paprovuar", "document_record": "dokument procesverbal akt kontrolli njoftim",
}


def plain(question: str) -> str:
    """S8 of a question, on the driver."""
    folded = "".join(c for c in unicodedata.normalize("NFKD", question) if not unicodedata.combining(c))
    return re.sub("[^a-z0-9/]+", " ", folded.casefold()).strip()


def intents(question: str) -> set[str]:
    """What a question asks for."""
    said = plain(question)
    return {name for name, groups in INTENTS.items() if all(any(m in said for m in g) for g in groups)}


def preferred_sections(question: str) -> list[str]:
    """The sections whose documents a question is about."""
    return [s for s, marks in SECTIONS.items() if any(m in plain(question) for m in marks)]


def field_words(field: Column) -> Column:
    """Words by which a question may name a field; empty for none."""
    name = F.coalesce(field, F.lit(""))
    own = fields.canonical_field(name)
    said, spaced = question_text(name), lambda x: F.replace(x, F.lit("_"), F.lit(" "))
    dated = F.when(fields.any_of(said, DATED), "data date kronologji faza fillim perfundim")
    hidden = F.when(fields.any_of(said, ["mask", "element", "kontroll", "control"]), "punime maskuara kontroll procesverbal element")
    return F.when(name == "", F.lit("")).otherwise(F.concat_ws(" ", spaced(name), spaced(own), fields.lookup(FIELD_WORDS, own), dated, hidden))


def token_hits(text: Column, tokens: list[str]) -> Column:
    """How many of the question's tokens, repeats counted, match the text."""
    return reduce(lambda a, b: a + b, [token_matches(t, text).cast("int") for t in tokens], F.lit(0))


def intent_score(asked: set[str], kind: Column, field: Column, text: Column, conflicted: Column) -> Column:
    """What an item's kind, field and normalised text add for what is asked."""
    name = question_text(F.coalesce(field, F.lit("")))
    dates = F.when(field == "project_chronology", 14.0).when(fields.any_of(name, DATED), 9.0).otherwise(0.0) + F.when((field == "document_record") & fields.any_of(text, LISTED), 6.0).otherwise(0.0)
    gains = {
        "chronology": dates,
        "foundation_completion": F.when(text.contains("theme") & text.contains("perfund"), 11.0).otherwise(0.0),
        "hidden_works": F.when(fields.any_of(text, HIDDEN), 10.0).otherwise(0.0),
        "conflicts": F.when(conflicted, 14.0).otherwise(0.0),
        "missing": F.when(field == "missing_core_fields", 16.0).otherwise(0.0),
        "document_list": F.when(field == "document_record", 9.0).otherwise(0.0),
        "law": F.when(kind == "law", 14.0).otherwise(0.0),
    }
    return reduce(lambda a, b: a + b, [gains[k] for k in INTENTS if k in asked], F.lit(0.0))


def ranked(evidence: DataFrame, question: str, tokens: list[str], top: int = 12) -> DataFrame:
    """The ``top`` items for a question, with hits and score.

    Items: id, kind, text, authority, chunk_id, and, where there are such,
    field_name, value, source_label, is_conflicted, is_canonical. Score:
    authority, the kind's bonus, 2 for each matching token, 5 if the whole
    question occurs, 5 if a token matches the field's words, what the intents
    add, less 16 for conflicts and for missing fields that are not asked for, 8
    if canonical. Items without a match of text, field or intent go; of items
    with the same chunk and first 180 characters the best stays; ties go by id.
    """
    c, there = F.col, set(evidence.columns)
    text_of = lambda n: c(n) if n in there else F.lit(None).cast("string")
    flag = lambda n: F.coalesce(c(n), F.lit(False)) if n in there else F.lit(False)
    field, asked, said = text_of("field_name"), intents(question), plain(question)
    words = field_words(field) if "field_name" in there else F.lit("")
    # The normalised text is worked out once for each item, then met with every token.
    whole = question_text(F.concat_ws(" ", field, text_of("value"), "text", text_of("source_label"), words))
    search = question_text(F.concat_ws(" ", field, "text", text_of("source_label")))
    named = (words != "") & (token_hits(question_text(words), tokens) > 0)
    found = F.transform(F.array(whole), lambda q: F.struct(token_hits(q, tokens).alias("hits"), q.contains(said).alias("whole") if said else F.lit(False).alias("whole")))[0]
    bonus = reduce(lambda x, k: x.when(c("kind") == k, KIND[k]), KIND, F.when(F.lit(False), 0.0)).otherwise(0.0)
    gain = intent_score(asked, c("kind"), field, search, flag("is_conflicted"))
    x = evidence.withColumns({"_found": found, "_named": named, "_gain": gain}).withColumn("hits", c("_found.hits")).where((c("hits") > 0) | c("_named") | (c("_gain") > 0))
    less = F.when((c("kind") == "dossier") & flag("is_conflicted") & ~c("_named"), 16.0).otherwise(0.0) if "conflicts" not in asked else F.lit(0.0)
    gone = F.when(F.coalesce(field == "missing_core_fields", F.lit(False)), 16.0).otherwise(0.0) if "missing" not in asked else F.lit(0.0)
    plus = lambda when, n: F.when(when, n).otherwise(0.0)
    x = x.withColumn("score", c("authority") + bonus + 2 * c("hits") + plus(c("_found.whole"), 5.0) + plus(c("_named"), 5.0) + c("_gain") - less - gone + plus(flag("is_canonical"), 8.0))
    once = Window.partitionBy("chunk_id", F.left("text", F.lit(180))).orderBy(F.desc("score"), "id")
    x = x.withColumn("_r", F.row_number().over(once)).where("_r = 1").drop("_r", "_found", "_named", "_gain")
    return x.orderBy(F.desc("score"), "id").limit(top)  # the top is what is asked for


def canonical_boost(evidence: DataFrame, facts: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Items (id, chunk_id, field_name, authority) with is_canonical, is_conflicted and 3 more authority for each source of a fact in their chunk.

    ``facts``: (field, chunk_id), a row for each source; a fact's source counts for items of its field or of none. ``conflicts``: (field), distinct.
    """
    own = fields.canonical_field(F.coalesce("field_name", F.lit("")))
    x = evidence.withColumn("_own", own)
    f = facts.select(F.col("field").alias("_fact"), F.col("chunk_id").alias("_chunk"))
    hits = x.select("id", "chunk_id", "_own").join(f, (F.col("chunk_id") == F.col("_chunk")) & ((F.col("_own") == "") | (F.col("_own") == F.col("_fact"))))
    hits = hits.join(conflicts.select(F.col("field").alias("_fact"), F.lit(True).alias("_hot")), "_fact", "left")
    hits = hits.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.max_by(F.coalesce("_hot", F.lit(False)), "_fact").alias("_last"))
    x = x.join(hits, "id", "left").join(conflicts.select(F.col("field").alias("_own"), F.lit(True).alias("_named")), "_own", "left")
    return x.withColumns({"is_canonical": F.col("_n").isNotNull(), "is_conflicted": F.coalesce("_last", "_named", F.lit(False)), "authority": F.col("authority") + 3.0 * F.coalesce("_n", F.lit(0))}).drop("_own", "_n", "_last", "_named")


def section_boost(evidence: DataFrame, files: DataFrame, gain: float = 5.0) -> DataFrame:
    """Items (source_label, authority) whose label begins with the name of a preferred file get ``gain`` once.

    ``files``: (filename), those of the preferred sections. Names are matched by
    equality with every beginning of the label that a name's length allows.
    """
    names = files.select("filename").distinct()
    labels = evidence.select("source_label").distinct().where("length(source_label) > 0")
    begins = labels.select("source_label", F.explode(F.sequence(F.lit(1), F.length("source_label"))).alias("n"))
    hit = begins.select("source_label", F.left("source_label", F.col("n")).alias("filename")).join(names, "filename", "left_semi").select("source_label").distinct().withColumn("_hit", F.lit(gain))
    return evidence.join(hit, "source_label", "left").withColumn("authority", F.col("authority") + F.coalesce("_hit", F.lit(0.0))).drop("_hit")


def dossier_rows(records: DataFrame, conflicts: DataFrame, missing: DataFrame, events: DataFrame) -> DataFrame:
    """Evidence (id, kind, text, source_label, field_name, value, authority, is_canonical, is_conflicted) of what a dossier holds.

    ``records``: version_id, filename, kind, role, relation (foreign and unusable
    ones, and those without a version or name, go). ``conflicts``: n, field,
    selected, alternatives; only those with an alternative that is not the same
    (S37). ``missing``: field. ``events``: n, field, value, source.
    """
    c, lit = F.col, F.lit
    row = lambda df, i, text, label, field, value, authority, hot=False: df.select(i.alias("id"), lit("dossier").alias("kind"), text.alias("text"), label.alias("source_label"), field.alias("field_name"), value.alias("value"), lit(authority).alias("authority"), lit(hot).alias("is_canonical"), lit(hot).alias("is_conflicted"))
    r = records.where(fields.usable(c("role")) & ~c("relation").eqNullSafe("foreign_project_reference") & c("version_id").isNotNull() & (F.trim(F.coalesce("filename", lit(""))) != ""))
    out = row(r, F.concat(lit("dossier:document:"), c("version_id").cast("string")), F.concat(lit("Dokument i indeksuar në dosjen e projektit. Emri: "), "filename", lit(". Lloji i klasifikuar: "), F.coalesce("kind", lit("unknown")), lit(".")), c("filename"), lit("document_record"), c("filename"), 3.0)
    real = F.filter("alternatives", lambda a: F.trim(a) != "")
    k = conflicts.withColumn("_a", real).where((F.trim("selected") != "") & F.exists("_a", lambda a: ~token_subset(c("selected"), a)))
    said = F.array_join(F.array_distinct(F.concat(F.array("selected"), c("_a"))), " | ")
    out = out.unionByName(row(k, F.concat(lit("dossier:conflict:"), c("n").cast("string"), lit(":"), "field"), F.concat(lit("Konflikt i identifikuar gjatë konsolidimit për fushën "), "field", lit(". Vlerat e gjetura: "), said, lit(".")), F.concat(lit("Konsolidimi i dosjes: konflikt për "), "field"), c("field"), c("selected"), 10.0, True))
    m = missing.agg(F.array_join(F.array_sort(F.collect_set("field")), ", ").alias("all")).where("all <> ''")  # names of core fields
    out = out.unionByName(row(m, lit("dossier:missing-core-fields"), F.concat(lit("Fushat bazë që nuk rezultojnë të provuara pas konsolidimit të versioneve aktuale: "), "all", lit(".")), lit("Kontrolli i mbulimit të dosjes teknike"), lit("missing_core_fields"), c("all"), 10.0))
    e = events.withColumn("_s", F.coalesce("source", lit("Kronologjia e konsoliduar e dosjes")))
    return out.unionByName(row(e, F.concat(lit("dossier:chronology:"), c("n").cast("string")), F.concat(lit("Ngjarje e kronologjisë së konsoliduar: "), "field", lit(" = "), "value", lit(". Dokumentet: "), F.coalesce("source", lit("")), lit(".")), c("_s"), lit("project_chronology"), c("value"), 9.0))


def has_any_token(text: Column, tokens: list[str]) -> Column:
    """One of the tokens is a word of the text."""
    return F.arrays_overlap(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), F.array(*[F.lit(t) for t in tokens]))


def fulltext_boost(evidence: DataFrame, tokens: list[str], most: int = 32, gain: float = 4.0) -> DataFrame:
    """The first ``most`` chunks by id that hold one of the tokens get ``gain``; the limit is the search's own."""
    hit = evidence.where((F.col("kind") == "chunk") & has_any_token(F.col("text"), tokens)).select("id").orderBy("id").limit(most).withColumn("_hit", F.lit(gain))
    return evidence.join(F.broadcast(hit), "id", "left").withColumn("authority", F.col("authority") + F.coalesce("_hit", F.lit(0.0))).drop("_hit")


def quota(requests: DataFrame, user: str, ts: str, tokens: str, window: int, now: str) -> DataFrame:
    """Of each user the requests of the last ``window`` seconds and of the last day, and the day's tokens."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col(ts).cast("timestamp"))
    return requests.groupBy(user).agg(
        F.count_if(age.between(0, window)).alias("in_window"), F.count_if(age.between(0, 86_400)).alias("in_day"),
        F.coalesce(F.sum(F.when(age.between(0, 86_400), F.col(tokens))), F.lit(0)).alias("day_tokens"),
    )


def trailing_counts(requests: DataFrame, user: str, ts: str, seconds: int) -> Column:
    """Requests of the same user in the ``seconds`` up to each, itself included."""
    w = Window.partitionBy(user).orderBy(F.unix_timestamp(F.col(ts).cast("timestamp"))).rangeBetween(-seconds, 0)
    return F.count(F.lit(1)).over(w)
