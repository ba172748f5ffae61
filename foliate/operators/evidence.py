"""Evidence of claims: catalogue, references, joins to chunks and documents, and what it supports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions import fields
from foliate.functions import text as t
from foliate.operators.rounds import written
from foliate.operators.windows import first_of, top_of

# Kinds of evidence that need no source of the current versions, and those that prove a fact.
TIMELESS = ["verified_law_reference", "canonical_conflict", "integrity_issue", "user_confirmation"]
DIRECT = ["register_entry", "canonical_fact", "verified_law_reference"]


def numbered(rows: DataFrame, by: list[str], order: list, name: str = "n") -> DataFrame:
    """Rows with their place from 0 in their group."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def catalogue(entries: DataFrame, facts: DataFrame, conflicts: DataFrame, issues: DataFrame, laws: DataFrame) -> DataFrame:
    """One catalogue (evidence_id, kind, register, field, value, supporting) of all evidence.

    ``entries``: register, n (W8), field, value. ``facts``: field, value, confirmed.
    ``conflicts`` and ``issues``: n, field or code, value or detail. ``laws``: n,
    rule, reference. Facts are supported by the entries of their field.
    """
    row = lambda df, eid, kind, register, field, value: df.select(eid.alias("evidence_id"), kind.alias("kind"), register.alias("register"), field.alias("field"), value.alias("value"))
    c, none, num = F.col, F.lit(None).cast("string"), lambda p, n: F.concat(F.lit(p), F.col(n).cast("string"))
    own = row(entries, F.concat("register", F.lit(":"), c("n").cast("string")), F.lit("register_entry"), c("register"), c("field"), c("value"))
    support = own.groupBy("field").agg(F.array_sort(F.collect_set("evidence_id")).alias("supporting"))
    confirmed = F.when(F.coalesce("confirmed", F.lit(False)), "user_confirmation").otherwise("canonical_fact")
    canon = row(facts, F.concat(F.lit("canonical:"), "field"), confirmed, none, c("field"), c("value")).join(support, "field", "left")
    rest = row(conflicts, num("conflict:", "n"), F.lit("canonical_conflict"), none, c("field"), c("value"))
    rest = rest.unionByName(row(issues, num("integrity:", "n"), F.lit("integrity_issue"), none, c("code"), c("detail")))
    rest = rest.unionByName(row(laws, num("law:", "n"), F.lit("verified_law_reference"), none, c("rule"), c("reference")))
    return own.unionByName(rest).unionByName(canon, allowMissingColumns=True)


def references(sources: DataFrame, key: str, order: list[str], most: int = 8) -> DataFrame:
    """Of sources (key, file_version_id, source_document) the first of each version and document, ``most`` for each key."""
    x = first_of(sources, [key, "file_version_id", "source_document"], order)
    return top_of(x, [key], order, most, "n").withColumn("n", F.col("n") - 1)


def current_sources(items: DataFrame, sources: DataFrame, versions: DataFrame) -> DataFrame:
    """Items (evidence_id, kind) with ``is_current``: their kind needs no source, or they have sources (evidence_id, version) and all are in ``versions`` (version)."""
    s = sources.where("version is not null").join(versions.select("version", F.lit(True).alias("_now")).distinct(), "version", "left")
    s = s.groupBy("evidence_id").agg(F.bool_and(F.coalesce("_now", F.lit(False))).alias("_all"))
    return items.join(s, "evidence_id", "left").withColumn("is_current", F.col("kind").isin(*TIMELESS) | F.coalesce("_all", F.lit(False))).drop("_all")


def supported_registers(cited: DataFrame, items: DataFrame, support: DataFrame) -> DataFrame:
    """(claim_id, register) of all evidence that claims cite (claim_id, evidence_id) or that supports it (evidence_id, supporting), to the end.

    What evidence reaches is worked out once for all claims: each round hands the registers found last to the evidence above them,
    until none is new, so that cycles end. Items (evidence_id, register) alone count; evidence that is no item leads nowhere.
    """
    found = items.where("register is not null").select("evidence_id", "register").distinct()
    above = support.select("evidence_id", "supporting").join(items.select("evidence_id").distinct(), "evidence_id", "left_semi").distinct()
    above = above.select(F.col("evidence_id").alias("upper"), F.col("supporting").alias("evidence_id"))
    found = new = written(found)
    while new.head(1):
        reached = new.join(above, "evidence_id").select(F.col("upper").alias("evidence_id"), "register").distinct()
        new = written(reached.join(found, ["evidence_id", "register"], "left_anti"))
        found = found.unionByName(new)
    return cited.select("claim_id", "evidence_id").distinct().join(found, "evidence_id").select("claim_id", "register").distinct()


def claim_chunks(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sources of claims with their chunk, which must be of the same project and version."""
    return sources.join(chunks, ["chunk_id", "project_id", "version_id"])


def with_record(analyses: DataFrame, documents: DataFrame, records: DataFrame) -> DataFrame:
    """Analyses (version_id, sha) with their document (version_id, filename, sha256) and its record (version_id, filename, role, authority).

    The record is that of the version, else of the file name (of several the
    last by version). Records that are not usable, and analyses of another
    content than the document's, where both are known, go.
    """
    d = documents.select("version_id", "filename", "sha256")
    by_version = records.where("version_id is not null").groupBy("version_id").agg(F.max_by(F.struct("role", "authority"), F.col("filename")).alias("_v"))
    by_name = records.groupBy("filename").agg(F.max_by(F.struct("role", "authority"), F.coalesce("version_id", F.lit(-1))).alias("_n"))
    x = analyses.join(d, "version_id").join(by_version, "version_id", "left").join(by_name, "filename", "left").withColumn("_r", F.coalesce("_v", "_n"))
    x = x.where(fields.usable(F.col("_r.role")) & (F.col("sha").isNull() | F.col("sha256").isNull() | (F.col("sha") == F.col("sha256"))))
    return x.select(*analyses.columns, "filename", "_r.role", "_r.authority")


def nested_claims(runs: DataFrame, claims: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Runs with their claims as an array in order; an empty one for runs without. Claims of one run are one document's."""
    rest = [c for c in claims.columns if c not in (key, *order)]
    held = claims.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("claims"))
    kind = held.schema["claims"].dataType.simpleString()
    return runs.join(held, key, "left").withColumn("claims", F.coalesce("claims", F.array().cast(kind)))


def excerpt_verified(excerpt: Column, chunk: Column) -> Column:
    """The excerpt is in its chunk, case and white space apart; an empty one is in every chunk."""
    low = lambda x: t.squeeze(F.lower(F.coalesce(x, F.lit(""))))
    return low(chunk).contains(low(excerpt))


def batch_claims(claims: DataFrame, allowed: DataFrame, by: list[str]) -> DataFrame:
    """Claims (``by``, claim_id, chunk_indexes and texts) with the indexes that their batch has (``by``, chunk_index); those without any go, texts are cleaned."""
    one = claims.select(*by, "claim_id", F.posexplode("chunk_indexes").alias("pos", "chunk_index")).join(allowed.select(*by, "chunk_index").distinct(), [*by, "chunk_index"], "left_semi")
    held = one.groupBy(*by, "claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk_index"))), lambda x: x["chunk_index"]).alias("chunk_indexes"))
    name = lambda c: t.field_name(F.coalesce(c, F.lit("")))
    x = claims.drop("chunk_indexes").join(held, [*by, "claim_id"])
    return x.withColumns({"category": F.coalesce(F.nullif(name("category"), F.lit("")), F.lit("other")), "field_name": name("field_name"), "original_value": t.squeeze(F.coalesce("original_value", F.lit(""))), "confidence": t.clamp(F.col("confidence")), "supporting_excerpt": F.left(t.squeeze(F.coalesce("supporting_excerpt", F.lit(""))), F.lit(500))})


def reinforcement(entries: DataFrame, sources_col: str = "source_documents") -> DataFrame:
    """Masses in kilograms among register entries (evidence_id, field, value, normalized, sources), each (mass, sources) once, largest first by O10.

    An entry counts if its field is one of mass, its words are about steel, and
    it is public (P15).
    """
    shown = public_value(F.col("field"), F.col("value"), F.col("normalized"))
    x = entries.withColumn("shown", shown).where(public_entry(F.col("field"), F.col("value"), F.col("normalized")))
    said = t.plain_value(F.concat_ws(" ", "field", "value", "normalized", F.array_join(sources_col, " ")))
    mass = F.regexp_extract("shown", MASS, 1)
    x = x.where(fields.any_of(F.col("field"), MASS_FIELDS) & fields.any_of(said, STEEL) & (mass != ""))
    x = x.withColumns({"source_value": F.regexp_extract("shown", MASS, 0), "amount": F.replace(mass, F.lit(","), F.lit(".")).cast("double"), "number": mass})
    x = first_of(x, [t.plain_value(F.col("source_value")), F.array_join(sources_col, "|")], ["evidence_id"])
    return x.orderBy(F.desc("amount"), "evidence_id")


# P15 to P17, what is noise, mass and steel, and phrases that say nothing.
NOISE = ["numeric_values", "numerical_values", "numerical_values_list", "number_list", "dimension_values"]
STEEL_FIELDS = ["armatur", "iron", "mass", "rebar", "reinforcement", "steel_bar", "weight"]
MASS_FIELDS, STEEL = ["mass", "weight", "pesha", "sasia_e_hekurit"], ["armatur", "hekur", "rebar", "steel"]
MASS = r"(?i)(?<![0-9])([0-9]{1,7}(?:[.,][0-9]{1,3})?)\s*(?:kg|kilogram(?:e|ë)?)\b"
UNITS = r"\b(?:cm|kg|kn|m2|m3|mm|diameter|gjatesi|gjeresi|lartesi|masa|sasia|siperfaqe|vellim)\b"
BOILERPLATE = [
    r"\bmaterialet\s+e\s+perdorura.{0,180}\b(?:jane|rezultojne)\s+(?:te\s+)?deklaruara?\s+ne\s+dosje\b",
    r"\bprovat?\s+laboratorike.{0,180}\b(?:kerkojne|mbeten|duhet)\b.{0,100}\bverifikim",
    r"\bnuk\s+perbejne\s+prova?\s+laboratorike\b",
    r"\bnuk\s+(?:u\s+)?(?:identifikuan|paraqiten|gjenden).{0,180}\b(?:raporte?\s+laboratorike|certifikata?\s+(?:te\s+)?celikut|rezultate?\s+(?:te\s+)?provave?)\b",
]


def fused(x: Column) -> Column:
    """24 characters or more that are mostly digits or hold a run of seven; with units and two commas only such a run counts."""
    tight = F.regexp_replace(x, r"\s+", "")
    ratio = F.length(F.regexp_replace(tight, "[^0-9]", "")) / F.length(tight)
    run = tight.rlike("[0-9]{7,}")
    readable = x.rlike(r"(?i)\b(?:cm|kg|kn|m|mm)\b") & (F.length(x) - F.length(F.replace(x, F.lit(","), F.lit(""))) >= 2)
    return F.when(F.length(tight) < 24, F.lit(False)).when(readable, run).otherwise((ratio >= 0.48) | run)


def public_value(field: Column, value: Column, normalized: Column) -> Column:
    """The normalised value of a steel field if there is one that can be read, else the value."""
    n = t.squeeze(F.coalesce(normalized, F.lit("")))
    return F.when(fields.any_of(field, STEEL_FIELDS) & (n != "") & ~fused(n), n).otherwise(t.squeeze(F.coalesce(value, F.lit(""))))


def public_entry(field: Column, value: Column, normalized: Column) -> Column:
    """A named field that is no noise, with a value that can be read."""
    shown = public_value(field, value, normalized)
    return (F.coalesce(field, F.lit("")) != "") & ~field.isin(*NOISE) & (shown != "") & ~(fields.any_of(field, STEEL_FIELDS) & fused(shown))


def numbers_alone(x: Column) -> Column:
    """Six numbers or more and no unit or label."""
    return (F.size(F.regexp_extract_all(t.squeeze(x), F.lit(r"[0-9]+(?:[.,][0-9]+)?"), F.lit(0))) >= 6) & ~t.plain_value(x).rlike(UNITS)


def boilerplate(x: Column) -> Column:
    """Phrases about materials that state nothing."""
    return t.plain_value(x).rlike("|".join(f"(?:{p})" for p in BOILERPLATE))
