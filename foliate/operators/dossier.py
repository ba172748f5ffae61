"""From texts and analysed claims to canonical facts: extraction, admission, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions import fields
from foliate.functions import text as t
from foliate.operators import claims, evidence, extraction

#: Where a candidate comes from, in the order in which equal ones of a document count.
STEPS = ["lines", "contract", "roles", "metrics", "places"]


def records(docs: DataFrame) -> DataFrame:
    """K9: documents (version_id, filename, kind, classification, parsed, text) with style, authority and role."""
    kind, text = F.coalesce("kind", F.lit("unknown")), F.coalesce("text", F.lit(""))
    x = docs.withColumn("style", fields.style_reference(F.col("filename"), kind, text))
    return x.withColumns({"authority": fields.authority(kind, F.col("style")), "role": fields.document_role(F.coalesce("parsed", F.lit(False)), kind, F.col("style"))})


def text_candidates(docs: DataFrame, lines: int = 1500) -> DataFrame:
    """Candidates (version_id, filename, field, value, evidence, extraction, authority, classification, step, line_no, n) that documents state themselves.

    ``docs`` as ``records`` gives them. Lines of three characters or more count, the first ``lines`` of a text. The facts of single
    lines come from one pass over them. Equal values of a field count once in a document, the first by step, line and place.
    """
    rows = extraction.text_lines(docs.select("version_id", "text"), "text", 3, lines).drop("text")
    own = ["version_id"]
    whole = docs.select("version_id", "text")
    contract = extraction.contract_facts(docs.select("version_id", "filename", "kind", "text"), own, "filename", "kind", "text").withColumns({"line_no": F.lit(0), "step": F.lit(STEPS.index("contract"))})
    each = [extraction.stated(rows, own), contract, extraction.told(whole, "text").withColumn("line_no", F.lit(0))]
    every = reduce(DataFrame.unionAll, [x.select("version_id", "step", "line_no", "n", "field", "value", "evidence", "extraction") for x in each])
    told = every.join(docs.select("version_id", "filename", "kind", "authority", F.coalesce(F.nullif("classification", F.lit(0.0)), F.lit(0.55)).alias("classification")), "version_id")
    return extraction.admitted(told, ["filename"], ["step", "line_no", "n", "version_id"], F.col("kind")).drop("kind")


def claim_candidates(analysed: DataFrame, docs: DataFrame) -> DataFrame:
    """K8: candidates from analysed claims, as ``text_candidates`` gives them, with step and line number after all of those.

    ``analysed``: version_id, sha, claim_no, field_name, original_value, confidence, evidence (array of excerpt, verified). Claims
    need verified evidence, the first of which counts; a value of 2 to 280 characters that is no placeholder; a usable record of
    their document (J10, P14, P22); a field, which may depend on the excerpt (S16); and a document that may state it (P13).
    ``docs`` as ``records`` gives them, with sha256.
    """
    known = docs.select("version_id", "filename", "sha256")
    held = evidence.with_record(analysed, known, docs.select("version_id", "filename", "role", "authority"))
    proof = F.get(F.filter("evidence", lambda e: F.coalesce(e["verified"], F.lit(False))), F.lit(0))
    value = F.trim(t.squeeze(F.coalesce("original_value", F.lit(""))), F.lit(" ;,."))
    x = held.withColumns({"proof": proof, "value": value}).where("proof is not null").join(docs.select("version_id", "kind", F.coalesce(F.nullif("classification", F.lit(0.0)), F.lit(0.55)).alias("classification")), "version_id")
    x = x.withColumn("snippet", F.coalesce(F.nullif(F.col("proof.excerpt"), F.lit("")), "value"))
    x = x.withColumn("field", fields.contextual_field(F.col("field_name"), F.col("snippet"), F.col("kind"))).where("field <> ''")
    out = x.select(
        "version_id", F.lit(len(STEPS)).alias("step"), F.col("claim_no").cast("int").alias("line_no"), F.lit(0).alias("n"), "field", "value", F.left("snippet", F.lit(300)).alias("evidence"),
        F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(0.5)).alias("extraction"), "filename", "kind", F.coalesce(F.nullif("authority", F.lit(0.0)), F.lit(0.45)).alias("authority"), "classification",
    )
    return extraction.admitted(out, ["filename"], ["step", "line_no", "n", "version_id"], F.col("kind")).drop("kind")


def candidates(docs: DataFrame, analysed: DataFrame | None = None) -> DataFrame:
    """K7, K8: what documents and the claims about them state, equal values of a field once in a document, what its text says first."""
    x = text_candidates(docs)
    if analysed is None:
        return x
    both = x.unionByName(claim_candidates(analysed, docs))
    again = F.row_number().over(Window.partitionBy("filename", "field", fields.fact_value(F.col("field"), F.col("value"))).orderBy("step", "line_no", "n", "version_id"))
    return both.withColumn("again", again).where("again = 1").drop("again")


def dossier_facts(docs: DataFrame, analysed: DataFrame | None = None) -> DataFrame:
    """The canonical facts (field, value, score, level, sources, alternatives) of a dossier's documents and the claims about them.

    ``docs``: version_id, filename, kind, classification, parsed, sha256, text. Documents that are models of acts count little (K9);
    what is not readable has no text. Values are equal by S6, scored by A7, and the best by score, sources and first place wins. The
    order of places is that of file names, steps and lines. Null texts state nothing; an empty table gives no facts.
    """
    own = records(docs.where(F.coalesce("parsed", F.lit(False))))
    x = candidates(own, analysed)
    seq = F.struct("filename", "step", "line_no", "n")
    x = x.withColumns({"norm": fields.fact_value(F.col("field"), F.col("value")), "seq": seq})
    groups = groups_of(x)
    return claims.canonical(groups, "field")


def groups_of(x: DataFrame) -> DataFrame:
    """A7 over candidates (field, norm, value, authority, extraction, classification, filename, seq of any ordered type)."""
    best = F.min_by(F.struct("value", "seq"), F.struct(F.negative("authority"), F.negative("extraction"), "seq")).alias("best")
    y = x.groupBy("field", "norm").agg(F.max("authority").alias("authority"), F.max("extraction").alias("extraction"), F.max("classification").alias("classification"), F.count_distinct("filename").alias("sources"), best, F.min("seq").alias("first_seq"))
    score = claims.fact_score(F.col("field"), F.col("authority"), F.col("extraction"), F.col("classification"), F.col("sources"))
    return y.withColumn("value", F.col("best.value")).withColumn("score", score).withColumn("level", claims.level(F.col("score"), 0.82, 0.68)).drop("best")
