"""Tiered keyword-signature classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions import text as t
from foliate.operators import signatures
from foliate.operators.windows import fresh

#: (type, terms that must all occur, confidence)
Signature = tuple[str, list[str], float]


def best_signature(text: Column, signatures: list[Signature]) -> Column:
    """(confidence, type) of the matching signature of largest confidence, of equals the first; null without one.

    Written as one expression, so that the text is read once and nothing is
    joined: signatures are a list of the program, not a table.
    """
    ranked = sorted(enumerate(signatures), key=lambda s: (-s[1][2], s[0]))
    out = F.lit(None).cast("struct<confidence:double,type:string>")
    for _, (kind, terms, confidence) in reversed(ranked):
        holds = F.lit(True)
        for t in terms:
            holds = holds & text.contains(t)
        out = F.when(holds, F.struct(F.lit(confidence).alias("confidence"), F.lit(kind).alias("type"))).otherwise(out)
    return out


def classify(name: Column, text: Column, by_name: list[Signature], by_text: list[Signature], window: int = 12_000) -> Column:
    """K1: the first tier that matches decides: the name, then the text's first ``window`` characters; else unknown at 0.

    The window is the classifier's own definition, not a cap on what is read.
    """
    none = F.struct(F.lit(0.0).alias("confidence"), F.lit("unknown").alias("type"))
    return F.coalesce(best_signature(name, by_name), best_signature(F.left(text, F.lit(window)), by_text), none)


def classify_document(name: Column, text: Column, by_name: list[Signature] | None = None, by_text: list[Signature] | None = None, window: int = 12_000) -> Column:
    """K1: (confidence, type) over normalised names and texts (S1), in tiers: laws are unknown; the name; a permit's heading in the first 3,000 characters; the text.

    A law has a law's word in its name and one of its phrases in the first 4,000
    characters. Missing names and texts count as empty.
    """
    any_of = lambda x, words: reduce(lambda a, b: a | b, [x.contains(w) for w in words])
    value = lambda kind, confidence: F.struct(F.lit(confidence).alias("confidence"), F.lit(kind).alias("type"))

    def of(n: Column, body: Column) -> Column:
        law = any_of(n, signatures.LAW_NAMES) & any_of(F.left(body, F.lit(4_000)), signatures.LAW_WORDS)
        heading = lambda head: F.when(head.contains("leje ndertimi") & any_of(head, signatures.CONSTRUCTION_HEADS), value("construction_permit", 0.99)).when(head.contains("leje zhvillimi") & any_of(head, signatures.DEVELOPMENT_HEADS), value("development_permit", 0.99))
        permit = t.let(F.left(body, F.lit(3_000)), heading)
        named = best_signature(n, signatures.NAME if by_name is None else by_name)
        of_text = [s for s in signatures.TEXT if s[0] not in signatures.NOT_IN_TEXT] if by_text is None else by_text
        told = t.let(F.left(body, F.lit(window)), lambda x: best_signature(x, of_text))
        return F.when(law, value("unknown", 0.0)).otherwise(F.coalesce(named, permit, told, value("unknown", 0.0)))

    # Each text is normalised once, however many signatures look into it.
    normal = lambda x: t.class_text(F.coalesce(x, F.lit("")))
    return t.let(normal(name), lambda n: t.let(normal(text), lambda body: of(n, body)))


def reclassified(docs: DataFrame, found: Column, kind: str, confidence: str) -> DataFrame:
    """K2: documents (kind, confidence) with what is ``found`` now where it is surer, and whether the type changed."""
    own = fresh(docs.columns, "found")
    x = docs.withColumn(own, found)
    surer = F.col(f"{own}.confidence") > F.coalesce(confidence, F.lit(0.0))
    new = F.when(surer, F.col(f"{own}.type")).otherwise(F.col(kind))
    return x.withColumns({"changed": ~new.eqNullSafe(F.col(kind)), kind: new, confidence: F.when(surer, F.col(f"{own}.confidence")).otherwise(F.col(confidence))}).drop(own)
