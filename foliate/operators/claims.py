"""Claims about documents, consolidated into registers and canonical facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions import fields, text
from foliate.functions.text import or_default


def consolidate(claims: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """A4: one claim for each key: the first one's values, the largest confidence, distinct evidence and batches."""
    return claims.groupBy(*keys).agg(
        F.min_by(F.struct(*values), F.struct(*order)).alias("first"), F.max("confidence").alias("confidence"),
        F.count(F.lit(1)).alias("n_claims"), F.array_sort(F.collect_set("evidence")).alias("evidence"), F.array_sort(F.collect_set("batch")).alias("batches"),
    ).select(*keys, "first.*", "confidence", "n_claims", "evidence", "batches")


def level(score: Column, high: float, medium: float) -> Column:
    """S45."""
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def corroboration(authority: Column, extraction: Column, classification: Column, sources: Column) -> Column:
    """The unrounded score of a register entry."""
    return F.least(F.lit(0.99), 0.57 * authority + 0.25 * extraction + 0.10 * classification + F.least(F.lit(0.15), 0.05 * F.greatest(F.lit(0), sources - 1)))


def register_entries(claims: DataFrame, keys: list[str], source: str) -> DataFrame:
    """An entry for each key over claims with a source; measures are maxima, a source counts once.

    Missing (or zero) authority, extraction and classification become 0.45, 0.6
    and 0.5. The level is decided on the score before it is rounded.
    """
    x = claims.groupBy(*keys).agg(
        F.max(or_default(F.col("authority"), 0.45)).alias("authority"), F.max(or_default(F.col("extraction"), 0.6)).alias("extraction"),
        F.max(or_default(F.col("classification"), 0.5)).alias("classification"), F.countDistinct(source).alias("sources"),
    )
    score = corroboration(F.col("authority"), F.col("extraction"), F.col("classification"), F.col("sources"))
    return x.withColumn("raw", score).select(*keys, "sources", F.round("raw", 3).alias("score"), level(F.col("raw"), 0.85, 0.65).alias("level"))


def routed(claims: DataFrame, rules: dict[str, Column], otherwise: str) -> DataFrame:
    """A row for each register whose rule holds, in the order of ``rules``; ``otherwise`` if none does."""
    found = F.filter(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]), lambda r: r.isNotNull())
    return claims.withColumn("register", F.explode(F.when(F.size(found) > 0, F.array_distinct(found)).otherwise(F.array(F.lit(otherwise)))))


def fact_score(field: Column, authority: Column, extraction: Column, classification: Column, sources: Column) -> Column:
    """The score of a value; well-proven construction permits get a little more."""
    more = F.least(F.lit(0.15), 0.05 * F.greatest(F.lit(0), sources - 1))
    permit = F.when(field.startswith("construction_permit") & (authority >= 0.9), 0.04).otherwise(0.0)
    return F.round(F.least(F.lit(0.99), 0.62 * authority + 0.23 * extraction + 0.10 * classification + more + permit), 3)


def fact_groups(candidates: DataFrame, field: str, norm: str, value: str, source: str) -> DataFrame:
    """A group for each field and normalised value: its score, level and best-supported value; well-proven construction permits get a little more."""
    x = candidates.groupBy(field, norm).agg(
        F.max(or_default(F.col("authority"), 0.45)).alias("authority"), F.max(or_default(F.col("extraction"), 0.6)).alias("extraction"),
        F.max(or_default(F.col("classification"), 0.5)).alias("classification"), F.countDistinct(source).alias("sources"),
        F.max_by(F.col(value), F.struct("authority", "extraction", F.negative("seq"))).alias("value"), F.min("seq").alias("first_seq"),
    )
    score = fact_score(F.col(field), F.col("authority"), F.col("extraction"), F.col("classification"), F.col("sources"))
    return x.withColumn("score", score).withColumn("level", level(F.col("score"), 0.82, 0.68))


def canonical(groups: DataFrame, field: str, alternatives: int = 3) -> DataFrame:
    """Of each field the winner and the next ``alternatives``; earlier groups win ties."""
    w = Window.partitionBy(field).orderBy(F.desc("score"), F.desc("sources"), "first_seq")
    ranked = groups.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= alternatives + 1)
    pick = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c))).alias(c)
    others = F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", "value", "score"))))
    return ranked.groupBy(field).agg(pick("value"), pick("score"), pick("level"), pick("sources"), others.alias("alternatives"))


def conflicts(facts: DataFrame, field: str, blocking: list[str]) -> DataFrame:
    """A row for each canonical fact of a ``blocking`` field with alternatives: field, selected value and score, alternatives."""
    return facts.where((F.size("alternatives") > 0) & F.col(field).isin(*blocking)).select(field, F.col("value").alias("selected_value"), F.col("score").alias("selected_score"), "alternatives")


def integrity(facts: DataFrame, eligible: int | Column = 0, analysed: int | Column = 0) -> DataFrame:
    """Issues (code, severity, detail): a start after the completion among facts (field, value); documents not analysed."""
    when = lambda f: F.max(F.when(F.col("field") == f, text.day(F.col("value"))))
    order = facts.agg(when("start_date").alias("a"), when("completion_date").alias("b")).where("a > b")
    order = order.select(F.lit("DOSSIER-CHRONOLOGY-ORDER").alias("code"), F.lit("major").alias("severity"), F.concat(F.date_format("a", "dd.MM.yyyy"), F.lit(" > "), F.date_format("b", "dd.MM.yyyy")).alias("detail"))
    lit = lambda n: F.lit(n) if isinstance(n, int) else n
    gap = facts.sparkSession.range(1).select((lit(eligible) - lit(analysed)).alias("n")).where("n > 0")
    return order.unionByName(gap.select(F.lit("DOSSIER-ANALYSIS-COVERAGE").alias("code"), F.lit("major").alias("severity"), F.col("n").cast("string").alias("detail")))


def backfilled(entries: DataFrame, facts: DataFrame) -> DataFrame:
    """Register entries (register, field, value, confidence, level) and one for each fact (field, value, confidence, level) whose field no entry has, in the first register that takes it."""
    own = facts.withColumn("field", fields.canonical_field(F.col("field"))).where("field <> '' and trim(coalesce(value, '')) <> ''")
    own = own.groupBy("field").agg(F.min(F.struct("value", "confidence", "level")).alias("f")).select("field", "f.*")
    late = own.join(entries.select("field").distinct(), "field", "left_anti")
    return entries.unionByName(late.withColumn("register", fields.registers(F.lit("other"), F.col("field"))[0]).select(*entries.columns))


def overridden(facts: DataFrame, overrides: DataFrame) -> DataFrame:
    """Facts (field, value, confidence) with a user's values (field, value): confidence 1, the old value kept as an alternative; new fields are added."""
    o = overrides.select("field", F.col("value").alias("said"))
    x = facts.join(o, "field", "full_outer")
    given = F.col("said").isNotNull()
    other = given & F.col("value").isNotNull() & (F.col("value") != F.col("said"))
    return x.select("field", F.coalesce("said", "value").alias("value"), F.when(given, 1.0).otherwise(F.col("confidence")).alias("confidence"), given.alias("user_confirmed"), F.when(other, F.col("value")).alias("alternative"))


def override_conflicts(facts: DataFrame) -> DataFrame:
    """The conflict that each of a user's values (as ``overridden`` gives them) marks: its field, the value said, and the old one as alternative."""
    x = facts.where(F.col("user_confirmed") & F.col("alternative").isNotNull())
    return x.select("field", F.col("value").alias("selected_value"), F.lit(1.0).alias("selected_score"), F.array(F.struct(F.col("alternative").alias("value"))).alias("alternatives"))


def relations(claims: DataFrame, anchors: DataFrame, document: str) -> DataFrame:
    """Of each document whether its anchor fields agree with the selected ones (field, selected)."""
    # A project has a handful of anchors; a shuffle by field would put all claims on one of them into one task.
    x = claims.join(F.broadcast(anchors), "field")
    same = F.col("value").eqNullSafe(F.col("selected"))
    n = x.groupBy(document).agg(F.count_if(same).alias("matches"), F.count_if(~same).alias("conflicts"))
    label = F.when((F.col("matches") >= 2) | ((F.col("matches") >= 1) & (F.col("conflicts") == 0)), "target").when(F.col("conflicts") >= 2, "foreign").otherwise("unlinked")
    return n.withColumn("relation", label)


def variance(planned: Column, final: Column) -> tuple[Column, Column]:
    """A10: difference and percent of the planned amount, rounded to cents; no percentage of nothing."""
    diff = F.round(final - planned, 2)
    return diff, F.round(F.when(planned != 0, 100 * (final - planned) / planned), 2)
