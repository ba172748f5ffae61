"""Rules against what a collection holds: requirements, obligations, currency of evidence, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def applies(rule: Column, value: Column) -> Column:
    """P10: no list means every value, else the value is in it."""
    return rule.isNull() | F.array_contains(rule, value)


def applies_to(rule: Column, key: str, value: Column) -> Column:
    """P10 on JSON: whether a rule's ``key`` takes a value: a text must equal it, a list hold it; anything else, or nothing, takes all."""
    v = F.try_variant_get(F.try_parse_json(rule), f"$.{key}", "variant")
    kind = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    listed = F.array_contains(F.try_variant_get(v, "$", "array<string>"), value)
    return F.when(kind == "STRING", F.try_variant_get(v, "$", "string") == value).when(kind.startswith("ARRAY"), F.coalesce(listed, F.lit(False))).otherwise(F.lit(True))


def with_aliases(types: DataFrame, aliases: DataFrame) -> DataFrame:
    """The distinct ``type``s and, for those in ``aliases`` (type, alias), their aliases."""
    return types.select("type").distinct().union(types.join(aliases, "type").select(F.col("alias").alias("type"))).distinct()


def missing_required(rules: DataFrame, found: DataFrame) -> DataFrame:
    """Of rules (rule, severity, required) those that lack a type in ``found``, with the missing types in the rule's order."""
    need = rules.select("rule", "severity", F.posexplode("required").alias("pos", "type"))
    lacking = need.join(found, "type", "left_anti").groupBy("rule", "severity").agg(F.array_sort(F.collect_list(F.struct("pos", "type"))).alias("m"))
    return lacking.select("rule", "severity", F.transform("m", lambda x: x["type"]).alias("missing"))


def obligations(groups: DataFrame, present: DataFrame) -> DataFrame:
    """Of groups (owner, required) how many types ``present`` (owner, type) has: complete, partial or missing."""
    need = groups.select("owner", F.explode("required").alias("type"))
    n = need.join(present.distinct().withColumn("__has", F.lit(1)), ["owner", "type"], "left").groupBy("owner").agg(F.count(F.lit(1)).alias("required"), F.count("__has").alias("present"))
    return n.withColumn("status", F.when(F.col("present") == F.col("required"), "complete").when(F.col("present") > 0, "partial").otherwise("missing"))


def current_evidence(cited: Column, current: Column) -> Column:
    """Something is cited and all of it is current."""
    return (F.size(cited) > 0) & (F.size(F.array_except(cited, current)) == 0)


def meets_groups(groups: Column, has: Column) -> Column:
    """Every group of alternatives has one among ``has``."""
    return F.forall(groups, lambda g: F.arrays_overlap(g, has))


def issues(*found: DataFrame) -> DataFrame:
    """The frames (code, severity, subject) of several checks as one."""
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def severity_counts(issues: DataFrame, severities: list[str]) -> DataFrame:
    """A count for each severity, zero for those that do not occur."""
    return issues.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in severities])


def coverage(items: DataFrame, by: str, done: str) -> DataFrame:
    """Of each group its items, those that are done, and the ratio."""
    n = items.groupBy(by).agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col(done)).alias("done"))
    return n.withColumn("ratio", F.round(F.col("done") / F.col("entries"), 3))


def register_coverage(entries: DataFrame, registers: list[str]) -> DataFrame:
    """(register, entries, documents, chunks, fields) of each of ``registers``: its entries (register, field, document, chunk) and the distinct documents, chunks and fields they have, zero for none."""
    n = entries.groupBy("register").agg(F.count(F.lit(1)).alias("entries"), *[F.count_distinct(x).alias(f"{x}s") for x in ("document", "chunk", "field")])
    every = entries.sparkSession.createDataFrame([(r,) for r in registers], "register string")
    x = every.join(n, "register", "left")
    return x.select("register", *[F.coalesce(v, F.lit(0)).alias(v) for v in ("entries", "documents", "chunks", "fields")])
