"""Who sees what: versions, deletions, members, predicates of requests, and the joins between files, rules, runs and laws."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.operators.windows import first_of, top_of


def not_deleted(rows: DataFrame, at: str = "deleted_at") -> DataFrame:
    """Rows that are not marked as deleted."""
    return rows.where(F.col(at).isNull())


def deleted(rows: DataFrame, when: Column, now: Column, at: str = "deleted_at") -> DataFrame:
    """Rows with a time of deletion put where ``when`` holds and none is yet."""
    return rows.withColumn(at, F.when(F.col(at).isNull() & F.coalesce(when, F.lit(False)), now).otherwise(F.col(at)))


def current_files(files: DataFrame, versions: DataFrame, key: str = "file_id") -> DataFrame:
    """Files (key, current_version, deleted_at) that are not deleted, with their current version (key, version_number)."""
    return not_deleted(files).join(versions, (files[key] == versions[key]) & (F.col("current_version") == F.col("version_number"))).drop(versions[key])


def parsed_files(files: DataFrame, versions: DataFrame, parsed: DataFrame, key: str = "file_id", version: str = "version_id", all_files: bool = True) -> DataFrame:
    """Current files with what was read of them (version); those not read yet too (J2), or not."""
    return current_files(files, versions, key).join(parsed, version, "left" if all_files else "inner")


def of_members(rows: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows whose key a member (key) has, each once however many members there are."""
    return rows.join(members, key, "left_semi")


def among(rows: DataFrame, column: str, values: list | DataFrame) -> DataFrame:
    """Rows whose column is one of a list, or of a frame's only column."""
    return rows.where(F.col(column).isin(*values)) if isinstance(values, list) else rows.join(values.toDF(column).distinct(), column, "left_semi")


def any_all(*groups: list[Column]) -> Column:
    """P5: all conditions of one of the groups hold."""
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, g) for g in groups])


def optional(rows: DataFrame, **wanted) -> DataFrame:
    """Rows with the given values (lists: one of them); None asks for nothing."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]).isin(*kv[1]) if isinstance(kv[1], list) else F.col(kv[0]) == kv[1]), [kv for kv in wanted.items() if kv[1] is not None], rows)


def claimable(rows: DataFrame, status: str, closed: list[str], lease: str, now: Column) -> DataFrame:
    """Rows that are not closed and whose lease is absent or over."""
    return rows.where(~F.col(status).isin(*closed) & (F.col(lease).isNull() | (F.col(lease) <= now)))


def not_expired(rows: DataFrame, until: str, now: Column) -> DataFrame:
    """T4: rows that have not run out; without an end they never do."""
    return rows.where(F.col(until).isNull() | (F.col(until) > now))


def rule_contexts(rules: DataFrame, laws: DataFrame, articles: DataFrame) -> DataFrame:
    """Rules with their law (law_code), and with the article (law_code, article) if there is one."""
    return rules.join(laws, "law_code").join(articles, ["law_code", "article"], "left")


def law_articles(laws: DataFrame, articles: DataFrame) -> DataFrame:
    """Articles of laws, with their place in the order of the numbers as texts."""
    w = Window.partitionBy("law_code").orderBy(F.col("article").cast("string"))
    return laws.join(articles, "law_code").withColumn("place", F.row_number().over(w))


def latest_step(runs: DataFrame, steps: DataFrame, by: str, key: str, order: list) -> DataFrame:
    """Of each ``by`` the latest step of its runs (key)."""
    x = runs.join(steps, key)
    return first_of(x, [by], order)


def latest_completed(runs: DataFrame, by: str, completed: str, updated: str, tie: str) -> DataFrame:
    """Of each ``by`` the run completed last; those not completed come after all others, then the last updated."""
    order = [F.desc_nulls_last(completed), F.desc_nulls_last(updated), F.desc(tie)]
    return first_of(runs, [by], order)


def project_of(versions: DataFrame, files: DataFrame, key: str = "file_id") -> DataFrame:
    """Versions with their file's project."""
    return versions.join(files.select(key, "project_id"), key)


def by_identity(new: DataFrame, old: DataFrame, keys: list[str], found: str) -> DataFrame:
    """New rows with the least ``found`` of old rows with the same identity, null without one."""
    return new.join(old.groupBy(*keys).agg(F.min(found).alias(found)), keys, "left")


def step_usage(runs: DataFrame, steps: DataFrame, key: str, usage: str) -> DataFrame:
    """Of the steps of given runs the sum of each number of a JSON object, by key; what is no whole number is left out."""
    x = steps.join(runs.select(key).distinct(), key, "left_semi").select(F.explode(F.from_json(usage, "map<string,string>")).alias("k", "v"))
    return x.where(F.col("v").rlike("^[0-9]+$")).groupBy("k").agg(F.sum(F.col("v").cast("long")).alias("total"))


def with_parts(owners: DataFrame, parts: DataFrame, key: str, order: list[str], name: str = "parts") -> DataFrame:
    """Owners with their parts as an array in order, empty without any."""
    rest = [c for c in parts.columns if c not in (key, *order)]
    held = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))
    return owners.join(held, key, "left").withColumn(name, F.coalesce(name, F.array().cast(held.schema[name].dataType.simpleString())))


def skip_reason(name: Column, size: Column, mime: Column, suffixes: list[str], exported: list[str], most: int = 50 << 20) -> Column:
    """P20: why a file is left out: a foreign format, an unknown ending or its size; null if it is taken."""
    foreign = mime.startswith("application/vnd.google-apps.") & ~mime.isin(*exported)
    ending = F.concat(F.lit("."), F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1)))
    return F.when(foreign, "format Google i pambështetur").when(~mime.isin(*exported) & ~ending.isin(*suffixes), "format i pambështetur").when(F.coalesce(size, F.lit(0)) > most, "tejkalon kufirin 50 MB")


def register_places(entries: DataFrame, by: list[str], day: Column) -> DataFrame:
    """Entries (register, field_name, value) with their place: chronology by day, those without last, then by field and value; other registers by field and value."""
    key = F.when(F.col("register") == "construction_chronology", F.coalesce(day, F.lit("9999-12-31").cast("date")))
    return entries.withColumn("place", F.row_number().over(Window.partitionBy(*by, "register").orderBy(key, "field_name", "value")))


def document_places(docs: DataFrame, by: list[str], priorities: DataFrame, other: int = 20, unread: int = 5) -> DataFrame:
    """Documents (type, parsed, confidence, name) with their place: those read first, then by the type's priority (type, priority), confidence and name."""
    x = docs.join(priorities, "type", "left")
    order = [F.when(F.col("parsed"), 0).otherwise(unread), F.coalesce("priority", F.lit(other)), F.desc(F.coalesce("confidence", F.lit(0.0))), "name"]
    return x.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).drop("priority")


def last_turns(turns: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The last ``n`` of each group with their place, the oldest of them first."""
    x = top_of(turns, [by], [F.desc(order)], n)
    return x.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order)))
