"""Snapshots of a folder against the manifest of the last one, and changes applied to tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot_diff(refs: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """(key, change): skipped, new, changed, unchanged or deleted.

    ``refs``: key, supported, version, md5, modified, size. ``manifest``: the same
    but supported, with file_version_id and status. The first of version, md5,
    modification or size that both sides have decides; a rename changes nothing.
    """
    a, b = refs.alias("a"), manifest.alias("b")
    both = lambda c: F.col(f"a.{c}").isNotNull() & F.col(f"b.{c}").isNotNull()
    differs = lambda c: F.col(f"a.{c}") != F.col(f"b.{c}")
    content = F.when(both("version"), differs("version")).when(both("md5"), differs("md5")).when(both("modified"), differs("modified") | F.coalesce(differs("size"), F.lit(False))).otherwise(F.coalesce(differs("size"), F.lit(False)))
    change = (
        F.when(F.col(f"a.{key}").isNull() | ~F.col("a.supported"), F.when(F.col("b.status") == "active", "deleted").when(F.col(f"a.{key}").isNotNull(), "skipped"))
        .when(F.col(f"b.{key}").isNull() | F.col("b.status").isin("source_deleted", "failed", "skipped"), "new")
        .when((F.col("b.status") != "active") | F.col("b.file_version_id").isNull() | content, "changed")
        .otherwise("unchanged")
    )
    x = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    return x.select(F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key), change.alias("change")).where("change is not null")


def same_keys(a: str, b: str, keys: list[str]) -> Column:
    """Whether rows of two aliases have the same keys; nulls are equal."""
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def one_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with the same keys the least by all other columns in their order (nulls first)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, "_row.*").select(*rows.columns) if rest else rows.distinct()


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """M1: ``old`` with the rows of ``new`` put in or in place of those with their keys; null keys are equal, repeated new keys give one row."""
    new = one_each(new.select(*old.columns), keys)
    return old.alias("a").join(new.alias("b"), same_keys("a", "b", keys), "left_anti").unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """M4: ``old`` and the rows of ``new`` whose keys it lacks, one for each key (the least); null keys are equal."""
    late = one_each(new.select(*old.columns), keys)
    return old.unionByName(late.alias("a").join(old.alias("b"), same_keys("a", "b", keys), "left_anti"))


def partial_update(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """M3: ``rows`` with the values of ``changes`` where it has some (not null) for their keys, one row of changes for each."""
    rest = [c for c in changes.columns if c not in keys]
    c = changes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(v).alias(f"_v_{v}") for v in rest])
    x = rows.join(c, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]), "left")
    return x.select(*[F.coalesce(f"_v_{n}", n).alias(n) if n in rest else F.col(n) for n in rows.columns])


def apply_sync(versions: DataFrame, changes: DataFrame, key: str, complete: bool = True) -> DataFrame:
    """M7: (key, version_number, name, status) after a scan, from the last versions (the same) and ``changes`` (key, change, name).

    New files begin at 1, changed ones go one further, unchanged ones take a new
    name without a new version, deleted ones keep theirs and are marked, the
    latter only if the scan was ``complete``. Skipped and unseen ones stay.
    """
    c = changes.select(F.col(key).alias("_k"), F.col("change").alias("_change"), F.col("name").alias("_name"))
    x = versions.join(c, F.col(key) == F.col("_k"), "full_outer")
    is_ = lambda *w: F.coalesce(F.col("_change").isin(*w), F.lit(False))
    n = F.coalesce("version_number", F.lit(0))
    number = F.when(is_("new", "changed"), n + 1).otherwise(F.col("version_number"))
    name = F.when(is_("new", "changed", "unchanged"), F.coalesce("_name", "name")).otherwise(F.col("name"))
    status = F.when(is_("new", "changed", "unchanged"), "active").when(is_("deleted") & F.lit(complete), "source_deleted").otherwise(F.col("status"))
    return x.where(F.col(key).isNotNull() | is_("new", "changed", "unchanged")).select(F.coalesce(key, "_k").alias(key), number.alias("version_number"), name.alias("name"), status.alias("status"))


def pending_batches(batches: DataFrame, completed: DataFrame, key: str) -> DataFrame:
    """The batches whose input hash no completed run has."""
    return batches.join(completed.select(key).distinct(), key, "left_anti")


def replace_groups(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """M2: ``old`` with all rows of the groups in ``new`` replaced."""
    return old.join(new.select(group).distinct(), group, "left_anti").unionByName(new.select(*old.columns))


def add_versions(versions: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """The rows of ``changed`` with the version after the key's last, 1 for a new key."""
    last = versions.groupBy(key).agg(F.max("version_number").alias("__last"))
    return changed.join(last, key, "left").withColumn("version_number", F.coalesce("__last", F.lit(0)) + 1).drop("__last")


def current_versions(versions: DataFrame, key: str) -> DataFrame:
    """The last version of each key that is not deleted."""
    top = versions.groupBy(key).agg(F.max("version_number").alias("version_number"))
    return versions.join(top, [key, "version_number"]).where("deleted_at is null")
