"""Folder listings: a parent table walked from a root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions import labels
from foliate.functions import text as t
from foliate.operators.rounds import forget, written

#: Levels of folders below the root that a listing may have.
LEVELS = 20


def item_order(is_folder: Column, name: Column) -> list[Column]:
    """Folders first, then by name with numbers as numbers."""
    return [(~is_folder).cast("int"), t.natural_key(name)]


def folder_paths(folders: DataFrame, root: str, levels: int = LEVELS) -> DataFrame:
    """IO14: (folder_id, path, depth, crumbs) of the folders (id, parent_id, name) that lead up to ``root``, which has depth 0.

    ``path`` joins safe names by slashes, ``crumbs`` are the ids on the way. Each round joins what a folder has walked so far to what
    the folder there has, which doubles the way; so few rounds do, and a folder with many children is only a larger side of a join.
    A folder more than ``levels`` below the root is an error, and so is a cycle that the root leads into, as it has no end. Folders
    that don't lead to the root, cycles among them included, are no part of the tree. A folder with several parents has several paths.
    """
    name = labels.safe_component(F.coalesce("name", F.lit("")))
    top = folders.where(F.col("id") == root).select(F.col("id").alias("folder_id"), name.alias("path"), F.lit(0).alias("depth"), F.array("id").alias("crumbs")).limit(1)
    walked = folders.where((F.col("id") != root) & F.col("parent_id").isNotNull()).select(F.col("id").alias("folder_id"), F.col("parent_id").alias("up"), name.alias("path"), F.lit(1).alias("depth"), F.array("id").alias("crumbs"))
    walked = written(walked.distinct())
    steps = 1
    while steps <= levels:
        there = walked.select(F.col("folder_id").alias("up"), F.col("up").alias("further"), F.col("path").alias("above"), F.col("depth").alias("more"), F.col("crumbs").alias("before"))
        moved = walked.where(F.col("up") != root).join(there, "up").select("folder_id", F.col("further").alias("up"), F.concat_ws("/", "above", "path").alias("path"), (F.col("depth") + F.col("more")).alias("depth"), F.concat("before", "crumbs").alias("crumbs"))
        after = written(walked.where(F.col("up") == root).unionByName(moved).where(F.col("depth") <= 2 * levels + 1))
        forget(walked)
        walked, steps = after, 2 * steps
    down = walked.where(F.col("up") == root)
    if down.where(F.col("depth") > levels).head(1):
        raise ValueError(f"the folder has more than {levels} levels of folders")
    names = top.select(F.col("path").alias("first"), F.col("folder_id").alias("up"), F.col("crumbs").alias("before"))
    below = down.join(F.broadcast(names), "up")  # the root is one row
    return top.unionByName(below.select("folder_id", F.concat_ws("/", "first", "path").alias("path"), "depth", F.concat("before", "crumbs").alias("crumbs")))


def folder_tree(items: DataFrame, root: str, levels: int = LEVELS, most: int | None = None) -> DataFrame:
    """IO14: (file_id, path, depth, and the items' other columns) of all files below ``root``.

    ``items``: id, parent_id, name, is_folder, is_output. Output folders and all below them, and files marked as output, are left out.
    Null marks count as false, items without an id or a parent are no files, and an empty table gives none. More files than ``most``
    are an error.
    """
    flag = lambda c: F.coalesce(c, F.lit(False))
    kept = items.where(F.col("id").isNotNull() & ~(flag("is_output") & (F.col("id") != root)))
    folders = folder_paths(kept.where(flag("is_folder")).select("id", "parent_id", "name"), root, levels)
    rest = [c for c in items.columns if c not in ("id", "parent_id", "name", "is_folder", "is_output", "path", "depth")]
    files = kept.where(~flag("is_folder")).withColumnRenamed("parent_id", "folder_id")
    out = files.select("id", "folder_id", "name", *rest).join(folders.select("folder_id", F.col("path").alias("folder"), "depth"), "folder_id")
    out = out.select(F.col("id").alias("file_id"), F.concat_ws("/", "folder", labels.safe_component(F.coalesce("name", F.lit("")))).alias("path"), "depth", *rest)
    if most is not None and out.limit(most + 1).count() > most:
        raise ValueError(f"the folder has more than {most} files")
    return out
