"""First-seen, ranked and running rows of groups: what windows give."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fresh(columns: Iterable[str], name: str) -> str:
    """``name``, made longer until no column has it (whatever the case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def first_of(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each group."""
    return top_of(df, keys, order, 1)


def top_of(df: DataFrame, keys: list, order: list, n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group, with their rank if it is named; Spark cuts groups before the shuffle."""
    own = rank or fresh(df.columns, "rank")
    out = df.withColumn(own, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(own) <= n)
    return out if rank else out.drop(own)


def representative(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The ``values`` of each group's least row by ``order`` (ascending): an aggregate with partial sums, so a hot group costs little."""
    rep = F.min_by(F.struct(*values), F.struct(*order)).alias("__rep")
    return df.groupBy(*keys).agg(rep).select(*keys, "__rep.*")


def running_within(df: DataFrame, keys: list[str], order: list, amount: str, limit: float) -> DataFrame:
    """The rows of each group up to a total of ``limit``."""
    total = F.sum(amount).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("running_total", total).where(F.col("running_total") <= limit)


def context_line(line: str, keys: list[str], order: list) -> Column:
    """The line with the one before and the two after."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return F.concat_ws(" ", F.lag(line, 1).over(w), F.col(line), F.lead(line, 1).over(w), F.lead(line, 2).over(w))
