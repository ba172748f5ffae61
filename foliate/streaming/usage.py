"""The time-window behaviour on streams: usage in sliding windows, and requests told once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliate.operators import sync


def sliding_usage(requests: DataFrame, user: str, ts: str, tokens: str, window: str = "1 day", slide: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """T3 on a stream: requests and tokens of each user in windows that slide; what comes ``late`` or later is left out.

    State is one row for each user and open window.
    """
    w = F.window(ts, window, slide)
    return requests.withWatermark(ts, late).groupBy(w.alias("w"), user).agg(F.count(F.lit(1)).alias("requests"), F.sum(tokens).alias("tokens")).select("w.start", "w.end", user, "requests", "tokens")


def once(requests: DataFrame, key: str, ts: str, within: str = "1 hour") -> DataFrame:
    """M4 on a stream: each key once within a time; keys are forgotten after it."""
    return requests.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def synced(changes: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], key: str, checkpoint: str) -> StreamingQuery:
    """M7, T1 and T2 on a stream of changes (key, change, name): each batch is put into the versions that ``read`` gives, and ``write`` takes the result.

    A batch that is repeated after a failure finds its own result if ``write``
    replaces what it wrote before; the last change of a key in a batch counts.
    """

    def apply(batch: DataFrame, _: int) -> None:
        last = batch.groupBy(key).agg(F.max(F.struct("seq", "change", "name")).alias("c")).select(key, "c.change", "c.name")
        write(sync.apply_sync(read(), last, key))

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
