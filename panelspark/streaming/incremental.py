"""Extracts as a stream: the latest row of each key within the recompute span is kept as state and merged by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.keyed import KeyedTable
from ..sources.landing import RECOMPUTE_DAYS
from ..sources.scratch import Scratch


def latest(stream: DataFrame, keys: Sequence[str], date: str, order: Sequence[str] = (), days: int = RECOMPUTE_DAYS) -> DataFrame:
    """The latest row of each key and date of a stream, in update mode: what a batch changes within the span.

    A later batch wins over an earlier one, within a batch the greatest `order`, then the greatest columns. The state has
    the keys of the last `days` days before the greatest date seen; a row older than that is dropped, not merged.
    Rows without a date have no place in time and are dropped too.
    """
    others = [c for c in stream.columns if c not in (*keys, date)]
    rank = F.struct("_at", *[F.col(c) for c in (*order, *sorted(c for c in others if c not in order))])
    # The batch's time is the same when a failed batch runs again.
    seen = stream.withColumns({"_ts": F.col(date).cast("timestamp"), "_at": F.current_timestamp()}).withWatermark("_ts", f"{days} days").filter("_ts is not null")
    best = seen.groupBy(*keys, "_ts").agg(F.max(rank).alias("_best"))
    kind = stream.schema[date].dataType
    return best.select(*[F.col(k) for k in keys], F.col("_ts").cast(kind).alias(date), *[F.col(f"_best.{c}") for c in others]).select(*stream.columns)


def merge_stream(
    stream: DataFrame, target: str, checkpoint: str, date: str = "tradedate", keys: Sequence[str] = ("symbol",), order: Sequence[str] = (), days: int = RECOMPUTE_DAYS,
) -> StreamingQuery:
    """Start a query that upserts each micro-batch into the keyed table at target.

    A batch touches only its own keys: late rows replace or add theirs and no other row goes. Batches are numbered by
    the checkpoint, so one that was merged before a failure is not merged again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        # The batch is read twice, its state must be updated once.
        with Scratch(batch.sparkSession) as tmp:
            KeyedTable(batch.sparkSession, target, keys, date, order).upsert(tmp(batch), checkpoint, number)

    updates = latest(stream, keys, date, order, days)
    return updates.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
