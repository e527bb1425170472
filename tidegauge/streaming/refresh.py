"""The periodic refresh and the index over a stream."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import config
from ..functions.text import headline_key
from ..operators import index as I
from ..plans.pipeline import refresh
from ..sources import warehouse


log = logging.getLogger(__name__)


def refresh_writer(
    stream: DataFrame, root: str, now_of_batch: Callable[[int], Column], responses: DataFrame | None = None, limit: int | None = config.MAX_ARTICLES, swallow: bool = True
) -> DataStreamWriter:
    """Every micro-batch of articles is scored as a whole and appends one snapshot to the stored table.

    One batch runs at a time; its number is the snapshot's id, so a batch that runs again after a failure appends nothing.
    A refresh that fails is logged and appends nothing, and the stream goes on with the next one; without swallow it ends."""

    def attempt(batch: DataFrame, number: int) -> None:
        try:
            run(batch, number)
        except Exception:
            if not swallow:
                raise
            log.exception("refresh %s failed", number)

    def run(batch: DataFrame, number: int) -> None:
        spark, now = batch.sparkSession, now_of_batch(number)
        stored = warehouse.read(spark, root, "index_snapshots")
        snapshot = refresh(batch, now, stored.filter(F.col("id") != str(number)), responses, limit).snapshot
        warehouse.append(snapshot.withColumn("id", F.lit(str(number))), root, "index_snapshots", now)

    return stream.writeStream.foreachBatch(attempt)


def every_half_hour(writer: DataStreamWriter) -> DataStreamWriter:
    return writer.trigger(processingTime=f"{config.REFRESH_MINUTES} minutes")


def windowed_pressure(stream: DataFrame, window: str = "1 hour", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Impact sums of each window of stream(ts timestamp, current_impact); rows later than the watermark are left out."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    grouped = stream.withWatermark("ts", late).groupBy(w.alias("w")).agg(*I.impact_sums())
    return grouped.select(F.col("w.start").alias("start"), "positive_sum", "negative_sum", "active_events")


def first_by_headline(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """Articles whose headline key wasn't seen within the watermark, across batches."""
    return stream.withColumn("headline_key", headline_key(F.col("headline"))).withWatermark("published_at", late).dropDuplicatesWithinWatermark(["headline_key"])


_OUT = "scope string, current_index double, change_since_previous double, events bigint"


def running_index(stream: DataFrame, baseline: float = config.BASELINE) -> DataFrame:
    """The index of each scope after every micro-batch that has events of it, with the pressure kept as state."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pressure, events = state.get if state.exists else (0.0, 0)
        change, n = 0.0, 0
        for f in frames:
            change += float(f["current_impact"].sum())
            n += len(f)
        pressure, events = round(pressure + change, 2), events + n
        state.update((pressure, events))
        yield pd.DataFrame([(key[0], round(baseline + pressure, 2), round(change, 2), events)], columns=["scope", "current_index", "change_since_previous", "events"])

    rows = stream.select("scope", "current_impact")
    return rows.groupBy("scope").applyInPandasWithState(update, _OUT, "pressure double, events bigint", "update", GroupStateTimeout.NoTimeout)
