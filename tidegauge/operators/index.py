"""The index: impact sums, snapshots, their series, history and contributors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config
from ..functions.numbers import round2


def impact_sums(impact: str = "current_impact") -> list[Column]:
    """positive_sum, negative_sum and active_events of a group of events; zero impacts count as events only."""
    i = F.col(impact)
    return [
        F.coalesce(F.sum(F.when(i > 0, i)), F.lit(0.0)).alias("positive_sum"), F.coalesce(F.sum(F.when(i < 0, i)), F.lit(0.0)).alias("negative_sum"), F.count("*").alias("active_events"),
    ]


def snapshot(events: DataFrame, previous: DataFrame, at: Column, scope: str = "global", baseline: float = config.BASELINE) -> DataFrame:
    """One snapshot row of events(current_impact) after the latest row of previous, also over no events."""
    p, n = F.col("positive_sum"), F.col("negative_sum")
    latest = previous.select(F.max_by(F.struct("current_index", (F.col("positive_impact_sum") + F.col("negative_impact_sum")).alias("pressure")), "snapshot_at").alias("last")).select("last.*")
    sums = events.agg(*impact_sums()).crossJoin(F.broadcast(latest))
    first = F.col("current_index").isNull()
    change = F.when(first, 0.0).otherwise(p + n - F.col("pressure"))
    index = F.when(first, F.lit(baseline) + p + n).otherwise(F.col("current_index") + change)
    return sums.select(
        F.lit(scope).alias("index_scope"), at.alias("snapshot_at"), F.lit(baseline).alias("baseline"), round2(index).alias("current_index"), round2(change).alias("change_since_previous"),
        round2(p).alias("positive_impact_sum"), round2(n).alias("negative_impact_sum"), F.col("active_events").cast("int").alias("active_event_count"),
        F.lit(config.CALCULATION_VERSION).alias("calculation_version"),
    )


def snapshot_series(sums: DataFrame, scope: list[str] | None = None, baseline: float = config.BASELINE) -> DataFrame:
    """Snapshots of sums(snapshot_at, positive_sum, negative_sum, ...) in closed form: impacts have two decimals, so the running value is baseline + pressure."""
    p, n = round2(F.col("positive_sum")), round2(F.col("negative_sum"))
    w = Window.partitionBy(*(scope or [])).orderBy("snapshot_at")  # rows are one a bucket and scope, few after the aggregation
    rows = sums.select(*(scope or []), "snapshot_at", p.alias("positive_sum"), n.alias("negative_sum"), "active_events")
    pressure = F.col("positive_sum") + F.col("negative_sum")
    change = F.coalesce(pressure - F.lag(pressure).over(w), F.lit(0.0))
    return rows.select("*", round2(F.lit(baseline) + pressure).alias("current_index"), round2(change).alias("change_since_previous"))


def snapshot_fold(sums: DataFrame, baseline: float = config.BASELINE) -> DataFrame:
    """The same by the recurrence itself: each index is the previous one plus the change of pressure."""
    p, n = round2(F.col("positive_sum")), round2(F.col("negative_sum"))
    rows = F.array_sort(F.collect_list(F.struct("snapshot_at", (p + n).alias("pressure"))))
    start = F.struct(F.lit(None).cast("double").alias("index"), F.lit(0.0).alias("last"), F.array().cast("array<struct<snapshot_at:timestamp_ntz,current_index:double>>").alias("out"))

    def step(acc, x):
        index = round2(F.when(acc["index"].isNull(), F.lit(baseline) + x["pressure"]).otherwise(acc["index"] + x["pressure"] - acc["last"]))
        return F.struct(index.alias("index"), x["pressure"].alias("last"), F.array_append(acc["out"], F.struct(x["snapshot_at"].alias("snapshot_at"), index.alias("current_index"))).alias("out"))

    return sums.agg(F.aggregate(rows, start, step)["out"].alias("out")).select(F.inline("out"))


def latest(snapshots: DataFrame, scope: str | None = None) -> DataFrame:
    rows = snapshots if scope is None else snapshots.filter(F.col("index_scope") == scope)
    return rows.orderBy(F.desc("snapshot_at")).limit(1)


def history(snapshots: DataFrame, n: int = config.MAX_HISTORY) -> DataFrame:
    """The last n points in ascending order."""
    return snapshots.select("snapshot_at", "current_index", "change_since_previous").orderBy(F.desc("snapshot_at")).limit(n).orderBy("snapshot_at")


def history_range(snapshots: DataFrame, start: Column | None = None, end: Column | None = None, scope: str | None = None) -> DataFrame:
    rows = snapshots
    if start is not None:
        rows = rows.filter(F.col("snapshot_at") >= start)
    if end is not None:
        rows = rows.filter(F.col("snapshot_at") <= end)
    if scope is not None:
        rows = rows.filter(F.col("index_scope") == scope)
    return rows.orderBy("snapshot_at")


def history_by(snapshots: DataFrame, interval: str) -> DataFrame:
    """The last point of each hour, day or week (from Monday), with the change over it."""
    bucket = F.date_trunc(interval, "snapshot_at").cast("timestamp_ntz")
    grouped = snapshots.groupBy(bucket.alias("bucket")).agg(
        F.max_by("current_index", "snapshot_at").alias("current_index"), F.sum("change_since_previous").alias("_change"), F.count("*").alias("points"),
    )
    return grouped.select("bucket", "current_index", round2(F.col("_change")).alias("change"), "points")


def chart_points(history: DataFrame, width: float = 720.0, height: float = 240.0) -> DataFrame:
    """The line of history(snapshot_at, current_index), some hundred rows at most, on a canvas: label, value, and x, y from the top left."""
    order, everything = Window.orderBy("snapshot_at"), Window.partitionBy()
    v, low, high = F.col("current_index"), F.min("current_index").over(everything), F.max("current_index").over(everything)
    n = F.count("*").over(everything)
    x = (F.row_number().over(order) - 1) / F.greatest(n - 1, F.lit(1)) * F.lit(width)
    y = F.when(high > low, F.lit(height) - (v - low) / (high - low) * F.lit(height)).otherwise(F.lit(height / 2))
    return history.select("snapshot_at", F.date_format("snapshot_at", "HH:mm").alias("label"), v.alias("value"), F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


def chart_svg(points: DataFrame, width: float = 720.0, height: float = 240.0) -> DataFrame:
    """One row svg: chart_points as a line drawing with the newest value as its title."""
    placed = F.transform(F.array_sort(F.collect_list(F.struct("snapshot_at", "x", "y"))), lambda p: F.format_string("%.2f,%.2f", p["x"], p["y"]))
    line = F.array_join(placed, " ")
    title = F.format_string("%.2f", F.max_by("value", "snapshot_at"))
    return points.agg(F.concat(F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width:g} {height:g}"><title>'), title, F.lit('</title><polyline fill="none" stroke="#246b88" points="'), line, F.lit('"/></svg>')).alias("svg"))


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, right_columns: list[str], by: list[str] | None = None, bucket: str = "day") -> DataFrame:
    """Each left row with right_columns of the newest right row (per by) that is strictly older; nulls if there is none.

    Rows are partitioned by time bucket, so no partition holds the whole line; the newest row
    of earlier buckets is carried in from a table of one row a bucket. Left rows without a
    time match nothing."""
    by = by or []
    values = F.struct(F.col(right_on).alias("_at"), *right_columns)
    r = right.filter(F.col(right_on).isNotNull()).select(*by, F.col(right_on).alias("_t"), F.lit(1).alias("_side"), values.alias("_value"))
    left_columns = F.struct(*left.columns)
    lft = left.select(*by, F.col(left_on).alias("_t"), F.lit(0).alias("_side"), left_columns.alias("_row"))
    rows = lft.unionByName(r, allowMissingColumns=True).withColumn("_bucket", F.date_trunc(bucket, "_t"))
    last = rows.filter("_side = 1").groupBy(*by, "_bucket").agg(F.max_by("_value", "_t").alias("_last"))
    buckets = rows.select(*by, "_bucket").distinct().join(last, [*by, "_bucket"], "left")
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select(*[F.col(b).alias(f"_c_{b}") for b in by], F.col("_bucket").alias("_c_bucket"), F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    on = F.col("_bucket") == F.col("_c_bucket")
    for b in by:
        on = on & (F.col(b) == F.col(f"_c_{b}"))
    within = Window.partitionBy(*by, "_bucket").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("_seen", F.last("_value", ignorenulls=True).over(within)).filter("_side = 0").join(carried, on, "left")
    return seen.select("_row.*", *[F.coalesce("_seen", "_carried")[c].alias(c) for c in right_columns])


def contributor_rows(events: DataFrame, scores: DataFrame, snapshot_id: Column) -> DataFrame:
    """Audit rows of a snapshot: its events(event_id, current_impact, age_hours) with the id of the active score of each of scores(id, event_id, is_active)."""
    active = scores.filter("is_active").select("event_id", F.col("id").alias("event_score_id"))
    rows = events.join(active, "event_id")
    key = F.concat_ws("/", snapshot_id, "event_id")
    return rows.select(key.alias("id"), snapshot_id.alias("snapshot_id"), "event_id", "event_score_id", "current_impact", F.col("age_hours").alias("hours_since_detected"))


def contributors(snapshot_events: DataFrame, events: DataFrame, scores: DataFrame) -> DataFrame:
    """The events behind each snapshot, with title, category and the score's impact."""
    e = events.select(F.col("id").alias("event_id"), "title", "category")
    s = scores.select(F.col("id").alias("event_score_id"), F.col("impact"))
    return snapshot_events.join(e, "event_id").join(s, "event_score_id").select("snapshot_id", "event_id", "title", "category", "impact", "current_impact", "hours_since_detected")


def explain_change(snapshot_events: DataFrame, before: str, after: str) -> DataFrame:
    """What each event added to the change between two snapshots; events in one of them only count as 0 in the other."""
    side = lambda i, name: snapshot_events.filter(F.col("snapshot_id") == i).groupBy("event_id").agg(F.sum("current_impact").alias(name))
    both = side(before, "before").join(side(after, "after"), "event_id", "full")
    b, a = F.coalesce("before", F.lit(0.0)), F.coalesce("after", F.lit(0.0))
    return both.select("event_id", b.alias("before"), a.alias("after"), round2(a - b).alias("change"))


def scope_index(events: DataFrame, baseline: float = config.BASELINE) -> DataFrame:
    """The index of each scope and, with a null scope, of all."""
    sums = events.rollup("scope").agg(*impact_sums())
    return sums.select("scope", round2(F.lit(baseline) + F.col("positive_sum") + F.col("negative_sum")).alias("current_index"), "active_events")


def category_balance(events: DataFrame) -> DataFrame:
    sums = events.groupBy("category").agg(*impact_sums())
    return sums.select("category", round2(F.col("positive_sum")).alias("positive_sum"), round2(F.col("negative_sum")).alias("negative_sum"), "active_events")
