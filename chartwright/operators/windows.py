"""Windows before and after many decision dates, over one read of the charts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = ["market", "store", "t0"]
#: First and last day of each window, from the decision date.
TRAILING = {"week": (-6, 0), "quarter": (-90, 0), "year": (-365, 0)}


def outcome(horizon: int) -> dict[str, tuple[int, int]]:
    """Windows of the day `horizon` days after a decision date and of the week that ends then."""
    return {"exact": (horizon, horizon), "around": (horizon - 6, horizon)}


def segments(t0s: list[dt.date], windows: dict[str, tuple[int, int]]) -> tuple[list[tuple], list[tuple]]:
    """(day, seg) of each day that some window of some date covers, and (seg, t0, *in each window) of each segment.

    Days between two neighbouring edges lie in the same windows of all dates: they are a segment.
    """
    edges = sorted({t0 + dt.timedelta(x) for t0 in t0s for a, b in windows.values() for x in (a, b + 1)})
    calendar, member = [], []
    for seg, (start, end) in enumerate(zip(edges, edges[1:])):
        within = [(t0, *(t0 + dt.timedelta(a) <= start and end <= t0 + dt.timedelta(b + 1) for a, b in windows.values())) for t0 in t0s]
        within = [(seg, *w) for w in within if any(w[1:])]
        if within:
            member += within
            calendar += [(start + dt.timedelta(d), seg) for d in range((end - start).days)]
    return calendar, member


def windowed(charts: DataFrame, cohorts: DataFrame, windows: dict[str, tuple[int, int]], top_n: int) -> DataFrame:
    """(market, store, app_id, t0, one struct for each window) of every app of every chart with a row in some window of t0.

    Each struct has n, total, squares (of all ranks, whole numbers), best (least rank), last (best rank of the last day) and
    high (days within top_n). n and high are 0 and the others null where the window has no row.

    A chart row meets its segment by its day, once, whatever the number of dates; rows are shuffled once, by
    market, store and app, and summed by day, then segment, then window, all within that partitioning. Decision dates
    are a few dozen (they reach the driver): segments are at most two for each date and window.
    """
    spark = charts.sparkSession
    t0s = sorted(r["t0"] for r in cohorts.select("t0").distinct().where("t0 is not null").collect())
    calendar, member = segments(t0s, windows)
    days = spark.createDataFrame(calendar, "day date, seg int")
    served = spark.createDataFrame(member, f"seg int, t0 date, {', '.join(f'in_{w} boolean' for w in windows)}")
    key = ["market", "store", "app_id"]
    rows = charts.select(*key, "day", F.col("rank").cast("long").alias("rank"))
    if calendar:
        rows = rows.where(F.col("day").between(F.lit(calendar[0][0]), F.lit(calendar[-1][0])))
    rows = rows.join(F.broadcast(days), "day").repartition(*key)
    daily = rows.groupBy(*key, "seg", "day").agg(F.count("rank").alias("n"), F.sum("rank").alias("total"), F.sum(F.col("rank") * F.col("rank")).alias("squares"), F.min("rank").alias("best"))
    parts = daily.groupBy(*key, "seg").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.min("best").alias("best"),
        F.max_by("best", "day").alias("last"), F.max("day").alias("last_day"), F.count_if(F.col("best") <= top_n).alias("high"),
    )
    own = parts.join(F.broadcast(served), "seg")

    def stats(w: str):
        there = F.col(f"in_{w}")
        only = lambda c: F.when(there, F.col(c))
        none = F.lit(0).cast("long")
        return F.struct(
            F.coalesce(F.sum(only("n")), none).alias("n"), F.sum(only("total")).alias("total"), F.sum(only("squares")).alias("squares"), F.min(only("best")).alias("best"),
            F.max_by("last", only("last_day")).alias("last"), F.coalesce(F.sum(only("high")), none).alias("high"),
        ).alias(w)

    return own.groupBy(*key, "t0").agg(*[stats(w) for w in windows])


def deviation(window: str):
    """Population deviation of a window's ranks, from whole sums; null without rows."""
    n, total, squares = (F.col(f"{window}.{c}") for c in ("n", "total", "squares"))
    return F.when(n > 0, F.sqrt((n * squares - total * total).cast("double")) / n)


def chart_ends(charts: DataFrame) -> DataFrame:
    """(market, store, last_day) of each chart."""
    return charts.groupBy("market", "store").agg(F.max("day").alias("last_day"))
