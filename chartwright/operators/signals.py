"""Per-app signals: momentum, volatility, rating trend, vulnerability, unit economics, composite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartwright.functions import fixed
from chartwright.functions.exprs import clamp, finite, improvement_score, ratio_score


def smoothed(series: DataFrame, key: list[str], t: str, value: str, threshold: int = 80) -> DataFrame:
    """Without interior spikes: more than `threshold` off both original neighbours, on the same side of both."""
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    w = Window.partitionBy(*key).orderBy(t)
    before, after = F.col(value) - F.lag(value).over(w), F.lead(value).over(w) - F.col(value)
    spike = (F.abs(before) > threshold) & (F.abs(after) > threshold) & (F.signum(before) != F.signum(after))
    return series.withColumn("__spike", F.coalesce(spike, F.lit(False))).where("not __spike").drop("__spike")


def velocity_v1(charts: DataFrame, now: str, days: int = 30, deepest: int = 200, least: int = 7, threshold: int = 80) -> DataFrame:
    """(app_id, points, first_rank, last_rank, velocity) over the best rank of each day, markets and stores pooled."""
    inside = charts.where(F.col("day").between(F.date_sub(F.lit(now).cast("date"), days), F.lit(now).cast("date")) & (F.col("rank") <= deepest))
    best = inside.groupBy("app_id", "day").agg(F.min("rank").alias("rank"))
    enough = best.withColumn("n", F.count("*").over(Window.partitionBy("app_id"))).where(F.col("n") >= least)
    out = smoothed(enough, ["app_id"], "day", "rank", threshold).groupBy("app_id").agg(F.count("*").alias("points"), F.min_by("rank", "day").alias("first_rank"), F.max_by("rank", "day").alias("last_rank"))
    return out.where(F.col("points") >= least).withColumn("velocity", F.round(improvement_score(F.col("first_rank") - F.col("last_rank")), 6))


def legacy_velocity(daily: DataFrame, as_of: str, days: int) -> DataFrame:
    """(app_id, velocity) of daily (app_id, day, rank, ratings); null unless every day is there."""
    inside = daily.where(F.col("day").between(F.date_sub(F.lit(as_of).cast("date"), days - 1), F.lit(as_of).cast("date")))
    out = inside.groupBy("app_id").agg(
        F.count("*").alias("n"), F.min_by("rank", "day").alias("r0"), F.max_by("rank", "day").alias("r1"), F.min_by("ratings", "day").alias("c0"), F.max_by("ratings", "day").alias("c1")
    )
    rank_part = F.coalesce(clamp((F.col("r0") - F.col("r1")) / 50 * 10, 0, 10), F.lit(0.0))
    count_part = F.coalesce(clamp((F.col("c1") - F.col("c0")) / days / F.greatest("c0", F.lit(100)) * 1000, 0, 10), F.lit(0.0))
    return out.select("app_id", F.when(F.col("n") >= days, F.round(0.6 * rank_part + 0.4 * count_part, 6)).alias("velocity"))


def volatility(charts: DataFrame, now: str, days: int = 90) -> DataFrame:
    """(app_id, rank_sd, retention, instability): population deviation of rank; under three rows null."""
    inside = charts.where(F.col("day").between(F.date_sub(F.lit(now).cast("date"), days), F.lit(now).cast("date")))
    sd = F.when(F.count("*") >= 3, F.stddev_pop("rank"))
    out = inside.groupBy("app_id").agg(sd.alias("sd"))
    return out.select("app_id", F.round("sd", 6).alias("rank_sd"), F.round(clamp(1 - F.col("sd") / 50, 0, 1), 6).alias("retention"), F.round(clamp(F.col("sd") / 50 * 10, 0, 10), 6).alias("instability"))


def rating_trend(reviews: DataFrame, now: str, days: int = 90) -> DataFrame:
    """(app_id, n_reviews, slope, trend): falling ratings to 0..10; under three reviews null, all at one time 0."""
    x = F.datediff(F.col("ts").cast("date"), F.lit(now).cast("date")).cast("double")
    inside = reviews.where((F.col("ts") <= F.lit(now).cast("timestamp")) & (F.col("ts") >= F.date_sub(F.lit(now).cast("date"), days)))
    out = inside.withColumn("x", x).groupBy("app_id").agg(F.count("*").alias("n_reviews"), F.regr_slope("rating", "x").alias("s"), F.var_pop("x").alias("v"))
    slope = F.when(F.col("n_reviews") < 3, None).when(F.col("v") == 0, 0.0).otherwise(F.col("s") * days)
    return out.select("app_id", "n_reviews", F.round(slope, 4).alias("slope"), F.round(F.least(F.lit(10.0), F.greatest(F.lit(0.0), -slope) * 10), 4).alias("trend"))


def vulnerability(staleness: DataFrame, trend: DataFrame) -> DataFrame:
    """(app_id, vulnerability): 0.6 staleness + 0.4 trend, null if either is."""
    both = staleness.join(trend.select("app_id", "trend"), "app_id", "full_outer")
    return both.select("app_id", F.round(0.6 * clamp(F.col("stale_days") / 365 * 10, 0, 10) + 0.4 * F.col("trend"), 4).alias("vulnerability"))


def chart_vulnerability(charts: DataFrame, now: str, days: int = 90, version: str = "chart-stability") -> DataFrame:
    """(app_id, vulnerability, version): the chart-only form, rank deviation over 50 to 0..10; null under three rows."""
    return volatility(charts, now, days).select("app_id", F.col("instability").alias("vulnerability"), F.lit(version).alias("version"))


def economics_seed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fixed.ECONOMICS_SEED), "market string, category string, cpi_low double, cpi_high double, ltv_low double, ltv_high double")


def category_family(spark: SparkSession) -> DataFrame:
    """(category, sibling, priority): whose estimate stands in for a category's, in order."""
    rows = [(c, s, i + 1) for c, siblings in fixed.CATEGORY_FAMILY.items() for i, s in enumerate(siblings)]
    return spark.createDataFrame(rows, "category string, sibling string, priority int")


def unit_economics(requests: DataFrame, seed: DataFrame | None = None, family: DataFrame | None = None) -> DataFrame:
    """Requests (market, category, ...) with the ratio of value over cost, its score `economics`, the ranges it comes
    from, and is_fallback: the category's own estimate, else the family's first one that the market has. Null if none."""
    spark = requests.sparkSession
    seed = economics_seed(spark) if seed is None else seed
    family = category_family(spark) if family is None else family
    asked = requests.select(F.lower("market").alias("m"), F.lower("category").alias("c")).distinct()
    chain = asked.select("m", "c", F.col("c").alias("sibling"), F.lit(0).alias("priority"))
    chain = chain.unionByName(asked.join(family, F.col("c") == F.col("category")).select("m", "c", "sibling", "priority"))
    ranges = ("cpi_low", "cpi_high", "ltv_low", "ltv_high")
    found = chain.join(seed.select(F.lower("market").alias("m"), F.lower("category").alias("sibling"), *ranges), ["m", "sibling"])
    best = found.groupBy("m", "c").agg(F.min_by(F.struct(*ranges, "priority"), "priority").alias("b"))
    cost, value = finite(F.col("b.cpi_low") + F.col("b.cpi_high")), finite(F.col("b.ltv_low") + F.col("b.ltv_high"))
    ratio = F.when(cost > 0, value / cost)
    out = requests.join(best, (F.lower(requests["market"]) == F.col("m")) & (F.lower(requests["category"]) == F.col("c")), "left")
    return out.select(
        *[requests[c] for c in requests.columns], F.round(ratio, 6).alias("ratio"), F.round(F.when(ratio <= 0, 0.0).otherwise(ratio_score(ratio)), 6).alias("economics"),
        *[F.col(f"b.{r}").alias(r) for r in ranges], (F.col("b.priority") > 0).alias("is_fallback"),
    )


def signal_grid(charts: DataFrame, pool: DataFrame, scores: DataFrame | None = None, days: int = 30, weak_days: int = 90, deepest: int = 200, least: int = 7, threshold: int = 80) -> DataFrame:
    """(app_id, t0, signal_name, value) of every candidate of the pool (market, t0, app_id), asked once for each date:
    velocity as velocity_v1() has it at t0, the chart-only vulnerability, and winner_score from scores (app_id, score) where
    given. A value that can't be computed is a row with null.

    One pass for any number of dates: an app's days, each with its best rank and its sums over all charts, lie in one array
    in order (a calendar's length at most), and each date reads its windows from it.
    """
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    asked = pool.select("app_id", "t0").distinct()
    span = asked.agg(F.date_sub(F.min("t0"), max(days, weak_days)).alias("low"), F.max("t0").alias("high")).first()
    rows = charts.select("app_id", "day", F.col("rank").cast("long").alias("rank")).where(F.col("day").between(F.lit(span["low"]), F.lit(span["high"])))
    daily = rows.groupBy("app_id", "day").agg(F.min(F.when(F.col("rank") <= deepest, F.col("rank"))).alias("best"), F.count("rank").alias("n"), F.sum("rank").alias("total"), F.sum(F.col("rank") * F.col("rank")).alias("squares"))
    series = daily.groupBy("app_id").agg(F.array_sort(F.collect_list(F.struct("day", "best", "n", "total", "squares"))).alias("series"))
    dates = asked.groupBy("app_id").agg(F.collect_set("t0").alias("t0s"))
    days_ = F.coalesce("series", F.array().cast(series.schema["series"].dataType))

    def velocity(t0):
        near = F.filter(days_, lambda x: x["day"].between(F.date_sub(t0, days), t0) & x["best"].isNotNull())

        def spike(all_, x, i):
            before, after = x["best"] - F.get(all_, i - 1)["best"], F.get(all_, i + 1)["best"] - x["best"]
            return F.coalesce((F.abs(before) > threshold) & (F.abs(after) > threshold) & (F.signum(before) != F.signum(after)), F.lit(False))

        def of(all_):
            kept = F.filter(all_, lambda x, i: ~spike(all_, x, i))
            return F.transform(F.array(kept), lambda k: F.when((F.size(all_) >= least) & (F.size(k) >= least), F.round(improvement_score(F.get(k, F.lit(0))["best"] - F.get(k, F.size(k) - 1)["best"]), 6)))[0]

        return F.transform(F.array(near), of)[0]

    def weakness(t0):
        near = F.filter(days_, lambda x: x["day"].between(F.date_sub(t0, weak_days), t0))
        zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("n", "total", "squares")])
        sums = F.aggregate(near, zero, lambda s, x: F.struct(*[(s[c] + x[c]).alias(c) for c in ("n", "total", "squares")]))
        sd = lambda s: F.sqrt((s["n"] * s["squares"] - s["total"] * s["total"]).cast("double")) / s["n"]
        return F.transform(F.array(sums), lambda s: F.when(s["n"] >= 3, F.round(clamp(sd(s) / 50 * 10, 0, 10), 6)))[0]

    found = dates.join(series, "app_id", "left").select("app_id", F.inline(F.transform("t0s", lambda t: F.struct(t.alias("t0"), velocity(t).alias("velocity"), weakness(t).alias("weakness")))))
    named = [("velocity", "velocity"), ("incumbent_vulnerability", "weakness")]
    if scores is not None:
        found, named = found.join(scores.select("app_id", F.col("score").cast("double").alias("score")), "app_id", "left"), [*named, ("winner_score", "score")]
    return found.select("app_id", "t0", F.inline(F.array(*[F.struct(F.lit(n).alias("signal_name"), F.col(c).cast("double").alias("value")) for n, c in named])))
