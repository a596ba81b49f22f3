"""Data audit: one row for each check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEVERITY = {"PASS": 0, "WARN": 1, "FAIL": 2}


def chart_coverage(charts: DataFrame) -> DataFrame:
    return charts.groupBy("market", "store").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.countDistinct("day").alias("days"), F.count("*").alias("n_rows"))


def coverage_verdicts(charts: DataFrame, markets: DataFrame, passing: int = 300, warning: int = 200) -> DataFrame:
    """(market, days, status) on the union of days over stores; a market without rows fails."""
    days = charts.select("market", "day").distinct().groupBy("market").agg(F.count("*").alias("days"))
    out = markets.select("market").join(days, "market", "left").withColumn("days", F.coalesce("days", F.lit(0)))
    return out.withColumn("status", F.when(F.col("days") >= passing, "PASS").when(F.col("days") >= warning, "WARN").otherwise("FAIL"))


def _row(df: DataFrame, name: str, status, detail) -> DataFrame:
    return df.select(F.lit(name).alias("check_name"), status.alias("status"), detail.cast("string").alias("detail"))


def audit(charts: DataFrame, invariants: DataFrame, signals: DataFrame, markets: DataFrame, now: str, deepest: int = 100, least_apps: int = 500, warn_apps: int = 1000) -> DataFrame:
    """(check_name, status, detail) of coverage, ranks, staleness, signal inventory, invariant coverage."""
    worst = lambda df: F.max(F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0))
    named = lambda c: F.element_at(F.array(F.lit("PASS"), F.lit("WARN"), F.lit("FAIL")), c + 1)
    verdicts = coverage_verdicts(charts, markets)
    coverage = verdicts.agg(F.coalesce(worst(verdicts), F.lit(2)).alias("w"), F.min("days").alias("d"))
    ranks = charts.agg(F.max("rank").alias("m"))
    stale = charts.agg(F.datediff(F.lit(now).cast("date"), F.max("day")).alias("d"))
    inv = invariants.agg(F.count("*").alias("n"), F.count("publisher_id").alias("p"), F.count("release_day").alias("r"))
    share = F.least("p", "r") / F.col("n")
    checks = [
        _row(coverage, "chart_coverage", named(F.col("w").cast("int")), F.col("d")),
        _row(ranks, "rank_range", F.when(F.col("m").isNull() | (F.col("m") > deepest), "WARN").otherwise("PASS"), F.col("m")),
        _row(stale, "recent_data", F.when(F.col("d") <= 30, "PASS").when(F.col("d") <= 90, "WARN").otherwise("FAIL"), F.col("d")),
        _row(signals.agg(F.countDistinct("signal_name").alias("n")), "signal_inventory", F.lit("PASS"), F.col("n")),
        _row(inv, "invariant_coverage", F.when(F.col("n") < least_apps, "FAIL").when((F.col("n") < warn_apps) | (share < 0.7), "WARN").otherwise("PASS"), F.col("n")),
    ]
    return reduce(DataFrame.unionByName, checks)


def signal_inventory(signals: DataFrame) -> DataFrame:
    return signals.groupBy("signal_name").agg(F.count("*").alias("n_rows"), F.count("value").alias("n_values"))


def metadata_point_in_time(metadata: DataFrame, key: list[str], version_day: str, first_groups: int | None = None) -> DataFrame:
    """(status, n_groups, varying): whether repeated records of a key ever differ in their last release.

    first_groups: only so many repeated keys, the first in order. WARN if no key repeats or none varies.
    """
    groups = metadata.groupBy(*key).agg(F.count("*").alias("n"), F.countDistinct(version_day).alias("k")).where("n >= 2")
    if first_groups is not None:
        groups = groups.orderBy(*key).limit(first_groups)
    out = groups.agg(F.count("*").alias("n_groups"), F.count_if(F.col("k") > 1).alias("varying"))
    return out.withColumn("status", F.when(F.col("varying") > 0, "PASS").otherwise("WARN"))


def market_coverage(expected: DataFrame, probe: DataFrame, errors: DataFrame, keys: list[str], price: float = 0.0) -> DataFrame:
    """(*keys, has_data, n_apps, error, cost) of every expected market: apps charted on the probe day, what went wrong, and
    the price of the call where one was answered or failed."""
    apps = probe.groupBy(*keys).agg(F.countDistinct("app_id").alias("n_apps"))
    failed = errors.groupBy(*keys).agg(F.min("error").alias("error"))
    out = expected.join(apps, keys, "left").join(failed, keys, "left").withColumn("n_apps", F.coalesce("n_apps", F.lit(0)))
    asked = (F.col("n_apps") > 0) | F.col("error").isNotNull()
    return out.select(*keys, (F.col("n_apps") > 0).alias("has_data"), "n_apps", "error", F.when(asked, float(price)).otherwise(0.0).alias("cost"))
