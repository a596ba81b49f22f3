"""Composite of an app's sub-scores, and opportunities from signals and unit economics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwright.functions import exprs as X
from chartwright.operators.backtest import as_of
from chartwright.operators.signals import unit_economics

SIGNALS = ("locGap", "velocity", "incumbent_vulnerability", "cpi_ltv_proxy")


def composite_scores(apps: DataFrame, preset: str = "subscription") -> DataFrame:
    """Apps (description, market, rating, ratings_count, iap_present, velocity) with gap, revenue, paywall, composite,
    eligible, and a participation flag for each sub-score.

    composite: the mean of the three largest sub-scores, clamped to 0..10, and 0 where fewer are there.
    """
    scored = apps.withColumns({
        "gap": X.localization_gap(F.col("description"), X.expected_language(F.col("market"))),
        "revenue": X.revenue_proxy(F.col("rating"), F.col("ratings_count"), X.market_weight(F.col("market"), preset)),
        "paywall": X.paywall_score(F.col("description"), F.col("iap_present")),
    })
    names = ("gap", "revenue", "paywall", "velocity")
    top = X.top3_mean([F.col(n) for n in names])
    flags = {f"uses_{n}": flag for n, flag in zip(names, X.participation(*[F.col(n) for n in names]), strict=True)}
    return scored.withColumns({"composite": X.clamp(F.coalesce(top, F.lit(0.0)), 0, 10), "eligible": top.isNotNull(), **flags})


def opportunities(requests: DataFrame, signals: DataFrame, budget: float = 500.0) -> DataFrame:
    """requests (source_app_id, target_market, category, t0) with the latest values of SIGNALS known at t0, the predicted
    ranges and budget, score, eligible, and a sentence.

    The unit-economics score comes from the (category, market) estimate and takes the place of any stored one.
    """
    asked = unit_economics(requests.withColumnRenamed("target_market", "market")).withColumnRenamed("market", "target_market")
    stored = tuple(s for s in SIGNALS if s != "cpi_ltv_proxy")
    cohort = requests.select(F.col("source_app_id").alias("app_id"), "t0").distinct()
    known = as_of(cohort, signals.where(F.col("signal_name").isin(*stored)), "skip").groupBy("app_id", "t0").pivot("signal_name", list(stored)).agg(F.first("value"))
    out = asked.withColumnRenamed("economics", "cpi_ltv_proxy").join(known.withColumnRenamed("app_id", "source_app_id"), ["source_app_id", "t0"], "left")
    score = X.top3_mean([F.col(s) for s in SIGNALS])
    n = F.aggregate(F.array(*X.participation(*[F.col(s) for s in SIGNALS])), F.lit(0), lambda a, x: a + x)
    said = F.when(
        score.isNotNull(),
        F.format_string("Opportunity score %.2f/10 for %s to %s (%s), from %d signals.", score, F.col("source_app_id").cast("string"), "target_market", "category", n),
    ).otherwise(F.format_string("Fewer than three signals for %s to %s.", F.col("source_app_id").cast("string"), "target_market"))
    return out.withColumns({"budget": F.lit(float(budget)), "score": score, "eligible": score.isNotNull(), "thesis": said})
