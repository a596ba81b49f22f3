"""Durable-winner shortlist: durability, rollup, joins with drop accounting, score, risk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartwright.functions import fixed
from chartwright.functions.exprs import clonability_tier, shortlist_parts
from chartwright.functions.exprs import fixed_text as fixed_places


def chart_window(charts: DataFrame, start: str, end: str, top_n: int = 100, category: str | None = None, markets: list[str] | None = None) -> DataFrame:
    """Chart rows of a category and markets (None: of all) within top_n and from start to end, both included."""
    inside = charts.where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & (F.col("rank") <= top_n))
    if category is not None:
        inside = inside.where(F.col("category") == category)
    return inside if markets is None else inside.where(F.col("market").isin(*markets))


def durability(charts: DataFrame, start: str, end: str, recent_days: int, least_days: int, top_n: int = 100, category: str | None = None, markets: list[str] | None = None) -> DataFrame:
    """(app_id, store, market, tenure_days, best_rank, recent_rows) of apps charted on least_days distinct days."""
    inside = chart_window(charts, start, end, top_n, category, markets)
    recent = F.col("day") >= F.date_sub(F.lit(end).cast("date"), recent_days)
    rows = inside.groupBy("app_id", "store", "market").agg(
        F.countDistinct("day").alias("tenure_days"), F.min("rank").alias("best_rank"), F.sum(F.when(recent, 1).otherwise(0)).alias("recent_rows")
    )
    return rows.where(F.col("tenure_days") >= least_days)


def rollup(durable: DataFrame) -> DataFrame:
    """One row for each (app_id, store), markets sorted."""
    return durable.groupBy("app_id", "store").agg(
        F.sort_array(F.collect_list("market")).alias("markets"),
        F.max("tenure_days").alias("tenure_max"),
        F.sum("tenure_days").alias("tenure_total"),
        F.min("best_rank").alias("best_rank"),
        F.max("recent_rows").alias("recent_rows"),
    )


def publisher_sizes(invariants: DataFrame) -> DataFrame:
    """(publisher_id, store, publisher_apps): a publisher's apps in each store."""
    return invariants.where("publisher_id is not null").groupBy("publisher_id", "store").agg(F.count("*").alias("publisher_apps"))


def stages(rolled: DataFrame, metadata: DataFrame, invariants: DataFrame, least_markets: int, auto: tuple[str, ...] = fixed.AUTO_CLASSES, review: tuple[str, ...] = fixed.REVIEW_CLASSES) -> DataFrame:
    """Every rolled-up pair with the first reason to drop it, null if it stays: spread, no_meta, no_pub, not_clonable.

    metadata and invariants have a row at most for each (app_id, store); a null class can't be cloned.
    """
    pubs = invariants.select("app_id", "store", "publisher_id").join(publisher_sizes(invariants), ["publisher_id", "store"], "left")
    meta = metadata.select("app_id", "store", "dna_class", "has_subscription", F.lit(True).alias("listed"))
    tier = clonability_tier(F.col("dna_class"), auto, review)
    reason = (
        F.when(F.size("markets") < least_markets, "spread")
        .when(F.col("listed").isNull(), "no_meta")
        .when(F.col("publisher_id").isNull(), "no_pub")
        .when(tier == "NOT", "not_clonable")
    )
    out = rolled.join(meta, ["app_id", "store"], "left").join(pubs, ["app_id", "store"], "left")
    return out.withColumns({"tier": tier, "drop_reason": reason, "publisher_apps": F.coalesce("publisher_apps", F.lit(1))}).drop("listed")


def scored(staged: DataFrame, total_markets: int) -> DataFrame:
    parts = shortlist_parts(F.col("tenure_max"), F.size("markets"), total_markets, F.col("recent_rows"), F.col("best_rank"), F.col("publisher_apps"))
    total = sum(parts.values(), F.lit(0.0))
    return staged.where("drop_reason is null").withColumn("parts", F.struct(*[v.alias(k) for k, v in parts.items()])).withColumn("score", F.round(total, 6))


def top(candidates: DataFrame, n: int) -> DataFrame:
    """The first n by score, ties by app and store, with their position."""
    best = candidates.orderBy(F.desc("score"), "app_id", "store").limit(n)
    return best.withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "app_id", "store")).cast("long"))


def funnel(staged: DataFrame) -> DataFrame:
    return staged.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("stage")).agg(F.count("*").alias("n"))


def classifier_verdicts(candidates: DataFrame, verdicts: DataFrame | None, keys: list[str]) -> DataFrame:
    """Candidates with `hypothesis`, the first line of a classifier's answer cut to 200, and `verdict`.

    verdicts: (*keys, answer). CLONE keeps a candidate, SKIP drops it, any other or no answer is UNPARSED and keeps
    it. Without verdicts all are kept.
    """
    if verdicts is None:
        return candidates.withColumns({"hypothesis": F.lit(None).cast("string"), "verdict": F.lit("CLONE")})
    first = F.substring(F.substring_index(F.trim("answer"), "\n", 1), 1, 200)
    out = candidates.join(verdicts.select(*keys, first.alias("hypothesis")), keys, "left")
    h = F.coalesce("hypothesis", F.lit(""))
    return out.withColumn("verdict", F.when(h.startswith("CLONE:"), "CLONE").when(h.startswith("SKIP:"), "SKIP").otherwise("UNPARSED"))


def classify_rows(candidates: DataFrame, prompt: Column, classify) -> DataFrame:
    """Candidates with `answer`: classify(list of prompts) -> list of texts, called once for each Arrow batch in a task."""
    import pandas as pd

    def run(prompts):
        return pd.Series(classify(prompts.tolist()), dtype=object)

    run.__annotations__ = {"prompts": pd.Series, "return": pd.Series}
    return candidates.withColumn("answer", F.pandas_udf(run, "string")(prompt))


def kept(judged: DataFrame) -> DataFrame:
    return judged.where("verdict <> 'SKIP'")


def csv_rows(candidates: DataFrame) -> DataFrame:
    """The shortlist's CSV columns as text: rank, score and its parts in fixed places, markets between bars, 200 characters
    of the description. Columns that candidates lack are empty."""
    w = Window.orderBy(F.desc("score"), "app_id", "store")  # a shortlist has final_size rows
    have = set(candidates.columns)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    names = (("tenure", "tenure", 0.30), ("spread", "spread", 0.20), ("recent", "recency", 0.20), ("rank", "rank", 0.15), ("focus", "indie", 0.15))
    parts = [fixed_places(F.col(f"parts.{p}") / share, 3).alias(f"score_{n}") for p, n, share in names]  # before their weights
    return candidates.select(
        F.row_number().over(w).cast("string").alias("rank"), fixed_places(F.col("score"), 4).alias("score"), *parts, text("app_id").alias("app_id"), text("store").alias("store"), text("title").alias("title"),
        text("dna_class").alias("dna_class"), text("dna_subclass").alias("dna_subclass"), text("tier").alias("clonability_tier"), text("publisher_name").alias("publisher_name"), text("publisher_apps").alias("publisher_app_count"),
        F.array_join("markets", "|").alias("markets_active"), text("tenure_max").alias("tenure_days_max"), text("best_rank").alias("best_rank"), text("recent_rows").alias("recent_30d_days"),
        F.when(F.col("has_subscription"), "1").otherwise("0").alias("has_subscription_iap"), text("iap_count").alias("iap_count"), text("icon").alias("icon_url"), text("subtitle").alias("subtitle"),
        F.substring(text("description"), 1, 200).alias("description_short"), text("hypothesis").alias("clonability_hypothesis"),
    )


@dataclass(frozen=True)
class RiskThresholds:
    least_markets: int = 3
    least_tenure: int = 180
    needs_subscription: bool = False
    supported_markets: tuple[str, ...] = fixed.SUPPORTED_MARKETS
    clonable_classes: tuple[str, ...] = (*fixed.AUTO_CLASSES, *fixed.REVIEW_CLASSES)

    def __post_init__(self):
        if not 1 <= self.least_markets <= 10 or not 0 <= self.least_tenure <= 365:
            raise ValueError("least_markets must be in 1..10 and least_tenure in 0..365")
        if any(len(m) < 2 for m in self.supported_markets):
            raise ValueError("a supported market needs a code")


DEFAULT_RISK_THRESHOLDS = RiskThresholds()
RISK_CHECKS = ("markets_spread", "tenure", "subscription_iap", "supported_markets", "clonable_dna")


def _check(name: str, status: Column, details: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), status.alias("status"), details.alias("details"))


def evaluate_shortlist(candidates: DataFrame, t: RiskThresholds = DEFAULT_RISK_THRESHOLDS) -> DataFrame:
    """Candidates (markets, tenure_max, has_subscription, dna_class) with `checks` (name, status, details) and `overall`:
    FAIL over WARN over PASS, INFO ignored."""
    n, days, dna = F.size("markets"), F.col("tenure_max"), F.col("dna_class")
    supported = F.array(*[F.lit(m.lower()) for m in t.supported_markets]).cast("array<string>")
    active = F.transform("markets", lambda m: F.lower(m))
    outside = F.filter(active, lambda m: ~F.array_contains(supported, m))
    listed = F.concat(F.lit(" (outside: "), F.array_join(outside, ", "), F.lit(")"))
    all_in, none_in = F.size(outside) == 0, F.size(outside) == n
    enough, durable, clonable = n >= t.least_markets, days >= t.least_tenure, F.coalesce(dna.isin(*t.clonable_classes), F.lit(False))
    passed = lambda ok: F.when(ok, "PASS").otherwise("FAIL")
    checks = F.array(
        _check("markets_spread", passed(enough), F.format_string("%d markets %s %d required", n, F.when(enough, ">=").otherwise("<"), F.lit(t.least_markets))),
        _check("tenure", passed(durable), F.format_string("%dd %s %dd", days, F.when(durable, ">=").otherwise("<"), F.lit(t.least_tenure))),
        _check("subscription_iap", passed(F.col("has_subscription")), F.when(F.col("has_subscription"), "subscription IAP present").otherwise("subscription IAP required but absent"))
        if t.needs_subscription
        else _check("subscription_iap", F.lit("INFO"), F.lit("subscription IAP not required")),
        _check(
            "supported_markets",
            F.when(n == 0, "FAIL").when(all_in, "PASS").when(none_in, "FAIL").otherwise("WARN"),
            F.when(n == 0, "candidate has no active markets")
            .when(all_in, F.format_string("all %d markets in supported set", n))
            .when(none_in, F.concat(F.format_string("none of %d markets in supported set", n), listed))
            .otherwise(F.concat(F.format_string("%d/%d markets in supported set", n - F.size(outside), n), listed)),
        ),
        _check(
            "clonable_dna",
            passed(clonable),
            F.when(clonable, F.concat(dna, F.lit(" in clonable set"))).when(F.coalesce(dna, F.lit("")) == "", "dna_class is null").otherwise(F.concat(dna, F.lit(" not in clonable set"))),
        ),
    )
    out = candidates.withColumn("checks", checks)
    seen = F.transform("checks", lambda c: c["status"])
    return out.withColumn("overall", F.when(F.array_contains(seen, "FAIL"), "FAIL").when(F.array_contains(seen, "WARN"), "WARN").otherwise("PASS"))


def check_status(name: str) -> Column:
    """The status of one check of evaluate_shortlist() rows."""
    return F.filter("checks", lambda c: c["name"] == name)[0]["status"]


def risk_csv_rows(checked: DataFrame) -> DataFrame:
    """The risk report's CSV columns as text, one for each check."""
    w = Window.orderBy(F.desc("score"), "app_id", "store")  # a shortlist has final_size rows
    have = set(checked.columns)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    return checked.select(
        F.row_number().over(w).cast("string").alias("rank"), text("app_id").alias("app_id"), text("store").alias("store"), text("title").alias("title"), fixed_places(F.col("score"), 4).alias("score"), text("dna_class").alias("dna_class"),
        text("publisher_name").alias("publisher_name"), F.array_join("markets", "|").alias("markets_active"), text("tenure_max").alias("tenure_days_max"), text("best_rank").alias("best_rank"),
        F.when(F.col("has_subscription"), "1").otherwise("0").alias("has_subscription_iap"), text("iap_count").alias("iap_count"), F.col("overall").alias("risk_overall"), *[check_status(n).alias(f"risk_{n}") for n in RISK_CHECKS],
    )


def risk_summary(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count("*").alias("total"), *[F.count_if(F.col("overall") == s.upper()).alias(s) for s in ("pass", "warn", "fail")])


def evaluate_candidate(candidates: DataFrame, app_id: int, store: str, t: RiskThresholds = DEFAULT_RISK_THRESHOLDS) -> DataFrame:
    return evaluate_shortlist(find_candidate(candidates, app_id, store), t)


def parse_candidate_ref(ref: str) -> tuple[str, str]:
    """app_id:store; the last colon splits."""
    app_id, colon, store = ref.rpartition(":")
    if not colon or not app_id or not store:
        raise ValueError(f"not an app_id:store reference: {ref!r}")
    return app_id, store


def find_candidate(candidates: DataFrame, app_id, store: str) -> DataFrame:
    return candidates.where((F.col("app_id") == app_id) & (F.col("store") == store))
