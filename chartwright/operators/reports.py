"""Rows and texts for readers: ranking, gates, usage, opportunity rows, dossiers, audit and cohort reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartwright.operators.backtest import lift

from chartwright.functions.exprs import fill_template, finite
from chartwright.sources import scratch

# Bands of cited estimates and their scores; dollars of a million tokens in and out of a model with no price.
BANDS = {"low": 2.0, "mid": 5.0, "high": 8.0}
DEFAULT_PRICE = (3.0, 15.0)
DOSSIER = "# {{app_id}} on {{store}}\nMarkets: {{markets}}\nClass: {{dna_class}} ({{tier}})\nSubscription: {{has_subscription}}\nScore: {{score}}\n{{unknown}}"


def judge_confidence(*confidences: Column) -> Column:
    """Mean of the confidences that are there; 0 if none is."""
    there = F.filter(F.array(*[finite(c.cast("double")) for c in confidences]), lambda x: x.isNotNull())
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there)).otherwise(0.0)


def ranked(candidates: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """The first n candidates with their position: composite, mean judge confidence and number of ratings
    descending (missing: last), then the key columns. The rest is cut before positions are given."""
    order = [F.desc_nulls_last("composite"), F.desc("confidence"), F.desc(F.coalesce("ratings_count", F.lit(0))), *keys]
    best = candidates.orderBy(*order).limit(n)
    return best.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long"))


def batches(rows: DataFrame, cell: list[str], order: list[str], size: int = 5) -> DataFrame:
    """Rows with `batch`: consecutive groups of `size` within a cell."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*cell).orderBy(*order)) - 1) / size).cast("long"))


def cited_scores(claims: DataFrame) -> DataFrame:
    """claims (band, url, quote) with `value`: the band's score if band, address and quote (20 characters) hold,
    else null; the provenance stays."""
    band = F.lower(F.trim("band"))
    score = F.coalesce(*[F.when(band == k, v) for k, v in BANDS.items()])
    cited = F.col("url").rlike("^https?://[^/ ]+") & (F.length("quote") >= 20)
    return claims.withColumn("value", F.when(cited, score))


def judge_violations(results: DataFrame) -> DataFrame:
    """results with the names of the rules each row breaks; none: valid.

    Columns: kind (text or vision), app_id, store, market, score, reasoning, confidence, model_version, flags (four
    booleans for text, three for vision), and for vision freshness and screenshots_analyzed.
    """
    vision, long = F.col("kind") == "vision", lambda c, low, high: F.length(c).between(low, high)
    rules = {
        "kind": F.col("kind").isin("text", "vision"),
        "app_id": F.length("app_id") >= 1,
        "store": F.col("store").isin("apple", "google"),
        "market": F.length("market") == 2,
        "score": finite(F.col("score")).between(0, 10),
        "reasoning": long("reasoning", 1, 600),
        "confidence": finite(F.col("confidence")).between(0, 1),
        "model_version": F.length("model_version") >= 1,
        "flags": (F.size("flags") == F.when(vision, 3).otherwise(4)) & ~F.exists("flags", lambda f: f.isNull()),
        "freshness": ~vision | F.col("freshness").isin("fresh", "stale", "unknown"),
        "screenshots_analyzed": ~vision | (F.col("screenshots_analyzed") >= 1),
    }
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
    return results.withColumn("violations", broken)


def usage(calls: DataFrame, cap: float, prices: dict[str, tuple[float, float]], default: tuple[float, float] = DEFAULT_PRICE) -> DataFrame:
    """(model, calls, tokens_in, tokens_out, cost, share) of calls (model, tokens_in, tokens_out); prices are dollars of a
    million tokens in and out by model, `default` for others; share is the cost over the cap."""

    def price(place: int) -> Column:
        return F.coalesce(*[F.when(F.col("model") == k, v[place]) for k, v in prices.items()], F.lit(default[place]))

    out = calls.groupBy("model").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    cost = (F.col("tokens_in") * price(0) + F.col("tokens_out") * price(1)) / 1e6
    return out.withColumn("cost", F.round(cost, 6)).withColumn("share", F.round(F.col("cost") / cap, 6))


def usage_total(by_model: DataFrame, cap: float) -> DataFrame:
    """One row (models, calls, cost, cap, left, over) of usage() rows: what is left of the cap, and whether it's exceeded."""
    out = by_model.agg(F.count("*").alias("models"), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("cost"))
    return out.select("*", F.lit(float(cap)).alias("cap"), F.round(F.greatest(F.lit(0.0), cap - F.col("cost")), 6).alias("left"), (F.col("cost") > cap).alias("over"))


def baseline_stats(values: DataFrame, grid: DataFrame, keys: list[str], value: str = "value", below: float = 5.0) -> DataFrame:
    """(*keys, n, mean, share_below) for every cell of the grid; a cell without values has n 0 and nulls."""
    v = F.col(value)
    stats = values.where(v.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.avg(F.when(v < below, 1.0).otherwise(0.0)), 6).alias("share_below")
    )
    return grid.join(stats, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def label_distribution(labels: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(*keys, winners, losers, unlabelled) by cell and, with null keys, by each leading part of the keys and in all."""
    count = lambda c: F.count_if(c)
    return labels.rollup(*keys).agg(count(F.col(label) == 1).alias("winners"), count(F.col(label) == 0).alias("losers"), count(F.col(label).isNull()).alias("unlabelled"))


def tier_precision(precision: DataFrame, tier: Column) -> DataFrame:
    """(tier, ranker, k, n_cohorts, mean): mean precision over the cohorts of a tier."""
    return precision.withColumn("tier", tier).groupBy("tier", "ranker", "k").agg(F.count("*").alias("n_cohorts"), F.round(F.avg("precision"), 6).alias("mean"))


def paired_delta(precision: DataFrame, first: Column) -> DataFrame:
    """(t0, ranker, k, delta): mean precision of the first tier's cohorts less that of the others, at each date."""
    mean = lambda c: F.avg(F.when(c, F.col("precision")))
    return precision.groupBy("t0", "ranker", "k").agg(F.round(mean(first) - mean(~first), 6).alias("delta"))


def opportunity_rows(opportunities: DataFrame, keys: list[str], nested: list[str]) -> DataFrame:
    """Opportunities as flat rows: an id that the keys decide, the `nested` columns as one JSON text."""
    plain = [c for c in opportunities.columns if c not in nested]
    evidence = F.to_json(F.struct(*nested), {"ignoreNullFields": "false"})
    return opportunities.select(F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), 256).alias("id"), *plain, evidence.alias("evidence_json"))


def token_text(c: Column, kind: str, places: int = 4) -> Column:
    """A value as a document shows it: lists by commas, yes or no, fixed places, null as nothing."""
    if kind.startswith("array"):
        c = F.array_join(c, ", ")
    elif kind == "boolean":
        c = F.when(c, "yes").when(~c, "no")
    elif kind in ("double", "float"):
        c = F.when(c.isNotNull(), F.format_string(f"%.{places}f", c))
    return F.coalesce(c.cast("string"), F.lit(""))


def dossiers(candidates: DataFrame, tokens: list[str], template: str = DOSSIER) -> DataFrame:
    """Candidates with `dossier`: the template with {{token}} replaced by the columns named; other tokens stay."""
    kinds = dict(candidates.dtypes)
    pairs = [x for name in tokens for x in (F.lit(name), token_text(F.col(name), kinds[name]))]
    return candidates.withColumn("dossier", fill_template(F.lit(template), F.create_map(*pairs)))


def audit_report(checks: DataFrame) -> DataFrame:
    """(overall, n_checks, report): the worst status, and a line for each check by name. One row: checks are few."""
    severity = F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0)
    line = F.concat_ws(" | ", "check_name", "status", F.coalesce("detail", F.lit("")))
    out = checks.agg(F.max(severity).alias("s"), F.count("*").alias("n_checks"), F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("report"))
    return out.select(F.when(F.col("s") == 2, "FAIL").when(F.col("s") == 1, "WARN").when(F.col("s") == 0, "PASS").alias("overall"), "n_checks", "report")


def language_quality(evals: DataFrame, passing: float = 8.0) -> DataFrame:
    """evals (phrases, translations, back_translations, scores: arrays by place) with mean_score, accuracy, passes.

    Arrays of unequal length, empty or null ones give nulls and don't pass.
    """
    n = F.size("scores")
    whole = (n > 0) & (F.size("phrases") == n) & (F.size("translations") == n) & (F.size("back_translations") == n)
    mean = F.when(whole, F.aggregate("scores", F.lit(0.0), lambda a, x: a + x.cast("double")) / n)
    return evals.withColumn("mean_score", mean).withColumns({"accuracy": F.col("mean_score") / 10, "passes": F.coalesce(F.col("mean_score") >= passing, F.lit(False))})


def drift(actual: DataFrame, baseline: DataFrame, keys: list[str], tolerance: float = 1.0) -> DataFrame:
    """(*keys, score, base, status): score and pass flag against the baseline's; a case without baseline passes."""
    if tolerance <= 0:
        raise ValueError(f"tolerance must be above 0: {tolerance}")
    both = actual.select(*keys, "score", "passes").join(baseline.select(*keys, F.col("score").alias("base"), F.col("passes").alias("base_passes"), F.lit(True).alias("there")), keys, "left")
    same = (F.abs(F.col("score") - F.col("base")) <= tolerance) & F.col("passes").eqNullSafe(F.col("base_passes"))
    status = F.when(F.col("there").isNull(), "PASS").when(F.coalesce(same, F.lit(False)), "PASS").otherwise("FAIL")
    return both.select(*keys, "score", "base", status.alias("status"))


def compare_judges(results: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(pairs, counts) of results (*keys, kind, score, *order): the last text and vision score of a key, their divergence,
    and how many keys have only one of them."""
    last = results.groupBy(*keys).agg(
        F.max_by(F.when(F.col("kind") == "text", F.col("score")), F.when(F.col("kind") == "text", F.struct(*order))).alias("text_score"),
        F.max_by(F.when(F.col("kind") == "vision", F.col("score")), F.when(F.col("kind") == "vision", F.struct(*order))).alias("vision_score"),
    )
    text, vision = F.col("text_score").isNotNull(), F.col("vision_score").isNotNull()
    pairs = last.where(text & vision).withColumn("divergence", F.round(F.abs(F.col("text_score") - F.col("vision_score")), 6))
    counts = last.agg(F.count_if(text & vision).alias("pairs"), F.count_if(text & ~vision).alias("only_text"), F.count_if(~text & vision).alias("only_vision"))
    return pairs, counts


def divergence_lines(pairs: DataFrame, keys: list[str], n: int | None = 1000) -> DataFrame:
    """(position, line): a table row for each of the n pairs that are furthest apart, ties by key; n None: of all pairs.

    All pairs are sorted over the tasks and written out, and each task's rows are counted on from those of the tasks before.
    """
    order = [F.desc("divergence"), *keys]
    cells = [F.col(k).cast("string") for k in keys] + [F.format_string("%.1f", c) for c in ("text_score", "vision_score", "divergence")]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")
    if n is not None:
        return pairs.orderBy(*order).limit(n).select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("position"), line)
    sorted_ = scratch.stored(pairs.orderBy(*order).select(F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("nth"), line), "divergence")
    first = sorted_.groupBy("task").agg(F.min("nth").alias("first"), F.count("*").alias("rows"))
    first = first.select("task", (F.sum("rows").over(Window.orderBy("task")) - F.col("rows") - F.col("first")).alias("before"))  # a row for each task
    return sorted_.join(F.broadcast(first), "task").select((F.col("nth") + F.col("before") + 1).alias("position"), "line")


def baseline_lines(stats: DataFrame, keys: list[str], tier: Column) -> DataFrame:
    """(line): baseline_stats() as tab-separated text, three places, with a tier."""
    number = lambda c: F.coalesce(F.format_string("%.3f", c), F.lit(""))
    return stats.select(F.concat_ws("\t", *[F.col(k).cast("string") for k in keys], F.col("n").cast("string"), number(F.col("mean")), number(F.col("share_below")), tier).alias("line"))


def predicted_line(cpi_low: Column, cpi_high: Column, ltv_low: Column, ltv_high: Column, budget: Column, months: Column) -> Column:
    """What an opportunity is predicted to cost and bring, what is missing left out."""
    money = lambda c: F.concat(F.lit("$"), F.regexp_replace(c.cast("string"), r"\.0$", ""))
    span = lambda name, low, high: F.when(low.isNotNull() & high.isNotNull(), F.concat(F.lit(f"{name}: "), money(low), F.lit("-"), money(high))).when(low.isNotNull(), F.concat(F.lit(f"{name}: "), money(low), F.lit("+")))
    parts = (
        span("CPI", cpi_low, cpi_high),
        span("LTV", ltv_low, ltv_high),
        F.when(budget.isNotNull(), F.concat(F.lit("Capital to validate: "), money(budget))),
        F.when(months.isNotNull(), F.concat(F.lit("Horizon: "), months.cast("string"), F.lit(" months"))),
    )
    joined = F.concat_ws(" | ", *parts)
    return F.when(joined == "", "(no predictions)").otherwise(joined)


def plan_line(steps: Column, metric: Column, direction: Column, threshold: Column) -> Column:
    numbered = F.transform(steps, lambda s, i: F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": "), s))
    return F.concat_ws(" | ", F.array_join(numbered, " | "), F.concat_ws(" ", F.lit("Kill criterion:"), metric, direction, F.regexp_replace(threshold.cast("string"), r"\.0$", "")))


def briefs(opportunities: DataFrame, signals: list[str]) -> DataFrame:
    """Opportunities (source_app_id, source_market, target_market, thesis, *signals, predicted, tags, plan, url, claim) with
    `brief`: sections under bold headings, missing signals left out."""
    lines = F.concat_ws("\n", *[F.when(F.col(s).isNotNull(), F.concat(F.lit(f"  - {s}: "), F.format_string("%.1f", s), F.lit("/10"))) for s in signals])
    section = lambda name, body: F.concat(F.lit(f"**{name}**\n"), body, F.lit("\n"))
    tags = F.when(F.size("tags") > 0, F.array_join("tags", ", ")).otherwise("(none derived)")
    head = F.concat(F.lit("**Source:** "), F.col("source_app_id").cast("string"), F.lit(" in "), F.col("source_market"), F.lit("\n**Target:** "), F.col("target_market"), F.lit("\n"))
    parts = (
        head,
        section("Thesis", F.col("thesis")),
        section("Signals", F.when(lines == "", "  (none computed)").otherwise(lines)),
        section("Predicted economics", F.concat(F.lit("  "), F.col("predicted"))),
        F.concat(F.lit("**Tags:** "), tags, F.lit("\n")),
        section("Validation plan", F.concat(F.lit("  "), F.col("plan"))),
        section("Evidence", F.concat(F.lit("  "), F.col("url"), F.lit(" - "), F.col("claim"))),
    )
    return opportunities.withColumn("brief", F.concat_ws("\n", *parts))


def first_ranked(candidates: DataFrame, order: list, n: int) -> DataFrame:
    """The first n candidates in order, with their position."""
    return candidates.orderBy(*order).limit(n).withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long"))


def demo_highlights(digest: DataFrame, n: int = 3) -> DataFrame:
    """(kind, position, line) of a digest's rows: the n greatest revenues, gaps and paywall scores, each as a line."""
    kinds = (("revenue", "estimated_revenue", F.format_string("%s (%s): $%d a month", "name", "market", "estimated_revenue")), ("gap", "gap", F.format_string("%s (%s): localization gap %.1f", "name", "market", "gap")), ("paywall", "paywall", F.format_string("%s (%s): paywall %.1f", "name", "market", "paywall")))
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("double").alias("value"), line.alias("line")) for k, c, line in kinds])
    rows = digest.select(F.col("position").alias("at"), F.inline(each)).where("value is not null")
    ranked = rows.withColumn("position", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("value"), "at")).cast("long"))  # a digest has n rows
    return ranked.where(F.col("position") <= n).select("kind", "position", "line")


def demo_digest(candidates: DataFrame, n: int, revenue_per_rating: float = 50.0) -> DataFrame:
    """The first n ranked candidates as shown to a reader: revenue from ratings, rounded scores, the judge's reasoning or
    a sentence from the scores. Columns: position, name, store, market, category, ratings_count, gap, paywall, revenue,
    composite, reasoning."""
    said = F.format_string("Composite %.1f/10 from heuristic scoring (loc gap %.1f, paywall %.1f, revenue %.1f).", "composite", "gap", "paywall", "revenue")
    return candidates.where(F.col("position") <= n).select(
        "position", "name", "store", F.upper("market").alias("market"), "category", F.round(F.coalesce("ratings_count", F.lit(0)) * revenue_per_rating).cast("long").alias("estimated_revenue"),
        F.round("gap", 1).alias("gap"), F.round("paywall", 1).alias("paywall"), F.round("composite", 2).alias("composite"), F.coalesce("reasoning", said).alias("reasoning"),
    )


def backtest_documents(precision: DataFrame, picks: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, json, text) of each cohort: its precision rows (ranker, k, precision) and picks (ranker, pos, app_id) as one JSON
    document and as two tables. A cohort has a few rankers and the first picks of each."""
    rows = precision.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ranker", "k", "precision"))).alias("precision"))
    firsts = picks.groupBy(*keys, "ranker").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "app_id"))), lambda x: x["app_id"]).alias("app_ids"))
    firsts = firsts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ranker", "app_ids"))).alias("picks"))
    both = rows.join(firsts, keys, "left").withColumn("picks", F.coalesce("picks", F.array().cast(firsts.schema["picks"].dataType)))
    lines = F.transform("precision", lambda x: F.concat(F.lit("| "), x["ranker"], F.lit(" | "), x["k"].cast("string"), F.lit(" | "), F.format_string("%.2f", x["precision"].cast("double")), F.lit(" |")))
    chosen = F.transform("picks", lambda x: F.concat(F.lit("| "), x["ranker"], F.lit(" | "), F.array_join(x["app_ids"].cast("array<string>"), ", "), F.lit(" |")))
    text = F.array_join(F.concat(F.array(F.lit("| ranker | k | precision |"), F.lit("|-|-|-|")), lines, F.array(F.lit(""), F.lit("| ranker | picks |"), F.lit("|-|-|")), chosen), "\n")
    return both.select(*keys, F.to_json(F.struct(*keys, "precision", "picks")).alias("json"), text.alias("text"))


def aggregate_precision(precision: DataFrame, base: str) -> DataFrame:
    """(ranker, k, n_cohorts, mean, lift): mean precision over all cohorts, and over that of the ranker `base` (999 where base
    has none and the ranker some, 0 where neither has)."""
    means = precision.groupBy("ranker", "k").agg(F.count("*").alias("n_cohorts"), F.avg("precision").alias("mean"))
    other = means.where(F.col("ranker") == base).select("k", F.col("mean").alias("base"))
    return means.join(other, "k", "left").select("ranker", "k", "n_cohorts", F.round("mean", 6).alias("mean"), F.round(lift(F.col("mean"), F.coalesce("base", F.lit(0.0))), 6).alias("lift"))
