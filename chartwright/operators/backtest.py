"""Leak-free backtests: as-of values, labels, rankings, precision, lift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartwright.functions.exprs import clamp


#: Distinct dates of a cohort up to which its signals are cut into spans between them.
MOST_DATES = 1000


def as_of(cohort: DataFrame, signals: DataFrame, null_policy: str = "skip", order: tuple[str, ...] = ("day", "event_id")) -> DataFrame:
    """(app_id, t0, signal_name, value, seen_day): the latest row at or before t0 of each app and signal.

    null_policy: 'skip' passes over null values before picking; 'keep' picks the latest row even if null;
    'missing' picks the latest row and drops it if null. Up to MOST_DATES distinct dates, a row is read once however many
    dates there are.
    """
    if null_policy not in ("skip", "keep", "missing"):
        raise ValueError(null_policy)
    rows = signals.where("value is not null") if null_policy == "skip" else signals
    asked = cohort.select("app_id", "t0").distinct()
    dates = sorted(r["t0"] for r in asked.select("t0").distinct().where("t0 is not null").limit(MOST_DATES + 1).collect())
    if len(dates) > MOST_DATES:  # dates of their own for many apps: each app's rows meet its dates
        joined = asked.join(rows, "app_id").where(F.col("day") <= F.col("t0"))
        latest = joined.groupBy("app_id", "t0", "signal_name").agg(F.max_by(F.struct("value", "day"), F.struct(*order)).alias("x"))
    else:
        # a row counts from the first date at or after its day on; what a span between two dates leaves is one row
        marks = F.array(*[F.lit(d) for d in dates]).cast("array<date>")
        span = F.size(F.filter(marks, lambda d: d < F.col("day")))
        spans = rows.withColumn("span", span).where(F.col("span") < len(dates)).join(asked.select("app_id").distinct(), "app_id", "left_semi")
        spans = spans.groupBy("app_id", "signal_name", "span").agg(F.max(F.struct(F.struct(*order).alias("o"), F.struct("value", "day").alias("x"))).alias("last"))
        spans = spans.groupBy("app_id", "signal_name").agg(F.array_sort(F.collect_list(F.struct("span", "last"))).alias("spans"))  # one at most for each date
        own = F.filter("spans", lambda s: s["span"] <= F.array_position(marks, F.col("t0")) - 1)
        latest = asked.join(spans, "app_id").select("app_id", "t0", "signal_name", F.element_at(F.when(F.size(own) > 0, own), -1)["last"]["x"].alias("x")).where("x is not null")
    out = latest.select("app_id", "t0", "signal_name", F.col("x.value").alias("value"), F.col("x.day").alias("seen_day"))
    return out.where("value is not null") if null_policy == "missing" else out


def leaks(frozen: DataFrame, signals: DataFrame) -> DataFrame:
    """(app_id, t0, n_after): signal rows of frozen apps after their cut-off."""
    return frozen.select("app_id", "t0").distinct().join(signals, "app_id").where(F.col("day") > F.col("t0")).groupBy("app_id", "t0").agg(F.count("*").alias("n_after"))


def assert_no_leaks(frozen: DataFrame, signals: DataFrame) -> None:
    found = [f"{r['app_id']}@{r['t0']}" for r in leaks(frozen, signals).orderBy("app_id").limit(5).collect()]
    if found:
        raise ValueError(f"signals after the cut-off: {', '.join(found)}")


def freeze(candidates: DataFrame, charts: DataFrame) -> DataFrame:
    """(market, t0, app_ids): raises if a candidate has no chart row at or before t0, naming the first five."""
    seen = candidates.join(charts.select("market", "app_id", "day"), ["market", "app_id"]).where("day <= t0").select("market", "t0", "app_id").distinct()
    lost = [str(r["app_id"]) for r in candidates.join(seen, ["market", "t0", "app_id"], "left_anti").orderBy("app_id").limit(5).collect()]
    if lost:
        raise ValueError(f"no chart row before the cut-off: {', '.join(lost)}")
    return seen.groupBy("market", "t0").agg(F.sort_array(F.collect_list("app_id")).alias("app_ids"))


def candidate_pool(charts: DataFrame, cohorts: DataFrame, mode: str, fresh_days: int = 90, deepest: int = 100) -> DataFrame:
    """(market, t0, app_id) for every cohort at once. mode: survival, entrants, fresh or any.

    What an app's whole past decides is taken from its first day in the market, so history isn't multiplied by dates.
    """
    asked, rows = cohorts.select("market", "t0").distinct(), charts.select("market", "day", "app_id", "rank")
    t0, day = F.col("t0"), F.col("day")
    if mode in ("any", "survival"):
        first = (rows if mode == "any" else rows.where(F.col("rank") <= 2 * deepest)).groupBy("market", "app_id").agg(F.min("day").alias("day"))
        return asked.join(first, "market").where(day <= t0).select("market", "t0", "app_id")
    if mode == "entrants":
        return _around(rows.where(F.col("rank").between(deepest + 1, 2 * deepest)), asked, 7, 7).select("market", "t0", "app_id").distinct()
    if mode == "fresh":
        recent = _around(rows.where(F.col("rank") <= deepest), asked, 7, 0).select("market", "t0", "app_id").distinct()
        first = rows.groupBy("market", "app_id").agg(F.min("day").alias("day"))
        return recent.join(first, ["market", "app_id"]).where(day >= F.date_sub(t0, fresh_days)).select("market", "t0", "app_id")
    raise ValueError(mode)


def cohort_grid(parts: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Each part's cells on each of its dates: the cells' columns and t0. Dates are given, so a cell's are one array."""
    grids = [cells.select("*", F.explode(F.array(*[F.lit(d).cast("date") for d in dates])).alias("t0")) for cells, dates in parts]
    out = grids[0]
    for g in grids[1:]:
        out = out.unionByName(g)
    return out


def cohort_sizes(charts: DataFrame, grid: DataFrame, days: int = 6) -> DataFrame:
    """The grid's rows (market, store, t0, ...) with n, the apps charted in the days up to t0; 0 where there are none."""
    key = ["market", "store", "t0"]
    week = grid.select(*key).distinct().withColumn("day", F.explode(F.sequence(F.date_sub("t0", days), F.col("t0"))))
    n = charts.select("market", "store", "day", "app_id").join(week, ["market", "store", "day"]).groupBy(*key).agg(F.count_distinct("app_id").alias("n"))
    return grid.join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def with_tiers(ranked: DataFrame, tiers: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """Ranked apps with the tier of the same keys measured exactly `horizon` days after t0, null if there is none, and
    is_winner. tiers (*keys, measured_at, tier): what was measured at another day is none."""
    own = tiers.where(F.col("measured_at") == F.date_add("t0", horizon)).select(*keys, "tier")
    return ranked.join(own, keys, "left").withColumn("is_winner", F.coalesce(F.col("tier") == "winner", F.lit(False)))


def _around(rows: DataFrame, asked: DataFrame, before: int, after: int) -> DataFrame:
    """Rows of each asked (market, t0) from `before` days before t0 to `after` days after it: an equal join on the day."""
    days = asked.withColumn("day", F.explode(F.sequence(F.date_sub("t0", before), F.date_add("t0", after))))
    return rows.join(days, ["market", "day"])


def winner_labels(pairs: DataFrame, charts: DataFrame, horizon: int = 90, deepest: int = 100) -> DataFrame:
    """pairs (app_id, market, store, t0) with winner_exact and winner_window at t0 + horizon.

    Cells whose charts end before that day are left out. Only the seven days asked for are joined.
    """
    key = ["market", "store", "app_id"]
    ends = charts.groupBy("market", "store").agg(F.max("day").alias("last_day"))
    asked = pairs.withColumn("tm", F.date_add("t0", horizon)).join(ends, ["market", "store"]).where(F.col("last_day") >= F.col("tm"))
    week = asked.select(*key, "t0", "tm", F.explode(F.sequence(F.date_sub("tm", 6), F.col("tm"))).alias("day"))
    hits = week.join(charts.where(F.col("rank") <= deepest).select(*key, "day"), [*key, "day"])
    hits = hits.groupBy(*key, "t0").agg(F.max(F.when(F.col("day") == F.col("tm"), 1).otherwise(0)).alias("e"), F.lit(1).alias("w"))
    out = asked.join(hits, [*key, "t0"], "left")
    return out.select("app_id", "market", "store", "t0", F.coalesce("e", F.lit(0)).alias("winner_exact"), F.coalesce("w", F.lit(0)).alias("winner_window"))


def simple_winner_scores(pairs: DataFrame, charts: DataFrame, days: int = 7, deepest: int = 100) -> DataFrame:
    """pairs (app_id, t0, t_measure) with score and tier: 10 and winner if charted within deepest at most `days` off
    t_measure, else 0 and loser; null if there's no chart row by t_measure. t_measure before t0 is an error."""
    if pairs.where("t_measure < t0").limit(1).count():
        raise ValueError("t_measure lies before t0")
    first = charts.groupBy("app_id").agg(F.min("day").alias("first_day"))
    near = pairs.select("app_id", "t0", "t_measure", F.explode(F.sequence(F.date_sub("t_measure", days), F.date_add("t_measure", days))).alias("day"))
    hits = near.join(charts.where(F.col("rank") <= deepest).select("app_id", "day"), ["app_id", "day"]).groupBy("app_id", "t0", "t_measure").agg(F.lit(True).alias("hit"))
    out = pairs.join(first, "app_id", "left").join(hits, ["app_id", "t0", "t_measure"], "left")
    seen, won = F.col("first_day") <= F.col("t_measure"), F.col("hit").isNotNull()
    return out.select("app_id", "t0", "t_measure", F.when(seen, F.when(won, 10.0).otherwise(0.0)).alias("score"), F.when(seen, F.when(won, "winner").otherwise("loser")).alias("tier"))


def winner_scores(pairs: DataFrame, charts: DataFrame, signals: DataFrame, count_signal: str, revenue_signal: str) -> DataFrame:
    """(app_id, t, score, tier): months charted, review growth, revenue and retention, weighted; future rows don't count.

    pairs (app_id, t); null score if the app has neither chart nor signal rows by then.
    """
    c = pairs.join(charts.select("app_id", "day", "rank"), "app_id").where("day <= t")
    near = F.col("day") >= F.date_sub("t", 90)
    c = c.groupBy("app_id", "t").agg(
        F.countDistinct(F.when(F.col("rank") <= 100, F.floor(F.unix_date("day") / 30))).alias("months"),
        F.count_if(near).alias("n_near"),
        F.stddev_pop(F.when(near, F.col("rank"))).alias("sd"),
        F.count("*").alias("n_charts"),
    )
    s = pairs.join(signals, "app_id").where("day <= t")
    counted = (F.col("signal_name") == count_signal) & near & F.col("value").isNotNull()
    when = F.struct("day", "event_id")
    s = s.groupBy("app_id", "t").agg(
        F.count_if(counted).alias("points"),
        F.max_by(F.when(counted, F.col("value")), F.when(counted, when)).alias("v1"),
        F.min_by(F.when(counted, F.col("value")), F.when(counted, when)).alias("v0"),
        F.max_by(F.when(F.col("signal_name") == revenue_signal, F.struct("value")), F.when(F.col("signal_name") == revenue_signal, when)).alias("revenue"),
        F.count("*").alias("n_signals"),
    )
    zero = F.lit(0.0)
    growth = F.when(F.col("points") >= 2, F.col("v1") - F.col("v0")).otherwise(zero)
    retention = F.when(F.col("n_near") >= 3, clamp(1 - F.col("sd") / 50, 0, 1)).otherwise(zero)
    total = 0.4 * clamp(F.coalesce("months", F.lit(0)) / 36, 0, 1) + 0.3 * clamp(growth / 1000, 0, 1) + 0.2 * F.coalesce(clamp(F.col("revenue.value") / 100000, 0, 1), zero) + 0.1 * F.coalesce(retention, zero)
    out = pairs.join(c, ["app_id", "t"], "left").join(s, ["app_id", "t"], "left")
    score = F.when(F.coalesce("n_charts", F.lit(0)) + F.coalesce("n_signals", F.lit(0)) > 0, F.round(total * 10, 6))
    return out.select("app_id", "t", score.alias("score")).withColumn("tier", F.when(F.col("score") >= 7, "winner").when(F.col("score") >= 5, "marginal").when(F.col("score").isNotNull(), "loser"))


def _drawn(keys: list[str], seed: int):
    """A number from the digest of seed, keys and app."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col("app_id").cast("string"))), 1, 12), 16, 10).cast("double")


def rankings(values: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """(*keys, ranker, app_id, pos): each named value ranks the apps that have it; `random` ranks all by a digest of seed,
    keys and app."""
    w = Window.partitionBy(*keys, "ranker").orderBy(F.desc("value"), "app_id")
    drawn = values.select(*keys, "app_id").distinct().select(*keys, "app_id", F.lit("random").alias("ranker"), _drawn(keys, seed).alias("value"))
    named = values.select(*keys, "app_id", F.col("signal_name").alias("ranker"), F.col("value").cast("double").alias("value"))
    return named.where("value is not null and not isnan(value)").unionByName(drawn).withColumn("pos", F.row_number().over(w).cast("long")).drop("value")


def rankings_wide(cells: DataFrame, keys: list[str], names: dict[str, object], seed: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, ranker, app_id, *carry, pos) as rankings(), of one row for each app of a cell: names are the rankers and their
    values' columns. The cells are read once, and what they carry (a label) needs no join afterwards."""
    each = F.array(*[F.struct(F.lit(n).alias("ranker"), v.cast("double").alias("value")) for n, v in names.items()], F.struct(F.lit("random").alias("ranker"), _drawn(keys, seed).alias("value")))
    rows = cells.select(*keys, "app_id", *carry, F.inline(each)).where("value is not null and not isnan(value)")
    w = Window.partitionBy(*keys, "ranker").orderBy(F.desc("value"), "app_id")
    return rows.withColumn("pos", F.row_number().over(w).cast("long")).select(*keys, "ranker", "app_id", *carry, "pos")


def select_signals(signals: DataFrame, names: dict[str, str], excluded: tuple[str, ...] = (), versions: dict[str, str] | None = None) -> DataFrame:
    """Signal rows by their public names, without the excluded ones, without nulls, each at its version where one is set."""
    public = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), F.col("signal_name")), F.lit(""))
    rows = signals.where("value is not null").withColumn("signal_name", public).where((F.col("signal_name") != "") & ~F.col("signal_name").isin(*excluded))
    if not versions:
        return rows
    wanted = F.try_element_at(F.create_map(*[F.lit(x) for p in versions.items() for x in p]), F.col("signal_name"))
    return rows.where(wanted.isNull() | (F.col("version") == wanted))


def cohort_counters(values: DataFrame, tiers: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """(*keys, candidates, eligible, winners): candidates, those with `least` signals or more, and winners among them.

    values (*keys, app_id, signal_name, value) has a row for each candidate, with a null value if it has no signal.
    """
    apps = values.groupBy(*keys, "app_id").agg(F.count("value").alias("n"))
    out = apps.join(tiers.select(*keys, "app_id", "tier"), [*keys, "app_id"], "left")
    return out.groupBy(*keys).agg(F.count("*").alias("candidates"), F.count_if(F.col("n") >= least).alias("eligible"), F.count_if(F.col("tier") == "winner").alias("winners"))


def top_k(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.where(F.col("pos") <= k)


def precision_at_k(ranked: DataFrame, winners: DataFrame, keys: list[str], ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """(*keys, ranker, k, precision): winners among the first k, over k."""
    won = ranked.join(winners.select(*keys, "app_id", "is_winner"), [*keys, "app_id"], "left")
    return won.select(*keys, "ranker", "pos", F.coalesce("is_winner", F.lit(0)).alias("w"), F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).groupBy(*keys, "ranker", "k").agg(
        F.round(F.sum(F.when(F.col("pos") <= F.col("k"), F.col("w")).otherwise(0)) / F.col("k"), 6).alias("precision")
    )


def carried_precision(ranked: DataFrame, label: str, keys: list[str], ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """precision_at_k() of rankings that carry their label, 1 for winners: one aggregate in the ranking's own partitions."""
    won = [F.round(F.sum(F.when(F.col("pos") <= k, F.coalesce(F.col(label), F.lit(0))).otherwise(0)) / k, 6) for k in ks]
    out = ranked.groupBy(*keys, "ranker").agg(F.array(*[F.struct(F.lit(k).alias("k"), p.alias("precision")) for k, p in zip(ks, won, strict=True)]).alias("at"))
    return out.select(*keys, "ranker", F.inline("at"))


def lift(composite, baseline):
    return F.when(baseline > 0, composite / baseline).when(composite > 0, 999.0).otherwise(0.0)
