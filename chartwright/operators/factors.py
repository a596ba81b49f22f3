"""Cross-sectional factors at decision dates, and the factor study."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartwright.operators.windows import CELL, TRAILING, chart_ends, deviation, outcome, windowed
from chartwright.sources import scratch

FACTORS = ("f0", "f1", "f2", "f4", "f5", "f7", "f11", "f14")


def _per_cell(charts: DataFrame, t0s: DataFrame, top_n: int, horizon: int | None = None) -> DataFrame:
    """One row for each (t0, market, store, app) seen in the year before t0, of all charts; with a horizon also winner_exact
    and winner_window at t0 + horizon, whether or not the charts go on until then."""
    more = {} if horizon is None else outcome(horizon)
    rows = windowed(charts, t0s, {**TRAILING, **more}, top_n).where("year.n > 0")
    sd = deviation("quarter")
    out = rows.select(
        "t0", "app_id", "market", "store", F.col("week.last").alias("f0"), F.col("year.high").alias("f1"), F.when((F.col("quarter.n") >= 2) & (sd > 0), 1 / sd).alias("f2"),
        F.col("year.best").alias("best"), F.when(F.col("week.high") > 0, 1).otherwise(0).alias("high_week"),
        *([] if horizon is None else [F.when(F.col(f"{w}.high") > 0, 1).otherwise(0).alias(label) for w, label in (("exact", "winner_exact"), ("around", "winner_window"))]),
    )
    return out


def cell_factors(charts: DataFrame, cohorts: DataFrame, top_n: int = 100, horizon: int | None = None) -> DataFrame:
    """(market, store, t0, app_id, f0, f1, f2, f4) for apps charted in the week that ends at t0; with a horizon also whether
    they are within top_n at t0 + horizon and in the week that ends then (0 too where the chart has ended).

    f0 rank last seen in the week; f1 days within top_n in a year; f2 steadiness, 1 / population deviation of
    rank in 90 days; f4 current rank over best rank of the year.
    """
    out = _per_cell(charts, cohorts, top_n, horizon).join(cohorts.select(*CELL).distinct(), CELL, "left_semi").where("f0 is not null")
    labels = [] if horizon is None else ["winner_exact", "winner_window"]
    return out.select(*CELL, "app_id", F.col("f0").cast("long"), F.col("f1").cast("long"), F.round("f2", 6).alias("f2"), F.round(F.col("f0") / F.col("best"), 6).alias("f4"), *labels)


def cohort_labels(charts: DataFrame, cohorts: DataFrame, horizon: int = 90, top_n: int = 100) -> DataFrame:
    """(app_id, market, store, t0, winner_exact, winner_window) of every app charted in the week that ends at t0: whether it
    is within top_n at t0 + horizon, and in the week that ends then. Charts that end before then give no rows."""
    rows = windowed(charts, cohorts, {"week": TRAILING["week"], **outcome(horizon)}, top_n).where("week.n > 0")
    rows = rows.join(cohorts.select(*CELL).distinct(), CELL, "left_semi")
    rows = rows.join(chart_ends(charts), ["market", "store"]).where(F.col("last_day") >= F.date_add("t0", horizon))
    won = lambda w: F.when(F.col(f"{w}.high") > 0, 1).otherwise(0)
    return rows.select("app_id", "market", "store", "t0", won("exact").alias("winner_exact"), won("around").alias("winner_window"))


def factor_table(charts: DataFrame, invariants: DataFrame, cohorts: DataFrame, top_n: int = 100, horizon: int | None = None) -> DataFrame:
    """All eight factors, one row for each cell of the cohorts and app charted there in the week that ends at t0.

    f0, f1, f2, f4 as in cell_factors(). f5: charts (market, store) within top_n that week. f7: mean tenure (days within
    top_n in a year, over markets) of the publisher's other apps in the same store, null if it has none. f11: age in
    days, 365 at most. f14: whether the app is within top_n in the other store that week, null if that store has no
    such row then. With a horizon also winner_exact and winner_window as in cohort_labels(), null where the chart ends before.

    The charts are made once and written out, since the cells, the charts' last days and their weeks with a row within
    top_n are read from them. Those weeks, a row for each chart and date, are joined by broadcast; all else are windows over
    the cells of an app or a publisher, so no task gathers those of a whole market.
    """
    charts = scratch.stored(charts.select("market", "store", "day", "app_id", "rank"), "charts")
    w_app = Window.partitionBy("t0", "app_id")
    w_market, w_store = Window.partitionBy("t0", "app_id", "market"), Window.partitionBy("t0", "app_id", "store")
    other = lambda w: F.when(F.col("store") == "apple", F.max(F.when(F.col("store") != "apple", F.col("high_week"))).over(w)).otherwise(F.max(F.when(F.col("store") == "apple", F.col("high_week"))).over(w))
    rows = _per_cell(charts, cohorts, top_n, horizon).withColumns({
        "f5": F.sum("high_week").over(w_app),
        "both": F.coalesce(other(w_market), F.lit(0)),
        "tenure": F.sum("f1").over(w_store),
        "nth": F.row_number().over(w_store.orderBy("market")),
    })
    inv = invariants.select("app_id", "store", "publisher_id", "release_day")
    pub = F.coalesce(F.col("publisher_id").cast("string"), F.concat(F.lit("?"), F.col("app_id").cast("string")))  # no publisher: a group of its own
    w_pub = Window.partitionBy("t0", "store", "pub")
    counted = (F.col("nth") == 1) & (F.col("tenure") > 0)
    rows = rows.join(inv, ["app_id", "store"], "left").withColumn("pub", pub).withColumns({"s": F.sum(F.when(counted, F.col("tenure"))).over(w_pub), "k": F.count_if(counted).over(w_pub)})
    mine = F.col("tenure") > 0
    f7 = (F.col("s") - F.col("tenure")) / F.nullif(F.col("k") - 1, F.lit(0))
    week = cohorts.select("t0").distinct().select("t0", F.explode(F.sequence(F.date_sub("t0", 6), F.col("t0"))).alias("day"))
    high = charts.where(F.col("rank") <= top_n).select("market", "store", "day").distinct().join(F.broadcast(week), "day").select("t0", "market", F.col("store").alias("in_store")).distinct()
    apple = F.col("in_store") == "apple"
    high = high.groupBy("t0", "market").agg(F.max(F.when(apple, 1)).alias("any_apple"), F.max(F.when(~apple, 1)).alias("any_rest"))
    any_other = F.when(F.col("store") == "apple", F.col("any_rest")).otherwise(F.col("any_apple"))
    days = F.datediff("t0", "release_day")
    labels = []
    if horizon is not None:
        rows = rows.join(F.broadcast(chart_ends(charts)), ["market", "store"])
        labels = [F.when(F.col("last_day") >= F.date_add("t0", horizon), F.col(c)).alias(c) for c in ("winner_exact", "winner_window")]
    rows = rows.join(F.broadcast(high), ["t0", "market"], "left").withColumn("any", F.coalesce(any_other, F.lit(0))).join(cohorts.select(*CELL).distinct(), CELL, "left_semi").where("f0 is not null")
    return rows.select(
        *CELL, "app_id", F.col("f0").cast("long"), F.col("f1").cast("long"), F.round("f2", 6).alias("f2"), F.round(F.col("f0") / F.col("best"), 6).alias("f4"),
        F.nullif(F.col("f5"), F.lit(0)).cast("long").alias("f5"), F.round(F.when(mine & F.col("publisher_id").isNotNull(), f7), 6).alias("f7"),
        F.when(days >= 0, F.least(F.lit(365), days)).cast("long").alias("f11"), F.when(F.col("any") == 1, F.col("both")).cast("long").alias("f14"), *labels,
    )


def to_long(wide: DataFrame, names: tuple[str, ...] = FACTORS) -> DataFrame:
    return wide.select(*CELL, "app_id", *[F.col(n).cast("double").alias(n) for n in names]).unpivot([*CELL, "app_id"], list(names), "signal_name", "value")


def to_wide(long: DataFrame, names: tuple[str, ...] = FACTORS) -> DataFrame:
    return long.groupBy(*CELL, "app_id").pivot("signal_name", list(names)).agg(F.first("value", ignorenulls=True))


def coverage(long: DataFrame) -> DataFrame:
    return long.groupBy("signal_name").agg(F.count("*").alias("n_rows"), F.count("value").alias("n_values"), F.round(F.count("value") / F.count("*"), 6).alias("share"))


def standardized(long: DataFrame, keys: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Winsorized at two quantiles, then as z-scores, for each cell and factor; deviation 0 gives 0, nulls included."""
    w = Window.partitionBy(*keys, "signal_name")
    q = F.percentile("value", F.array(F.lit(low), F.lit(high))).over(w)
    cut = long.withColumn("__q", q).withColumn("__v", F.when(F.col("value").isNotNull(), F.least(F.greatest("value", F.col("__q")[0]), F.col("__q")[1])))
    n, mean, sd = F.count("__v").over(w), F.avg("__v").over(w), F.stddev_samp("__v").over(w)
    z = F.when(n < 2, F.col("__v")).when(F.coalesce(sd, F.lit(0.0)) < 1e-12, 0.0).otherwise((F.col("__v") - mean) / sd)
    return cut.select(*long.columns, z.alias("z"))


def standardized_wide(wide: DataFrame, keys: list[str], names: tuple[str, ...] = FACTORS, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(*keys, app_id, *names as doubles, z_<name> of each): the scores of standardized(), of all factors with one shuffle
    and one sort, by cell."""
    w, rows = Window.partitionBy(*keys), wide.select(*keys, "app_id", *[F.col(n).cast("double").alias(n) for n in names])
    rows = rows.select("*", *[F.percentile(n, F.array(F.lit(low), F.lit(high))).over(w).alias(f"q_{n}") for n in names])
    rows = rows.select(*keys, "app_id", *names, *[F.when(F.col(n).isNotNull(), F.least(F.greatest(n, F.col(f"q_{n}")[0]), F.col(f"q_{n}")[1])).alias(f"v_{n}") for n in names])
    facts = [f(f"v_{n}").over(w).alias(f"{k}_{n}") for n in names for k, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_samp))]
    rows = rows.select("*", *facts)
    z = lambda n: F.when(F.col(f"n_{n}") < 2, F.col(f"v_{n}")).when(F.coalesce(f"s_{n}", F.lit(0.0)) < 1e-12, 0.0).otherwise((F.col(f"v_{n}") - F.col(f"m_{n}")) / F.col(f"s_{n}"))
    return rows.select(*keys, "app_id", *names, *[z(n).alias(f"z_{n}") for n in names])


def _let(value, body):
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _coefficients(grams, k: int):
    """For each of k columns the weights of (1, column 1, ..., column k) that give its residual.

    grams[i] is null or (n, have, gram): rows where column i is there, how many of them have each column, and sums of
    products of (1, columns) over those rows, row by row. Regressors of column i are the constant and the residuals of
    earlier columns that all of those rows have; they are made orthogonal one by one in the inner product of the sums,
    twice over, and what is left of one is dropped below 1e-11 of its column's own sum of squares.
    """
    units, size = F.sequence(F.lit(0), F.lit(k)), k + 1
    unit = lambda at: F.transform(units, lambda j: F.when(j == at, 1.0).otherwise(0.0))

    def times(g, v):
        return F.transform(units, lambda a: _dot(F.slice(g, a * size + 1, F.lit(size)), v))

    def reduced(v, basis):
        step = lambda x, e: _let(_dot(x, e["g"]) / e["n"], lambda c: F.zip_with(x, e["w"], lambda p, q: p - c * q))
        return F.aggregate(F.concat(basis, basis), v, step)

    none = F.array().cast("array<struct<w:array<double>,g:array<double>,n:double>>")

    def residual(done, i):
        g = F.element_at(grams, i + 1)
        before = F.when(i > 0, F.sequence(F.lit(0), i - 1)).otherwise(F.array().cast("array<int>"))
        prior = F.filter(before, lambda p: F.get(g["have"], p) == g["n"])
        regressors = F.concat(F.array(F.struct(unit(0).alias("v"), F.lit(0).alias("at"))), F.transform(prior, lambda p: F.struct(F.get(done, p).alias("v"), (p + 1).alias("at"))))

        def added(basis, r):
            def kept(w):
                return _let(times(g["gram"], w), lambda gw: _let(_dot(w, gw), lambda n: F.when(n > 1e-11 * F.get(g["gram"], r["at"] * (size + 1)), F.concat(basis, F.array(F.struct(w.alias("w"), gw.alias("g"), n.alias("n"))))).otherwise(basis)))

            return _let(reduced(r["v"], basis), kept)

        fitted = reduced(unit(i + 1), F.aggregate(regressors, none, added))
        return F.when(g.isNull() | (g["n"] < 3) | (F.size(prior) == 0), unit(i + 1)).otherwise(fitted)

    return F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.array().cast("array<array<double>>"), lambda done, i: F.concat(done, F.array(residual(done, i))))


def residualized(wide: DataFrame, keys: list[str], order: tuple[str, ...] = FACTORS) -> DataFrame:
    """Each factor's part that the factors before it don't explain, by least squares within each cell.

    The first stays. Only earlier factors that are there on all of the factor's rows are used; with fewer than
    three rows or none such the value stays; null stays null. A cell's rows are only summed: one table of sums of
    products for each factor, from which all its weights follow; they are joined back by cell. Exactly collinear factors
    leave 0. Values should be of order one, as z-scores are.
    """
    k = len(order)
    rows = wide.select(*keys, "app_id", *[F.col(n).cast("double").alias(n) for n in order])
    x = [F.lit(1.0), *[F.coalesce(F.col(n), F.lit(0.0)) for n in order]]
    each = rows.select(*keys, F.posexplode(F.array(*[F.col(n) for n in order])).alias("i", "own"), F.array(*x).alias("x"), F.array(*[F.col(n).isNotNull() for n in order]).alias("there")).where("own is not null")
    pairs = [(a, b) for a in range(k + 1) for b in range(a, k + 1)]
    sums = each.groupBy(*keys, "i").agg(F.count("*").alias("n"), F.array(*[F.count_if(F.col("there")[j]) for j in range(k)]).alias("have"), *[F.sum(F.col("x")[a] * F.col("x")[b]).alias(f"s{a}_{b}") for a, b in pairs])
    gram = F.array(*[F.col(f"s{min(a, b)}_{max(a, b)}") for a in range(k + 1) for b in range(k + 1)])
    by_cell = sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("n", "have", gram.alias("gram"))))).alias("grams"))
    grams = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.try_element_at(F.col("grams"), i))
    weights = by_cell.select(*keys, grams.alias("grams")).select(*keys, _coefficients(F.col("grams"), k).alias("weights"))
    fits = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in keys]
    joined = rows.alias("l").join(F.broadcast(weights).alias("r"), fits, "left").select("l.*", "r.weights")  # a row for each cell
    left = lambda i: F.when(F.col(order[i]).isNotNull(), sum((F.col("weights")[i][j] * x[j] for j in range(1, k + 1)), F.col("weights")[i][0]))
    return joined.select(*keys, "app_id", *[left(i).alias(order[i]) for i in range(k)])


def directions(long: DataFrame, label: str, least: int = 30) -> DataFrame:
    """(signal_name, ascending): whether low values go with winning, over all rows; a correlation has the sign of the covariance."""
    out = long.where("value is not null").groupBy("signal_name").agg(F.count("*").alias("n"), F.round(F.covar_pop("value", F.col(label).cast("double")), 9).alias("c"))
    return out.select("signal_name", F.coalesce((F.col("n") >= least) & (F.col("c") < 0), F.lit(False)).alias("ascending"))


def top_decile(long: DataFrame, keys: list[str], label: str, ascending: DataFrame, least: int = 10) -> DataFrame:
    """(*keys, signal_name, n, precision): share of winners in the best tenth, one at least; under `least` rows none."""
    rows = long.where("value is not null").join(F.broadcast(ascending), "signal_name")
    signed = F.when(F.col("ascending"), F.col("value")).otherwise(-F.col("value"))
    w = Window.partitionBy(*keys, "signal_name")
    rows = rows.withColumns({"pos": F.row_number().over(w.orderBy(signed, "app_id")), "n": F.count("*").over(w)}).where(F.col("n") >= least)
    return rows.where(F.col("pos") <= F.greatest(F.lit(1), F.ceil(0.1 * F.col("n")))).groupBy(*keys, "signal_name").agg(F.max("n").alias("n"), F.round(F.avg(F.col(label).cast("double")), 6).alias("precision"))


def directions_wide(rows: DataFrame, labels: tuple[str, ...], names: tuple[str, ...] = FACTORS, least: int = 30) -> DataFrame:
    """(signal_name, up_<label> of each): directions() of all factors and labels, in one pass over rows with both as columns."""
    facts = [F.struct(F.lit(f).alias("signal_name"), *[F.coalesce((F.count(f) >= least) & (F.round(F.covar_pop(F.col(f).cast("double"), F.col(v).cast("double")), 9) < 0), F.lit(False)).alias(f"up_{v}") for v in labels]) for f in names]
    return rows.agg(F.array(*facts).alias("facts")).select(F.inline("facts"))


def top_deciles(rows: DataFrame, labels: tuple[str, ...], base: str = "f0", least: int = 10, names: tuple[str, ...] = FACTORS) -> DataFrame:
    """(*CELL, label, signal_name, n, precision): top_decile() of all factors and labels of rows (*CELL, app_id, *names, *labels).

    Each factor's values are dealt and placed once for all labels, from both ends; `base` ranks its low values first."""
    up = directions_wide(rows, labels, names)
    each = F.array(*[F.struct(F.lit(f).alias("signal_name"), F.col(f).cast("double").alias("value")) for f in names])
    long = rows.select(*CELL, "app_id", *labels, F.inline(each)).where("value is not null").join(F.broadcast(up), "signal_name")
    w = Window.partitionBy(*CELL, "signal_name")
    placed = long.withColumns({"low": F.row_number().over(w.orderBy("value", "app_id")), "high": F.row_number().over(w.orderBy(-F.col("value"), "app_id")), "n": F.count("*").over(w)}).where(F.col("n") >= least)
    cut = F.greatest(F.lit(1), F.ceil(0.1 * F.col("n")))
    at = lambda v: F.when(F.col(f"up_{v}") | (F.col("signal_name") == base), F.col("low")).otherwise(F.col("high"))
    best = placed.groupBy(*CELL, "signal_name").agg(F.max("n").alias("n"), *[F.round(F.avg(F.when(at(v) <= cut, F.col(v).cast("double"))), 6).alias(v) for v in labels])
    return best.unpivot([*CELL, "signal_name", "n"], list(labels), "label", "precision")


def cluster_bootstrap(lifts: DataFrame, reps: int = 200, seed: int = 42) -> DataFrame:
    """(signal_name, n, median, low, high, p): medians of resampled cohort lifts; under three cohorts nulls.

    lifts (signal_name, cohort, lift). Draw d of repetition r takes the cohort at a multiplicative hash of (r, d, seed),
    in integers that any engine computes alike. A factor's lifts, one for each cohort, lie in one array; each repetition
    draws from it in place, so nothing is joined.
    """
    values = lifts.groupBy("signal_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("cohort", "lift"))), lambda x: x["lift"]).alias("lifts")).withColumn("n", F.size("lifts"))
    mixed = lambda d: (F.col("rep").cast("long") * 1000003 + d.cast("long") * 7919 + seed * 104729) * 2654435761 % 4294967296
    drawn = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda d: F.get(F.col("lifts"), (F.floor(mixed(d) / 256) % F.col("n")).cast("int")))
    draws = values.where("n > 0").select("signal_name", "n", "lifts", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")).select("signal_name", "n", "rep", F.sort_array(drawn).alias("x"))
    medians = draws.select("signal_name", "rep", ((F.get("x", F.floor((F.col("n") - 1) / 2).cast("int")) + F.get("x", F.floor(F.col("n") / 2).cast("int"))) / 2).alias("m"))
    boot = medians.groupBy("signal_name").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.avg(F.when(F.col("m") <= 0, 1.0).otherwise(0.0)).alias("below"), F.avg(F.when(F.col("m") >= 0, 1.0).otherwise(0.0)).alias("above"))
    real = lifts.groupBy("signal_name").agg(F.count("*").alias("n"), F.median("lift").alias("median"))
    enough = F.col("n") >= 3
    p = F.when(F.col("median") == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.when(F.col("median") > 0, F.col("below")).otherwise(F.col("above"))))
    return real.join(boot, "signal_name", "left").select("signal_name", "n", *[F.when(enough, v).alias(k) for k, v in (("median", F.col("median")), ("low", F.col("q")[0]), ("high", F.col("q")[1]), ("p", p))])


def cohort_lifts(best: DataFrame, keys: list[str], base: str = "f0") -> DataFrame:
    """(signal_name, cohort, n, precision, base, lift) of top_decile() rows: each factor's precision less the base's."""
    of_base = best.where(F.col("signal_name") == base).select(*keys, F.col("precision").alias("base"))
    rows = best.where(F.col("signal_name") != base).join(of_base, keys)
    return rows.select("signal_name", *keys, F.concat_ws("/", *keys).alias("cohort"), "n", "precision", "base", (F.col("precision") - F.col("base")).alias("lift"))


def with_cohort_columns(rows: DataFrame, first_tier: tuple[str, ...]) -> DataFrame:
    """Rows (market, store, t0, ...) with tier (sea or tier1), t0_iso and cohort_key."""
    tier = F.when(F.col("market").isin(*first_tier), "sea").otherwise("tier1")
    return rows.withColumns({"tier": tier, "t0_iso": F.date_format("t0", "yyyy-MM-dd"), "cohort_key": F.concat_ws("/", "market", "store", F.date_format("t0", "yyyy-MM-dd"))})


def label_long(labels: DataFrame, keys: list[str], names: tuple[str, ...] = ("winner_exact", "winner_window")) -> DataFrame:
    """(*keys, label, is_winner): one row for each kind of label, so that one run covers the main and the other one."""
    return labels.unpivot(keys, list(names), "label", "is_winner")


def low_coverage(covered: DataFrame, least: float = 0.5) -> list[str]:
    """Factors whose share of values is under `least`; one row a factor reaches the driver."""
    return sorted(r["signal_name"] for r in covered.where(F.col("share") < least).collect())


def study_verdict(alive: DataFrame, composite_lift: float | None, least_composite: float = 0.05) -> str:
    """K1 if any factor is alive, else K2 if the composite lifts enough, else K3."""
    if alive.where("alive").limit(1).count():
        return "K1"
    return "K2" if composite_lift is not None and composite_lift >= least_composite else "K3"


def forward_chaining(rows: DataFrame, features: list[str], label: str, least_train: int = 30, least_test: int = 10, c: float = 1.0, rounds: int = 60) -> DataFrame:
    """(t0, n_train, n_test, prec_composite, prec_f0, lift) of each date after the first: a logistic model of all earlier
    dates ranks that date's apps, and its top tenth is held against that of f0.

    rows (market, store, t0, app_id, *features, label). Missing values take the training median; markets and stores are
    indicators, the first left out; the penalty is 1 / (2 c) of the squared weights, the constant's included. Dates with
    too few rows, one class or a feature without any training value are left out.

    All dates are fitted at once: a round of Newton's method is one read of the rows, from which each task adds up, for every
    date, the gradient, the products and the loss at the present weights. A row counts for every later date. Dates are a few dozen, so what reaches the driver
    are small sums; a step that raises the loss is halved. Write `rows` out before, they are read once a round.
    """
    import numpy as np

    rows = rows.where(F.col(label).isNotNull()).withColumn("y", F.col(label).cast("double"))
    spark = rows.sparkSession
    extra = [(k, v) for k in ("market", "store") for v in sorted(r[0] for r in rows.select(k).distinct().collect())[1:]]
    at = {r["t0"]: r["n"] for r in rows.groupBy("t0").agg(F.count("*").alias("n")).collect()}
    dates, schema = sorted(at), "t0 date, n_train long, n_test long, prec_composite double, prec_f0 double, lift double"
    later = spark.createDataFrame([(d, fold) for d in dates for fold in dates if fold > d], "t0 date, fold date")
    known = rows.join(F.broadcast(later), "t0").groupBy("fold").agg(F.count("*").alias("n"), F.min("y").alias("low"), F.max("y").alias("high"), *[F.median(F.col(f).cast("double")).alias(f) for f in features]).collect()
    known = {r["fold"]: r for r in known if r["n"] >= least_train and at[r["fold"]] >= least_test and r["low"] != r["high"] and all(r[f] is not None for f in features)}
    if not known:
        return spark.createDataFrame([], schema)
    d = 1 + len(features) + len(extra)

    def design(weights: dict, dates_of) -> DataFrame:
        """Rows with each date that they serve, its weights and their features, filled with its medians."""
        table = spark.createDataFrame([(t0, fold, [float(known[fold][f]) for f in features], [float(x) for x in weights[fold]]) for t0, fold in dates_of], "t0 date, fold date, fill array<double>, w array<double>")
        filled = [F.coalesce(F.col(f).cast("double"), F.col("fill")[i]) for i, f in enumerate(features)]
        x = F.array(F.lit(1.0), *filled, *[(F.col(k) == v).cast("double") for k, v in extra])
        return rows.join(F.broadcast(table), "t0").select("fold", "market", "store", "app_id", "f0", "y", x.alias("x"), "w").withColumn("margin", _dot(F.col("x"), F.col("w")))

    columns = ["t0", "y", *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], *[F.coalesce((F.col(k) == v).cast("double"), F.lit(0.0)).alias(f"e{i}") for i, (k, v) in enumerate(extra)]]
    table, fills = rows.select(*columns), {fold: np.array([float(r[f]) for f in features]) for fold, r in known.items()}

    def sums_at(weights: dict) -> dict:
        """For each open date (loss, gradient, products) of its rows at the weights: a task adds up its batches, Spark the tasks."""

        def run(batches):
            import pyarrow as pa

            total = {fold: np.zeros(1 + d + d * d) for fold in weights}
            for batch in batches:
                t0 = batch.column(0).to_numpy(zero_copy_only=False).astype("datetime64[D]")
                y, *raw = (c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:])
                raw, ones = np.column_stack(raw), np.ones((batch.num_rows, 1))
                for fold, w in weights.items():
                    mine = t0 < np.datetime64(fold)
                    if not mine.any():
                        continue
                    own = raw[mine][:, : len(features)]
                    x = np.hstack((ones[mine], np.where(np.isnan(own), fills[fold], own), raw[mine][:, len(features) :]))
                    margin, at_y = x @ w, y[mine]
                    mu = 0.5 * (1 + np.tanh(0.5 * margin))
                    loss = np.maximum(margin, 0.0) - at_y * margin + np.log1p(np.exp(-np.abs(margin)))
                    total[fold] += np.concatenate(([loss.sum()], (mu - at_y) @ x, ((x * (mu * (1 - mu))[:, None]).T @ x).ravel()))
            for fold, v in total.items():
                yield pa.record_batch([pa.array([fold] * len(v), pa.date32()), pa.array(range(len(v)), pa.int32()), pa.array(v)], names=["fold", "k", "v"])

        out = {fold: np.zeros(1 + d + d * d) for fold in weights}
        for r in table.mapInArrow(run, "fold date, k int, v double").groupBy("fold", "k").agg(F.sum("v").alias("v")).collect():
            out[r["fold"]][r["k"]] = r["v"]
        return {fold: (v[0], v[1 : d + 1], v[d + 1 :].reshape(d, d)) for fold, v in out.items()}

    weights = {fold: np.zeros(d) for fold in known}
    before, loss_before, open_ = dict(weights), dict.fromkeys(known, float("inf")), set(known)
    for _ in range(rounds):
        if not open_:
            break
        for fold, (loss, g, h) in sums_at({fold: weights[fold] for fold in sorted(open_)}).items():
            w = weights[fold]
            total = c * loss + 0.5 * float(w @ w)
            if total > loss_before[fold] + 1e-12 * abs(total):
                weights[fold] = (before[fold] + w) / 2
                continue
            step = np.linalg.solve(c * h + np.eye(d), c * g + w)
            before[fold], loss_before[fold], weights[fold] = w, total, w - step
            if np.abs(step).max() < 1e-9:
                open_.discard(fold)
    scored = design(weights, [(fold, fold) for fold in sorted(known)])
    w = Window.partitionBy("fold", "market", "store")
    placed = scored.withColumns({"n": F.count("*").over(w), "by_p": F.row_number().over(w.orderBy(F.desc("margin"), "app_id")), "by_f0": F.row_number().over(w.orderBy("f0", "app_id"))}).where(F.col("n") >= least_test)
    cut = F.greatest(F.lit(1), F.ceil(0.1 * F.col("n")))
    each = placed.groupBy("fold", "market", "store").agg(F.avg(F.when(F.col("by_p") <= cut, F.col("y"))).alias("p"), F.avg(F.when(F.col("by_f0") <= cut, F.col("y"))).alias("f"))
    sizes = spark.createDataFrame([(fold, known[fold]["n"], at[fold]) for fold in sorted(known)], "fold date, n_train long, n_test long")
    folds = each.groupBy("fold").agg(F.avg("p").alias("prec_composite"), F.avg("f").alias("prec_f0")).join(F.broadcast(sizes), "fold")
    return folds.select(F.col("fold").alias("t0"), "n_train", "n_test", "prec_composite", "prec_f0", (F.col("prec_composite") - F.col("prec_f0")).alias("lift"))


def composite_verdict(rows: DataFrame, folds: DataFrame, least_rows: int = 100, least_dates: int = 3, least_lift: float = 0.05) -> DataFrame:
    """One row (status, n_rows, n_dates, n_folds, median_lift, alive) of forward_chaining() folds and the rows they come from.

    status: too few rows, too few dates, no fold or ok; only ok has a median lift over the folds and can be alive.
    """
    size = rows.agg(F.count("*").alias("n_rows"), F.count_distinct("t0").alias("n_dates"))
    found = folds.agg(F.count("*").alias("n_folds"), F.median("lift").alias("lift"))
    status = F.when(F.col("n_rows") < least_rows, "too few rows").when(F.col("n_dates") < least_dates, "too few dates").when(F.col("n_folds") == 0, "no fold").otherwise("ok")
    out = size.crossJoin(F.broadcast(found)).withColumn("status", status)  # one row each
    ok = F.col("status") == "ok"
    return out.select("status", "n_rows", "n_dates", F.when(ok, F.col("n_folds")).otherwise(0).alias("n_folds"), F.when(ok, F.col("lift")).alias("median_lift"), (ok & (F.col("lift") >= least_lift)).alias("alive"))


def verdicts(boot: DataFrame, least_lift: float = 0.03, level: float = 0.05 / 8) -> DataFrame:
    return boot.withColumn("alive", F.coalesce((F.col("median") >= least_lift) & (F.col("p") < level), F.lit(False)))
