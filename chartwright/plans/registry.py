"""All registered chart queries over the derived tables, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartwright.functions import exprs as X
from chartwright.functions import fixed
from chartwright.operators import audit, backtest, factors, shortlist, signals
from chartwright.sources import derived as D
from chartwright.sources import scratch

START, END, LEAST_DAYS, TOP = "2000-06-01", "2001-06-01", 10, 3
NOW = "2000-06-01"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def sql(*parts: str) -> str:
    *ctes, last = parts
    return "WITH " + ",\n".join(ctes) + ("\n" if last.lstrip().startswith("SELECT") else ",\n") + last


def cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market, store and the first of each month of 2000, from the regions."""
    months = F.explode(F.sequence(F.lit("2000-01-01").cast("date"), F.lit("2000-12-01").cast("date"), F.expr("interval 1 month"))).alias("t0")
    return D.table(spark, sf_dir, "region").select(F.col("r_name").alias("market"), months).select("market", F.explode(F.array(F.lit("apple"), F.lit("googleplay"))).alias("store"), "t0")


COHORTS_SQL = """cohorts AS (SELECT r_name AS market, store, CAST(t0 AS DATE) AS t0 FROM region, (VALUES ('apple'), ('googleplay')) s(store),
  generate_series(DATE '2000-01-01', DATE '2000-12-01', INTERVAL 1 MONTH) g(t0))"""
DURABLE_SQL = f"""durable AS (SELECT app_id, store, market, COUNT(DISTINCT day) AS tenure_days, MIN(rank) AS best_rank,
  CAST(SUM(CASE WHEN day >= DATE '{END}' - 30 THEN 1 ELSE 0 END) AS BIGINT) AS recent_rows
  FROM charts WHERE day BETWEEN DATE '{START}' AND DATE '{END}' AND rank <= 100 GROUP BY 1, 2, 3 HAVING COUNT(DISTINCT day) >= {LEAST_DAYS})"""
ROLLED_SQL = """rolled AS (SELECT app_id, store, list_sort(list(market)) AS markets, MAX(tenure_days) AS tenure_max, CAST(SUM(tenure_days) AS BIGINT) AS tenure_total,
  MIN(best_rank) AS best_rank, MAX(recent_rows) AS recent_rows FROM durable GROUP BY 1, 2)"""
AUTO_SQL, REVIEW_SQL = (", ".join(f"'{c}'" for c in classes) for classes in (fixed.AUTO_CLASSES, fixed.REVIEW_CLASSES))
STAGED_SQL = f"""pubs AS (SELECT publisher_id, store, COUNT(*) AS publisher_apps FROM inv WHERE publisher_id IS NOT NULL GROUP BY 1, 2),
staged AS (SELECT r.*, m.dna_class, m.has_subscription, m.description, i.publisher_id, COALESCE(p.publisher_apps, 1) AS publisher_apps,
  CASE WHEN m.dna_class IN ({AUTO_SQL}) THEN 'AUTO' WHEN m.dna_class IN ({REVIEW_SQL}) THEN 'REVIEW' ELSE 'NOT' END AS tier,
  CASE WHEN len(markets) < 2 THEN 'spread' WHEN m.app_id IS NULL THEN 'no_meta' WHEN i.publisher_id IS NULL THEN 'no_pub'
       WHEN m.dna_class IS NULL OR m.dna_class NOT IN ({AUTO_SQL}, {REVIEW_SQL}) THEN 'not_clonable' END AS drop_reason
  FROM rolled r LEFT JOIN meta m ON m.app_id = r.app_id AND m.store = r.store LEFT JOIN inv i ON i.app_id = r.app_id AND i.store = r.store
  LEFT JOIN pubs p ON p.publisher_id = i.publisher_id AND p.store = r.store),
scored AS (SELECT *, ROUND(0.3 * LEAST(1.0, tenure_max / 365.0) + 0.2 * LEAST(1.0, len(markets) / 5.0) + 0.2 * LEAST(1.0, recent_rows / 30.0)
  + 0.15 * GREATEST(0.0, 1 - best_rank / 100.0) + 0.15 * GREATEST(0.0, 1 - GREATEST(0, publisher_apps - 1) / 5.0), 6) AS score FROM staged WHERE drop_reason IS NULL)"""
SHORT = (D.CHARTS_SQL, DURABLE_SQL, ROLLED_SQL, D.INVARIANTS_SQL, D.METADATA_SQL, STAGED_SQL)


def _durable(spark, sf_dir):
    return shortlist.durability(D.charts(spark, sf_dir), START, END, 30, LEAST_DAYS)


def _staged(spark, sf_dir):
    return shortlist.stages(shortlist.rollup(_durable(spark, sf_dir)), D.metadata(spark, sf_dir), D.invariants(spark, sf_dir), 2)


@query(sql(*SHORT, """SELECT ROW_NUMBER() OVER (ORDER BY score DESC, app_id, store) AS position, app_id, store, array_to_string(markets, '|') AS markets, tenure_max, tier, score
  FROM scored ORDER BY score DESC, app_id, store LIMIT 100"""))
def shortlist_top(spark, sf_dir):
    out = shortlist.top(shortlist.scored(_staged(spark, sf_dir), 5), 100)
    return out.select("position", "app_id", "store", F.array_join("markets", "|").alias("markets"), "tenure_max", "tier", "score")


QUERIES["shortlist"] = QUERIES.pop("shortlist_top")
ORACLE_SQL["shortlist"] = ORACLE_SQL.pop("shortlist_top")


@query(sql(D.CHARTS_SQL, "SELECT market, store, day, app_id, rank, revenue FROM charts"))
def charts(spark, sf_dir):
    return D.charts(spark, sf_dir).select("market", "store", "day", "app_id", "rank", "revenue")


@query(sql(D.CHARTS_SQL, DURABLE_SQL, "SELECT * FROM durable"))
def a1_durability(spark, sf_dir):
    return _durable(spark, sf_dir)


@query(sql(D.CHARTS_SQL, DURABLE_SQL, ROLLED_SQL, "SELECT * REPLACE (array_to_string(markets, '|') AS markets) FROM rolled"))
def a2_rollup(spark, sf_dir):
    return shortlist.rollup(_durable(spark, sf_dir)).withColumn("markets", F.array_join("markets", "|"))


@query(sql(*SHORT, "SELECT COALESCE(drop_reason, 'kept') AS stage, COUNT(*) AS n FROM staged GROUP BY 1"))
def a30_funnel(spark, sf_dir):
    return shortlist.funnel(_staged(spark, sf_dir))


RISK = shortlist.RiskThresholds(least_markets=3, least_tenure=15, needs_subscription=True, supported_markets=("Asia", "EUROPE", "america"), clonable_classes=("Puzzle", "Idle", "Education", "Casino"))
CHECKED_SQL = """c AS (SELECT *, len(markets) AS n, list_filter(list_transform(markets, lambda m: lower(m)), lambda m: m NOT IN ('asia', 'europe', 'america')) AS outside FROM scored),
checked AS (SELECT *, CASE WHEN n >= 3 THEN 'PASS' ELSE 'FAIL' END AS s1, CASE WHEN tenure_max >= 15 THEN 'PASS' ELSE 'FAIL' END AS s2, CASE WHEN has_subscription THEN 'PASS' ELSE 'FAIL' END AS s3,
  CASE WHEN len(outside) = 0 THEN 'PASS' WHEN len(outside) = n THEN 'FAIL' ELSE 'WARN' END AS s4, CASE WHEN dna_class IN ('Puzzle', 'Idle', 'Education', 'Casino') THEN 'PASS' ELSE 'FAIL' END AS s5 FROM c),
risk AS (SELECT *, CASE WHEN 'FAIL' IN (s1, s2, s3, s4, s5) THEN 'FAIL' WHEN 'WARN' IN (s1, s2, s3, s4, s5) THEN 'WARN' ELSE 'PASS' END AS overall FROM checked)"""


def checked_shortlist(spark, sf_dir):
    return shortlist.evaluate_shortlist(shortlist.scored(_staged(spark, sf_dir), 5), RISK)


@query(sql(*SHORT, CHECKED_SQL, """ SELECT app_id, store, s1 AS markets_spread, s2 AS tenure, s3 AS subscription_iap, s4 AS supported_markets, s5 AS clonable_dna, overall,
  concat_ws('; ', n || ' markets ' || CASE WHEN n >= 3 THEN '>=' ELSE '<' END || ' 3 required', tenure_max || 'd ' || CASE WHEN tenure_max >= 15 THEN '>=' ELSE '<' END || ' 15d',
    CASE WHEN has_subscription THEN 'subscription IAP present' ELSE 'subscription IAP required but absent' END,
    CASE WHEN len(outside) = 0 THEN 'all ' || n || ' markets in supported set' WHEN len(outside) = n THEN 'none of ' || n || ' markets in supported set (outside: ' || array_to_string(outside, ', ') || ')'
      ELSE (n - len(outside)) || '/' || n || ' markets in supported set (outside: ' || array_to_string(outside, ', ') || ')' END,
    dna_class || CASE WHEN s5 = 'PASS' THEN ' in clonable set' ELSE ' not in clonable set' END) AS details FROM risk"""))
def a29_risk(spark, sf_dir):
    rows = checked_shortlist(spark, sf_dir)
    return rows.select("app_id", "store", *[shortlist.check_status(n).alias(n) for n in shortlist.RISK_CHECKS], "overall", F.array_join(F.transform("checks", lambda c: c["details"]), "; ").alias("details"))


@query(sql(*SHORT, CHECKED_SQL, " SELECT COUNT(*) AS total, COUNT(*) FILTER (overall = 'PASS') AS pass, COUNT(*) FILTER (overall = 'WARN') AS warn, COUNT(*) FILTER (overall = 'FAIL') AS fail FROM risk"))
def a29_summary(spark, sf_dir):
    return shortlist.risk_summary(checked_shortlist(spark, sf_dir))


@query(sql(D.CHARTS_SQL, "SELECT market, store, MIN(day) AS first_day, MAX(day) AS last_day, COUNT(DISTINCT day) AS days, COUNT(*) AS n_rows FROM charts GROUP BY 1, 2"))
def a4_coverage(spark, sf_dir):
    return audit.chart_coverage(D.charts(spark, sf_dir))


@query(sql(D.CHARTS_SQL, """v AS (SELECT r_name AS market, COUNT(DISTINCT day) AS days FROM region LEFT JOIN charts ON r_name = market GROUP BY 1)
  SELECT market, days, CASE WHEN days >= 300 THEN 'PASS' WHEN days >= 200 THEN 'WARN' ELSE 'FAIL' END AS status FROM v"""))
def a5_verdicts(spark, sf_dir):
    return audit.coverage_verdicts(D.charts(spark, sf_dir), D.table(spark, sf_dir, "region").select(F.col("r_name").alias("market")))


@query(sql(D.CHARTS_SQL, D.INVARIANTS_SQL, D.SIGNALS_SQL, """d AS (SELECT r_name, COUNT(DISTINCT day) AS n FROM region LEFT JOIN charts ON r_name = market GROUP BY 1),
  i AS (SELECT COUNT(*) AS n, LEAST(COUNT(publisher_id), COUNT(release_day)) / COUNT(*) AS share FROM inv)
  SELECT 'chart_coverage' AS check_name, CASE WHEN MIN(n) >= 300 THEN 'PASS' WHEN MIN(n) >= 200 THEN 'WARN' ELSE 'FAIL' END AS status, CAST(MIN(n) AS VARCHAR) AS detail FROM d
  UNION ALL SELECT 'rank_range', CASE WHEN MAX(rank) > 100 OR MAX(rank) IS NULL THEN 'WARN' ELSE 'PASS' END, CAST(MAX(rank) AS VARCHAR) FROM charts
  UNION ALL SELECT 'recent_data', CASE WHEN DATE '2002-01-01' - MAX(day) <= 30 THEN 'PASS' WHEN DATE '2002-01-01' - MAX(day) <= 90 THEN 'WARN' ELSE 'FAIL' END, CAST(DATE '2002-01-01' - MAX(day) AS VARCHAR) FROM charts
  UNION ALL SELECT 'signal_inventory', 'PASS', CAST(COUNT(DISTINCT signal_name) AS VARCHAR) FROM signals
  UNION ALL SELECT 'invariant_coverage', CASE WHEN n < 150 THEN 'FAIL' WHEN n < 180 OR share < 0.7 THEN 'WARN' ELSE 'PASS' END, CAST(n AS VARCHAR) FROM i"""))
def a10_audit(spark, sf_dir):
    markets = D.table(spark, sf_dir, "region").select(F.col("r_name").alias("market"))
    return audit.audit(D.charts(spark, sf_dir), D.invariants(spark, sf_dir), D.signals(spark, sf_dir), markets, "2002-01-01", least_apps=150, warn_apps=180)


@query(sql(D.SIGNALS_SQL, "SELECT signal_name, COUNT(*) AS n_rows, COUNT(value) AS n_values FROM signals GROUP BY 1"))
def a9_inventory(spark, sf_dir):
    return audit.signal_inventory(D.signals(spark, sf_dir))


@query(sql(D.INVARIANTS_SQL, "SELECT publisher_id, store, COUNT(*) AS publisher_apps FROM inv WHERE publisher_id IS NOT NULL GROUP BY 1, 2"))
def a3_publishers(spark, sf_dir):
    return shortlist.publisher_sizes(D.invariants(spark, sf_dir))


IMPROVE = """CASE WHEN d >= 50 THEN 8 + LEAST(d - 50, 50) / 50.0 * 2 WHEN d >= 20 THEN 5 + (d - 20) / 29.0 * 2 WHEN d >= 0 THEN 2 + d / 19.0 * 2
  ELSE GREATEST(0.0, 1 - LEAST(-d, 50) / 50.0) END"""


@query(sql(D.CHARTS_SQL, f"""best AS (SELECT app_id, day, MIN(rank) AS rank FROM charts WHERE day BETWEEN DATE '{NOW}' - 30 AND DATE '{NOW}' AND rank <= 200 GROUP BY 1, 2),
  n AS (SELECT *, COUNT(*) OVER (PARTITION BY app_id) AS n, rank - LAG(rank) OVER w AS b, LEAD(rank) OVER w - rank AS a FROM best WINDOW w AS (PARTITION BY app_id ORDER BY day)),
  s AS (SELECT * FROM n WHERE n >= 5 AND NOT COALESCE(abs(b) > 2 AND abs(a) > 2 AND sign(b) <> sign(a), false)),
  g AS (SELECT app_id, COUNT(*) AS points, arg_min(rank, day) AS first_rank, arg_max(rank, day) AS last_rank FROM s GROUP BY 1 HAVING COUNT(*) >= 5)
  SELECT app_id, points, first_rank, last_rank, ROUND(CAST({IMPROVE.replace('d ', '(first_rank - last_rank) ').replace('-d', '-(first_rank - last_rank)')} AS DOUBLE), 6) AS velocity FROM g"""))
def w2_velocity(spark, sf_dir):
    return signals.velocity_v1(D.charts(spark, sf_dir), NOW, least=5, threshold=2)


@query(sql(D.CHARTS_SQL, f"""v AS (SELECT app_id, CASE WHEN COUNT(*) >= 3 THEN stddev_pop(rank) END AS sd FROM charts WHERE day BETWEEN DATE '{NOW}' - 90 AND DATE '{NOW}' GROUP BY 1)
  SELECT app_id, ROUND(sd, 6) AS rank_sd, CASE WHEN sd IS NOT NULL THEN ROUND(LEAST(GREATEST(1 - sd / 50, 0), 1), 6) END AS retention,
  CASE WHEN sd IS NOT NULL THEN ROUND(LEAST(GREATEST(sd / 50 * 10, 0), 10), 6) END AS instability FROM v"""))
def a13_volatility(spark, sf_dir):
    return signals.volatility(D.charts(spark, sf_dir), NOW)


TREND_SQL = """tr AS (SELECT app_id, COUNT(*) AS n_reviews, regr_slope(rating, x) AS s, var_pop(x) AS v FROM (
  SELECT app_id, rating, CAST(CAST(ts AS DATE) - DATE '2024-01-31' AS DOUBLE) AS x FROM reviews WHERE ts <= TIMESTAMP '2024-01-31' AND ts >= DATE '2024-01-31' - 90) GROUP BY 1),
trend AS (SELECT app_id, n_reviews, CASE WHEN n_reviews < 3 THEN NULL WHEN v = 0 THEN 0.0 ELSE s * 90 END AS sl FROM tr)"""


@query(sql(D.REVIEWS_SQL, TREND_SQL, "SELECT app_id, n_reviews, ROUND(sl, 4) AS slope, CASE WHEN sl IS NOT NULL THEN ROUND(LEAST(10.0, GREATEST(0.0, -sl) * 10), 4) END AS trend FROM trend"))
def a14_rating_trend(spark, sf_dir):
    out = signals.rating_trend(D.reviews(spark, sf_dir), "2024-01-31")
    return out.withColumn("trend", F.when(F.col("slope").isNotNull(), F.col("trend")))


@query(sql(D.SIGNALS_SQL, """latest AS (SELECT app_id, signal_name, arg_max(value, (day, event_id)) AS value, MAX(day) AS seen_day FROM signals WHERE value IS NOT NULL AND day <= DATE '2024-01-20' GROUP BY 1, 2)
  SELECT app_id, DATE '2024-01-20' AS t0, signal_name, value, seen_day FROM latest"""))
def j7_as_of_skip(spark, sf_dir):
    s = D.signals(spark, sf_dir)
    return backtest.as_of(s.select("app_id", F.lit("2024-01-20").cast("date").alias("t0")), s, "skip")


@query(sql(D.SIGNALS_SQL, """r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY app_id, signal_name ORDER BY day DESC, event_id DESC) AS k FROM signals WHERE day <= DATE '2024-01-20')
  SELECT app_id, DATE '2024-01-20' AS t0, signal_name, value, day AS seen_day FROM r WHERE k = 1"""))
def j7_as_of_keep(spark, sf_dir):
    s = D.signals(spark, sf_dir)
    return backtest.as_of(s.select("app_id", F.lit("2024-01-20").cast("date").alias("t0")), s, "keep")


@query(sql(D.SIGNALS_SQL, """g AS (SELECT DISTINCT app_id, CAST(t0 AS DATE) AS t0 FROM signals, generate_series(DATE '2023-12-30', DATE '2024-02-03', INTERVAL 7 DAY) d(t0) WHERE app_id % 10 <> 0),
  r AS (SELECT g.t0, s.*, ROW_NUMBER() OVER (PARTITION BY s.app_id, g.t0, signal_name ORDER BY day DESC, event_id DESC) AS k FROM g JOIN signals s ON s.app_id = g.app_id AND day <= g.t0)
  SELECT app_id, t0, signal_name, value, day AS seen_day FROM r WHERE k = 1 AND value IS NOT NULL"""))
def j7_as_of_grid(spark, sf_dir):
    """Policy `missing` on six dates at once."""
    s = D.signals(spark, sf_dir)
    dates = F.explode(F.sequence(F.lit("2023-12-30").cast("date"), F.lit("2024-02-03").cast("date"), F.expr("interval 7 day"))).alias("t0")
    return backtest.as_of(s.where("app_id % 10 <> 0").select("app_id").distinct().select("app_id", dates), s, "missing")


@query(sql(D.CHARTS_SQL, f"""inside AS (SELECT *, CASE WHEN app_id % 2 = 0 THEN 'games' ELSE 'tools' END AS category FROM charts WHERE day BETWEEN DATE '{START}' AND DATE '{END}' AND rank <= 3 AND market IN ('ASIA', 'EUROPE'))
  SELECT app_id, store, market, COUNT(DISTINCT day) AS tenure_days, MIN(rank) AS best_rank, CAST(COUNT(*) FILTER (day >= DATE '{END}' - 30) AS BIGINT) AS recent_rows FROM inside WHERE category = 'games' GROUP BY 1, 2, 3 HAVING COUNT(DISTINCT day) >= 3"""))
def p1_window(spark, sf_dir):
    """Durable apps of one category in two of the markets."""
    rows = D.charts(spark, sf_dir).withColumn("category", F.when(F.col("app_id") % 2 == 0, "games").otherwise("tools"))
    return shortlist.durability(rows, START, END, 30, 3, 3, "games", ["ASIA", "EUROPE"])


@query(sql(D.SIGNALS_SQL, "SELECT app_id, DATE '2024-01-20' AS t0, COUNT(*) AS n_after FROM signals WHERE day > DATE '2024-01-20' GROUP BY 1"))
def j10_leaks(spark, sf_dir):
    s = D.signals(spark, sf_dir)
    return backtest.leaks(s.select("app_id", F.lit("2024-01-20").cast("date").alias("t0")), s)


@query(sql(D.SIGNALS_SQL, """v AS (SELECT app_id, signal_name, arg_max(value, (day, event_id)) AS value FROM signals WHERE value IS NOT NULL AND day <= DATE '2024-01-20' GROUP BY 1, 2),
  k AS (SELECT app_id, value, ROW_NUMBER() OVER (PARTITION BY app_id ORDER BY value DESC, signal_name) AS k, COUNT(*) OVER (PARTITION BY app_id) AS n FROM v)
  SELECT app_id, CASE WHEN MAX(n) >= 3 THEN ROUND(SUM(CASE WHEN k <= 3 THEN value END) / 3, 6) END AS score, MAX(n) >= 3 AS eligible FROM k GROUP BY 1"""))
def a26_composite(spark, sf_dir):
    s = D.signals(spark, sf_dir)
    wide = backtest.as_of(s.select("app_id", F.lit("2024-01-20").cast("date").alias("t0")), s, "skip").groupBy("app_id").pivot("signal_name", ["click", "error", "purchase", "signup", "view"]).agg(F.first("value"))
    score = X.top3_mean([F.col(c) for c in ("click", "error", "purchase", "signup", "view")])
    return wide.select("app_id", F.round(score, 6).alias("score"), score.isNotNull().alias("eligible"))


LABELS_SQL = f"""pairs AS (SELECT DISTINCT c.market, c.store, c.t0, app_id FROM cohorts c JOIN charts USING (market, store) WHERE day BETWEEN c.t0 - 6 AND c.t0),
e AS (SELECT market, store, MAX(day) AS last_day FROM charts GROUP BY 1, 2),
labels AS (SELECT p.app_id, p.market, p.store, p.t0, CAST(COALESCE(MAX(CASE WHEN h.day = p.t0 + 90 THEN 1 END), 0) AS INTEGER) AS winner_exact, CAST(COALESCE(MAX(CASE WHEN h.day IS NOT NULL THEN 1 END), 0) AS INTEGER) AS winner_window
  FROM pairs p JOIN e USING (market, store) LEFT JOIN charts h ON h.market = p.market AND h.store = p.store AND h.app_id = p.app_id AND h.rank <= {TOP} AND h.day BETWEEN p.t0 + 84 AND p.t0 + 90
  WHERE last_day >= p.t0 + 90 GROUP BY 1, 2, 3, 4)"""


@query(sql(D.CHARTS_SQL, COHORTS_SQL, LABELS_SQL, "SELECT * FROM labels"))
def a31_labels(spark, sf_dir):
    return factors.cohort_labels(D.charts(spark, sf_dir), cohorts(spark, sf_dir), 90, TOP)


@query(sql(D.CHARTS_SQL, COHORTS_SQL, """m AS (SELECT DISTINCT market, t0 FROM cohorts),
  p AS (SELECT m.market, m.t0, app_id, MIN(day) AS first, MAX(CASE WHEN day BETWEEN m.t0 - 7 AND m.t0 AND rank <= 100 THEN 1 ELSE 0 END) AS recent FROM m JOIN charts USING (market) GROUP BY 1, 2, 3)
  SELECT market, t0, app_id FROM p WHERE first >= t0 - 1850 AND recent = 1"""))
def t8_fresh_pool(spark, sf_dir):
    return backtest.candidate_pool(D.charts(spark, sf_dir), cohorts(spark, sf_dir).select("market", "t0").distinct(), "fresh", 1850)


@query(sql(D.CHARTS_SQL, COHORTS_SQL, "SELECT DISTINCT c.market, c.t0, app_id FROM cohorts c JOIN charts USING (market) WHERE day <= c.t0 AND rank <= 200"))
def t8_survival_pool(spark, sf_dir):
    return backtest.candidate_pool(D.charts(spark, sf_dir), cohorts(spark, sf_dir).select("market", "t0").distinct(), "survival")


@query(sql(D.CHARTS_SQL, COHORTS_SQL, "SELECT DISTINCT c.market, c.t0, app_id FROM cohorts c JOIN charts USING (market) WHERE day BETWEEN c.t0 - 7 AND c.t0 + 7 AND rank BETWEEN 3 AND 4"))
def t8_entrants_pool(spark, sf_dir):
    return backtest.candidate_pool(D.charts(spark, sf_dir), cohorts(spark, sf_dir), "entrants", deepest=2)


@query(sql(D.CHARTS_SQL, COHORTS_SQL, "SELECT DISTINCT c.market, c.t0, app_id FROM cohorts c JOIN charts USING (market) WHERE day <= c.t0"))
def t8_any_pool(spark, sf_dir):
    return backtest.candidate_pool(D.charts(spark, sf_dir), cohorts(spark, sf_dir), "any")


CELLS_SQL = f"""y AS (SELECT c.market, c.store, c.t0, app_id, day, rank FROM cohorts c JOIN charts USING (market, store) WHERE day BETWEEN c.t0 - 365 AND c.t0),
cells AS (SELECT market, store, t0, app_id, arg_min(rank, (CAST(t0 - day AS INTEGER), rank)) FILTER (day >= t0 - 6) AS f0, COUNT(DISTINCT day) FILTER (rank <= {TOP}) AS f1,
  CASE WHEN COUNT(*) FILTER (day >= t0 - 90) >= 2 AND stddev_pop(rank) FILTER (day >= t0 - 90) > 0 THEN ROUND(1 / stddev_pop(rank) FILTER (day >= t0 - 90), 6) END AS f2, MIN(rank) AS best
  FROM y GROUP BY 1, 2, 3, 4 HAVING COUNT(*) FILTER (day >= t0 - 6) > 0),
b5 AS (SELECT t0, app_id, COUNT(DISTINCT (market, store)) AS f5 FROM (SELECT DISTINCT t0 FROM cohorts) c JOIN charts ON day BETWEEN t0 - 6 AND t0 AND rank <= {TOP} GROUP BY 1, 2),
t7 AS (SELECT t0, store, app_id, publisher_id, COUNT(DISTINCT (market, day)) AS tenure FROM (SELECT DISTINCT t0 FROM cohorts) c JOIN charts ON day BETWEEN t0 - 365 AND t0 AND rank <= {TOP} JOIN inv USING (app_id, store) GROUP BY 1, 2, 3, 4),
f7 AS (SELECT a.t0, a.store, a.app_id, ROUND(AVG(b.tenure), 6) AS f7 FROM t7 a LEFT JOIN t7 b ON a.t0 = b.t0 AND a.store = b.store AND a.publisher_id = b.publisher_id AND a.app_id <> b.app_id GROUP BY 1, 2, 3),
wk AS (SELECT DISTINCT c.market, c.t0, charts.store, app_id FROM (SELECT DISTINCT market, t0 FROM cells) c JOIN charts ON charts.market = c.market AND day BETWEEN t0 - 6 AND t0 AND rank <= {TOP})"""


WIDE_SQL = """wide AS (SELECT c.market, c.store, c.t0, c.app_id, f0, f1, f2, ROUND(f0 / best, 6) AS f4, f5, f7,
  CAST(CASE WHEN c.t0 >= release_day THEN LEAST(365, c.t0 - release_day) END AS BIGINT) AS f11,
  CASE WHEN EXISTS (SELECT 1 FROM wk w WHERE w.market = c.market AND w.t0 = c.t0 AND w.store <> c.store)
       THEN CAST(EXISTS (SELECT 1 FROM wk w WHERE w.market = c.market AND w.t0 = c.t0 AND w.store <> c.store AND w.app_id = c.app_id) AS BIGINT) END AS f14
  FROM cells c LEFT JOIN b5 USING (t0, app_id) LEFT JOIN f7 ON f7.t0 = c.t0 AND f7.store = c.store AND f7.app_id = c.app_id LEFT JOIN inv ON inv.app_id = c.app_id AND inv.store = c.store)"""
FACTOR_SQL = (D.CHARTS_SQL, COHORTS_SQL, D.INVARIANTS_SQL, CELLS_SQL, WIDE_SQL)


@query(sql(*FACTOR_SQL, "SELECT * FROM wide"))
def m11_factors(spark, sf_dir):
    return factors.factor_table(D.charts(spark, sf_dir), D.invariants(spark, sf_dir), cohorts(spark, sf_dir), TOP)


def _long(spark, sf_dir):
    return factors.to_long(m11_factors(spark, sf_dir))


LONG_SQL = f"""long AS (SELECT market, store, t0, app_id, unnest({list(factors.FACTORS)}) AS signal_name, unnest([{", ".join(f"CAST({f} AS DOUBLE)" for f in factors.FACTORS)}]) AS value FROM wide)"""


@query(sql(*FACTOR_SQL, LONG_SQL, "SELECT signal_name, COUNT(*) AS n_rows, COUNT(value) AS n_values, ROUND(COUNT(value) / COUNT(*), 6) AS share FROM long GROUP BY 1"))
def a25_factor_coverage(spark, sf_dir):
    return factors.coverage(_long(spark, sf_dir))


@query(sql(*FACTOR_SQL, "SELECT market, store, t0, app_id, CAST(f0 AS DOUBLE) AS f0, CAST(f5 AS DOUBLE) AS f5, f7 FROM wide"))
def m0_wide(spark, sf_dir):
    return factors.to_wide(_long(spark, sf_dir), ("f0", "f5", "f7"))


@query(sql(*FACTOR_SQL, LONG_SQL, """q AS (SELECT *, LEAST(GREATEST(value, quantile_cont(value, 0.01) OVER w), quantile_cont(value, 0.99) OVER w) AS cut FROM long WINDOW w AS (PARTITION BY market, store, t0, signal_name)),
  s AS (SELECT *, CASE WHEN value IS NOT NULL THEN cut END AS v FROM q),
  z AS (SELECT *, COUNT(v) OVER w AS n, AVG(v) OVER w AS mean, stddev_samp(v) OVER w AS sd FROM s WINDOW w AS (PARTITION BY market, store, t0, signal_name))
  SELECT market, store, t0, app_id, signal_name, value, ROUND(CASE WHEN n < 2 THEN v WHEN COALESCE(sd, 0) < 1e-12 THEN 0.0 ELSE (v - mean) / sd END, 5) AS z FROM z"""))
def m2_standardized(spark, sf_dir):
    out = factors.standardized_wide(m11_factors(spark, sf_dir), factors.CELL)
    each = F.array(*[F.struct(F.lit(f).alias("signal_name"), F.col(f).alias("value"), F.round(f"z_{f}", 5).alias("z")) for f in factors.FACTORS])
    return out.select(*factors.CELL, "app_id", F.inline(each))


RANKED_SQL = """vals AS (SELECT market, store, t0, app_id, unnest(['f0', 'f1', 'random']) AS ranker, unnest([-CAST(f0 AS DOUBLE), CAST(f1 AS DOUBLE),
    CAST(CAST('0x' || substr(md5(concat_ws('|', '0', market, store, CAST(t0 AS VARCHAR), CAST(app_id AS VARCHAR))), 1, 12) AS BIGINT) AS DOUBLE)]) AS value FROM cells),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY market, store, t0, ranker ORDER BY value DESC, app_id) AS pos FROM vals)"""


def _ranked(spark, sf_dir, *carry):
    cells = factors.cell_factors(D.charts(spark, sf_dir), cohorts(spark, sf_dir), TOP, 90 if carry else None)
    return backtest.rankings_wide(cells, factors.CELL, {"f0": -F.col("f0"), "f1": F.col("f1")}, carry=carry)


@query(sql(D.CHARTS_SQL, COHORTS_SQL, D.INVARIANTS_SQL, CELLS_SQL, RANKED_SQL, "SELECT market, store, t0, ranker, app_id, pos FROM ranked WHERE pos <= 5"))
def t3_top_k(spark, sf_dir):
    return backtest.top_k(_ranked(spark, sf_dir), 5)


@query(sql(D.CHARTS_SQL, COHORTS_SQL, D.INVARIANTS_SQL, CELLS_SQL, RANKED_SQL, """w AS (SELECT ranked.*, EXISTS (SELECT 1 FROM charts h WHERE h.market = ranked.market AND h.store = ranked.store AND h.app_id = ranked.app_id AND h.rank <= 3 AND h.day BETWEEN ranked.t0 + 84 AND ranked.t0 + 90) AS won FROM ranked)
  SELECT market, store, t0, ranker, k, ROUND(COUNT(*) FILTER (pos <= k AND won) / k, 6) AS precision FROM w, (VALUES (5), (10)) ks(k) GROUP BY 1, 2, 3, 4, 5"""))
def a17_precision(spark, sf_dir):
    return backtest.carried_precision(_ranked(spark, sf_dir, "winner_window"), "winner_window", factors.CELL, (5, 10))


@query(f"""WITH p AS ({ORACLE_SQL['a17_precision']}), w AS (SELECT market, store, t0, k, MAX(CASE WHEN ranker = 'f1' THEN precision END) AS a, MAX(CASE WHEN ranker = 'f0' THEN precision END) AS b FROM p GROUP BY 1, 2, 3, 4)
  SELECT market, store, t0, k, ROUND(CAST(CASE WHEN b > 0 THEN a / b WHEN a > 0 THEN 999.0 ELSE 0.0 END AS DOUBLE), 6) AS lift FROM w""")
def a18_lift(spark, sf_dir):
    wide = a17_precision(spark, sf_dir).groupBy(*factors.CELL, "k").pivot("ranker", ["f0", "f1"]).agg(F.first("precision"))
    return wide.select(*factors.CELL, "k", F.round(backtest.lift(F.col("f1"), F.col("f0")), 6).alias("lift"))


@query(sql(D.CHARTS_SQL, COHORTS_SQL, D.INVARIANTS_SQL, CELLS_SQL, """r AS (SELECT *, COUNT(*) OVER w AS n, regr_slope(f1, f0) OVER w AS b, AVG(f1) OVER w AS my, AVG(f0) OVER w AS mx FROM cells WINDOW w AS (PARTITION BY market, store, t0))
  SELECT market, store, t0, app_id, CAST(f0 AS DOUBLE) AS f0, ROUND(CASE WHEN n < 3 THEN f1 ELSE f1 - my - COALESCE(CASE WHEN isnan(b) THEN 0 ELSE b END, 0) * (f0 - mx) END, 5) AS f1 FROM r"""))
def m3_two_factors(spark, sf_dir):
    cells = factors.cell_factors(D.charts(spark, sf_dir), cohorts(spark, sf_dir), TOP)
    return factors.residualized(cells, factors.CELL, ("f0", "f1")).withColumn("f1", F.round("f1", 5))


def _study(spark, sf_dir):
    """Factors of all cells with both labels, of charts that go on until then, written out: several jobs read them."""
    rows = factors.factor_table(D.charts(spark, sf_dir), D.invariants(spark, sf_dir), cohorts(spark, sf_dir), TOP, 90)
    return scratch.stored(rows.where("winner_exact is not null"), "study")


KEYS = [*factors.CELL, "app_id"]
SEA_REGIONS = ("AFRICA", "ASIA")
_LABELLED_SQL = LABELS_SQL + """,
ll AS (SELECT l.*, label, CASE label WHEN 'winner_exact' THEN winner_exact ELSE winner_window END AS is_winner FROM long l JOIN labels USING (market, store, t0, app_id), (VALUES ('winner_exact'), ('winner_window')) v(label) WHERE value IS NOT NULL),
dir AS (SELECT signal_name, label, COALESCE(COUNT(*) >= 30 AND ROUND(covar_pop(value, is_winner), 9) < 0, false) AS up FROM ll GROUP BY 1, 2),
pl AS (SELECT ll.*, COUNT(*) OVER (PARTITION BY market, store, t0, label, signal_name) AS n, ROW_NUMBER() OVER (PARTITION BY market, store, t0, label, signal_name ORDER BY CASE WHEN up OR signal_name = 'f0' THEN value ELSE -value END, app_id) AS pos
  FROM ll JOIN dir USING (signal_name, label)),
pr AS (SELECT market, store, t0, label, signal_name, MAX(n) AS n, ROUND(AVG(is_winner), 6) AS precision FROM pl WHERE n >= {least} AND pos <= GREATEST(1, ceil(0.1 * n)) GROUP BY 1, 2, 3, 4, 5),
lifts AS (SELECT a.market, a.store, a.t0, a.label, a.signal_name, a.n, a.precision, b.precision AS base, ROUND(a.precision - b.precision, 6) AS lift FROM pr a JOIN pr b ON a.market = b.market AND a.store = b.store AND a.t0 = b.t0 AND a.label = b.label AND b.signal_name = 'f0' WHERE a.signal_name <> 'f0')"""
LABELLED_SQL, RAW_LIFTS_SQL = (_LABELLED_SQL.replace("{least}", str(n)) for n in (10, 3))


LABELS = ("winner_exact", "winner_window")


def lifts_of(long, labels, least=10):
    """lifts_wide() of factors (*KEYS, signal_name, value) and labels in tables of their own."""
    return lifts_wide(factors.to_wide(long).join(labels, KEYS), least)


def lifts_wide(rows, least=10):
    """Lifts over f0 for each cohort, factor and kind of label; f0 always ranks its low values first."""
    return factors.cohort_lifts(factors.top_deciles(rows, LABELS, least=least), [*factors.CELL, "label"])


@query(sql(*FACTOR_SQL, LONG_SQL, RAW_LIFTS_SQL, " SELECT * FROM lifts"))
def m5_lifts(spark, sf_dir):
    rows = _study(spark, sf_dir)
    return lifts_wide(rows, least=3).drop("cohort").withColumn("lift", F.round("lift", 6))


@query(sql(*FACTOR_SQL, LONG_SQL, LABELLED_SQL, f"""i AS (SELECT label || ':' || signal_name AS signal_name, lift, ROW_NUMBER() OVER w - 1 AS i, COUNT(*) OVER (PARTITION BY label, signal_name) AS n FROM lifts WHERE market IN {SEA_REGIONS}
    WINDOW w AS (PARTITION BY label, signal_name ORDER BY concat_ws('/', market, store, CAST(t0 AS VARCHAR), label))),
  d AS (SELECT signal_name, n, rep, (((CAST(rep AS BIGINT) * 1000003 + i * 7919 + 42 * 104729) * 2654435761 % 4294967296) // 256) % n AS i FROM i, range(0, 200) r(rep)),
  m AS (SELECT d.signal_name, rep, median(i.lift) AS m FROM d JOIN i ON i.signal_name = d.signal_name AND i.i = d.i GROUP BY 1, 2),
  q AS (SELECT signal_name, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high, AVG(CASE WHEN m <= 0 THEN 1.0 ELSE 0.0 END) AS below, AVG(CASE WHEN m >= 0 THEN 1.0 ELSE 0.0 END) AS above FROM m GROUP BY 1),
  s AS (SELECT signal_name, COUNT(*) AS n, median(lift) AS med FROM i GROUP BY 1),
  o AS (SELECT signal_name, n, CASE WHEN n >= 3 THEN ROUND(med, 6) END AS median, CASE WHEN n >= 3 THEN ROUND(low, 6) END AS low, CASE WHEN n >= 3 THEN ROUND(high, 6) END AS high,
    CASE WHEN n >= 3 THEN ROUND(CASE WHEN med = 0 THEN 1.0 ELSE LEAST(1.0, 2 * CASE WHEN med > 0 THEN below ELSE above END) END, 6) END AS p FROM s JOIN q USING (signal_name))
  SELECT signal_name, n, CAST(median AS DOUBLE) AS median, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, CAST(p AS DOUBLE) AS p, COALESCE(median >= 0.03 AND p < 0.05 / 8, false) AS alive FROM o"""))
def m6_bootstrap(spark, sf_dir):
    rows = _study(spark, sf_dir)
    lifts = lifts_wide(rows, least=10).where(F.col("market").isin(*SEA_REGIONS))
    boot = factors.cluster_bootstrap(lifts.select(F.concat_ws(":", "label", "signal_name").alias("signal_name"), "cohort", F.round("lift", 6).alias("lift")), reps=200)
    return factors.verdicts(boot.select("signal_name", "n", *[F.round(c, 6).alias(c) for c in ("median", "low", "high", "p")]))


def processed(rows):
    """Standardized and residualized factors of _study() rows, by cell."""
    z = factors.standardized_wide(rows, factors.CELL).select(*KEYS, *[F.col(f"z_{f}").alias(f) for f in factors.FACTORS])
    return factors.residualized(scratch.stored(z, "standardized"), factors.CELL)


def _composite(rows, chain, label="winner_exact"):
    """(rows, folds) of the composite over the first tier, without the factors that too few rows have."""
    left_out = factors.low_coverage(factors.coverage(factors.to_long(rows)))
    wide = chain.join(rows.select(*KEYS, label), KEYS)
    wide = scratch.stored(wide.where(F.col("market").isin(*SEA_REGIONS)), "composite")
    return wide, factors.forward_chaining(wide, [f for f in factors.FACTORS if f == "f0" or f not in left_out], label)


@query()
def m9_study(spark, sf_dir):
    """The whole study: each factor's lift over f0 after standardizing and residualizing, for both labels over the first
    tier's cohorts, the composite's median lift over its folds, and the code of the verdict on the exact label. No SQL: tests
    hold chain, lifts, bootstrap and folds against plain numpy."""
    rows = _study(spark, sf_dir)
    chain = scratch.stored(processed(rows), "chain")
    lifts = scratch.stored(lifts_wide(chain.join(rows.select(*KEYS, *LABELS), KEYS)), "lifts")
    boot = factors.cluster_bootstrap(lifts.where(F.col("market").isin(*SEA_REGIONS)).select(F.concat_ws(":", "label", "signal_name").alias("signal_name"), "cohort", "lift"))
    out = scratch.stored(factors.verdicts(boot), "verdicts")
    said = factors.composite_verdict(*_composite(rows, chain)).first()
    code = factors.study_verdict(out.where("signal_name like 'winner_exact:%'"), said["median_lift"])
    whole = spark.createDataFrame([("winner_exact:composite", said["n_folds"], said["median_lift"], said["alive"])], "signal_name string, n long, median double, alive boolean")
    return out.unionByName(whole, allowMissingColumns=True).withColumn("verdict", F.lit(code))


@query()
def m7_composite(spark, sf_dir):
    """Forward-chaining folds of the composite and a last row with their median lift and what came of it. No SQL: a test
    holds the folds against a plain logistic fit."""
    rows = _study(spark, sf_dir)
    wide, folds = _composite(rows, processed(rows))
    folds = scratch.stored(folds, "folds")
    said = factors.composite_verdict(wide, folds)
    last = said.select(F.lit("composite").alias("kind"), "status", "n_folds", F.col("median_lift").alias("lift"), "alive")
    return folds.withColumn("kind", F.lit("fold")).unionByName(last, allowMissingColumns=True)


def _language_sql() -> str:
    words = {k: v.split() for k, v in fixed.STOP_WORDS.items()}
    hits = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(s) for s in v)}))) AS n_{k}" for k, v in words.items())
    best = " ".join(f"WHEN n_{k} >= 2 AND " + " AND ".join(f"n_{k} > n_{o}" for o in words if o != k) + f" THEN '{k}'" for k in words)
    return f"""WITH t AS (SELECT doc_id, lang, text, regexp_split_to_array(nfc_normalize(lower(text)), '[^\\p{{L}}\\p{{M}}''’]+') AS w FROM documents),
  c AS (SELECT doc_id, lang, trim(text) = '' AS blank, {hits} FROM t), d AS (SELECT doc_id, lang, blank, CASE {best} END AS found FROM c)
  SELECT doc_id, found, CASE WHEN blank OR found IS NULL THEN 5.0::DOUBLE WHEN found = lang THEN 0.0::DOUBLE ELSE 10.0::DOUBLE END AS gap FROM d"""


@query(_language_sql())
def x10_localization(spark, sf_dir):
    found = D.table(spark, sf_dir, "documents").select("doc_id", "lang", "text", X.detected_language(F.col("text")).alias("found"))
    return found.select("doc_id", "found", X.localization_gap(F.col("text"), F.col("lang"), F.col("found")).alias("gap"))


@query("""WITH p AS (SELECT p_partkey, p_retailprice AS price, p_size AS size FROM part)
  SELECT p_partkey, ROUND(CASE WHEN p_partkey % 5 = 0 OR price * size <= 0 THEN 0.0 ELSE LEAST(10.0, GREATEST(0.0, (log10(price * size + 1) - 2) / 6 * 10)) END, 6) AS revenue,
  ROUND(CAST(CASE WHEN size / 3.0 < 5 THEN size / 15.0 WHEN size / 3.0 < 10 THEN 2 + (size / 3.0 - 5) / 5 * 2 WHEN size / 3.0 <= 15 THEN 5 + (size / 3.0 - 10) / 5 * 2 ELSE 8 + LEAST(size / 3.0 - 15, 10) / 10 * 2 END AS DOUBLE), 6) AS economics FROM p""")
def x3_economics(spark, sf_dir):
    size = F.col("p_size").cast("double")
    rating = F.when(F.col("p_partkey") % 5 == 0, float("nan")).otherwise(F.col("p_retailprice"))
    return D.table(spark, sf_dir, "part").select("p_partkey", F.round(X.revenue_proxy(rating, F.col("p_size"), F.lit(1.0)), 6).alias("revenue"), F.round(X.ratio_score(size / 3), 6).alias("economics"))
