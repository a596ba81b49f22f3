"""Registered queries of rankings, gates, reports and cohort statistics, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartwright.functions import exprs as X
from chartwright.operators import backtest, reports, shortlist
from chartwright.plans import registry as R
from chartwright.plans.registry import ORACLE_SQL, QUERIES, query, sql
from chartwright.sources import derived as D

NAMES = ("click", "error", "purchase", "signup", "view")
SEA = ("AFRICA", "ASIA")
AS_OF = "2024-01-20"
WIDE_SQL = f"""latest AS (SELECT app_id, signal_name, arg_max(value, (day, event_id)) AS value FROM signals WHERE value IS NOT NULL AND day <= DATE '{AS_OF}' GROUP BY 1, 2),
wide AS (SELECT app_id, {", ".join(f"MAX(CASE WHEN signal_name = '{n}' THEN value END) AS {n}" for n in NAMES)} FROM latest GROUP BY 1)"""


def _wide(spark, sf_dir):
    s = D.signals(spark, sf_dir)
    latest = backtest.as_of(s.select("app_id", F.lit(AS_OF).cast("date").alias("t0")), s, "skip")
    return latest.groupBy("app_id").pivot("signal_name", list(NAMES)).agg(F.first("value"))


@query(sql(D.CHARTS_SQL, D.SIGNALS_SQL, """pairs AS (SELECT app_id, t FROM (SELECT DISTINCT app_id FROM (SELECT app_id FROM charts UNION ALL SELECT app_id FROM signals)), (VALUES (DATE '2000-06-01'), (DATE '2024-01-20')) d(t)),
  c AS (SELECT p.app_id, t, COUNT(DISTINCT CASE WHEN rank <= 100 THEN floor((day - DATE '1970-01-01') / 30) END) AS months, COUNT(*) FILTER (day >= t - 90) AS n_near,
    stddev_pop(rank) FILTER (day >= t - 90) AS sd FROM pairs p JOIN charts USING (app_id) WHERE day <= t GROUP BY 1, 2),
  s AS (SELECT p.app_id, t, COUNT(value) FILTER (signal_name = 'view' AND day >= t - 90) AS points,
    arg_max(value, (day, event_id)) FILTER (signal_name = 'view' AND day >= t - 90) - arg_min(value, (day, event_id)) FILTER (signal_name = 'view' AND day >= t - 90) AS growth,
    arg_max({'v': value}, (day, event_id)) FILTER (signal_name = 'purchase') AS revenue FROM pairs p JOIN signals USING (app_id) WHERE day <= t GROUP BY 1, 2),
  w AS (SELECT p.app_id, p.t, CASE WHEN c.app_id IS NOT NULL OR s.app_id IS NOT NULL THEN ROUND(10 * (0.4 * LEAST(1.0, COALESCE(months, 0) / 36.0)
    + 0.3 * CASE WHEN points >= 2 THEN LEAST(1.0, GREATEST(0.0, growth / 1000)) ELSE 0 END + 0.2 * COALESCE(LEAST(1.0, GREATEST(0.0, revenue.v / 100000)), 0.0)
    + 0.1 * CASE WHEN n_near >= 3 THEN LEAST(1.0, GREATEST(0.0, 1 - sd / 50)) ELSE 0 END), 6) END AS score FROM pairs p LEFT JOIN c USING (app_id, t) LEFT JOIN s USING (app_id, t))
  SELECT app_id, t, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 7 THEN 'winner' WHEN score >= 5 THEN 'marginal' WHEN score IS NOT NULL THEN 'loser' END AS tier FROM w"""))
def a16_winner_scores(spark, sf_dir):
    c, s = D.charts(spark, sf_dir), D.signals(spark, sf_dir)
    dates = F.explode(F.array(F.lit("2000-06-01").cast("date"), F.lit("2024-01-20").cast("date"))).alias("t")
    pairs = c.select("app_id").unionByName(s.select("app_id")).distinct().select("app_id", dates)
    return backtest.winner_scores(pairs, c, s, "view", "purchase")


def _gaps(spark, sf_dir):
    found = D.table(spark, sf_dir, "documents").select("source", "lang", "text", X.detected_language(F.col("text")).alias("found"))
    return found.select("source", "lang", X.localization_gap(F.col("text"), F.col("lang"), F.col("found")).alias("value"))


@query(f"""WITH g AS ({ORACLE_SQL['x10_localization']}), v AS (SELECT source, lang, gap FROM g JOIN (SELECT doc_id, source, lang FROM documents) USING (doc_id)),
  grid AS (SELECT * FROM (SELECT DISTINCT source FROM documents), (SELECT DISTINCT lang FROM documents))
  SELECT grid.source, grid.lang, COUNT(gap) AS n, ROUND(AVG(gap), 6) AS mean, ROUND(AVG(CASE WHEN gap < 5 THEN 1.0::DOUBLE WHEN gap >= 5 THEN 0.0::DOUBLE END), 6) AS share_below
  FROM grid LEFT JOIN v ON v.source = grid.source AND v.lang = grid.lang GROUP BY 1, 2""")
def a21_baseline_stats(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents")
    grid = docs.select("source").distinct().crossJoin(F.broadcast(docs.select("lang").distinct()))  # two small dimensions
    return reports.baseline_stats(_gaps(spark, sf_dir), grid, ["source", "lang"])


@query(f"""SELECT market, t0, CAST(COUNT(*) FILTER (winner_window = 1) AS BIGINT) AS winners, COUNT(*) FILTER (winner_window = 0) AS losers, COUNT(*) FILTER (winner_window IS NULL) AS unlabelled
  FROM ({ORACLE_SQL['a31_labels']}) GROUP BY ROLLUP (market, t0)""")
def a35_label_distribution(spark, sf_dir):
    return reports.label_distribution(QUERIES["a31_labels"](spark, sf_dir), ["market", "t0"], "winner_window")


@query(f"""SELECT CASE WHEN market IN {SEA} THEN 'sea' ELSE 'tier1' END AS tier, ranker, k, COUNT(*) AS n_cohorts, ROUND(AVG(precision), 6) AS mean
  FROM ({ORACLE_SQL['a17_precision']}) GROUP BY 1, 2, 3""")
def a19_tier_precision(spark, sf_dir):
    return reports.tier_precision(QUERIES["a17_precision"](spark, sf_dir), F.when(F.col("market").isin(*SEA), "sea").otherwise("tier1"))


@query(f"""SELECT t0, ranker, k, ROUND(AVG(CASE WHEN market IN {SEA} THEN precision END) - AVG(CASE WHEN market NOT IN {SEA} THEN precision END), 6) AS delta
  FROM ({ORACLE_SQL['a17_precision']}) GROUP BY 1, 2, 3""")
def a20_paired_delta(spark, sf_dir):
    return reports.paired_delta(QUERIES["a17_precision"](spark, sf_dir), F.col("market").isin(*SEA))


@query(sql(D.SIGNALS_SQL, D.REVIEWS_SQL, WIDE_SQL, """n AS (SELECT app_id, COUNT(*) AS ratings_count FROM reviews GROUP BY 1),
  c AS (SELECT app_id, ROUND(purchase, 1) AS composite, ROUND(CASE WHEN view IS NULL AND click IS NULL THEN 0.0 ELSE (COALESCE(view, 0) + COALESCE(click, 0)) / 10 / ((view IS NOT NULL)::INT + (click IS NOT NULL)::INT) END, 6) AS confidence, ratings_count
    FROM wide LEFT JOIN n USING (app_id))
  SELECT ROW_NUMBER() OVER (ORDER BY composite DESC NULLS LAST, confidence DESC, COALESCE(ratings_count, 0) DESC, app_id) AS position, app_id, composite, confidence, ratings_count FROM c
  ORDER BY position LIMIT 100"""))
def t1_ranking(spark, sf_dir):
    n = D.reviews(spark, sf_dir).groupBy("app_id").agg(F.count("*").alias("ratings_count"))
    confidence = F.round(reports.judge_confidence(F.col("view") / 10, F.col("click") / 10), 6)
    rows = _wide(spark, sf_dir).join(n, "app_id", "left").select("app_id", F.round("purchase", 1).alias("composite"), confidence.alias("confidence"), "ratings_count")
    return reports.ranked(rows, 100, ["app_id"]).select("position", "app_id", "composite", "confidence", "ratings_count")


@query(sql(D.SIGNALS_SQL, WIDE_SQL, """SELECT app_id, concat_ws('|', CASE WHEN view > 7 AND app_id % 2 = 0 THEN 'tier2-localization' END, CASE WHEN click > 7 AND (view IS NULL OR view < 4) THEN 'hot-wave' END,
  CASE WHEN purchase > 7 AND signup > 6 THEN 'incumbent-toppling' END) AS tags,
  CASE WHEN app_id % 2 = 0 THEN 'https://apps.apple.com/us/app/id' || app_id ELSE 'https://play.google.com/store/apps/details?id=' || app_id || '&gl=us' END AS link FROM wide"""))
def p15_tags(spark, sf_dir):
    tags = X.pattern_tags(F.col("view"), F.col("click"), F.col("purchase"), F.col("signup"), F.col("app_id") % 2 == 0)
    store = F.when(F.col("app_id") % 2 == 0, "apple").otherwise("googleplay")
    app = F.col("app_id").cast("string")
    return _wide(spark, sf_dir).select("app_id", F.array_join(tags, "|").alias("tags"), X.store_link(store, app, F.lit(None).cast("string"), F.lit("us")).alias("link"))


@query(sql(*R.SHORT, r"""SELECT app_id, store, '# ' || app_id || ' on ' || store || chr(10) || 'Markets: ' || array_to_string(markets, ', ') || chr(10) || 'Class: ' || COALESCE(dna_class, '') || ' (' || tier || ')' || chr(10)
  || 'Subscription: ' || CASE WHEN has_subscription THEN 'yes' WHEN NOT has_subscription THEN 'no' ELSE '' END || chr(10) || 'Score: ' || printf('%.4f', score) || chr(10) || '{{unknown}}' AS dossier FROM scored"""))
def k9_dossiers(spark, sf_dir):
    rows = shortlist.scored(R._staged(spark, sf_dir), 5).withColumn("score", F.col("score").cast("double"))
    return reports.dossiers(rows, ["app_id", "store", "markets", "dna_class", "tier", "has_subscription", "score"]).select("app_id", "store", "dossier")


@query(f"""SELECT CASE MAX(CASE status WHEN 'FAIL' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS overall, COUNT(*) AS n_checks,
  string_agg(concat_ws(' | ', check_name, status, COALESCE(CAST(detail AS VARCHAR), '')), chr(10) ORDER BY check_name, status) AS report FROM ({ORACLE_SQL['a10_audit']})""")
def k8_audit_report(spark, sf_dir):
    return reports.audit_report(QUERIES["a10_audit"](spark, sf_dir))


@query(sql(D.CHARTS_SQL, "SELECT market, store, day, app_id, CAST((ROW_NUMBER() OVER (PARTITION BY market, store, day ORDER BY rank) - 1) // 5 AS BIGINT) AS batch FROM charts"))
def w9_batches(spark, sf_dir):
    return reports.batches(D.charts(spark, sf_dir), ["market", "store", "day"], ["rank"]).select("market", "store", "day", "app_id", "batch")


@query("""SELECT page_id, url, CASE WHEN regexp_matches(url, '^https?://[^/ ]+') AND length(html) >= 20 THEN CASE page_id % 4 WHEN 0 THEN 2.0::DOUBLE WHEN 1 THEN 5.0::DOUBLE WHEN 2 THEN 8.0::DOUBLE END END AS value FROM pages""")
def p10_citations(spark, sf_dir):
    band = F.element_at(F.array(F.lit("low"), F.lit("Mid"), F.lit("high "), F.lit("huge")), (F.col("page_id") % 4 + 1).cast("int"))
    return reports.cited_scores(D.table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("quote"), band.alias("band"))).select("page_id", "url", "value")


@query("""WITH c AS (SELECT *, length(text) AS n, CASE role WHEN 'user' THEN 'text' WHEN 'assistant' THEN 'vision' ELSE role END AS kind FROM conversations)
  SELECT conv_id, turn, concat_ws('|', CASE WHEN kind NOT IN ('text', 'vision') THEN 'kind' END, CASE WHEN n % 7 = 0 THEN 'store' END, CASE WHEN n % 17 = 0 OR n % 13 > 10 THEN 'score' END,
  CASE WHEN NOT COALESCE(n BETWEEN 1 AND 600, false) THEN 'reasoning' END, CASE WHEN n % 11 > 9 THEN 'confidence' END, CASE WHEN n % 19 = 0 THEN 'model_version' END, CASE WHEN n % 5 = 0 THEN 'flags' END,
  CASE WHEN kind = 'vision' AND n % 3 = 0 THEN 'freshness' END, CASE WHEN kind = 'vision' AND n % 4 = 0 THEN 'screenshots_analyzed' END) AS violations FROM c""")
def p11_judge_violations(spark, sf_dir):
    n, vision = F.length("text"), F.col("role") == "assistant"
    flag = F.when(n % 5 != 0, F.lit(True))
    rows = D.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "user", "text").when(vision, "vision").otherwise(F.col("role")).alias("kind"), F.col("conv_id").cast("string").alias("app_id"),
        F.when(n % 7 == 0, "other").otherwise("apple").alias("store"), F.lit("us").alias("market"), F.when(n % 17 == 0, float("nan")).otherwise((n % 13).cast("double")).alias("score"), F.col("text").alias("reasoning"),
        F.when(n % 11 > 9, 1.5).otherwise(0.5).alias("confidence"), F.when(n % 19 == 0, "").otherwise("v1").alias("model_version"),
        F.when(vision, F.array(F.lit(True), flag, F.lit(False))).otherwise(F.array(F.lit(True), flag, F.lit(False), F.lit(True))).alias("flags"),
        F.when(n % 3 == 0, "old").otherwise("fresh").alias("freshness"), (n % 4).alias("screenshots_analyzed"),
    )
    return reports.judge_violations(rows).select("conv_id", "turn", F.array_join("violations", "|").alias("violations"))


@query("""WITH u AS (SELECT role AS model, COUNT(*) AS calls, CAST(SUM((length(text) + 3) // 4) AS BIGINT) AS tokens_in, CAST(SUM(length(text) // 10) AS BIGINT) AS tokens_out FROM conversations GROUP BY 1),
  c AS (SELECT *, ROUND((tokens_in * CASE model WHEN 'assistant' THEN 15.0::DOUBLE ELSE 3.0::DOUBLE END + tokens_out * CASE model WHEN 'assistant' THEN 75.0::DOUBLE ELSE 15.0::DOUBLE END) / 1000000, 6) AS cost FROM u)
  SELECT model, calls, tokens_in, tokens_out, cost, ROUND(cost / 2.0, 6) AS share FROM c""")
def a32_usage(spark, sf_dir):
    n = F.length("text")
    turns = D.table(spark, sf_dir, "conversations").select(F.col("role").alias("model"), F.floor((n + 3) / 4).cast("long").alias("tokens_in"), F.floor(n / 10).cast("long").alias("tokens_out"))
    return reports.usage(turns, 2.0, {"user": (3.0, 15.0), "assistant": (15.0, 75.0)})


@query(f"""WITH u AS ({ORACLE_SQL['a32_usage']}) SELECT COUNT(*) AS models, CAST(SUM(calls) AS BIGINT) AS calls, ROUND(SUM(cost), 6) AS cost, 2.0::DOUBLE AS cap, ROUND(GREATEST(0.0, 2.0 - ROUND(SUM(cost), 6)), 6) AS left, ROUND(SUM(cost), 6) > 2.0 AS over FROM u""".replace(" AS left", ' AS "left"').replace(" AS over", ' AS "over"'))
def a32_total(spark, sf_dir):
    return reports.usage_total(a32_usage(spark, sf_dir), 2.0)


@query(sql(D.SIGNALS_SQL, WIDE_SQL, """SELECT sha256(concat_ws('|', app_id, 'us')) AS id, app_id, 'us' AS market, purchase AS economics,
  '{"seen":' || app_id || ',"store":"' || CASE WHEN app_id % 2 = 0 THEN 'apple' ELSE 'googleplay' END || '"}' AS evidence_json FROM wide"""))
def k11_opportunities(spark, sf_dir):
    store = F.when(F.col("app_id") % 2 == 0, "apple").otherwise("googleplay")
    rows = _wide(spark, sf_dir).select("app_id", F.lit("us").alias("market"), F.col("purchase").alias("economics"), F.col("app_id").alias("seen"), store.alias("store"))
    return reports.opportunity_rows(rows, ["app_id", "market"], ["seen", "store"])
