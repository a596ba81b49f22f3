"""Queries that land files or payloads made from the given tables and read them again, and the write policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartwright.functions import exprs as X
from chartwright.operators import records as K
from chartwright.operators import shortlist
from chartwright.plans import registry as R
from chartwright.plans.registry import query, sql
from chartwright.sources import derived as D
from chartwright.sources import files, scratch, sinks
from chartwright.streaming import ingest, judging


def _text_files(lines, name: str) -> str:
    """Lines (k, line) in order of k over the files of a folder, in the order of their names: for what line order decides."""
    path = scratch.new_folder(lines.sparkSession, name)
    lines.repartitionByRange("k").sortWithinPartitions("k").select("line").write.text(path)
    return path


def _lines(spark, sf_dir):
    """Metadata lines of every listing: for each sixth app an error line first, for each fifth a second good line."""
    meta = D.metadata(spark, sf_dir).join(D.invariants(spark, sf_dir), ["app_id", "store"], "left")
    app, apple = F.col("app_id"), F.col("store") == "apple"
    n = F.explode(F.array_compact(F.array(F.when(app % 6 == 0, 0), F.lit(1), F.when(app % 5 == 0, 2)))).alias("n")
    rows = meta.select("*", n)
    described = lambda c: F.when(c, F.col("description"))
    body = F.struct(
        F.format_string("App %d line %d", app, F.col("n")).alias("title"), described(apple).alias("description"), described(~apple).alias("long_description"), F.struct(F.col("dna_class").alias("class_label")).alias("dna"),
        F.array(F.struct(F.col("has_subscription").alias("is_subscription"))).alias("in_app_purchases"), F.date_format("release_day", "MMM d, yyyy").alias("release_date"),
    )
    publisher = F.col("publisher_id").cast("string")
    developer = F.when(publisher.isNull(), "").when(apple, F.concat(F.lit(',"developer":{"id":"'), publisher, F.lit('","name":"P"}'))).otherwise(F.concat(F.lit(',"developer":"'), publisher, F.lit('"')))
    json = F.to_json(body)
    raw = F.when(F.col("n") == 0, '{"error":"422"}').otherwise(F.concat(F.expr("left(x, length(x) - 1)"), developer, F.lit("}")))
    rows = rows.withColumn("x", json).withColumn("raw", raw)
    line = F.concat(F.lit('{"app_id":"'), app.cast("string"), F.lit('","market":"us","store":"'), F.col("store"), F.lit('","device":"d","t0":"2024-01-01","raw":{"metadata":'), F.col("raw"), F.lit("}}"))
    return files.read_metadata_lines(spark, _text_files(rows.select(F.struct("app_id", "store", "n").alias("k"), line.alias("line")), "metadata"))


LINES_SQL = """ml AS (SELECT meta.*, n, inv.publisher_id, inv.release_day, 'App ' || meta.app_id || ' line ' || n AS title FROM meta LEFT JOIN inv ON inv.app_id = meta.app_id AND inv.store = meta.store
  JOIN (VALUES (0), (1), (2)) v(n) ON n = 1 OR (n = 0 AND meta.app_id % 6 = 0) OR (n = 2 AND meta.app_id % 5 = 0))"""
LINES = (D.METADATA_SQL, D.INVARIANTS_SQL, LINES_SQL)


@query(sql(*LINES, "SELECT CAST(app_id AS VARCHAR) AS app_id, store, '' AS language, CASE WHEN n > 0 THEN title END AS title FROM ml"))
def s3_metadata_lines(spark, sf_dir):
    return _lines(spark, sf_dir).select("app_id", "store", "language", F.col("metadata.title").alias("title"))


@query(sql(*LINES, "SELECT CAST(app_id AS VARCHAR) AS app_id, store, title FROM ml QUALIFY ROW_NUMBER() OVER (PARTITION BY app_id, store ORDER BY n DESC) = 1"))
def s5_last_line(spark, sf_dir):
    return files.one_per_key(_lines(spark, sf_dir), ["app_id", "store"], "last").select("app_id", "store", F.col("metadata.title").alias("title"))


@query(sql(*LINES, "SELECT CAST(app_id AS VARCHAR) AS app_id, store, dna_class, has_subscription, CAST(1 AS INTEGER) AS iap_count, substr(description, 1, 400) AS description FROM ml WHERE n = 1"))
def s6_metadata(spark, sf_dir):
    return files.shortlist_metadata(_lines(spark, sf_dir)).select("app_id", "store", "dna_class", "has_subscription", "iap_count", "description")


@query(sql(*LINES, """SELECT CAST(app_id AS VARCHAR) AS app_id, store, CASE WHEN n > 0 THEN CAST(publisher_id AS VARCHAR) END AS publisher_id,
  CASE WHEN n > 0 THEN CASE WHEN store = 'apple' AND publisher_id IS NOT NULL THEN 'P' ELSE CAST(publisher_id AS VARCHAR) END END AS publisher_name, CASE WHEN n > 0 THEN epoch_ms(CAST(release_day AS TIMESTAMP)) END AS release_date
  FROM ml QUALIFY ROW_NUMBER() OVER (PARTITION BY app_id, store ORDER BY n) = 1"""))
def s8_invariants(spark, sf_dir):
    return files.invariants_of(_lines(spark, sf_dir))


@query(sql(*LINES, "SELECT CASE store WHEN 'googleplay' THEN 'google' ELSE store END AS store, CAST(app_id AS VARCHAR) AS app_id, CASE WHEN store = 'apple' THEN CAST(app_id AS VARCHAR) END AS track_id, title AS name, CASE WHEN store = 'apple' THEN COALESCE(length(description), 0) ELSE 0 END AS n FROM ml WHERE n > 0"))
def x21_records(spark, sf_dir):
    return K.adapted_records(_lines(spark, sf_dir)).select("store", "app_id", "track_id", "name", F.length("description").cast("long").alias("n"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS app_id, CASE WHEN p_size % 3 > 0 THEN CAST(p_size AS BIGINT) END AS total, CASE WHEN p_size % 3 > 0 THEN CASE WHEN p_size % 3 = 1 THEN p_retailprice ELSE p_size / 2.0 END END AS avg,
  CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END AS app_power FROM part""")
def s4_metrics(spark, sf_dir):
    size, price = F.col("p_size"), F.col("p_retailprice")
    breakdown = F.struct(F.when(size % 3 > 0, size).alias("total"), F.when(size % 3 == 1, price).alias("avg"))
    ratings = F.array(F.struct((size / 2).alias("value"), breakdown.alias("breakdown")))
    power = F.when(F.col("p_partkey") % 2 == 0, F.array(F.struct(price.alias("value"))))
    body = F.to_json(F.struct(F.col("p_partkey").cast("string").alias("app_id"), F.lit("us").alias("market"), F.lit("apple").alias("store"), F.lit("d").alias("device"), F.lit("2024-01-01").alias("t0"), F.struct(ratings.alias("ratings"), power.alias("app-power")).alias("raw")))
    path = scratch.new_folder(spark, "metrics")
    D.table(spark, sf_dir, "part").select(body.alias("value")).write.text(path)
    return files.read_metrics_lines(spark, path).select("app_id", F.col("ratings.total").alias("total"), F.col("ratings.avg").alias("avg"), "app_power")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS drop_date FROM orders WHERE strftime(o_orderdate, '%Y-%m') = (SELECT MAX(strftime(o_orderdate, '%Y-%m')) FROM orders)")
def s7_latest_drop(spark, sf_dir):
    return files.latest_drop(D.table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("drop_date")))


@query(sql(D.CHARTS_SQL, "SELECT market, store AS device, 'overall' AS category, 'grossing' AS kind, epoch_ms(CAST(day AS TIMESTAMP)) AS captured_at, CAST(app_id AS VARCHAR) AS app_id, CAST(rank AS INTEGER) AS rank FROM charts"))
def s10_chart_history(spark, sf_dir):
    apps = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("app_id").cast("string").alias("app")))), lambda x: x["app"])
    days = D.charts(spark, sf_dir).groupBy("market", "store", "day").agg(apps.alias("value"))  # one chart
    months = days.groupBy("market", "store", F.trunc("day", "month").alias("month")).agg(F.collect_list(F.struct(F.date_format("day", "yyyy-MM-dd").alias("date"), "value")).alias("d"))  # 31 days at most
    body = F.to_json(F.struct(F.create_map(F.lit("overall"), F.create_map(F.lit("grossing"), F.col("d"))).alias("result")))
    return files.chart_history(months.select("market", F.col("store").alias("device"), body.alias("body")))


@query("""SELECT user_id AS app_id, CASE event_id % 3 WHEN 0 THEN 'anonymous' ELSE 'u' || event_id END AS author, CASE WHEN event_id % 4 = 0 THEN 0.0::DOUBLE ELSE CAST(event_id % 5 AS DOUBLE) END AS rating, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS text,
  CASE WHEN event_id % 7 > 0 THEN 'd' || (event_id % 7) END AS posted_at FROM events""")
def s11_reviews(spark, sf_dir):
    e = F.col("event_id")
    pick = lambda n, k, v: F.when(e % n == k, v)
    user, stars, day = F.concat(F.lit("u"), e.cast("string")), (e % 5).cast("string"), F.concat(F.lit("d"), (e % 7).cast("string"))
    review = F.to_json(F.struct(
        pick(3, 1, user).alias("userName"), pick(3, 2, user).alias("author"), F.when((e % 4 > 0) & (e % 2 == 0), stars).alias("score"), F.when((e % 4 > 0) & (e % 2 == 1), stars).alias("rating"),
        F.when(e % 4 == 0, F.col("event_type")).alias("text"), F.when(e % 4 == 2, F.col("event_type")).alias("title"), F.when((e % 7).between(1, 3), day).alias("date"), F.when(e % 7 > 3, day).alias("updated"),
    ))
    raw = D.table(spark, sf_dir, "events").select(F.col("user_id").alias("app_id"), F.lit("us").alias("market"), F.lit("apple").alias("store"), review.alias("review"))
    return files.normalized_reviews(raw).select("app_id", "author", "rating", "text", "posted_at")


@query(sql(D.CHARTS_SQL, "SELECT market, store, day, CAST(app_id AS VARCHAR) AS app_id, CAST(rank AS INTEGER) AS rank FROM charts"))
def s13_page_apps(spark, sf_dir):
    link = F.concat(F.lit('<li><a href="https://x/us/app/a-'), F.col("app_id").cast("string"), F.lit("/id"), F.col("app_id").cast("string"), F.lit('"><img></a><a href="/app/again/id'), F.col("app_id").cast("string"), F.lit('">again</a></li>'))
    html = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", link.alias("l")))), lambda x: x["l"]), "\n")
    return files.page_apps(D.charts(spark, sf_dir).groupBy("market", "store", "day").agg(html.alias("html")))  # one chart a page


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_name END AS name, CASE WHEN p_partkey % 3 < 2 THEN CAST(p_size AS DOUBLE) END AS rating, CASE WHEN p_partkey % 3 < 2 THEN p_partkey END AS rating_count FROM part""")
def s14_app_pages(spark, sf_dir):
    app = F.to_json(F.struct(F.lit("MobileApplication").alias("@type"), F.col("p_name").alias("name"), F.struct(F.col("p_size").alias("ratingValue"), F.col("p_partkey").alias("reviewCount")).alias("aggregateRating")))
    block = lambda body: F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))
    k = F.col("p_partkey") % 3
    html = F.concat(F.lit("<head>"), block(F.lit('{"@type":"WebSite","name":"S"}')), block(F.lit("{broken")), F.when(k == 0, block(app)).when(k == 1, block(F.concat(F.lit("["), app, F.lit("]")))).otherwise(""))
    return files.page_app_record(D.table(spark, sf_dir, "part").select("p_partkey", html.alias("html"))).select("p_partkey", "name", "rating", "rating_count")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE epoch_ms(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) END AS archived_at, CASE o_orderkey % 3 WHEN 0 THEN 'https://apps.apple.com/us/charts' WHEN 1 THEN 'https://apps.apple.com/id/charts' END AS url FROM orders")
def s15_archive_index(spark, sf_dir):
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyyMMdd")
    body = F.when(k % 4 == 0, F.lit("[]")).otherwise(F.concat(F.lit('[["urlkey","timestamp"],["x","'), day, F.lit('"],["y","19990101000000"]]')))
    market = F.when(k % 3 == 0, "US").when(k % 3 == 1, "id").otherwise("gb")
    rows = files.closest_archive(D.table(spark, sf_dir, "orders").select("o_orderkey", body.alias("body"), market.alias("market")))
    return rows.select("o_orderkey", "archived_at", files.landing_url(F.col("market")).alias("url"))


def _dump(spark, sf_dir, gz: bool = False) -> str:
    """A dump of the charts with times of three forms; every tenth app's ranks are no whole numbers."""
    app, day = F.col("app_id"), F.col("day").cast("timestamp")
    at = F.when(app % 3 == 0, F.unix_seconds(day).cast("string")).when(app % 3 == 1, F.unix_millis(day).cast("string")).otherwise(F.date_format("day", "yyyy-MM-dd"))
    rank = F.when(app % 10 == 0, "1.5").otherwise(F.col("rank").cast("string"))
    rows = D.charts(spark, sf_dir).select(app.cast("string").alias("app_id"), "market", F.lit("top").alias("category"), at.alias("captured_at"), rank.alias("rank"), F.lit("x").alias("source"), F.when(app % 4 == 0, "google").otherwise(F.col("store")).alias("store"))
    path = scratch.new_folder(spark, "dump")
    (rows if gz else rows.drop("source", "store")).write.options(sep="\t", header=True, compression="gzip" if gz else "none").csv(path)
    return path


DUMP_SQL = "CAST(app_id AS VARCHAR) AS app_id, market, 'top' AS category, epoch_ms(CAST(day AS TIMESTAMP)) AS captured_at, CAST(rank AS INTEGER) AS rank"


@query(sql(D.CHARTS_SQL, f"SELECT {DUMP_SQL}, 'dump' AS source, 'apple' AS store FROM charts WHERE app_id % 10 <> 0"))
def s1_dump(spark, sf_dir):
    return files.read_chart_dump(spark, _dump(spark, sf_dir))[0]


@query(sql(D.CHARTS_SQL, f"SELECT {DUMP_SQL}, 'provider' AS source, store FROM charts WHERE app_id % 10 <> 0 AND app_id % 4 <> 0"))
def s2_dump_gz(spark, sf_dir):
    return files.read_chart_dump(spark, _dump(spark, sf_dir, gz=True), with_store=True, source="provider")[0]


@query(sql(D.CHARTS_SQL, "SELECT COUNT(*) AS rows_read, COUNT(*) FILTER (app_id % 10 <> 0 AND app_id % 4 <> 0) AS rows_valid, COUNT(*) FILTER (app_id % 10 = 0 OR app_id % 4 = 0) AS rows_invalid FROM charts"))
def s2_counts(spark, sf_dir):
    return files.read_chart_dump(spark, _dump(spark, sf_dir, gz=True), with_store=True, source="provider")[1]


def _records(spark, sf_dir):
    """Chart payloads of fifty parts each as store entries, read back as app records."""
    k = F.col("p_partkey")
    entry = F.to_json(F.struct(
        F.concat(F.lit("a"), k.cast("string")).alias("appId"), F.when(k % 4 > 0, F.col("p_name")).alias("title"), F.when(k % 3 == 0, F.col("p_type")).alias("primaryGenre"), F.when(k % 3 == 1, F.col("p_brand")).alias("genre"),
        F.col("p_retailprice").alias("price"), F.when(k % 2 == 0, "USD").otherwise("EUR").alias("currency"), (k % 5 == 0).alias("free"), (F.col("p_size") / 8).alias("score"), F.when(k % 6 > 0, F.col("p_size")).alias("ratings"), k.alias("reviews"),
        F.when(k % 7 == 0, F.lit(True)).alias("inAppPurchases"), F.when(k % 7 == 1, F.array(F.lit("x"))).alias("iapHints"), F.when(k % 2 == 0, "Apr 21, 2014").otherwise("2023-05-18T00:00:00-07:00").alias("released"),
    ))
    developer = F.when(k % 2 == 0, F.concat(F.lit(',"developer":"'), F.col("p_brand"), F.lit('"}'))).otherwise(F.concat(F.lit(',"developer":{"devName":"'), F.col("p_brand"), F.lit('"}}')))
    parts = D.table(spark, sf_dir, "part").withColumn("x", entry).withColumn("e", F.concat(F.expr("left(x, length(x) - 1)"), developer))
    body = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "e"))), lambda r: r["e"]), ","), F.lit("]"))
    payloads = parts.groupBy(F.floor(k / 50).alias("page")).agg(body.alias("body"))  # fifty entries
    return K.store_records(payloads.select("page", F.when(F.col("page") % 3 == 0, "usa").otherwise("us").alias("market"), F.lit("apple").alias("store"), "body"))


RECORDS_SQL = """rec AS (SELECT p_partkey // 50 AS page, CASE WHEN (p_partkey // 50) % 3 = 0 THEN 'usa' ELSE 'us' END AS market, 'a' || p_partkey AS app_id, ROW_NUMBER() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) AS rank, CASE WHEN p_partkey % 4 > 0 THEN p_name ELSE 'a' || p_partkey END AS name, p_brand AS developer,
  CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN p_brand ELSE 'Unknown' END AS category, CASE WHEN p_partkey % 2 = 0 OR p_partkey % 5 = 0 THEN p_retailprice ELSE 0.0::DOUBLE END AS price_usd, p_size / 8.0::DOUBLE AS rating,
  CASE WHEN p_partkey % 6 > 0 THEN CAST(p_size AS BIGINT) ELSE p_partkey END AS ratings_count, p_partkey % 7 < 2 AS iap_present, CASE WHEN p_partkey % 2 = 0 THEN '2014-04-21T00:00:00.000Z' ELSE '2023-05-18T00:00:00-07:00' END AS release_date FROM part)"""


@query(f"WITH {RECORDS_SQL} SELECT * FROM rec")
def s9_records(spark, sf_dir):
    return _records(spark, sf_dir).select("page", "market", "app_id", "rank", "name", "developer", "category", "price_usd", "rating", "ratings_count", "iap_present", "release_date")


@query(f"WITH {RECORDS_SQL} SELECT app_id, concat_ws('|', CASE WHEN length(market) <> 2 THEN 'market' END, CASE WHEN rating > 5 THEN 'rating' END) AS violations FROM rec")
def p12_app_violations(spark, sf_dir):
    return K.app_violations(_records(spark, sf_dir)).select("app_id", F.array_join("violations", "|").alias("violations"))


@query(sql(*R.SHORT, """SELECT CAST(app_id AS VARCHAR) AS app_id, store, CASE WHEN len(markets) < 2 OR tenure_max < 12 OR dna_class NOT IN ('Puzzle', 'Casino') THEN 'FAIL' WHEN len(list_filter(markets, lambda m: m NOT IN ('ASIA', 'EUROPE'))) = len(markets) THEN 'FAIL'
  WHEN len(list_filter(markets, lambda m: m NOT IN ('ASIA', 'EUROPE'))) > 0 THEN 'WARN' ELSE 'PASS' END AS overall FROM (SELECT * FROM scored ORDER BY score DESC, app_id, store LIMIT 200)"""))
def s18_shortlist_json(spark, sf_dir):
    rows = shortlist.top(shortlist.scored(R._staged(spark, sf_dir), 5), 200)
    one = F.struct(F.col("app_id").cast("string").alias("app_id"), "store", F.col("score").cast("double").alias("score"), "dna_class", F.col("markets").alias("markets_active"), F.col("tenure_max").cast("double").alias("tenure_days_max"), F.col("has_subscription").alias("has_subscription_iap"))
    document = rows.agg(F.to_json(F.struct(F.collect_list(one).alias("shortlist"))).alias("value"))  # a shortlist is one document
    path, limits = scratch.new_folder(spark, "shortlist"), scratch.new_folder(spark, "thresholds")
    document.write.text(path)
    spark.createDataFrame([('{"least_markets": 2, "least_tenure": 12, "supported_markets": ["asia", "europe"], "clonable_classes": ["Puzzle", "Casino"]}',)], "value string").coalesce(1).write.text(limits)
    return shortlist.evaluate_shortlist(files.read_shortlist(spark, path), files.read_thresholds(spark, limits)).select("app_id", "store", "overall")


@query(sql(D.CHARTS_SQL, "SELECT market, store, day, rank, app_id FROM charts"))
def k1_append(spark, sf_dir):
    rows = scratch.stored(D.charts(spark, sf_dir).select("market", "store", "day", "rank", "app_id"), "charts")
    path, key = scratch.new_folder(spark, "appended"), ["market", "store", "day", "rank"]
    sinks.append_if_absent(rows.where("app_id % 2 = 0"), path, key, "market")
    sinks.append_if_absent(rows, path, key, "market")
    sinks.append_if_absent(rows, path, key, "market")
    return spark.read.parquet(path).select("market", "store", "day", "rank", "app_id")


@query(sql(D.INVARIANTS_SQL, "SELECT app_id, store, CASE WHEN app_id % 2 = 0 THEN -1 ELSE publisher_id END AS publisher_id FROM inv"))
def k2_replace(spark, sf_dir):
    rows = D.invariants(spark, sf_dir).select("app_id", "store", "publisher_id")
    path = scratch.new_folder(spark, "replaced")
    rows.write.parquet(path)
    return sinks.replace_rows(rows.where("app_id % 2 = 0").withColumn("publisher_id", F.lit(-1).cast("long")), path, path + "-new", ["app_id", "store"])


def _third(x: str) -> str:
    return f"CAST(CAST(ROUND(CAST({x} AS DECIMAL(18, 9)), 3) AS DECIMAL(18, 3)) AS VARCHAR)"


@query(sql(*R.SHORT, f"""SELECT CAST(ROW_NUMBER() OVER (ORDER BY score DESC, app_id, store) AS VARCHAR) AS rank, printf('%.4f', CAST(score AS DOUBLE)) AS score, {_third('LEAST(1.0, tenure_max / 365.0)')} AS score_tenure, {_third('LEAST(1.0, len(markets) / 5.0)')} AS score_spread,
  {_third('LEAST(1.0, recent_rows / 30.0)')} AS score_recency, {_third('GREATEST(0.0, 1 - best_rank / 100.0)')} AS score_rank, {_third('GREATEST(0.0, 1 - GREATEST(0, publisher_apps - 1) / 5.0)')} AS score_indie, CAST(app_id AS VARCHAR) AS app_id, store, dna_class, tier AS clonability_tier,
  CAST(publisher_apps AS VARCHAR) AS publisher_app_count, array_to_string(markets, '|') AS markets_active, CAST(tenure_max AS VARCHAR) AS tenure_days_max, CAST(best_rank AS VARCHAR) AS best_rank, CAST(recent_rows AS VARCHAR) AS recent_30d_days, CASE WHEN has_subscription THEN '1' ELSE '0' END AS has_subscription_iap,
  'A "' || app_id || '", of ' || store AS title, substr(replace(description, chr(13), ''), 1, 200) AS description_short, 'CLONE: a' || chr(10) || 'b' AS clonability_hypothesis FROM scored ORDER BY scored.score DESC, scored.app_id, scored.store LIMIT 200"""))
def k4_shortlist_csv(spark, sf_dir):
    rows = shortlist.scored(R._staged(spark, sf_dir), 5).join(D.metadata(spark, sf_dir).select("app_id", "store", F.replace("description", F.lit("\r"), F.lit("")).alias("description")), ["app_id", "store"], "left")
    rows = shortlist.top(rows, 200).withColumns({"title": F.concat(F.lit('A "'), F.col("app_id").cast("string"), F.lit('", of '), "store"), "hypothesis": F.lit("CLONE: a\nb")})
    folder = scratch.new_folder(spark, "artifact")
    sinks.write_shortlist(shortlist.csv_rows(rows), rows.select("app_id", "store", "score"), shortlist.funnel(R._staged(spark, sf_dir)), {"markets": 5}, folder)
    back = spark.read.options(header=True, quote='"', escape='"', multiLine=True, lineSep="\n").csv(f"{folder}/shortlist_csv")
    return back.drop("dna_subclass", "publisher_name", "iap_count", "icon_url", "subtitle")


@query(sql(*R.SHORT, R.CHECKED_SQL, """ SELECT CAST(ROW_NUMBER() OVER (ORDER BY score DESC, app_id, store) AS VARCHAR) AS rank, CAST(app_id AS VARCHAR) AS app_id, store, printf('%.4f', CAST(score AS DOUBLE)) AS score, dna_class, array_to_string(markets, '|') AS markets_active,
  CAST(tenure_max AS VARCHAR) AS tenure_days_max, CAST(best_rank AS VARCHAR) AS best_rank, CASE WHEN has_subscription THEN '1' ELSE '0' END AS has_subscription_iap, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS publisher_name, CAST(NULL AS VARCHAR) AS iap_count,
  overall AS risk_overall, s1 AS risk_markets_spread, s2 AS risk_tenure, s3 AS risk_subscription_iap, s4 AS risk_supported_markets, s5 AS risk_clonable_dna FROM risk ORDER BY risk.score DESC, risk.app_id, risk.store LIMIT 200"""))
def k5_risk_csv(spark, sf_dir):
    path = scratch.new_folder(spark, "risk")
    sinks.write_csv(shortlist.risk_csv_rows(shortlist.top(R.checked_shortlist(spark, sf_dir), 200)), path)
    back = spark.read.options(header=True, quote='"', escape='"').csv(path)
    return back


@query(f"""SELECT ranker, string_agg(market || ' ' || store || ' ' || CAST(t0 AS VARCHAR) || ' @' || k || ' ' || printf('%.2f', precision), chr(10) ORDER BY market, store, t0, k) AS text FROM ({R.ORACLE_SQL['a17_precision']}) GROUP BY 1""")
def k7_report(spark, sf_dir):
    line = F.format_string("%s %s %s @%d %.2f", "market", "store", F.col("t0").cast("string"), "k", "precision")
    return sinks.report_text(R.a17_precision(spark, sf_dir).withColumn("line", line), ["ranker"], ["market", "store", "t0", "k"], "line")


@query(sql(D.CHARTS_SQL, "SELECT CAST(app_id AS VARCHAR) AS app_id, market, store, epoch_ms(CAST(day AS TIMESTAMP)) AS captured_at, CAST(rank AS INTEGER) AS rank FROM charts WHERE app_id % 10 <> 0"))
def st1_ingest(spark, sf_dir):
    app = F.col("app_id")
    rows = D.charts(spark, sf_dir).select(app.cast("string").alias("app_id"), "market", F.lit("top").alias("category"), F.unix_millis(F.col("day").cast("timestamp")).cast("string").alias("captured_at"), F.when(app % 10 == 0, "x").otherwise(F.col("rank").cast("string")).alias("rank"), F.lit("s").alias("source"), "store")
    land, table, at = (scratch.new_folder(spark, n) for n in ("landing", "table", "checkpoint"))
    rows.write.options(sep="\t", header=True).csv(land)
    for _ in range(2):  # started again, it finds nothing new
        ingest.ingest_charts(spark, land, table, at).awaitTermination()
    return ingest.charts_table(spark, table).select("app_id", "market", "store", "captured_at", "rank")


SNAPSHOT_SQL = """s AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'apple' ELSE 'googleplay' END AS store, user_id AS app_id, event_type AS market, CAST(ts AS DATE) AS day, value, ts, event_id, event_id % 3 > 0 AS late, CASE WHEN event_id % 8 = 5 THEN 'error ' || event_id % 2 END AS error FROM events)"""


def _snapshots(spark, sf_dir):
    """Both tables after two runs of the same stream: every third event lands first, the others later."""
    k = F.col("event_id")
    rows = D.table(spark, sf_dir, "events").select(
        F.when(k % 2 == 0, "apple").otherwise("googleplay").alias("store"), F.col("user_id").alias("app_id"), F.col("event_type").alias("market"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value",
        F.when(k % 8 == 5, F.concat(F.lit("error "), (k % 2).cast("string"))).alias("error"),
    )
    land, table, failures, at = (scratch.new_folder(spark, n) for n in ("landing", "snapshots", "failures", "checkpoint"))
    for part in (rows.where("event_id % 3 = 0"), rows.where("event_id % 3 > 0")):
        part.write.mode("append").parquet(land)
        stream = spark.readStream.schema(rows.schema).parquet(land)
        ingest.land_snapshots(stream, table, failures, at, ["ts", "event_id"]).awaitTermination()
    schema = rows.drop("ts", "event_id", "error").withColumn("day", F.lit(None).cast("date")).schema
    return ingest.snapshot_tables(spark, table, failures, schema)


@query(sql(SNAPSHOT_SQL, "SELECT store, app_id, market, day, arg_min(value, (late, ts, event_id)) AS value FROM s WHERE error IS NULL GROUP BY 1, 2, 3, 4"))
def st2_daily_snapshots(spark, sf_dir):
    return _snapshots(spark, sf_dir)[0].select("store", "app_id", "market", "day", "value")


@query(sql(SNAPSHOT_SQL, "SELECT DISTINCT store, market, day, error FROM s WHERE error IS NOT NULL"))
def st2_failures(spark, sf_dir):
    return _snapshots(spark, sf_dir)[1]


@query("""WITH a AS (SELECT c_custkey AS app_id, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS batch, c_custkey % 12 AS score FROM customer WHERE c_custkey % 4 > 0 UNION ALL SELECT c_custkey, 2, 7 FROM customer WHERE c_custkey % 6 = 1)
  SELECT app_id, arg_min(CAST(score AS DOUBLE), (batch, score)) AS score FROM a WHERE score <= 10 GROUP BY 1""")
def st3_answers(spark, sf_dir):
    """Answers that land in two runs: out of bounds ones are refused, and of repeated ones the first to land stays."""
    k = F.col("c_custkey")
    rows = D.table(spark, sf_dir, "customer").select(k.alias("app_id"), (k % 12).cast("double").alias("score"), F.when(k % 3 == 0, 2).otherwise(1).alias("batch"))
    again = rows.where("app_id % 6 = 1").select("app_id", F.lit(7.0).alias("score"), F.lit(2).alias("batch"))
    rows = rows.where("app_id % 4 > 0").unionByName(again)
    land, table, at = (scratch.new_folder(spark, n) for n in ("landing", "answers", "checkpoint"))
    for batch in (1, 2):
        rows.where(F.col("batch") == batch).select("app_id", "score").write.mode("append").json(land)
        ingest.land_answers(spark, land, table, at, "app_id long, score double", ["app_id"], "app_id is not null and score between 0 and 10").awaitTermination()
    return spark.read.parquet(table).select("app_id", "score")


@query("""WITH o AS (SELECT c_custkey, c_custkey % 7 + 1 AS cost FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 3 <> 0), s AS (SELECT *, SUM(cost) OVER (ORDER BY c_custkey) - cost AS before FROM o)
  SELECT c_custkey AS app_id, CAST('request' AS VARCHAR) AS how, CAST(NULL AS DOUBLE) AS score FROM s WHERE before < 300 UNION ALL SELECT c_custkey, 'no-metadata', 10.0 FROM customer WHERE c_custkey % 5 = 0""")
def st3_judging(spark, sf_dir):
    k = F.col("c_custkey")
    requests = D.table(spark, sf_dir, "customer").select(k.alias("request_no"), k.alias("app_id"), (k % 7 + 1).cast("double").alias("cost"), (k % 5 != 0).alias("has_metadata"))
    known, asked = ingest.judging_requests(requests, requests.where("app_id % 3 = 0").select("app_id"), 300.0, ["app_id"])
    return asked.select("app_id", F.lit("request").alias("how"), F.lit(None).cast("double").alias("score")).unionByName(known.select("app_id", "how", "score"))


@query("""WITH r AS (SELECT c_custkey AS k, CAST(c_nationkey AS VARCHAR) AS run_id, c_custkey % 2 AS batch, c_custkey % 7 + 1 AS cost, c_custkey % 5 <> 0 AS has FROM customer),
  s AS (SELECT *, COALESCE(SUM(CASE WHEN has THEN cost END) OVER (PARTITION BY run_id ORDER BY batch, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r),
  o AS (SELECT *, CASE WHEN NOT has THEN 'known' WHEN before < 60 THEN 'ask' ELSE 'over' END AS outcome FROM s)
  SELECT run_id, CAST(k AS VARCHAR) AS key, outcome, CASE WHEN outcome = 'known' THEN 10.0::DOUBLE END AS score FROM o
  UNION ALL SELECT run_id, CAST(k AS VARCHAR), CASE WHEN outcome = 'ask' AND k % 12 <= 10 THEN 'answer' ELSE 'refused' END, CASE WHEN outcome = 'ask' AND k % 12 <= 10 THEN CAST(k % 12 AS DOUBLE) END FROM o WHERE batch = 0 AND outcome <> 'known' AND k % 3 > 0""")
def st3_stream(spark, sf_dir):
    """Requests land in two runs, with answers to the first ones in the second: the budget of each run goes on."""
    k = F.col("c_custkey")
    rows = D.table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("string").alias("run_id"), F.lit("request").alias("kind"), k.cast("string").alias("key"), k.alias("request_no"), (k % 7 + 1).cast("double").alias("cost"), (k % 5 != 0).alias("has_metadata"),
        F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("reasoning"), F.lit(None).cast("double").alias("confidence"), k.alias("k"),
    )
    said = rows.where("k % 2 = 0 and k % 3 > 0 and has_metadata").withColumns({"kind": F.lit("answer"), "score": (F.col("k") % 12).cast("double"), "reasoning": F.lit("said"), "confidence": F.lit(0.5)})
    land, out, at = (scratch.new_folder(spark, n) for n in ("landing", "judged", "checkpoint"))
    for part in (rows.where("k % 2 = 0"), rows.where("k % 2 = 1").unionByName(said).unionByName(said)):  # answers come twice
        part.drop("k").write.mode("append").parquet(land)
        judging.run_judging(spark.readStream.schema(judging.EVENT).parquet(land), 60.0, out, at)
    return spark.read.parquet(out)


@query("SELECT c_custkey AS app_id, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 3 > 0 THEN 'said ' || c_custkey END AS response FROM customer")
def st4_replay(spark, sf_dir):
    k = F.col("c_custkey")
    requests = D.table(spark, sf_dir, "customer").select(k.alias("app_id"), X.content_digest(k).alias("request_hash"))
    answers = requests.where("app_id % 4 = 0").withColumn("response", F.when(F.col("app_id") % 3 > 0, F.concat(F.lit("said "), F.col("app_id").cast("string"))).otherwise(""))
    return ingest.replayed(requests, answers, ["app_id"]).select("app_id", "response")


@query(sql(D.CHARTS_SQL, "SELECT DISTINCT market, store, day FROM charts EXCEPT SELECT DISTINCT market, store, day FROM charts WHERE app_id % 3 = 0"))
def st5_failed_slices(spark, sf_dir):
    """Chart days none of whose rows for every third app have landed."""
    rows = D.charts(spark, sf_dir).select("market", "store", "day", "app_id")
    return ingest.failed_slices(rows.select("market", "store", "day").distinct(), rows.where("app_id % 3 = 0"), ["market", "store", "day"])


@query(sql(D.INVARIANTS_SQL, "SELECT app_id, store, publisher_id FROM inv"))
def k3_reject(spark, sf_dir):
    """Rows land in two parts; a part that brings a key again, or the same key twice, is refused as a whole."""
    rows = scratch.stored(D.invariants(spark, sf_dir).select("app_id", "store", "publisher_id"), "invariants")
    path, keys = scratch.new_folder(spark, "strict"), ["app_id", "store"]
    sinks.append_or_reject(rows.where("app_id % 2 = 0"), path, keys)
    odd = rows.where("app_id % 2 = 1")
    for part in (rows, odd.unionByName(odd)):
        try:
            sinks.append_or_reject(part, path, keys)
            raise AssertionError("a repeated key was taken")
        except ValueError:
            pass
    sinks.append_or_reject(odd, path, keys)
    return spark.read.parquet(path)


@query(sql(*R.SHORT, R.CHECKED_SQL, """ SELECT app_id, store, overall, s1 AS markets_spread FROM risk WHERE (app_id, store) IN (SELECT (app_id, store) FROM scored ORDER BY app_id, store LIMIT 1)"""))
def f4_candidate(spark, sf_dir):
    """The risk of one candidate by its reference, here that of the first one."""
    rows = scratch.stored(shortlist.scored(R._staged(spark, sf_dir), 5), "candidates")
    first = rows.orderBy("app_id", "store").select(F.concat_ws(":", F.col("app_id").cast("string"), "store").alias("ref")).first()
    if first is None:  # a shortlist without candidates
        return shortlist.evaluate_shortlist(rows, R.RISK).select("app_id", "store", "overall", shortlist.check_status("markets_spread").alias("markets_spread"))
    app_id, store = shortlist.parse_candidate_ref(first["ref"])
    return shortlist.evaluate_candidate(rows, int(app_id), store, R.RISK).select("app_id", "store", "overall", shortlist.check_status("markets_spread").alias("markets_spread"))
