"""Chart tables derived from the star schema, and their DuckDB counterparts for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(market, store, day, app_id, revenue, rank): a ranked chart for each market, store and day."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_discount")
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations: dealt by them, all rows would go to 25 tasks
    )
    cells = rows.select(
        F.col("r_name").alias("market"),
        F.when(F.col("o_custkey") % 2 == 0, "apple").otherwise("googleplay").alias("store"),
        F.col("l_shipdate").cast("date").alias("day"),
        F.col("l_suppkey").cast("long").alias("app_id"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"),
    )
    # dealt once by chart and day, which both the sums and the ranks are within
    rev = cells.repartition("market", "store", "day").groupBy("market", "store", "day", "app_id").agg(F.round(F.sum("amount"), 4).alias("revenue"))
    return rev.withColumn("rank", F.row_number().over(Window.partitionBy("market", "store", "day").orderBy(F.desc("revenue"), "app_id")).cast("long"))


def _stores(app, every: int):
    """The stores an app is listed in: apple, and googleplay but for every n-th."""
    return F.explode(F.when(app % every == 0, F.array(F.lit("apple"))).otherwise(F.array(F.lit("apple"), F.lit("googleplay")))).alias("store")


def invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(app_id, store, publisher_id, release_day); every tenth release is unknown, every seventh publisher."""
    first = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey").agg(F.min("o_orderdate").cast("date").alias("first_day"))
    return (
        table(spark, sf_dir, "supplier")
        .join(first, F.col("s_suppkey") == F.col("l_suppkey"), "left")
        .select(
            F.col("s_suppkey").cast("long").alias("app_id"),
            _stores(F.col("s_suppkey"), 9),
            F.when(F.col("s_suppkey") % 7 != 0, F.col("s_nationkey").cast("long")).alias("publisher_id"),
            F.when(F.col("s_suppkey") % 10 != 0, F.col("first_day")).alias("release_day"),
        )
    )


#: Listing classes for the words of part types.
CLASSES = {"ECONOMY": "Puzzle", "PROMO": "Idle", "SMALL": "Education", "MEDIUM": "Casino", "STANDARD": "Simulation", "LARGE": "Strategy"}


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(app_id, store, dna_class, has_subscription, description, lang)."""
    kind = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    counts = kind.groupBy(F.col("l_suppkey").alias("app"), F.substring_index("p_type", " ", 1).alias("word")).agg(F.count("*").alias("n"))
    best = counts.withColumn("k", F.row_number().over(Window.partitionBy("app").orderBy(F.desc("n"), "word"))).where("k = 1")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    named = F.try_element_at(F.create_map(*[F.lit(x) for p in CLASSES.items() for x in p]), F.col("word"))
    return best.join(docs, F.col("app") == F.col("doc_id"), "left").select(
        F.col("app").cast("long").alias("app_id"), _stores(F.col("app"), 8), named.alias("dna_class"), (F.col("app") % 3 == 0).alias("has_subscription"), F.col("text").alias("description"), "lang"
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(app_id, rating, ts) from view and purchase events."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "purchase")).select(F.col("user_id").cast("long").alias("app_id"), (1 + F.pmod(k, F.lit(5))).cast("long").alias("rating"), "ts")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(app_id, signal_name, day, event_id, value): every ninth value is null, asked without an answer."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("long").alias("app_id"),
        F.col("event_type").alias("signal_name"),
        F.col("ts").cast("date").alias("day"),
        F.col("event_id").cast("long").alias("event_id"),
        F.when(F.col("event_id") % 9 != 0, F.round(F.least(F.lit(10.0), F.col("value") / 10), 6)).alias("value"),
    )


CHARTS_SQL = """rev AS (
  SELECT r_name AS market, CASE WHEN o_custkey % 2 = 0 THEN 'apple' ELSE 'googleplay' END AS store,
         CAST(l_shipdate AS DATE) AS day, CAST(l_suppkey AS BIGINT) AS app_id, ROUND(SUM(l_extendedprice * (1 - l_discount)), 4) AS revenue
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
charts AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY market, store, day ORDER BY revenue DESC, app_id) AS rank FROM rev)"""
INVARIANTS_SQL = """inv AS (
  SELECT CAST(s_suppkey AS BIGINT) AS app_id, st.store, CASE WHEN s_suppkey % 7 <> 0 THEN CAST(s_nationkey AS BIGINT) END AS publisher_id,
         CASE WHEN s_suppkey % 10 <> 0 THEN d END AS release_day
  FROM supplier LEFT JOIN (SELECT l_suppkey, CAST(MIN(o_orderdate) AS DATE) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) ON s_suppkey = l_suppkey
  JOIN (VALUES ('apple'), ('googleplay')) st(store) ON st.store = 'apple' OR s_suppkey % 9 <> 0)"""
METADATA_SQL = f"""meta AS (
  SELECT CAST(l_suppkey AS BIGINT) AS app_id, st.store, CASE word {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CLASSES.items())} END AS dna_class, l_suppkey % 3 = 0 AS has_subscription, text AS description, lang FROM (
    SELECT l_suppkey, split_part(p_type, ' ', 1) AS word, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY COUNT(*) DESC, split_part(p_type, ' ', 1)) AS k
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) LEFT JOIN documents ON doc_id = l_suppkey JOIN (VALUES ('apple'), ('googleplay')) st(store) ON st.store = 'apple' OR l_suppkey % 8 <> 0 WHERE k = 1)"""
REVIEWS_SQL = """reviews AS (
  SELECT CAST(user_id AS BIGINT) AS app_id, 1 + ((CAST(json_extract_string(props, '$.k') AS BIGINT) % 5) + 5) % 5 AS rating, ts
  FROM events WHERE event_type IN ('view', 'purchase'))"""
SIGNALS_SQL = """signals AS (
  SELECT CAST(user_id AS BIGINT) AS app_id, event_type AS signal_name, CAST(ts AS DATE) AS day, CAST(event_id AS BIGINT) AS event_id,
         CASE WHEN event_id % 9 <> 0 THEN ROUND(LEAST(10.0, value / 10), 6) END AS value FROM events)"""
