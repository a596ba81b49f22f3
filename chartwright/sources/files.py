"""Readers of landed chart dumps, metadata and metrics lines, provider payloads and page HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartwright.functions.exprs import epoch_ms

CHART_COLUMNS = ("app_id", "market", "category", "captured_at", "rank")
STORES = ("apple", "googleplay")
METADATA = (
    "app_id string, market string, store string, device string, language string, t0 string, raw struct<metadata: struct<error: string, title: string, subtitle: string, description: string, "
    "short_description: string, long_description: string, icon: string, dna: struct<class_label: string, subclass_label: string>, categories: array<string>, "
    "in_app_purchases: array<struct<is_subscription: boolean, recurring_subscription_period: string>>, developer: variant, release_date: string, versions: array<struct<release_date: string>>>>, _corrupt_record string"
)
METRICS = (
    "app_id string, market string, store string, device string, t0 string, raw struct<ratings: array<struct<value: double, breakdown: struct<total: bigint, avg: double>, date: string>>, "
    "`app-power`: array<struct<value: double, date: string>>>, _corrupt_record string"
)


def read_chart_dump(spark: SparkSession, path: str, with_store: bool = False, source: str = "dump") -> tuple[DataFrame, DataFrame]:
    """(valid rows, counts) of a tab-separated dump, .gz or plain, with the columns in any order.

    A missing column is an error. A row is invalid if a field is empty, the time can't be read, the rank isn't
    a positive whole number or, with_store, the store isn't known. Blank lines are skipped. Every row gets the
    `source` named here, whatever the dump says. Valid rows that repeat a key are kept here; append_if_absent()
    keeps the first.
    """
    raw = spark.read.options(sep="\t", header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).csv(path)
    wanted = [*CHART_COLUMNS, *(["source", "store"] if with_store else [])]
    if missing := [c for c in wanted if c not in raw.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    raw = raw.select(*wanted)
    if not with_store:
        raw = raw.withColumn("store", F.lit("apple"))
    typed = raw.withColumns({"ms": epoch_ms(F.col("captured_at")), "n": F.col("rank").try_cast("double")})
    filled = F.lit(True)
    for c in wanted:
        filled = filled & (F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0)
    ok = filled & F.col("ms").isNotNull() & F.coalesce((F.col("n") > 0) & (F.col("n") == F.floor("n")), F.lit(False)) & (F.abs("n") < float("inf")) & F.col("store").isin(*STORES)
    marked = typed.withColumn("ok", F.coalesce(ok, F.lit(False)))
    valid = marked.where("ok").select("app_id", "market", "category", F.col("ms").alias("captured_at"), F.col("n").cast("int").alias("rank"), F.lit(source).alias("source"), "store")
    return valid, marked.agg(F.count("*").alias("rows_read"), F.count_if("ok").alias("rows_valid"), F.count_if(~F.col("ok")).alias("rows_invalid"))


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a line_no that orders each file's lines, however many tasks read it; malformed ones left out.

    line_no is where the split that holds the line starts in its file, then the line's place among those that its task
    has read: one task reads a split from its start to its end, whatever other splits it reads.
    """
    read = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("nth"))
    rows = read.select("*", F.col("_metadata.file_path").alias("file"), place.alias("line_no"))
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def read_metadata_lines(spark: SparkSession, path: str) -> DataFrame:
    """Metadata records; `metadata` is null for a listing with an error, which means there is none. Keys are required."""
    rows = _lines(spark, path, METADATA).where("app_id is not null and market is not null and store is not null and device is not null and t0 is not null")
    md = F.when(F.col("raw.metadata.error").isNull(), F.col("raw.metadata"))
    return rows.select("app_id", "market", "store", "device", F.coalesce("language", F.lit("")).alias("language"), F.unix_millis(F.try_to_timestamp("t0")).alias("t0"), md.alias("metadata"), "file", "line_no").where("t0 is not null")


def read_metrics_lines(spark: SparkSession, path: str) -> DataFrame:
    rows = _lines(spark, path, METRICS)
    first = F.get("raw.ratings", F.lit(0))
    avg = F.coalesce(first["breakdown"]["avg"], first["value"])
    total = first["breakdown"]["total"]
    ratings = F.when(total.isNotNull() & avg.isNotNull(), F.struct(total.alias("total"), avg.alias("avg")))
    return rows.select("app_id", "market", "store", "device", F.unix_millis(F.try_to_timestamp("t0")).alias("t0"), ratings.alias("ratings"), F.get(F.col("raw")["app-power"], F.lit(0))["value"].alias("app_power"), "file", "line_no")


def one_per_key(rows: DataFrame, keys: list[str], wins: str = "first") -> DataFrame:
    """The first or last line of each key, in file and line order."""
    order = [F.asc("file"), F.asc("line_no")] if wins == "first" else [F.desc("file"), F.desc("line_no")]
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def shortlist_metadata(rows: DataFrame) -> DataFrame:
    """First usable record of each (app, store); a record without metadata doesn't claim the key."""
    m = F.col("metadata")
    subscription = F.exists(m["in_app_purchases"], lambda i: F.coalesce(i["is_subscription"], F.lit(False)) | i["recurring_subscription_period"].isNotNull())
    return one_per_key(rows.where("metadata is not null"), ["app_id", "store"]).select(
        "app_id", "store", m["dna"]["class_label"].alias("dna_class"), m["dna"]["subclass_label"].alias("dna_subclass"), m["categories"].alias("categories"),
        F.coalesce(subscription, F.lit(False)).alias("has_subscription"), F.coalesce(F.size(m["in_app_purchases"]), F.lit(0)).alias("iap_count"),
        F.substring(F.coalesce(m["description"], m["long_description"], m["short_description"]), 1, 400).alias("description"), m["icon"].alias("icon"),
    )


def invariants_of(rows: DataFrame) -> DataFrame:
    """Publisher and release of the first line of each (app, store); here a line with an error claims the key, with nulls."""
    d = F.col("metadata")["developer"]
    kind = F.schema_of_variant(d)
    as_text = F.when(kind == "STRING", F.try_variant_get(d, "$", "string"))
    return one_per_key(rows, ["app_id", "store"]).select(
        "app_id", "store", F.coalesce(as_text, F.try_variant_get(d, "$.id", "string")).alias("publisher_id"), F.coalesce(as_text, F.try_variant_get(d, "$.name", "string")).alias("publisher_name"),
        F.unix_millis(F.coalesce(F.try_to_timestamp(F.col("metadata")["release_date"]), F.try_to_timestamp(F.col("metadata")["release_date"], F.lit("MMM d, yyyy")))).alias("release_date"),
    )


def latest_drop(landed: DataFrame, column: str = "drop_date", pinned: str | None = None) -> DataFrame:
    """Rows of the pinned partition value, or of the greatest one only."""
    if pinned is not None:
        return landed.where(F.col(column) == pinned)
    newest = landed.agg(F.max(column).alias(column))
    return landed.join(F.broadcast(newest), column, "left_semi")


def chart_history(payloads: DataFrame) -> DataFrame:
    """(market, device, category, kind, captured_at, rank, app_id) of payload rows (market, device, body json)."""
    body = F.from_json("body", "struct<result: map<string, map<string, array<struct<date: string, value: array<string>>>>>>")
    days = payloads.select("market", "device", F.explode(body["result"]).alias("category", "kinds")).select("market", "device", "category", F.explode("kinds").alias("kind", "days")).select("market", "device", "category", "kind", F.explode("days").alias("d"))
    return days.select("market", "device", "category", "kind", F.unix_millis(F.try_to_timestamp("d.date")).alias("captured_at"), F.posexplode("d.value").alias("i", "app_id")).withColumn("rank", F.col("i") + 1).drop("i")


def page_apps(pages: DataFrame, html: str = "html") -> DataFrame:
    """(*columns, rank, app_id): distinct store ids linked from a chart page, in order of first place."""
    ids = F.array_distinct(F.regexp_extract_all(html, F.lit(r"/app/[^/\"]+/id(\d+)"), F.lit(1)))
    return pages.select(*[c for c in pages.columns if c != html], F.posexplode(ids).alias("i", "app_id")).withColumn("rank", F.col("i") + 1).drop("i")


def page_app_record(pages: DataFrame, html: str = "html") -> DataFrame:
    """The page's first linked-data block of an app: name, rating, count, price; nulls without one."""
    blocks = F.transform(F.regexp_extract_all(html, F.lit(r'(?s)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1)), lambda b: F.try_parse_json(b))
    each = F.flatten(F.transform(blocks, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))))  # an object or a list of them
    app = F.filter(each, lambda v: F.try_variant_get(v, "$['@type']", "string") == "MobileApplication")
    one = F.get(app, F.lit(0))
    return pages.withColumns({"name": F.try_variant_get(one, "$.name", "string"), "rating": F.try_variant_get(one, "$.aggregateRating.ratingValue", "double"), "rating_count": F.try_variant_get(one, "$.aggregateRating.reviewCount", "bigint"), "price": F.try_variant_get(one, "$.offers.price", "double")})


def closest_archive(payloads: DataFrame, column: str = "body") -> DataFrame:
    """Milliseconds of the first row's timestamp of an archive index (header row, then rows); 0 if it is short."""
    rows = F.from_json(column, "array<array<string>>")
    at = F.array_position(F.get(rows, F.lit(0)), "timestamp")
    stamp = F.when(at > 0, F.get(F.get(rows, F.lit(1)), (at - 1).cast("int")))
    return payloads.withColumn("archived_at", F.coalesce(F.unix_millis(F.try_to_timestamp(F.rpad(stamp, 14, "0"), F.lit("yyyyMMddHHmmss"))), F.lit(0)))


def normalized_reviews(raw: DataFrame) -> DataFrame:
    """(app_id, market, store, author, rating, text, posted_at) of landed rows whose `review` is JSON."""
    g = lambda *names: F.coalesce(*[F.get_json_object("review", f"$.{n}") for n in names])
    return raw.select("app_id", "market", "store", F.coalesce(g("userName", "author"), F.lit("anonymous")).alias("author"), F.coalesce(g("score", "rating").try_cast("double"), F.lit(0.0)).alias("rating"), F.coalesce(g("text", "title"), F.lit("")).alias("text"), g("date", "updated").alias("posted_at"))


# Markets with a storefront page.
STOREFRONTS = ("us", "id", "vn", "th", "my", "ph", "bd", "br", "es", "de", "fr", "jp")


def landing_url(market):
    """The storefront page of a market, null if it has none."""
    return F.when(F.lower(market).isin(*STOREFRONTS), F.concat(F.lit("https://apps.apple.com/"), F.lower(market), F.lit("/charts")))


CANDIDATE = "struct<app_id: string, store: string, title: string, score: double, dna_class: string, publisher_name: string, markets_active: array<string>, tenure_days_max: double, best_rank: bigint, has_subscription_iap: boolean, iap_count: bigint>"


def read_shortlist(spark: SparkSession, path: str) -> DataFrame:
    """Candidates of a shortlist's JSON document, as evaluate_shortlist() takes them.

    The document is an array, or has one named shortlist or candidates. Anything else, or a candidate without its app,
    store, markets, tenure or subscription flag, is an error.
    """
    text = spark.read.text(path, wholetext=True)
    named = F.from_json("value", f"struct<shortlist: array<{CANDIDATE}>, candidates: array<{CANDIDATE}>>")
    whole = F.when(F.trim("value").startswith("["), F.from_json("value", f"array<{CANDIDATE}>")).otherwise(F.coalesce(named["shortlist"], named["candidates"]))
    found = text.select(whole.alias("c"))
    if found.where("c is null").limit(1).count() or not found.limit(1).count():
        raise ValueError("a shortlist is an array, or has one named shortlist or candidates")
    rows = found.select(F.posexplode("c").alias("i", "c")).select("i", "c.*")
    needed = ("app_id", "store", "markets_active", "tenure_days_max", "has_subscription_iap")
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in needed]))
    for bad in rows.where(F.size(missing) > 0).orderBy("i").select("i", missing.alias("m")).limit(1).collect():
        raise ValueError(f"candidate {bad['i']} lacks {', '.join(bad['m'])}")
    return rows.select("app_id", "store", "title", "score", "dna_class", "publisher_name", F.col("markets_active").alias("markets"), F.col("tenure_days_max").cast("long").alias("tenure_max"), "best_rank", F.col("has_subscription_iap").alias("has_subscription"), "iap_count")


def read_thresholds(spark: SparkSession, path: str):
    """RiskThresholds of a JSON document with any of their fields; the others take their defaults, bad values are errors."""
    import dataclasses
    import json

    from chartwright.operators.shortlist import RiskThresholds

    given = json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).limit(1).collect()))  # a parameter file
    known = {f.name for f in dataclasses.fields(RiskThresholds)}
    if not isinstance(given, dict) or set(given) - known:
        raise ValueError(f"thresholds are an object with {', '.join(sorted(known))}")
    return RiskThresholds(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
