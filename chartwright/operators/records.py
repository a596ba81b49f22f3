"""App records from payloads, their validity, enrichment, stored judgements and snapshots, classes of signals by version."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartwright.functions import fixed
from chartwright.functions.exprs import finite

ENTRY = (
    "array<struct<appId: string, trackId: string, title: string, developer: variant, primaryGenre: string, genre: string, price: double, currency: string, free: boolean, score: double, "
    "ratings: bigint, reviews: bigint, inAppPurchases: boolean, iapHints: array<string>, description: string, screenshots: array<string>, icon: string, released: string, updated: string>>"
)


def store_records(payloads: DataFrame, body: str = "body") -> DataFrame:
    """App records of chart payloads (*columns, body: a JSON array in chart order), rank = place from 1."""
    rows = payloads.select(*[c for c in payloads.columns if c != body], F.posexplode(F.from_json(body, ENTRY)).alias("i", "e"))
    e, developer = F.col("e"), F.col("e.developer")
    name = F.when(F.schema_of_variant(developer) == "STRING", F.try_variant_get(developer, "$", "string")).otherwise(F.try_variant_get(developer, "$.devName", "string"))
    usd = (e["currency"] == "USD") | F.coalesce(e["free"], F.lit(False))
    return rows.select(
        *[c for c in rows.columns if c not in ("i", "e")], e["appId"].alias("app_id"), e["trackId"].alias("track_id"), (F.col("i") + 1).cast("long").alias("rank"), F.coalesce(e["title"], e["appId"]).alias("name"),
        F.coalesce(name, F.lit("")).alias("developer"), F.coalesce(e["primaryGenre"], e["genre"], F.lit("Unknown")).alias("category"), F.when(usd & e["price"].isNotNull(), e["price"]).otherwise(0.0).alias("price_usd"),
        e["score"].alias("rating"), F.coalesce(e["ratings"], e["reviews"]).alias("ratings_count"), F.coalesce(e["inAppPurchases"], F.size(e["iapHints"]) > 0, F.lit(False)).alias("iap_present"),
        F.coalesce(e["description"], F.lit("")).alias("description"), F.coalesce(e["screenshots"], F.array().cast("array<string>")).alias("screenshot_urls"), e["icon"].alias("icon_url"),
        iso_time(e["released"]).alias("release_date"), iso_time(e["updated"]).alias("last_updated"),
    )


def iso_time(text: Column) -> Column:
    """ISO 8601 with an offset as it is; any other date that can be read in Z form; else null."""
    read = F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("MMM d, yyyy")))
    zulu = F.date_format(F.to_utc_timestamp(read, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?([+-]\d{2}:?\d{2}|Z)$"), text).otherwise(zulu)


def adapted_records(metadata: DataFrame) -> DataFrame:
    """Metadata lines as app records with defaults; a listing that there is not has none and is left out."""
    m, store = F.col("metadata"), F.col("store")
    return metadata.where("metadata is not null").select(
        F.when(store == "googleplay", "google").otherwise(store).alias("store"), "app_id", F.when(store == "apple", F.col("app_id")).alias("track_id"), "market", F.coalesce(m["title"], F.lit("")).alias("name"),
        F.lit("unknown").alias("developer"), F.lit("unknown").alias("category"), F.lit(0.0).alias("price_usd"), F.lit(False).alias("iap_present"), F.coalesce(m["description"], F.lit("")).alias("description"),
    )


def _violations(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))


def app_violations(records: DataFrame) -> DataFrame:
    """App records with the names of the rules each breaks; none: valid."""
    within = lambda c, low, high: F.col(c).isNull() | finite(F.col(c).cast("double")).between(low, high)
    timed = lambda c: F.col(c).isNull() | F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$")
    most = float(2**62)
    rules = {
        "store": F.col("store").isin("apple", "google"),
        "app_id": F.length("app_id") >= 1,
        "market": F.length("market") == 2,
        "rating": within("rating", 0, 5),
        "ratings_count": within("ratings_count", 0, most),
        "price_usd": F.col("price_usd").isNotNull() & within("price_usd", 0, most),
        "release_date": timed("release_date"),
    }
    return records.withColumn("violations", _violations(rules))


def opportunity_violations(opportunities: DataFrame) -> DataFrame:
    """Opportunities with the names of the rules each breaks: closed lists, a score in 0..10 or none, evidence, a kill rule."""
    score = lambda c: F.col(c).isNull() | finite(F.col(c)).between(0, 10)
    rules = {
        "target_market": F.col("target_market").isin(*fixed.OPPORTUNITY_MARKETS),
        "category": F.col("category").isin(*fixed.OPPORTUNITY_CATEGORIES),
        "score": score("score"),
        "evidence": F.size("evidence") >= 1,
        "kill_direction": F.col("kill_direction").isin("below", "above"),
        "kill_metric": F.length("kill_metric") >= 1,
    }
    return opportunities.withColumn("violations", _violations(rules))


def merged_enrichment(chart_apps: DataFrame, enriched: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Chart rows with `app` (the enriched record, else their own) and `source` (enriched or chart-only).

    chart_apps (*keys, app), enriched (*keys, app, *order); the last enriched record of a key wins.
    """
    last = enriched.groupBy(*keys).agg(F.max_by("app", F.struct(*order)).alias("__app"), F.lit(True).alias("__there"))
    out = chart_apps.join(last, keys, "left")
    return out.select(*keys, F.when(F.col("__there"), F.col("__app")).otherwise(F.col("app")).alias("app"), F.when(F.col("__there"), "enriched").otherwise("chart-only").alias("source"))


def members(rows: DataFrame, listed: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is listed, however long the list is."""
    return rows.join(listed.select(*key), key, "left_semi")


def charted_on(charts: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Chart rows of each asked (*keys, day), with their place in the chart as `position`."""
    rows = charts.join(asked.select(*keys, "day").distinct(), [*keys, "day"], "left_semi")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*keys, "day").orderBy("rank", "app_id")).cast("long"))


def distinct_rows(rows: DataFrame) -> DataFrame:
    """Rows landed twice count once; nulls are equal."""
    return rows.dropDuplicates()


def first_groups(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """All rows of the first n keys in order."""
    return rows.join(F.broadcast(rows.select(*keys).distinct().orderBy(*keys).limit(n)), keys, "left_semi")


def latest_run(results: DataFrame, run: str, order: list[str]) -> DataFrame:
    """One row: the run id of the last result, null if there is none."""
    return results.agg(F.max_by(run, F.struct(*order)).alias(run))


def run_results(results: DataFrame, run_id, schema: str, order: list[str], valid: str | Column | None = None) -> DataFrame:
    """Rows of one run with `result`, their payload as a struct, and their place; payloads that can't be read are left out, and
    those for which `valid`, a condition on result, isn't true."""
    rows = results.where(F.col("run_id") == run_id).withColumn("result", F.from_json("payload", schema, {"mode": "PERMISSIVE"}))
    read = rows.where(F.try_parse_json("payload").isNotNull() & F.col("result").isNotNull())
    read = read if valid is None else read.where(valid)
    return read.withColumn("position", F.row_number().over(Window.partitionBy("run_id").orderBy(*order)).cast("long"))


def snapshot_range(snapshots: DataFrame, first_day: str, last_day: str, schema: str, valid: str) -> DataFrame:
    """Snapshots between two days, both included, with `snapshot`, their payload as a struct; corrupt or invalid ones go."""
    inside = snapshots.where(F.col("snapshot_day").between(first_day, last_day)).withColumn("snapshot", F.from_json("payload", schema))
    return inside.where(F.try_parse_json("payload").isNotNull()).where(valid)


def fresh(entries: DataFrame, now: str, stale: bool = False) -> DataFrame:
    """Cache entries that haven't expired at `now`; stale: those that have too, with their age in milliseconds."""
    at = F.lit(now).cast("timestamp")
    out = entries.withColumns({"is_fresh": F.col("expires_at") > at, "age_ms": F.unix_millis(at) - F.unix_millis("created_at")})
    return out if stale else out.where("is_fresh")


def version_tag(market: Column, store: Column | None = None, of_market: str = fixed.MARKET_TAG, of_cell: tuple[str, str, str] = fixed.CELL_TAG) -> Column:
    """The tag of a market, or of a cell, market and store: what stored signals carry as their version."""
    return F.concat(F.lit(of_market), market) if store is None else F.concat(F.lit(of_cell[0]), market, F.lit(of_cell[1]), store, F.lit(of_cell[2]))


def parsed_tag(tag: Column, of_cell: tuple[str, str, str] = fixed.CELL_TAG, stores: tuple[str, ...] = ("apple", "googleplay")) -> Column:
    """(market, store) of a cell's tag; null if it is none. The store is what stands last, so a market may hold the separator."""
    start, between, end = (re.escape(x) for x in of_cell)
    pattern = f"^{start}(.+){between}({'|'.join(re.escape(s) for s in stores)}){end}$"
    return F.when(tag.rlike(pattern), F.struct(F.regexp_extract(tag, pattern, 1).alias("market"), F.regexp_extract(tag, pattern, 2).alias("store")))


def parsed_rows(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows with market and store of their tag, counts of rows read, parsed and dropped)."""
    marked = rows.withColumn("__tag", parsed_tag(F.col(column)))
    counts = marked.agg(F.count("*").alias("n_rows"), F.count("__tag").alias("n_parsed"), F.count_if(F.col("__tag").isNull()).alias("n_dropped"))
    return marked.where("__tag is not null").withColumns({"market": F.col("__tag.market"), "store": F.col("__tag.store")}).drop("__tag"), counts


def signals_on_charts(signals: DataFrame, charts: DataFrame, name: str) -> DataFrame:
    """(app_id, market, store, day, value): one row for each chart row of a signal's app and day whose market the signal's
    version names."""
    rows = signals.where((F.col("signal_name") == name) & F.col("value").isNotNull()).select("app_id", "day", "version", "value")
    both = charts.select("app_id", "market", "store", "day", version_tag(F.col("market")).alias("version")).join(rows, ["app_id", "day", "version"])
    return both.select("app_id", "market", "store", "day", "value")


def extracted(responses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(metadata, review counts as signals, ranks, errors) of landed provider responses (endpoint, app_id, market, t, body, error).

    An empty review page makes no signal. Nulls and other shapes in a body are left out.
    """
    ok = responses.where("error is null and body is not null")
    metadata = ok.where("endpoint = 'metadata'").select("app_id", "market", "t", "body")
    pages = ok.where("endpoint = 'reviews'").withColumn("n", F.size(F.from_json("body", "array<string>"))).where("n > 0")
    reviews = pages.select("app_id", F.lit("review_count").alias("signal_name"), "t", F.col("n").cast("double").alias("value"))
    ranks = ok.where("endpoint = 'ranks'").select("app_id", "market", F.explode(F.from_json("body", "array<struct<category: string, day: date, rank: int>>")).alias("r"))
    errors = responses.where("error is not null").groupBy("endpoint").agg(F.count("*").alias("n_errors"))
    return metadata, reviews, ranks.select("app_id", "market", "r.category", "r.day", "r.rank").where("rank > 0"), errors


def sampled_dates(first: str, last: str) -> list[str]:
    """The first day, the one in the middle and the last one, each once."""
    a, b = dt.date.fromisoformat(first), dt.date.fromisoformat(last)
    if b < a:
        raise ValueError(f"{last} lies before {first}")
    return [d.isoformat() for d in sorted({a, a + (b - a) // 2, b})]


def request_grid(apps: DataFrame, markets: list[str], first: str, last: str, endpoints: tuple[str, ...] = ("metadata", "reviews", "ranks")) -> DataFrame:
    """(endpoint, app_id, market, t): each app asked in each market on the sampled dates, at each endpoint."""
    each = lambda values, kind: F.explode(F.array(*[F.lit(v).cast(kind) for v in values]))
    rows = apps.select("app_id").distinct().select("app_id", each(markets, "string").alias("market"))
    rows = rows.select("*", each(sampled_dates(first, last), "date").alias("t"))
    return rows.select(each(endpoints, "string").alias("endpoint"), "app_id", "market", "t")


def reconciled(grid: DataFrame, responses: DataFrame) -> DataFrame:
    """(endpoint, app_id, market, t, n, n_errors, status) of every call asked for or landed: ok, error if all its responses
    are errors, missing without any, unexpected if it wasn't asked for."""
    key = ["endpoint", "app_id", "market", "t"]
    landed = responses.groupBy(*key).agg(F.count("*").alias("n"), F.count("error").alias("n_errors"))
    both = grid.select(*key, F.lit(True).alias("asked")).join(landed, key, "full_outer")
    status = F.when(F.col("asked").isNull(), "unexpected").when(F.col("n").isNull(), "missing").when(F.col("n_errors") == F.col("n"), "error").otherwise("ok")
    return both.select(*key, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_errors", F.lit(0)).alias("n_errors"), status.alias("status"))
