"""Resumable ingestion: landed dumps and daily snapshots into tables, first write of a key wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chartwright.functions.exprs import epoch_ms
from chartwright.sources.sinks import KeyedTable, append_if_absent

CHART_KEY = ["market", "category", "captured_at", "rank", "store"]
CHART = ["captured_at", "market", "category", "store"]


CHART_ROWS = "app_id string, market string, category string, captured_at long, rank int, source string, store string"


def ingest_charts(spark: SparkSession, landing: str, table: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Append every landed tab-separated file once; restarted, it goes on where it stopped, and repeats are no-ops.

    The table is a KeyedTable by time and chart: a batch is held against the charts that it shares with earlier ones, counts
    as a whole or not at all, and of lines with one key the first of the first file stays. Read it with charts_table().
    """
    schema = "app_id string, market string, category string, captured_at string, rank string, source string, store string"
    read = spark.readStream.schema(schema).options(sep="\t", header=True, maxFilesPerTrigger=files_per_batch).csv(landing)
    rank = F.when(F.col("rank").rlike("[0-9]"), F.col("rank").try_cast("int"))  # a failed cast is dear, and without a digit it fails
    rows = read.select("app_id", "market", "category", epoch_ms(F.col("captured_at")).alias("captured_at"), rank.alias("rank"), "source", "store", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    good = "app_id is not null and market is not null and category is not null and captured_at is not null and rank > 0 and store is not null"
    keyed = KeyedTable(spark, table, CHART_KEY, "captured_at", CHART)

    def write(batch: DataFrame, id_: int) -> None:
        line = F.struct("file", "split", F.monotonically_increasing_id().alias("nth"))  # a task reads a split in order
        keyed.append(batch.where(good).withColumn("line", line).drop("file", "split"), id_, ["line"])  # a time is read once, then asked for

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def charts_table(spark: SparkSession, table: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The ingested chart rows, or the batches that can hold rows of a span of time in milliseconds, cut to that span."""
    from pyspark.sql.types import StructType

    keyed, schema = KeyedTable(spark, table, CHART_KEY, "captured_at", CHART), StructType.fromDDL(CHART_ROWS)
    if first is None or last is None:
        return keyed.read(schema)
    return keyed.read(schema, str(first), str(last)).where(F.col("captured_at").between(first, last))


def daily_snapshots(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """One row of each (store, app_id, market, day) of a stream with event time ts; later than `late` is dropped."""
    return stream.withColumn("day", F.to_date("ts")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["store", "app_id", "market", "day"])


def land_snapshots(stream: DataFrame, table: str, failures: str, checkpoint: str, order: list[str]) -> StreamingQuery:
    """Append the first snapshot of each (store, app_id, market, day) of a stream with event time ts, and the charts that failed.

    The first write of a day wins: what an earlier batch has written stays, within a batch the first by `order`. A row with
    an error is a chart that couldn't be read; each (store, market, day, error) is kept once, in `failures`. Late rows are
    snapshots of their own day like any other. Both tables are KeyedTables by day: a batch is held against the days it
    brings, and one that is repeated changes nothing. Read them with snapshot_tables().
    """
    spark = stream.sparkSession
    good, bad = _snapshot_tables(spark, table, failures)
    rows = stream.withColumn("day", F.to_date("ts"))

    def write(batch: DataFrame, id_: int) -> None:
        good.append(batch.where("error is null").drop("error"), id_, order)
        bad.append(batch.where("error is not null").select("store", "market", "day", "error"), id_)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _snapshot_tables(spark: SparkSession, table: str, failures: str) -> tuple[KeyedTable, KeyedTable]:
    return KeyedTable(spark, table, ["store", "app_id", "market", "day"], "day"), KeyedTable(spark, failures, ["store", "market", "day", "error"], "day")


def snapshot_tables(spark: SparkSession, table: str, failures: str, schema) -> tuple[DataFrame, DataFrame]:
    """(snapshots of the schema given, failed charts) as landed so far."""
    from pyspark.sql.types import StructType

    good, bad = _snapshot_tables(spark, table, failures)
    return good.read(schema), bad.read(StructType.fromDDL("store string, market string, day date, error string"))


def pending_requests(requests: DataFrame, answered: DataFrame, cap: float, keys: list[str]) -> DataFrame:
    """Requests without an answer while what came before them costs less than `cap`, in order of request_no.

    Costs are summed within groups of request numbers first, so that no task orders all of them.
    """
    from pyspark.sql import Window

    open_ = requests.join(answered.select(*keys), keys, "left_anti").withColumn("__g", F.floor(F.col("request_no") / 10_000))
    groups = open_.groupBy("__g").agg(F.sum("cost").alias("c"))
    before = groups.select("__g", F.coalesce(F.sum("c").over(Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("base"))
    w = Window.partitionBy("__g").orderBy("request_no").rowsBetween(Window.unboundedPreceding, -1)
    spent = open_.withColumn("__s", F.coalesce(F.sum("cost").over(w), F.lit(0.0))).join(before, "__g")
    return spent.where(F.col("__s") + F.col("base") < cap).select(*requests.columns)


def failed_slices(expected: DataFrame, landed: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(landed.select(*keys).distinct(), keys, "left_anti")


def judging_requests(requests: DataFrame, answered: DataFrame, cap: float, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(answers known without a call, requests to make): a request without metadata scores 10 and costs nothing; of the
    others those not answered yet, within the budget."""
    known = requests.where("not has_metadata").select(*keys, F.lit(10.0).alias("score"), F.lit("no-metadata").alias("how"))
    return known, pending_requests(requests.where("has_metadata"), answered, cap, keys)


def land_answers(spark: SparkSession, landing: str, table: str, checkpoint: str, schema: str, keys: list[str], valid: str) -> StreamingQuery:
    """Answer files as they land: rows that `valid` accepts are appended once for each key; restarted, it goes on."""
    rows = spark.readStream.schema(schema).json(landing).where(valid)
    return rows.writeStream.foreachBatch(lambda batch, _: append_if_absent(batch, table, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replayed(requests: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Requests with the archived answer of the same key and request hash, null without one: no call is made."""
    archived = answers.where("length(response) > 0").select(*keys, "request_hash", "response")
    return requests.join(archived, [*keys, "request_hash"], "left")
