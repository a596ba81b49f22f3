"""Plumbing shared by the training-data operators: tables, shared storage, row keys, session settings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a local session gets one of its
    own; on a cluster that is an error, as a folder of one machine would not be shared."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = _OWN_DIR.setdefault(app, "file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write `df` as Parquet to the shared folder and read it back.

    A lost executor then costs a reread, not a recomputation, and values that depend on the
    task that made them (row keys) are fixed from here on.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by materialize() that nothing reads any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores behind it where a column of `df` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sample_by_hash(df: DataFrame, key: str, bound: int) -> DataFrame:
    """At most `bound` rows, the ones whose key hashes lowest: the same rows on every run.

    Of a table far larger than that, only hashes low enough for about twice as many rows are sorted, so what
    all tasks together send on is bounded too.
    """
    n, h = df.count(), F.xxhash64(F.col(key))
    if n > 4 * bound:
        df = df.where(h < int(-(1 << 63) + (1 << 64) * 2 * bound // n))
    return df.orderBy(h, F.col(key)).limit(bound)


def join_by_size(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, share: float = 0.001) -> DataFrame:
    """`rows` left-joined to `table` (distinct keys, `count` rows of each in `rows`) on `key`, without `count`.

    Keys that more than `share` of all `total` rows have, 1 / share of them at most, are joined by broadcast,
    so no task gathers the rows of one; the others are shuffled. Null keys join nothing and stay where they are.
    """
    heavy, light = table.where(F.col(count) > total * share).drop(count), table.where(F.col(count) <= total * share).drop(count)
    added = [c for c in light.columns if c != key]
    hot = F.broadcast(heavy.withColumn("hot_", F.lit(True)))
    marked = rows.where(F.col(key).isNotNull()).join(hot, key, "left")
    done = marked.where("hot_").drop("hot_").select(*rows.columns, *added)
    rest = marked.where("hot_ is null").select(*rows.columns).join(light, key, "left").select(*rows.columns, *added)
    none = rows.where(F.col(key).isNull()).select(*rows.columns, *[F.lit(None).cast(light.schema[c].dataType).alias(c) for c in added])
    return done.unionByName(rest).unionByName(none)
