"""Write policies on a key, and text outputs. Tables are Parquet folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F


def _existing(new: DataFrame, path: str) -> DataFrame | None:
    spark = new.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None


def _numbered(new: DataFrame, keys: list[str], order: list[str] | None) -> DataFrame:
    """Rows with their place __k among those of one key."""
    rest = [c for c in new.columns if c not in keys]
    return new.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or rest or keys))))


def first_per_key(new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row of each key: the first by `order` (a line number), which isn't kept; without one the least in the order of
    all other columns, so the choice doesn't depend on the run."""
    return _numbered(new, keys, order).where("__k = 1").drop("__k", *(order or []))


class KeyedTable:
    """A table whose rows have distinct keys, written in batches that either are there or aren't.

    A batch lies in a folder of its own, batch=<id>. It counts once its line of the manifest is there, which is written
    last, under another name first; what a failed batch has left is deleted when it is written again, and a batch that
    has its line is not written twice. The line keeps the least and greatest `range_key` of its rows, so that a new
    batch is held only against earlier ones whose range meets its own, and a reader skips the others too.

    `group`: those of the keys by which rows come together, as a chart's rows do. A batch's distinct groups are kept below
    _groups, and a new batch is held only against earlier rows of groups that it has too. So batches that cover the same
    span with groups of their own aren't compared by rows, and a batch costs what it holds, not what the table holds.
    """

    def __init__(self, spark, path: str, keys: list[str], range_key: str, group: list[str] | None = None):
        if range_key not in keys or not set(group or []) <= set(keys):
            raise ValueError("the range key and those of the group are among the keys")
        self.spark, self.path, self.keys, self.range_key, self.group = spark, path.rstrip("/"), keys, range_key, group
        self.path_of = spark._jvm.org.apache.hadoop.fs.Path
        self.store = self.path_of(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def manifest(self) -> list[dict]:
        """One entry for each batch that counts: id, rows, low, high (as JSON values), group (the keys whose groups are kept)."""
        folder = self.path_of(f"{self.path}/_manifest")
        if not self.store.exists(folder):
            return []
        lines = self.spark.read.schema("id string, rows long, low string, high string, group array<string>").json(f"{self.path}/_manifest/*.json")
        return [r.asDict() for r in lines.orderBy("id").collect()]

    def _met(self, found: list[dict], low=None, high=None, kind: str = "string") -> list[dict]:
        """Entries of the batches with rows whose ranges meet [low, high], all by default."""
        if low is not None and found:
            rows = self.spark.createDataFrame([(e["id"], e["low"], e["high"]) for e in found], "id string, low string, high string")
            meets = (F.col("low").cast(kind) <= F.lit(high).cast(kind)) & (F.col("high").cast(kind) >= F.lit(low).cast(kind))
            keep = {r["id"] for r in rows.where(F.coalesce(meets, F.lit(True))).collect()}
            found = [e for e in found if e["id"] in keep]
        return [e for e in found if e["rows"]]

    def _folders(self, entries: list[dict]) -> list[str]:
        return [f"{self.path}/batch={e['id']}" for e in entries]

    def read(self, schema, low=None, high=None) -> DataFrame:
        """Rows of all batches that count, or of those whose ranges meet [low, high]."""
        kind = schema[self.range_key].dataType.simpleString()
        folders = self._folders(self._met(self.manifest(), low, high, kind))
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def append(self, new: DataFrame, batch_id, order: list[str] | None = None) -> dict[str, int]:
        """Write the rows whose key isn't there; -> rows read, written and batches looked at. Of rows with one key the first by
        `order` counts. A batch that is there already is left as it is. `new` is computed once: its rows are written below
        _new first, and again without those that are there if it shares keys' ranges and groups with earlier batches."""
        id_ = f"{int(batch_id):012d}" if str(batch_id).isdigit() else str(batch_id)
        found = self.manifest()
        if any(e["id"] == id_ for e in found):
            return {"read": 0, "written": 0, "batches": 0}
        folder, fresh, groups = (f"{self.path}/{x}batch={id_}" for x in ("", "_new/", "_groups/"))
        for left in (folder, fresh, groups):
            self.store.delete(self.path_of(left), True)
        # sorted by the range key first; counted before the cut, so that no task sorts its rows before they are dealt as well
        rows, seen, first = _numbered(new, [self.range_key, *[k for k in self.keys if k != self.range_key]], order), Observation(), F.col("__k") == 1
        facts = F.count(F.lit(1)).alias("read"), *self._facts(first)
        rows = rows.observe(seen, *facts).where(first).drop("__k", *(order or []))
        rows.write.parquet(fresh)
        said, earlier, there = seen.get, [], None
        if said["low"] is not None:
            earlier = self._met(found, said["low"], said["high"], new.schema[self.range_key].dataType.simpleString())
        own = self.spark.read.schema(rows.schema).parquet(fresh)
        if self.group and said["n"]:
            own.select(*self.group).distinct().write.parquet(groups)
        if earlier:
            earlier, there = self._there(id_, own, earlier, said)
        if not earlier:
            if not self.store.rename(self.path_of(fresh), self.path_of(folder)):
                raise OSError(f"batch {id_} can't be moved to its place")
            written = said
        else:
            again = Observation()
            own.join(there, self.keys, "left_anti").select(*rows.columns).observe(again, *self._facts(F.lit(True))).write.parquet(folder)
            written = again.get
            self.store.delete(self.path_of(fresh), True)
        self._commit(id_, written)
        return {"read": said["read"], "written": written["n"], "batches": len(earlier)}

    def _facts(self, which):
        at = F.when(which, F.col(self.range_key))
        return F.count_if(which).alias("n"), F.min(at).cast("string").alias("low"), F.max(at).cast("string").alias("high")

    def _there(self, id_: str, own: DataFrame, earlier: list[dict], said: dict) -> tuple[list[dict], DataFrame | None]:
        """Of the earlier batches those that may hold keys of batch `id_`, and the keys that they may hold."""
        shared = None
        if self.group and all(e["group"] == self.group for e in earlier):  # else one was written without its groups
            at, schema = f"{self.path}/_groups", own.select(*self.group).schema
            theirs = self.spark.read.schema(schema.add("batch", "string")).option("basePath", at).parquet(*[f"{at}/batch={e['id']}" for e in earlier])
            shared = theirs.join(self.spark.read.parquet(f"{at}/batch={id_}"), self.group, "left_semi")
            named = {r["batch"] for r in shared.select("batch").distinct().collect()}  # batches, not rows
            earlier = [e for e in earlier if e["id"] in named]
        if not earlier:
            return [], None
        kind = own.schema[self.range_key].dataType.simpleString()
        there = self.spark.read.schema(own.schema).parquet(*self._folders(earlier)).where(F.col(self.range_key).between(F.lit(said["low"]).cast(kind), F.lit(said["high"]).cast(kind)))
        if shared is not None:
            there = there.join(shared.select(*self.group).distinct(), self.group, "left_semi")
        return earlier, there.select(*self.keys)

    def _commit(self, id_: str, facts: dict) -> None:
        import json

        line = json.dumps({"id": id_, "rows": facts["n"], "low": facts["low"], "high": facts["high"], "group": self.group})
        own, name = self.path_of(f"{self.path}/_manifest/.{id_}.tmp"), self.path_of(f"{self.path}/_manifest/{id_}.json")
        out = self.store.create(own, True)
        out.write(bytearray(line.encode()))
        out.close()
        if not self.store.rename(own, name):
            raise OSError(f"batch {id_} can't be committed")


def append_if_absent(new: DataFrame, path: str, keys: list[str], partition: str | None = None) -> dict[str, int]:
    """Append the rows whose key isn't there; -> rows read and written. A repeated run writes nothing.

    partition: one of the keys, by which the table is laid out; then only the partitions that `new` names are read.
    """
    there, rows = _existing(new, path), first_per_key(new, keys)
    if there is not None and partition is not None:
        there = there.where(F.col(partition).isin([r[0] for r in new.select(partition).distinct().collect()]))  # days of one batch
    fresh = rows if there is None else rows.join(there.select(*keys), keys, "left_anti").select(*new.columns)
    read, written = Observation(), Observation()
    fresh = fresh.observe(written, F.count(F.lit(1)).alias("n"))
    writer = fresh.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    new.observe(read, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    return {"read": read.get["n"], "written": written.get["n"]}


def replace_rows(new: DataFrame, path: str, to: str, keys: list[str]) -> DataFrame:
    """Write to folder `to` what `path` holds with new's rows in place of those of the same key."""
    there, rows = _existing(new, path), first_per_key(new, keys)
    out = rows if there is None else there.join(rows.select(*keys), keys, "left_anti").select(*there.columns).unionByName(rows)
    out.write.mode("errorifexists").parquet(to)
    return new.sparkSession.read.parquet(to)


def append_or_reject(new: DataFrame, path: str, keys: list[str]) -> None:
    """Append, or raise if a key is there already or comes twice."""
    there = _existing(new, path)
    if new.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"a key comes twice: {keys}")
    if there is not None and new.join(there.select(*keys), keys, "left_semi").limit(1).count():
        raise ValueError(f"a key is there already: {keys}")
    new.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.options(header=True, quote='"', escape='"', sep=sep, nullValue="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def report_text(rows: DataFrame, keys: list[str], order: list[str], line: str) -> DataFrame:
    """(*keys, text): a group's lines in order, joined by line breaks. Groups are reports, so small."""
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, line))), lambda x: x[line]), "\n").alias("text"))


def write_shortlist(csv: DataFrame, rows: DataFrame, funnel: DataFrame, config: dict, folder: str) -> None:
    """A shortlist's folder: shortlist_csv, shortlist_json (a row a candidate), funnel_json and config_json. A shortlist is
    short, so each is one file."""
    write_csv(csv.coalesce(1), f"{folder}/shortlist_csv")
    rows.coalesce(1).write.json(f"{folder}/shortlist_json")
    funnel.coalesce(1).write.json(f"{folder}/funnel_json")
    spark = csv.sparkSession
    spark.createDataFrame([(k, str(v)) for k, v in config.items()], "name string, value string").coalesce(1).write.json(f"{folder}/config_json")
