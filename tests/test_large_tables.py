"""What only tables of another size show."""

import datetime as dt
import glob
import os

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chartwright.sources import derived, sinks
from chartwright.streaming import ingest

SMALL = "/root/testdata/sf0.001"


def _tables(spark, folder, changed):
    """A copy of the smallest tables with some of them changed; changed: name -> function of the table."""
    for path in glob.glob(f"{SMALL}/*.parquet"):
        name = os.path.basename(path)[:-8]
        if name in changed:
            changed[name](spark.read.parquet(path)).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        else:
            os.symlink(path, f"{folder}/{name}.parquet")
    return str(folder)


def test_a_shortlist_without_candidates_has_none_to_evaluate(spark, tmp_path):
    folder = _tables(spark, tmp_path, {"lineitem": lambda t: t.where("l_orderkey < 0")})
    out = entry.queries()["f4_candidate"](spark, folder)
    assert out.columns == ["app_id", "store", "overall", "markets_spread"] and out.collect() == []


def test_every_diverging_pair_has_its_line(spark, tmp_path):
    """1,500 pairs with many ties, against the query's SQL."""
    k = F.col("conv_id")
    turns = spark.range(1500).select(F.col("id").alias("conv_id"), F.explode(F.expr("array(struct('user' as role, 0 as turn), struct('assistant' as role, 1 as turn))")).alias("t"))
    rows = turns.select("conv_id", "t.turn", "t.role", F.repeat(F.lit("x"), (k * F.when(F.col("t.turn") == 0, 7).otherwise(13) % 50).cast("int")).alias("text"))
    folder = _tables(spark, tmp_path, {"conversations": lambda _: rows})
    got = sorted(tuple(r) for r in entry.queries()["k10_divergence"](spark, folder).select("position", "line").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    assert len(got) == 1500 and got == sorted(con.execute(entry.oracle_sql()["k10_divergence"]).fetchall())


def test_lifts_take_cohorts_of_three_rows(spark):
    """Cohorts of three to nine rows have their lifts, as before the floor was raised to ten."""
    rows = entry.queries()["m5_lifts"](spark, "/root/testdata/sf0.01")
    assert "n >= 3 AND" in entry.oracle_sql()["m5_lifts"] and "n >= 10 AND" in entry.oracle_sql()["m6_bootstrap"]
    assert 3 <= rows.agg(F.min("n")).first()[0] < 10


def test_charts_are_made_once(spark):
    """What reads the charts several times reads them as written out, not their join over again: customers lead to them only."""
    for name in ("a16_simple_winner", "m12_signal_grid", "m11_factors"):
        plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().toString()
        assert "c_custkey" not in plan, name


def _dump(folder, name, *rows):
    head = "app_id\tmarket\tcategory\tcaptured_at\trank\tsource\tstore\n"
    (folder / f"{name}.tsv").write_text(head + "".join(f"{a}\t{m}\tc\t{1700000000 + 86400 * d}\t{r}\ts\tapple\n" for a, m, d, r in rows))


def test_landed_files_are_read_once_and_held_against_their_own_charts(spark, tmp_path, monkeypatch):
    """Nine batches over the same span: eight with charts of their own look at no earlier batch, the last at the one whose chart it shares."""
    land, said = tmp_path / "land", []
    land.mkdir()
    for k in range(8):
        _dump(land, k, *[(f"a{k}", f"m{k}", d, r) for d in (0, 5, 9) for r in (1, 2)], (f"late{k}", f"m{k}", 5, 2), ("bad", f"m{k}", 5, "x"))
        os.utime(land / f"{k}.tsv", (1e9 + k, 1e9 + k))
    go = lambda: ingest.ingest_charts(spark, str(land), str(tmp_path / "out"), str(tmp_path / "cp"), files_per_batch=1).awaitTermination()
    append = sinks.KeyedTable.append
    monkeypatch.setattr(sinks.KeyedTable, "append", lambda *a: said.append(append(*a)))
    go()
    assert said == [{"read": 7, "written": 6, "batches": 0}] * 8
    _dump(land, "again", ("other", "m3", 5, 1), ("new", "m3", 5, 3), ("later", "m3", 6, 1))
    go()
    _dump(land, "none", ("bad", "m0", 5, "x"), ("bad", "m0", 6, ""))
    go()
    assert said[8:] == [{"read": 3, "written": 2, "batches": 1}, {"read": 0, "written": 0, "batches": 0}]
    rows = sorted((r["market"], r["captured_at"] // 86_400_000, r["rank"], r["app_id"]) for r in ingest.charts_table(spark, str(tmp_path / "out")).collect())
    want = [(f"m{k}", 19675 + d, r, f"a{k}") for k in range(8) for d in (0, 5, 9) for r in (1, 2)] + [("m3", 19680, 3, "new"), ("m3", 19681, 1, "later")]
    assert rows == sorted(want)


def test_a_batch_is_computed_once(spark, tmp_path):
    """Three batches, the second with an earlier one's keys: each row passes once."""
    table, count = sinks.KeyedTable(spark, str(tmp_path / "t"), ["day", "app_id"], "day", ["day"]), spark.sparkContext.accumulator(0)
    made = F.udf(lambda x: count.add(1) or x, "long").asNondeterministic()
    for k, (first, last) in enumerate(((0, 40), (30, 60), (90, 99))):
        rows = spark.range(first, last).select(F.date_add(F.lit("2024-01-01"), (F.col("id") / 10).cast("int")).alias("day"), made("id").alias("app_id"), F.lit(k).alias("value"))
        assert table.append(rows, k) == {"read": last - first, "written": (40, 20, 9)[k], "batches": (0, 1, 0)[k]}
    assert count.value == 40 + 30 + 9
    assert sorted((r["app_id"], r["value"]) for r in table.read(rows.schema).collect()) == [(i, 0 if i < 40 else 1 if i < 60 else 2) for i in (*range(60), *range(90, 99))]


def test_batches_written_without_their_groups_are_held_against(spark, tmp_path):
    rows = lambda *days: spark.createDataFrame([(d, 1) for d in days], "day int, app_id long")
    sinks.KeyedTable(spark, str(tmp_path / "t"), ["day", "app_id"], "day").append(rows(1, 5), 0)
    table = sinks.KeyedTable(spark, str(tmp_path / "t"), ["day", "app_id"], "day", ["day"])
    assert table.append(rows(2, 5), 1) == {"read": 2, "written": 1, "batches": 1}
    assert sorted(r["day"] for r in table.read(rows(1).schema).collect()) == [1, 2, 5]


def test_chart_rows_are_not_dealt_by_nation(spark):
    """Whatever the number of partitions and the broadcast threshold: with many partitions a table of 25 keys isn't broadcast by itself."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = derived.charts(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(o_custkey" in plan and "hashpartitioning(c_nationkey" not in plan
