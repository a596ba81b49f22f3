"""Registered queries against their SQL on the smallest tables, and operators on literal cases."""

import datetime as dt
import math

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chartwright.functions import exprs as X
from chartwright.operators import backtest, factors, shortlist, signals
from chartwright.plans import landed, registry, reports, scores  # noqa: F401  each registers its queries
from chartwright.sources import files, sinks
from chartwright.streaming import ingest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    cell = lambda v: None if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)) else str(v)[:10] if isinstance(v, (dt.date, pd.Timestamp)) else str(v) if isinstance(v, (str, bool)) else f"{float(v) + 0.0:.5f}"
    return sorted([tuple(map(cell, r)) for r in frame.itertuples(index=False, name=None)], key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    own, sql = registry.QUERIES[name](spark, DATA).toPandas(), duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(own.columns) == sorted(sql.columns)
    assert rows_of(own) == rows_of(sql)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("d", "score"), [(100, 10.0), (50, 8.0), (20, 5.0), (0, 2.0), (-25, 0.5), (-60, 0.0)])
def test_improvement_bands(spark, d, score):
    assert one(spark, X.improvement_score(F.lit(d))) == pytest.approx(score)


def test_top3_needs_three_and_counts_zeros(spark):
    assert one(spark, X.top3_mean([F.lit(9.0), F.lit(None).cast("double"), F.lit(float("nan"))])) is None
    assert one(spark, X.top3_mean([F.lit(9.0), F.lit(0.0), F.lit(0.0), F.lit(None).cast("double")])) == pytest.approx(3.0)


def test_times_and_templates(spark):
    assert one(spark, X.epoch_ms(F.lit("1700000000"))) == 1700000000000
    assert one(spark, X.epoch_ms(F.lit("Nov 12, 2012"))) == 1352678400000
    assert one(spark, X.epoch_ms(F.lit("nonsense"))) is None
    assert one(spark, X.fill_template(F.lit("{{a}}-{{b}}-{{c}}"), F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit(None).cast("string")))) == "x--{{c}}"


def test_language(spark):
    assert one(spark, X.detected_language(F.lit("ひらがな"))) == "ja"
    assert one(spark, X.detected_language(F.lit("the and for"))) == "en"
    assert one(spark, X.detected_language(F.lit("the word"))) is None
    assert one(spark, X.localization_gap(F.lit("  "), F.lit("en"))) == 5.0


def test_spikes_go_and_ends_stay(spark):
    s = spark.createDataFrame([("a", i, r) for i, r in enumerate([10, 200, 12, 11, 300])], "app string, t int, rank int")
    assert [r["rank"] for r in signals.smoothed(s, ["app"], "t", "rank").orderBy("t").collect()] == [10, 12, 11, 300]
    with pytest.raises(ValueError):
        signals.smoothed(s, ["app"], "t", "rank", 0)


def test_as_of_ignores_the_future_and_null_policies_differ(spark):
    day = lambda n: dt.date(2024, 1, n)
    rows = [(1, "s", day(1), 1, 5.0), (1, "s", day(3), 2, None), (1, "s", day(9), 3, 7.0)]
    schema = "app_id long, signal_name string, day date, event_id long, value double"
    cohort = spark.createDataFrame([(1, day(5))], "app_id long, t0 date")
    for policy, want in (("skip", [5.0]), ("keep", [None]), ("missing", [])):
        for future in ([], [(1, "s", day(6), 4, 99.0)]):
            got = backtest.as_of(cohort, spark.createDataFrame(rows + future, schema), policy)
            assert [r["value"] for r in got.collect()] == want
    with pytest.raises(ValueError):
        backtest.assert_no_leaks(cohort, spark.createDataFrame(rows, schema))


def test_precision_divides_by_k(spark):
    ranked = spark.createDataFrame([("c", "r", f"a{i}", i) for i in range(1, 5)], "cohort string, ranker string, app_id string, pos long")
    won = spark.createDataFrame([("c", "a1", 1), ("c", "a4", 1)], "cohort string, app_id string, is_winner int")
    assert {r["k"]: r["precision"] for r in backtest.precision_at_k(ranked, won, ["cohort"], (1, 10)).collect()} == {1: 1.0, 10: 0.2}


def test_winner_scores(spark):
    d0 = dt.date(2020, 1, 1)
    charts = spark.createDataFrame([(1, d0 + dt.timedelta(days=30 * i), 1) for i in range(36)], "app_id long, day date, rank long")
    sig = spark.createDataFrame([(1, "n", dt.date(2022, 11, 1), 1, 0.0), (1, "n", dt.date(2022, 12, 1), 2, 1000.0), (1, "rev", dt.date(2022, 1, 1), 3, 100000.0)], "app_id long, signal_name string, day date, event_id long, value double")
    got = {r["app_id"]: (r["score"], r["tier"]) for r in backtest.winner_scores(spark.createDataFrame([(1, dt.date(2022, 12, 16)), (2, dt.date(2022, 12, 16))], "app_id long, t date"), charts, sig, "n", "rev").collect()}
    assert got[1] == (10.0, "winner") and got[2] == (None, None)


def test_residuals_match_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.random((40, 2))
    frame = spark.createDataFrame([("m", i, float(a), float(b)) for i, (a, b) in enumerate(x)], "market string, app_id long, f0 double, f1 double")
    got = factors.residualized(frame, ["market"], ("f0", "f1")).orderBy("app_id").toPandas()
    design = np.column_stack([np.ones(40), x[:, 0]])
    assert np.allclose(got["f1"], x[:, 1] - design @ np.linalg.lstsq(design, x[:, 1], rcond=None)[0])


def test_bootstrap_is_reproducible_and_null_when_small(spark):
    lifts = spark.createDataFrame([("f1", str(i), 0.1 + i / 100) for i in range(12)] + [("f2", "a", 0.5)], "signal_name string, cohort string, lift double")
    a, b = ({r["signal_name"]: r.asDict() for r in factors.cluster_bootstrap(lifts).collect()} for _ in range(2))
    assert a == b and a["f1"]["p"] == 0.0 and a["f1"]["low"] <= a["f1"]["median"] <= a["f1"]["high"] and a["f2"]["p"] is None


def test_chart_dump(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("market\tapp_id\tcategory\tcaptured_at\trank\nus\ta\tc\t1700000000\t1\n\nus\tb\tc\tx\t2\nus\tc\tc\t1700000000\t-1\nus\t\tc\t1700000000\t3\n")
    valid, counts = files.read_chart_dump(spark, str(tmp_path / "d.tsv"))
    assert [r["app_id"] for r in valid.collect()] == ["a"]
    assert counts.first()["rows_invalid"] == 3
    (tmp_path / "e.tsv").write_text("market\tapp_id\nus\ta\n")
    with pytest.raises(ValueError):
        files.read_chart_dump(spark, str(tmp_path / "e.tsv"))


def test_metadata_lines(spark, tmp_path):
    base = '{"app_id": "%s", "market": "us", "store": "apple", "device": "d", "t0": "2024-01-01", "raw": {"metadata": %s}}'
    lines = [base % ("a", '{"error": "422"}'), base % ("a", '{"developer": {"id": 5, "name": "N"}, "dna": {"class_label": "X"}}'), "{broken", base % ("b", '{"developer": "Solo", "release_date": "Nov 12, 2012"}')]
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    rows = files.read_metadata_lines(spark, str(tmp_path / "m.jsonl"))
    assert rows.count() == 3
    inv = {r["app_id"]: r for r in files.invariants_of(rows).collect()}
    assert inv["a"]["publisher_id"] is None and inv["b"]["publisher_id"] == "Solo" and inv["b"]["release_date"] == 1352678400000
    short = {r["app_id"]: r for r in files.shortlist_metadata(rows).collect()}
    assert short["a"]["dna_class"] == "X"


def test_page_parsers(spark):
    ld = '<script type="application/ld+json">{"@type": "MobileApplication", "name": "N", "aggregateRating": {"ratingValue": 4.5, "reviewCount": 7}}</script>'
    pages = spark.createDataFrame([(1, '<a href="/app/x/id12"></a><a href="/app/y/id7"></a><a href="/app/x/id12"></a>'), (2, ld)], "page_id long, html string")
    assert [(r["rank"], r["app_id"]) for r in files.page_apps(pages).where("page_id = 1").orderBy("rank").collect()] == [(1, "12"), (2, "7")]
    got = {r["page_id"]: (r["name"], r["rating"]) for r in files.page_app_record(pages).collect()}
    assert got == {1: (None, None), 2: ("N", 4.5)}
    cdx = spark.createDataFrame([('[["urlkey","timestamp"],["x","20240102030405"]]',), ("[]",)], "body string")
    assert sorted(r["archived_at"] for r in files.closest_archive(cdx).collect()) == [0, 1704164645000]


def test_write_policies(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    path = str(tmp_path / "t")
    assert sinks.append_if_absent(a, path, ["k"]) == {"read": 2, "written": 2}
    assert sinks.append_if_absent(a.unionByName(spark.createDataFrame([(3, "z")], "k int, v string")), path, ["k"])["written"] == 1
    assert sorted(map(tuple, sinks.replace_rows(spark.createDataFrame([(1, "n")], "k int, v string"), path, path + "2", ["k"]).collect())) == [(1, "n"), (2, "y"), (3, "z")]
    with pytest.raises(ValueError):
        sinks.append_or_reject(a, path, ["k"])


def test_stream_ingest_is_idempotent(spark, tmp_path):
    (tmp_path / "land").mkdir()
    head = "app_id\tmarket\tcategory\tcaptured_at\trank\tsource\tstore\n"
    (tmp_path / "land/a.tsv").write_text(head + "a\tus\tc\t1700000000\t1\ts\tapple\nb\tus\tc\tbad\t2\ts\tapple\n")
    go = lambda: ingest.ingest_charts(spark, str(tmp_path / "land"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    go()
    (tmp_path / "land/b.tsv").write_text(head + "a\tus\tc\t1700000000\t1\ts\tapple\nc\tus\tc\t1700000000\t2\ts\tapple\n")
    go()
    assert sorted(r["app_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "c"]


def test_budget_stops_after_the_cap(spark):
    requests = spark.createDataFrame([(i, f"k{i}", 1.0) for i in range(6)], "request_no long, key string, cost double")
    done = spark.createDataFrame([("k0",)], "key string")
    assert sorted(r["key"] for r in ingest.pending_requests(requests, done, 3.0, ["key"]).collect()) == ["k1", "k2", "k3"]


def test_candidate_reference():
    assert shortlist.parse_candidate_ref("a:b:apple") == ("a:b", "apple")
    with pytest.raises(ValueError):
        shortlist.parse_candidate_ref("nocolon")
