"""Windows over many dates, the study's solvers, keyed tables, line order, grids and prompts, against plain versions."""

import datetime as dt
import hashlib
import json
import unicodedata

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartwright.functions import exprs as X
from chartwright.functions import fixed, prompts
from chartwright.operators import backtest, factors, records, reports, signals
from chartwright.operators.windows import TRAILING, deviation, outcome, segments, windowed
from chartwright.plans import registry
from chartwright.sources import files, sinks
from chartwright.streaming import ingest

DAY = dt.date(2020, 1, 1)
CHARTS = "market string, store string, app_id long, day date, rank long"


@pytest.fixture(scope="module")
def charts(spark):
    rng = np.random.default_rng(11)
    rows = [(m, s, int(a), DAY + dt.timedelta(int(d)), int(rng.integers(1, 120))) for m in ("a", "b") for s in ("apple", "googleplay") for a in range(6) for d in rng.choice(700, 150)]
    return spark.createDataFrame(rows, CHARTS), pd.DataFrame(rows, columns=["market", "store", "app_id", "day", "rank"])


def test_windows_are_those_of_each_date_alone(spark, charts):
    df, plain = charts
    t0s = [DAY + dt.timedelta(x) for x in (0, 90, 91, 97, 300, 660, 2000)]
    cohorts = spark.createDataFrame([("a", "apple", t) for t in t0s] + [("a", "apple", None)], "market string, store string, t0 date")
    spans = {**TRAILING, **outcome(30)}
    got = {(r["market"], r["store"], r["app_id"], r["t0"]): r for r in windowed(df, cohorts, spans, 50).withColumn("sd", deviation("quarter")).collect()}
    seen = 0
    for (m, s, a), rows in plain.groupby(["market", "store", "app_id"]):
        for t0 in t0s:
            parts = {w: rows[(rows["day"] >= t0 + dt.timedelta(lo)) & (rows["day"] <= t0 + dt.timedelta(hi))] for w, (lo, hi) in spans.items()}
            r = got.get((m, s, a, t0))
            assert (r is not None) == any(len(p) for p in parts.values())
            for w, p in parts.items() if r else ():
                seen += 1
                last = p[p["day"] == p["day"].max()]["rank"].min() if len(p) else None
                assert (r[w]["n"], r[w]["high"]) == (len(p), p[p["rank"] <= 50]["day"].nunique())
                assert (r[w]["best"], r[w]["last"]) == ((p["rank"].min(), last) if len(p) else (None, None))
            if r and len(parts["quarter"]):
                assert r["sd"] == pytest.approx(parts["quarter"]["rank"].std(ddof=0), abs=1e-9)
    assert seen > 200
    assert windowed(df, cohorts.limit(0), spans, 50).count() == 0


def test_charts_are_read_once_however_many_dates(spark, charts):
    for n in (1, 12):
        cohorts = spark.createDataFrame([("a", "apple", DAY + dt.timedelta(30 * k)) for k in range(n)], "market string, store string, t0 date")
        plan = windowed(charts[0], cohorts, TRAILING, 50)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("rank#") and plan.count("Generate") == 0 and plan.count("RepartitionByExpression") == 1
    calendar, member = segments([DAY, DAY + dt.timedelta(31)], TRAILING)
    assert len({d for d, _ in calendar}) == len(calendar) == 366 + 31 and len({s for s, *_ in member}) <= 2 * 2 * len(TRAILING)


def test_grid_of_signals_is_that_of_each_date_alone(spark, charts):
    df, _ = charts
    t0s = [DAY + dt.timedelta(x) for x in (40, 200, 410)]
    pool = spark.createDataFrame([("a", t, a) for t in t0s for a in (0, 3, 5, 99)], "market string, t0 date, app_id long")
    scores = spark.createDataFrame([(0, 4.5), (3, None)], "app_id long, score double")
    grid = {(r["app_id"], r["t0"], r["signal_name"]): r["value"] for r in signals.signal_grid(df, pool, scores, least=5, threshold=20).collect()}
    assert len(grid) == 3 * 3 * 4
    for t0 in t0s:
        speed = {r["app_id"]: r["velocity"] for r in signals.velocity_v1(df, str(t0), least=5, threshold=20).collect()}
        weak = {r["app_id"]: r["vulnerability"] for r in signals.chart_vulnerability(df, str(t0)).collect()}
        for a in (0, 3, 5, 99):
            assert grid[a, t0, "velocity"] == pytest.approx(speed.get(a)) if speed.get(a) is not None else grid[a, t0, "velocity"] is None
            assert grid[a, t0, "incumbent_vulnerability"] == pytest.approx(weak.get(a)) if weak.get(a) is not None else grid[a, t0, "incumbent_vulnerability"] is None
            assert grid[a, t0, "winner_score"] == (4.5 if a == 0 else None)
    assert any(v is not None for (_, _, n), v in grid.items() if n == "velocity")


def residuals(cell, names):
    out = cell[names].astype(float).copy()
    for i, f in enumerate(names):
        rows = cell[f].notna()
        prior = [p for p in names[:i] if out.loc[rows, p].notna().all()]
        if i and rows.sum() >= 3 and prior:
            x = np.column_stack([np.ones(rows.sum()), out.loc[rows, prior].to_numpy(float)])
            y = cell.loc[rows, f].to_numpy(float)
            out.loc[rows, f] = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    return out


def test_residuals_of_odd_columns(spark):
    """Collinear and constant columns, nulls in any pattern, small cells."""
    rng, names, rows = np.random.default_rng(2), list(factors.FACTORS), []
    for t in range(12):
        n = (1, 2, 3, 4, 9, 40)[t % 6]
        x = rng.standard_normal((n, 8))
        x[:, 3] = 2 * x[:, 0] - x[:, 1] if t % 2 else x[:, 3]
        x[:, 5] = 0.0 if t % 3 == 0 else x[:, 5]
        x[:, 6] = x[:, 2]
        gone = rng.random((n, 8)) < (0.0, 0.3)[t % 2]
        gone[:, 1] |= t % 4 == 3
        rows += [("m" if t % 5 else None, "apple", DAY + dt.timedelta(t), i, *[None if g else float(v) for v, g in zip(x[i], gone[i])]) for i in range(n)]
    schema = "market string, store string, t0 date, app_id long, " + ", ".join(f"{f} double" for f in names)
    got = factors.residualized(spark.createDataFrame(rows, schema), factors.CELL).toPandas().sort_values(["t0", "app_id"]).reset_index(drop=True)
    plain = pd.DataFrame(rows, columns=["market", "store", "t0", "app_id", *names]).sort_values(["t0", "app_id"]).reset_index(drop=True)
    want = pd.concat([residuals(cell, names) for _, cell in plain.groupby("t0")]).sort_index()
    assert len(got) == len(plain)
    for f in names:
        assert np.allclose(got[f].astype(float), want[f], atol=1e-6, equal_nan=True), f


def plain_folds(p, features, label):
    """Folds by a plain Newton fit of each date."""
    dates, out = sorted(p["t0"].unique()), {}
    levels = [(k, v) for k in ("market", "store") for v in sorted(p[k].unique())[1:]]
    for t0 in dates[1:]:
        train, test = p[p["t0"] < t0], p[p["t0"] == t0]
        if len(train) < 30 or len(test) < 10 or train[label].nunique() < 2:
            continue
        fill = train[features].median()
        design = lambda q: np.column_stack([np.ones(len(q)), *[q[f].fillna(fill[f]) for f in features], *[q[k] == v for k, v in levels]]).astype(float)  # noqa: E731, B023
        x, y = design(train), train[label].to_numpy(float)
        w = np.zeros(x.shape[1])
        for _ in range(100):
            mu = 1 / (1 + np.exp(-x @ w))
            w -= np.linalg.solve(x.T @ (x * (mu * (1 - mu))[:, None]) + np.eye(len(w)), x.T @ (mu - y) + w)
        test = test.assign(p=np.round(design(test) @ w, 7))
        both = []
        for _, c in test.groupby(["market", "store"]):
            if len(c) >= 10:
                k = max(1, int(np.ceil(0.1 * len(c))))
                both.append((c.sort_values(["p", "app_id"], ascending=[False, True])[label].head(k).mean(), c.sort_values(["f0", "app_id"])[label].head(k).mean()))
        if both:
            out[t0] = (len(train), len(test), *np.mean(both, axis=0))
    return out


def test_composite_of_the_given_charts_is_that_of_a_plain_fit(spark):
    rows = registry._study(spark, "/root/testdata/sf0.01")
    wide, folds = registry._composite(rows, registry.processed(rows))
    plain = wide.toPandas()
    left_out = factors.low_coverage(factors.coverage(factors.to_long(rows)))
    want = plain_folds(plain, [f for f in factors.FACTORS if f == "f0" or f not in left_out], "winner_exact")
    got = {r["t0"]: (r["n_train"], r["n_test"], r["prec_composite"], r["prec_f0"]) for r in folds.collect()}
    assert len(want) > 5 and sorted(got) == sorted(want)
    for t0, row in want.items():
        assert got[t0] == pytest.approx(row), t0
    said = factors.composite_verdict(wide, folds).first()
    assert (said["status"], said["n_folds"]) == ("ok", len(want)) and said["median_lift"] == pytest.approx(np.median([r[2] - r[3] for r in want.values()]))


def test_composite_verdicts(spark):
    """A composite that wins where no factor does alone gives K2; too little to go on is said."""
    rng, rows = np.random.default_rng(8), []
    for t in range(5):
        for i in range(60):
            a, b = rng.standard_normal(2)
            rows.append(("m", "apple", DAY + dt.timedelta(30 * t), i, float(rng.standard_normal()), float(a), float(b), int(a + b > 1.6)))
    df = spark.createDataFrame(rows, "market string, store string, t0 date, app_id long, f0 double, f1 double, f2 double, won int")
    said = factors.composite_verdict(df, factors.forward_chaining(df, ["f0", "f1", "f2"], "won")).first()
    assert said["status"] == "ok" and said["alive"] and said["n_folds"] == 4
    dead = spark.createDataFrame([("f1", False)], "signal_name string, alive boolean")
    assert factors.study_verdict(dead, said["median_lift"]) == "K2" and factors.study_verdict(dead, None) == "K3"
    two = df.where(F.col("t0") < F.lit(DAY + dt.timedelta(40)))
    for part, status in ((df.limit(50), "too few rows"), (two, "too few dates"), (df.withColumn("won", F.lit(1)), "no fold")):
        r = factors.composite_verdict(part, factors.forward_chaining(part, ["f0", "f1"], "won")).first()
        assert (r["status"], r["n_folds"], r["median_lift"], r["alive"]) == (status, 0, None, False)
    gone = df.withColumn("f2", F.lit(None).cast("double"))
    assert factors.forward_chaining(gone, ["f0", "f2"], "won").count() == 0


# keyed tables and line order

SCHEMA = T.StructType().add("day", "date").add("app_id", "long").add("value", "string")


def batch(spark, *rows):
    return spark.createDataFrame([(DAY + dt.timedelta(d), a, v) for d, a, v in rows], SCHEMA)


def test_batches_are_there_as_a_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    table = sinks.KeyedTable(spark, str(tmp_path / "t"), ["day", "app_id"], "day")
    assert table.read(SCHEMA).count() == 0
    assert table.append(batch(spark, (0, 1, "a"), (0, 1, "b"), (1, 2, "c")), 0) == {"read": 3, "written": 2, "batches": 0}
    monkeypatch.setattr(table, "_commit", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        table.append(batch(spark, (1, 2, "late"), (1, 3, "d")), 1)
    monkeypatch.undo()
    assert table.read(SCHEMA).count() == 2  # what the failed batch has left doesn't count
    assert table.append(batch(spark, (1, 2, "late"), (1, 3, "d"), (1, 3, "d")), 1)["written"] == 1
    assert table.append(batch(spark, (1, 2, "late"), (1, 3, "d")), 1) == {"read": 0, "written": 0, "batches": 0}  # repeated
    assert sorted(r["value"] for r in table.read(SCHEMA).collect()) == ["a", "c", "d"]
    assert table.append(batch(spark).limit(0), 2)["written"] == 0 and table.read(SCHEMA).count() == 3


def test_a_batch_reads_only_batches_of_its_days(spark, tmp_path):
    table = sinks.KeyedTable(spark, str(tmp_path / "t"), ["day", "app_id"], "day")
    for k in range(4):
        table.append(batch(spark, (10 * k, 1, "x"), (10 * k + 9, 2, "y")), k)
    assert table.append(batch(spark, (12, 1, "z"), (19, 2, "there")), 9) == {"read": 2, "written": 1, "batches": 1}
    read = table.read(SCHEMA, "2020-01-25", "2020-02-03")
    assert all("batch=000000000002" in f or "batch=000000000003" in f for f in read.inputFiles()) and len({f.split("batch=")[1][:12] for f in read.inputFiles()}) == 2


def test_a_killed_batch_of_the_stream_is_repeated(spark, tmp_path, monkeypatch):
    (tmp_path / "land").mkdir()
    head = "app_id\tmarket\tcategory\tcaptured_at\trank\tsource\tstore\n"
    (tmp_path / "land/a.tsv").write_text(head + "".join(f"{a}\tus\tc\t1700000000\t{r}\ts\tapple\n" for a, r in (("first", 1), ("second", 1), ("b", 2))))
    go = lambda: ingest.ingest_charts(spark, str(tmp_path / "land"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    monkeypatch.setattr(sinks.KeyedTable, "_commit", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(Exception, match="killed"):
        go()
    monkeypatch.undo()
    assert ingest.charts_table(spark, str(tmp_path / "out")).count() == 0
    go()
    (tmp_path / "land/b.tsv").write_text(head + "other\tus\tc\t1700000000\t1\ts\tapple\nnew\tus\tc\t1700086400\t1\ts\tapple\n")
    go()
    assert sorted(r["app_id"] for r in ingest.charts_table(spark, str(tmp_path / "out")).collect()) == ["b", "first", "new"]
    assert [r["app_id"] for r in ingest.charts_table(spark, str(tmp_path / "out"), 1700086400000, 1700086400000).collect()] == ["new"]


def test_first_snapshot_of_a_day_stays(spark, tmp_path):
    schema = "store string, app_id long, market string, ts timestamp, value double, error string"
    at = lambda h, d=1: dt.datetime(2024, 1, d, h)
    runs = [[("apple", 1, "us", at(9), 2.0, None), ("apple", 1, "us", at(8), 1.0, None), ("apple", None, "vn", at(8), None, "404")], [("apple", 1, "us", at(1), 9.0, None), ("apple", 1, "us", at(1, 2), 3.0, None), ("apple", None, "vn", at(9), None, "404"), ("apple", 2, "us", at(3), 4.0, None)]]
    land, table, failed, cp = (str(tmp_path / n) for n in ("land", "t", "f", "cp"))
    for rows in runs:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(land)
        ingest.land_snapshots(spark.readStream.schema(schema).parquet(land), table, failed, cp, ["ts"]).awaitTermination()
    good, bad = ingest.snapshot_tables(spark, table, failed, T.StructType.fromDDL("store string, app_id long, market string, ts timestamp, value double, day date"))
    assert sorted((r["app_id"], str(r["day"]), r["value"]) for r in good.collect()) == [(1, "2024-01-01", 1.0), (1, "2024-01-02", 3.0), (2, "2024-01-01", 4.0)]
    assert [tuple(r)[:2] + (r["error"],) for r in bad.collect()] == [("apple", "vn", "404")]


def test_line_order_of_a_file_that_many_tasks_read(spark, tmp_path):
    lines = [json.dumps({"app_id": str(i % 7), "market": "us", "store": "apple", "device": "d", "t0": "2024-01-01", "raw": {"metadata": {"title": f"line {i}"}}}) for i in range(3000)]
    (tmp_path / "in").mkdir()
    for name, part in (("a", lines[:2000]), ("b", lines[2000:])):
        (tmp_path / f"in/{name}.json").write_text("\n".join(part) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        rows = files.read_metadata_lines(spark, str(tmp_path / "in"))
        assert rows.rdd.getNumPartitions() > 6
        for wins, first in (("first", 0), ("last", 2993)):
            got = {r["metadata"]["title"] for r in files.one_per_key(rows, ["app_id", "store"], wins).collect()}
            assert got == {f"line {first + i}" for i in range(7)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


# prompts, tags, grids


def test_templates_are_compiled(spark):
    row = spark.createDataFrame([(1, None, ["x", "y"], True, 2.0, "a{{b}}" * 3)], "a int, b string, c array<string>, d boolean, e double, f string")
    text = prompts.compiled("{{a}} {{b}}|{{b|none}}|{{c}}|{{d}}|{{e}}|{{f:4}}|{{x}", {**prompts.fields_of(row), "x": F.lit(1)})
    assert row.select(text.alias("t")).first()["t"] == "1 |none|x, y|yes|2|a{{b|{{x}"
    with pytest.raises(ValueError, match="nothing"):
        prompts.compiled("{{nothing}}", {})
    out = prompts.prompt_requests(row, ["a"], "citation", "m", "say {{a}}").first()
    assert (out["prompt"], out["cost"]) == ("say 1", 2.0) and out["request_hash"] == hashlib.sha256(b"citation\nm\nsay 1").hexdigest()
    assert set(prompts.TEMPLATES) == {"localization", "clonability", "mechanic", "thesis", "citation"}


def test_stop_words_count_in_both_forms(spark):
    words = [(k, w) for k, text in fixed.STOP_WORDS.items() for w in text.split() if not w.isascii()]
    rows = [(i, unicodedata.normalize(form, w)) for i, (_, w) in enumerate(words) for form in ("NFC", "NFD")]
    got = {r["i"]: r["n"] for r in spark.createDataFrame(rows, "i int, w string").groupBy("i").agg(F.count_distinct(X.composed(F.col("w"))).alias("n")).collect()}
    assert set(got.values()) == {1} and len(got) == len(words) > 6
    texts = ["się są że", "için çok bir", "für die sie", "este está una"]
    found = [[r["l"] for r in spark.createDataFrame([(i, unicodedata.normalize(form, t)) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(X.detected_language(F.col("t")).alias("l")).collect()] for form in ("NFC", "NFD")]
    assert found[0] == found[1] == ["pl", "tr", "de", "es"]
    odd = spark.createDataFrame([("thé and́ yoú",), ("oʻzbek theʻ andʻ",)], "t string").select(X.detected_language(F.col("t")).alias("l")).collect()
    assert [r["l"] for r in odd] == [None, None]  # with a mark or a letter more they are other words


def test_tags_come_back(spark):
    rows = spark.createDataFrame([("a-b", "apple"), ("us", "googleplay")], "market string, store string")
    tagged = rows.select(records.version_tag(F.col("market"), F.col("store")).alias("tag")).unionByName(spark.createDataFrame([("x",), (None,), ("pathc-v3-us-other-tg",), ("v1.0.0-apptweak-us",)], "tag string"))
    good, counts = records.parsed_rows(tagged, "tag")
    assert sorted((r["market"], r["store"]) for r in good.collect()) == [("a-b", "apple"), ("us", "googleplay")] and tuple(counts.first()) == (6, 2, 4)
    own = ("c.", ":", "!")
    assert tuple(rows.where("market = 'us'").select(records.parsed_tag(records.version_tag(F.col("market"), F.col("store"), of_cell=own), own).alias("t")).first()["t"]) == ("us", "googleplay")


def test_requests_are_reconciled(spark):
    assert records.sampled_dates("2024-01-01", "2024-01-31") == ["2024-01-01", "2024-01-16", "2024-01-31"] and records.sampled_dates("2024-01-01", "2024-01-01") == ["2024-01-01"]
    with pytest.raises(ValueError):
        records.sampled_dates("2024-01-02", "2024-01-01")
    grid = records.request_grid(spark.createDataFrame([(1,), (1,)], "app_id long"), ["us"], "2024-01-01", "2024-01-02", ("ranks",))
    day = lambda d: dt.date(2024, 1, d)
    landed = spark.createDataFrame([("ranks", 1, "us", day(1), "500"), ("ranks", 1, "us", day(1), None), ("ranks", 2, "us", day(1), None)], "endpoint string, app_id long, market string, t date, error string")
    assert sorted((r["app_id"], r["t"].day, r["n"], r["n_errors"], r["status"]) for r in records.reconciled(grid, landed).collect()) == [(1, 1, 2, 1, "ok"), (1, 2, 0, 0, "missing"), (2, 1, 1, 0, "unexpected")]


def test_grid_of_cohorts(spark):
    cells = spark.createDataFrame([("a",), ("b",)], "market string")
    grid = backtest.cohort_grid([(cells, ["2020-01-01", "2020-02-01"]), (cells.where("market = 'a'"), ["2021-01-01"])])
    assert grid.count() == 5
    tiers = spark.createDataFrame([("a", DAY, 1, DAY + dt.timedelta(90), "winner"), ("a", DAY, 2, DAY + dt.timedelta(89), "winner")], "market string, t0 date, app_id long, measured_at date, tier string")
    ranked = spark.createDataFrame([("a", DAY, a) for a in (1, 2)], "market string, t0 date, app_id long")
    got = {r["app_id"]: (r["tier"], r["is_winner"]) for r in backtest.with_tiers(ranked, tiers, ["market", "t0", "app_id"], 90).collect()}
    assert got == {1: ("winner", True), 2: (None, False)}


def test_documents_of_a_backtest(spark):
    p = spark.createDataFrame([("c", "f1", 5, 0.4), ("c", "f0", 5, 0.2), ("d", "f0", 5, 0.0)], "cohort string, ranker string, k int, precision double")
    picks = spark.createDataFrame([("c", "f0", 2, 8), ("c", "f0", 1, 9)], "cohort string, ranker string, pos long, app_id long")
    r = {x["cohort"]: x for x in reports.backtest_documents(p, picks, ["cohort"]).collect()}
    assert json.loads(r["c"]["json"]) == {"cohort": "c", "precision": [{"ranker": "f0", "k": 5, "precision": 0.2}, {"ranker": "f1", "k": 5, "precision": 0.4}], "picks": [{"ranker": "f0", "app_ids": [9, 8]}]}
    assert "| f1 | 5 | 0.40 |" in r["c"]["text"] and r["c"]["text"].endswith("| f0 | 9, 8 |") and json.loads(r["d"]["json"])["picks"] == []
    got = {x["ranker"]: (x["n_cohorts"], x["mean"], x["lift"]) for x in reports.aggregate_precision(p, "f0").collect()}
    assert got == {"f0": (2, 0.1, 1.0), "f1": (1, 0.4, 4.0)}


def test_judging_goes_on_after_a_restart(spark, tmp_path):
    """Budget and standing outlive the query; an answer lands once, an invalid one or one nobody asked for is refused."""
    from chartwright.streaming import judging

    ask = lambda run, n, cost=1.0, meta=True: (run, "request", f"k{n}", n, cost, meta, None, None, None)
    say = lambda run, n, score, why="because": (run, "answer", f"k{n}", None, None, None, score, why, 0.5)
    land, out, cp = (str(tmp_path / n) for n in ("land", "out", "cp"))
    runs = [
        [ask("a", 2), ask("a", 1), ask("a", 3, meta=False), ask("b", 1, 5.0), ask("b", 2)],
        [ask("a", 1), ask("a", 4), ask("a", 5), say("a", 1, 7.0), say("a", 1, 7.0), say("a", 2, 11.0), say("a", 9, 1.0), say("b", 1, 3.0, ""), say("a", 3, 2.0)],
        [say("a", 1, 1.0), say("a", 2, 6.0), ask("b", 3)],
    ]
    for rows in runs:
        spark.createDataFrame(rows, judging.EVENT).write.mode("append").parquet(land)
        judging.run_judging(spark.readStream.schema(judging.EVENT).parquet(land), 3.0, out, cp)
    got = sorted(((r["run_id"], r["key"], r["outcome"], r["score"]) for r in spark.read.parquet(out).collect()), key=str)
    assert len(got) == 13 and sorted(g[:2] for g in got if g[2] == "refused") == [("a", "k2"), ("a", "k9"), ("b", "k1")] and [g for g in got if g[2] == "answer"] == [("a", "k1", "answer", 7.0), ("a", "k2", "answer", 6.0)]
    assert [g[1] for g in got if g[:3:2] == ("a", "ask")] == ["k1", "k2", "k4"] and [g[:2] for g in got if g[2] == "over"] == [("a", "k5"), ("b", "k2"), ("b", "k3")]


def test_latest_values_on_many_dates(spark):
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(4)), str(rng.choice(["x", "y"])), DAY + dt.timedelta(int(rng.integers(60))), i, None if rng.random() < 0.3 else float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "app_id long, signal_name string, day date, event_id long, value double")
    asked = [(a, DAY + dt.timedelta(d)) for a in (0, 1, 9) for d in (-1, 0, 17, 59, 400)]
    cohort = spark.createDataFrame(asked, "app_id long, t0 date")
    for policy in ("skip", "keep", "missing"):
        want = set()
        for a, t0 in asked:
            for name in ("x", "y"):
                mine = [r for r in rows if r[0] == a and r[1] == name and r[2] <= t0 and (policy != "skip" or r[4] is not None)]
                if mine:
                    last = max(mine, key=lambda r: (r[2], r[3]))
                    if policy != "missing" or last[4] is not None:
                        want.add((a, t0, name, last[4], last[2]))
        assert {tuple(r) for r in backtest.as_of(cohort, df, policy).collect()} == want, policy
        limit, backtest.MOST_DATES = backtest.MOST_DATES, 2
        try:
            assert {tuple(r) for r in backtest.as_of(cohort, df, policy).collect()} == want, policy
        finally:
            backtest.MOST_DATES = limit
    assert backtest.as_of(cohort.limit(0), df).count() == 0


def test_csv_keeps_blanks_at_the_ends(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([(" a, b ", "x")], "p string, q string").coalesce(1), str(tmp_path / "c"))
    assert spark.read.options(header=True, quote='"', escape='"').csv(str(tmp_path / "c")).first()["p"] == " a, b "
