"""The factor study against plain numpy, and operators of this round on literal cases."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chartwright.functions import exprs as X
from chartwright.operators import backtest, factors, records, shortlist
from chartwright.plans import registry
from chartwright.sources import files, sinks

DATA = "/root/testdata/sf0.001"


def plain_chain(cell):
    """Winsorized, standardized, residualized factors of one cell's frame."""
    z = pd.DataFrame(index=cell.index)
    for f in factors.FACTORS:
        v = cell[f].astype(float)
        there = v.dropna()
        if len(there):
            v = v.clip(np.quantile(there, 0.01), np.quantile(there, 0.99))
        sd = v.std(ddof=1)
        z[f] = v if len(there) < 2 else (v * 0).fillna(0.0) if not sd >= 1e-12 else (v - v.mean()) / sd
    out = z.copy()
    for i, f in enumerate(factors.FACTORS):
        rows = z[f].notna()
        prior = [p for p in factors.FACTORS[:i] if out.loc[rows, p].notna().all()]
        if i and rows.sum() >= 3 and prior:
            x = np.column_stack([np.ones(rows.sum()), out.loc[rows, prior].to_numpy(float)])
            y = z.loc[rows, f].to_numpy(float)
            out.loc[rows, f] = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    return out


def test_chain_of_the_study_is_that_of_numpy(spark):
    rows = registry._study(spark, DATA)
    plain = rows.toPandas().sort_values([*factors.CELL, "app_id"]).reset_index(drop=True)
    got = registry.processed(rows).toPandas().sort_values([*factors.CELL, "app_id"]).reset_index(drop=True)
    want = pd.concat([plain_chain(cell) for _, cell in plain.groupby(factors.CELL)]).sort_index()
    assert len(got) == len(want)
    for f in factors.FACTORS:
        assert np.allclose(got[f].astype(float), want[f].astype(float), atol=1e-6, equal_nan=True), f


def test_lifts_and_bootstrap(spark):
    rng = np.random.default_rng(3)
    rows = [(m, "apple", dt.date(2020, 1, 1 + t), i, int(rng.integers(1, 50)), float(rng.random()), int(rng.random() < 0.4)) for m in ("a", "b", "c", "d") for t in range(2) for i in range(15)]
    df = spark.createDataFrame(rows, "market string, store string, t0 date, app_id long, f0 long, f1 double, winner_exact int").withColumn("winner_window", F.lit(1) - F.col("winner_exact"))
    long = factors.to_long(df, ("f0", "f1"))
    got = {(r["cohort"], r["signal_name"]): r for r in registry.lifts_of(long, df.select(*registry.KEYS, "winner_exact", "winner_window")).collect()}
    p = pd.DataFrame(rows, columns=["market", "store", "t0", "app_id", "f0", "f1", "winner_exact"])
    p["winner_window"] = 1 - p["winner_exact"]
    for label in ("winner_exact", "winner_window"):
        up = np.cov(p["f1"], p[label])[0, 1] < 0
        for (m, s, t0), cell in p.groupby(["market", "store", "t0"]):
            k = max(1, int(np.ceil(0.1 * len(cell))))
            base = cell.sort_values(["f0", "app_id"])[label].head(k).mean()
            own = cell.assign(v=cell["f1"] if up else -cell["f1"]).sort_values(["v", "app_id"])[label].head(k).mean()
            r = got[f"{m}/{s}/{t0}/{label}", "f1"]
            assert (r["precision"], r["base"], r["lift"]) == pytest.approx((own, base, own - base), abs=1e-5)
    lifts = spark.createDataFrame([("f1", str(i), float(x)) for i, x in enumerate(rng.random(7) - 0.3)], "signal_name string, cohort string, lift double")
    values = [r["lift"] for r in lifts.orderBy("cohort").collect()]
    draws = [np.median([values[((rep * 1000003 + d * 7919 + 42 * 104729) * 2654435761 % 4294967296) // 256 % 7] for d in range(7)]) for rep in range(50)]
    boot = factors.cluster_bootstrap(lifts, reps=50).first()
    assert (boot["low"], boot["high"]) == pytest.approx(tuple(np.percentile(draws, [2.5, 97.5])))
    assert factors.study_verdict(factors.verdicts(factors.cluster_bootstrap(lifts)).withColumn("alive", F.lit(True)), None) == "K1"


def test_forward_chaining_is_a_penalised_logistic_fit(spark):
    rng = np.random.default_rng(5)
    rows = []
    for t in range(3):
        for m in ("a", "b"):
            for i in range(20):
                x = rng.standard_normal()
                rows.append((m, "apple", dt.date(2020, 1 + t, 1), i, float(rng.integers(1, 40)), None if rng.random() < 0.1 else float(x), int(x + rng.standard_normal() > 0.5)))
    df = spark.createDataFrame(rows, "market string, store string, t0 date, app_id long, f0 double, f1 double, won int")
    got = {r["t0"]: r for r in factors.forward_chaining(df, ["f0", "f1"], "won").collect()}
    p = pd.DataFrame(rows, columns=["market", "store", "t0", "app_id", "f0", "f1", "won"])
    dates = sorted(p["t0"].unique())
    assert sorted(got) == dates[1:]
    for t0 in dates[1:]:
        train, test = p[p["t0"] < t0], p[p["t0"] == t0]
        design = lambda q: np.column_stack([np.ones(len(q)), q["f0"], q["f1"].fillna(train["f1"].median()), q["market"] == "b"]).astype(float)  # noqa: E731, B023
        x, y, w = design(train), train["won"].to_numpy(float), np.zeros(4)
        for _ in range(50):  # Newton's steps for 0.5 |w|^2 + the sum of losses
            mu = 1 / (1 + np.exp(-x @ w))
            w -= np.linalg.solve(x.T @ (x * (mu * (1 - mu))[:, None]) + np.eye(4), x.T @ (mu - y) + w)
        test = test.assign(p=design(test) @ w)
        top = [c.sort_values(["p", "app_id"], ascending=[False, True])["won"].head(2).mean() for _, c in test.groupby("market")]
        first = [c.sort_values(["f0", "app_id"])["won"].head(2).mean() for _, c in test.groupby("market")]
        r = got[t0]
        assert (r["n_train"], r["n_test"]) == (len(train), len(test))
        assert (r["prec_composite"], r["prec_f0"]) == pytest.approx((np.mean(top), np.mean(first)))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scores_of_odd_values(spark):
    nan = F.lit(float("nan"))
    assert [one(spark, X.revenue_proxy(a, F.lit(10), F.lit(1.0))) for a in (nan, F.lit(None).cast("double"), F.lit(-1.0), F.lit(float("inf")))] == [0.0] * 4
    assert one(spark, X.paywall_score(F.lit("Billed monthly or annual. Elite and Platinum plans, pay once forever"), F.lit(True))) == 8.0
    assert one(spark, X.paywall_score(F.lit(None).cast("string"), F.lit(False))) == 0.0 and one(spark, X.ratio_score(F.lit(None).cast("double"))) is None
    assert one(spark, X.detected_language(F.lit("çok için bir"))) == "tr" and one(spark, X.detected_language(F.lit("we by if é o os"))) is None
    assert one(spark, X.market_weight(F.lit("US"))) == 5.5 and one(spark, X.market_weight(F.lit("zz"), "ads")) == 0.3


def test_risk_rules(spark):
    rows = [("a", ["us", "zz"], 200, False, "Puzzle"), ("b", ["US", "id", "vn"], 180, False, "Puzzle"), ("c", ["id", "vn", "zz"], 200, True, "Idle"), ("d", [], 200, True, None), ("e", ["id", "vn", "th"], 179, True, "Strategy")]
    df = spark.createDataFrame(rows, "app_id string, markets array<string>, tenure_max long, has_subscription boolean, dna_class string")
    got = {r["app_id"]: (r["overall"], {c["name"]: c["status"] for c in r["checks"]}) for r in shortlist.evaluate_shortlist(df).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": "FAIL", "b": "PASS", "c": "WARN", "d": "FAIL", "e": "FAIL"}
    assert got["a"][1]["markets_spread"] == "FAIL" and got["b"][1]["subscription_iap"] == "INFO" and got["d"][1]["supported_markets"] == "FAIL" and got["e"][1]["clonable_dna"] == "FAIL"
    strict = shortlist.RiskThresholds(needs_subscription=True)
    assert shortlist.evaluate_shortlist(df.where("app_id = 'b'"), strict).first()["overall"] == "FAIL"
    with pytest.raises(ValueError):
        shortlist.RiskThresholds(least_markets=0)


def test_shortlist_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"app_id": "x", "store": "apple", "markets_active": ["us"], "tenure_days_max": 1.0, "has_subscription_iap": true}]')
    assert files.read_shortlist(spark, str(tmp_path / "a.json")).first()["markets"] == ["us"]
    for name, text in (("b", '{"other": []}'), ("c", '{"candidates": [{"app_id": "x"}]}')):
        (tmp_path / f"{name}.json").write_text(text)
        with pytest.raises(ValueError):
            files.read_shortlist(spark, str(tmp_path / f"{name}.json"))
    (tmp_path / "t.json").write_text('{"least_tenure": 10}')
    assert files.read_thresholds(spark, str(tmp_path / "t.json")).least_tenure == 10
    (tmp_path / "u.json").write_text('{"least_tenure": 1000}')
    with pytest.raises(ValueError):
        files.read_thresholds(spark, str(tmp_path / "u.json"))


def test_csv_is_quoted(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([('a "b", c', None, "x\ny")], "p string, q string, r string").coalesce(1), str(tmp_path / "c"))
    back = spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(str(tmp_path / "c")).first()
    assert (back["p"], back["r"]) == ('a "b", c', "x\ny") and not back["q"]


def test_freeze_names_what_it_lacks(spark):
    day = dt.date(2020, 1, 1)
    charts = spark.createDataFrame([("m", 1, day)], "market string, app_id long, day date")
    asked = spark.createDataFrame([("m", day, 1), ("m", day, 2)], "market string, t0 date, app_id long")
    assert backtest.freeze(asked.where("app_id = 1"), charts).first()["app_ids"] == [1]
    with pytest.raises(ValueError, match="2"):
        backtest.freeze(asked, charts)
    with pytest.raises(ValueError):
        backtest.simple_winner_scores(spark.createDataFrame([(1, day, dt.date(2019, 1, 1))], "app_id long, t0 date, t_measure date"), charts.withColumn("rank", F.lit(1)))


def test_records_of_odd_payloads(spark):
    rows = spark.createDataFrame([(1, '[{"appId": "a", "developer": {"devName": "D"}, "price": 2.0, "currency": "EUR"}, {"appId": "b"}]'), (2, "[]"), (3, None), (4, "{broken")], "page long, body string")
    got = [(r["app_id"], r["rank"], r["name"], r["developer"], r["price_usd"], r["iap_present"]) for r in records.store_records(rows).orderBy("rank").collect() if r["app_id"]]
    assert got == [("a", 1, "a", "D", 0.0, False), ("b", 2, "b", "", 0.0, False)]
