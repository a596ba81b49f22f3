"""Report operators on literal cases."""

import pytest
from pyspark.sql import functions as F

from chartwright.operators import reports


def test_ranking_breaks_ties_and_puts_missing_last(spark):
    rows = spark.createDataFrame([("a", 5.0, 0.5, 10), ("b", 5.0, 0.5, None), ("c", 5.0, 0.9, None), ("d", None, 1.0, 99), ("e", 5.0, 0.5, 10)], "app string, composite double, confidence double, ratings_count int")
    assert [r["app"] for r in reports.ranked(rows, 5, ["app"]).orderBy("position").collect()] == ["c", "a", "e", "b", "d"]
    assert reports.ranked(rows, 2, ["app"]).count() == 2


def test_citations_need_band_address_and_quote(spark):
    quote = "x" * 20
    rows = spark.createDataFrame([(1, "High ", "https://a.b/c", quote), (2, "high", "a.b", quote), (3, "mid", "http://a", "short"), (4, "odd", "http://a", quote), (5, None, None, None)], "i int, band string, url string, quote string")
    assert {r["i"]: r["value"] for r in reports.cited_scores(rows).collect()} == {1: 8.0, 2: None, 3: None, 4: None, 5: None}


def test_language_quality_needs_arrays_of_one_length(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], ["x", "y"], ["a", "b"], [8, 9]), (2, ["a"], ["x", "y"], ["a"], [9]), (3, [], [], [], []), (4, None, None, None, None)], "i int, phrases array<string>, translations array<string>, back_translations array<string>, scores array<int>")
    got = {r["i"]: (r["mean_score"], r["passes"]) for r in reports.language_quality(rows).collect()}
    assert got == {1: (8.5, True), 2: (None, False), 3: (None, False), 4: (None, False)}


def test_drift_within_tolerance(spark):
    schema = "case_id string, score double, passes boolean"
    now = spark.createDataFrame([("a", 8.0, True), ("b", 6.0, True), ("c", 8.0, False), ("new", 1.0, False), ("gone", None, True)], schema)
    then = spark.createDataFrame([("a", 7.0, True), ("b", 8.0, True), ("c", 8.0, True), ("gone", 5.0, True)], schema)
    got = {r["case_id"]: r["status"] for r in reports.drift(now, then, ["case_id"]).collect()}
    assert got == {"a": "PASS", "b": "FAIL", "c": "FAIL", "new": "PASS", "gone": "FAIL"}
    with pytest.raises(ValueError, match="tolerance"):
        reports.drift(now, then, ["case_id"], 0)


def test_audit_report_of_no_checks(spark):
    empty = spark.createDataFrame([], "check_name string, status string, detail string")
    row = reports.audit_report(empty).select("overall", "n_checks", F.length("report").alias("n")).first()
    assert (row["overall"], row["n_checks"], row["n"]) == (None, 0, 0)
