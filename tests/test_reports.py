"""Report tables and ROI: golden arithmetic and hand-made cases."""

import pytest

from alertsieve.operators import reports as R
from alertsieve.operators.roi import roi, roi_breakdown


def _labelled(spark, rows):
    return spark.createDataFrame(
        rows, "problemId string, title string, severityLevel string, impactLevel string, hour int, "
              "duration_minutes double, classification_confidence double, is_false_positive int, "
              "fp_score_final double, is_reconciliacion int, is_weekend int, fp_keyword_score int, "
              "is_quincena int, startTime timestamp")


def test_roi_golden(spark):
    df = spark.range(120_000).selectExpr("CAST(id < 30000 AS INT) AS is_false_positive")
    r = roi(df).first()
    assert r["monthly_benefits"] == pytest.approx(547_500)
    assert r["monthly_costs"] == 1800
    assert r["monthly_net_benefit"] == pytest.approx(545_700)
    assert r["annual_net_benefit"] == pytest.approx(6_548_400)
    assert r["roi_percentage"] == pytest.approx(30_316.6667, abs=1e-3)
    assert r["payback_months"] == pytest.approx(0.0033, abs=1e-4)
    assert r["fp_ratio"] == pytest.approx(0.25)
    assert roi_breakdown(df).count() == 7


def test_pattern_analysis_mode_and_single_row(spark):
    rows = [("a", "t1", "ERROR", "X", 3, 1.0, 0.9, 1, 0.5, 0, 0, 0, 0, None),
            ("b", "t1", "ERROR", "X", 1, 2.0, 0.8, 1, 0.5, 0, 0, 0, 0, None),
            ("c", "t2", "ERROR", "X", 5, 1.0, 0.7, 1, 0.5, 0, 0, 0, 0, None),
            ("d", None, "ERROR", "X", 5, 1.0, 0.7, 1, 0.5, 0, 0, 0, 0, None),
            ("e", "t3", "ERROR", "X", 5, 1.0, 0.7, 0, 0.1, 0, 0, 0, 0, None)]
    out = {r["alert_title"]: r for r in R.pattern_analysis(_labelled(spark, rows)).collect()}
    assert set(out) == {"t1", "t2"}
    assert out["t1"]["most_common_hour"] == 1 and out["t1"]["frequency"] == 2
    assert out["t2"]["std_duration"] is None


def test_severity_distribution_lists_zero_levels(spark):
    rows = [("a", "t", "ERROR", "X", 1, 1.0, 0.9, 1, 0.5, 0, 0, 0, 0, None),
            ("b", "t", "PERFORMANCE", "X", 1, 1.0, 0.9, 0, 0.1, 0, 0, 0, 0, None)]
    out = {r["severityLevel"]: r["count"] for r in R.severity_distribution(_labelled(spark, rows)).collect()}
    assert out == {"ERROR": 1, "PERFORMANCE": 0}


def test_top_fp_layout(spark):
    rows = [("P-123456789012345678", "x" * 100, "RESOURCE_CONTENTION", "X", 1, 1.0, 0.95, 1, 0.5, 0, 0, 0, 0, None),
            ("b", None, None, "X", None, 1.0, 0.5, 1, 0.5, 0, 0, 0, 0, None)]
    out = R.top_fp(_labelled(spark, rows)).collect()
    assert out[0]["problem_id"] == "P-1234567890123" and len(out[0]["title"]) == 80
    assert out[0]["severity_class"] == "warning" and out[0]["high_confidence"]
    assert out[1]["title"] == "N/A" and out[1]["severity"] == "N/A" and not out[1]["high_confidence"]


def test_fp_pattern_flags(spark):
    rows = [("a", "t", "ERROR", "X", 1, 1.0, 0.9, 1, 0.5, 1, 1, 3, 1, None)]
    out = {r["pattern"]: r["found"] for r in R.fp_pattern_flags(_labelled(spark, rows)).collect()}
    assert all(out.values()) and len(out) == 5
