"""Boundary rows for the feature projections (FIXTURES.md section 3)."""

import math

import pytest
from pyspark.sql import Row

from alertsieve.operators.features import engineer_features
from alertsieve.sources.alerts import normalize_timestamps
from conftest import epoch_ms

RAW_SCHEMA = ("problemId string, title string, severityLevel string, impactLevel string, "
              "startTime long, endTime long")


def _raw(spark, rows):
    return normalize_timestamps(spark.createDataFrame(rows, RAW_SCHEMA))


@pytest.fixture(scope="module")
def feats(spark):
    t = epoch_ms("2025-05-14 03:00:00")
    rows = [
        ("zero", "a", "ERROR", "X", t, t),
        ("half", "a", "ERROR", "X", t, t + 30_000),
        ("two", "a", "ERROR", "X", t, t + 120_000),
        ("neg", "a", "ERROR", "X", t, t - 60_000),
        ("day", "a", "ERROR", "X", t, t + 25 * 3600 * 1000),
        ("open", "a", "ERROR", "X", t, None),
        ("nostart", None, "ERROR", "X", None, t),
        ("mixed", "  Network TIMEOUT ", "ERROR", "X", t, t + 1000),
        ("all", "network timeout synthetic availability", "ERROR", "X", t, t + 1000),
        ("accent", "Red caída", "ERROR", "X", t, t + 1000),
        ("six", "a", "ERROR", "X", epoch_ms("2025-05-14 06:30:00"), epoch_ms("2025-05-14 06:31:00")),
        ("h14", "a", "ERROR", "X", epoch_ms("2025-05-14 14:10:00"), epoch_ms("2025-05-14 15:10:00")),
        ("h17", "a", "ERROR", "X", epoch_ms("2025-05-14 17:10:00"), epoch_ms("2025-05-14 18:10:00")),
        ("d31", "a", "ERROR", "X", epoch_ms("2025-05-31 10:00:00"), epoch_ms("2025-05-31 10:10:00")),
        ("iso", "a", "ERROR", "X", epoch_ms("2024-12-30 10:00:00"), epoch_ms("2024-12-30 10:10:00")),
    ]
    df, stats = engineer_features(_raw(spark, rows))
    return {r["problemId"]: r for r in df.collect()}, stats


def test_duration_boundaries(feats):
    f, _ = feats
    assert f["zero"]["duration_minutes"] == 0 and f["zero"]["duration_category"] is None
    assert f["half"]["duration_category"] == "ultra_short"
    assert f["two"]["duration_category"] == "short" and f["two"]["short_night_alert"] == 0
    assert f["neg"]["duration_seconds"] == -60 and f["neg"]["duration_minutes"] == 0
    assert f["day"]["duration_seconds"] == 90000 and f["day"]["duration_minutes"] == 1440
    assert f["day"]["duration_category"] == "very_long"
    assert f["open"]["duration_seconds"] is None and f["open"]["duration_minutes"] == 5
    assert f["open"]["duration_category"] == "short"


def test_missing_start(feats):
    f, _ = feats
    r = f["nostart"]
    assert r["hour"] is None and r["hour_sin"] is None and r["hour_frequency"] is None
    for flag in ("is_weekend", "is_month_start", "is_month_end", "is_quincena", "is_reconciliacion",
                 "is_backup", "is_business_hours", "short_night_alert"):
        assert r[flag] == 0, flag
    assert r["duration_minutes"] == 5
    assert r["title_length"] == 0 and r["title_word_count"] == 0 and r["fp_keyword_score"] == 0


def test_text(feats):
    f, _ = feats
    m = f["mixed"]
    assert m["title_clean"] == "network timeout" and m["title_length"] == 15
    assert m["title_word_count"] == 2 and m["fp_keyword_score"] == 2
    assert f["all"]["fp_keyword_score"] == 4
    assert f["accent"]["title_length"] == 9


def test_calendar(feats):
    f, _ = feats
    assert f["six"]["short_night_alert"] == 1 and f["six"]["is_reconciliacion"] == 0
    assert f["h14"]["is_almuerzo"] == 1 and f["h17"]["is_business_hours"] == 1
    d = f["d31"]
    assert (d["is_quincena"], d["is_fin_mes"], d["is_month_end"], d["is_weekend"], d["day_of_week"]) == (1, 1, 1, 1, 5)
    assert f["iso"]["week_of_year"] == 1 and f["iso"]["year"] == 2024
    assert math.isclose(f["zero"]["temporal_criticality"], 0.3 + 0.4 + 0.3)


def test_frequency_ratio_counts_null_hours(feats):
    f, stats = feats
    assert stats.n_rows == 15
    r = f["zero"]
    assert r["hour_frequency"] == stats.hour_counts[3]
    assert math.isclose(r["hour_frequency_ratio"], stats.hour_counts[3] / 15)


def test_text_timestamps_and_junk(spark):
    df = spark.createDataFrame([Row(problemId="a", startTime="2025-05-14 03:00:00", endTime="junk"),
                                Row(problemId="b", startTime="1747191600000", endTime=None)])
    out = {r["problemId"]: r for r in normalize_timestamps(df).collect()}
    assert out["a"]["endTime"] is None
    assert out["a"]["startTime"] == out["b"]["startTime"]


def test_read_alerts_csv_hand_made(spark, tmp_path):
    from alertsieve.sources.alerts import read_alerts_csv

    csv = tmp_path / "alerts.csv"
    csv.write_text(
        'problemId,displayId,title,severityLevel,impactLevel,startTime,endTime\n'
        'P1,D1,"Network, timeout",ERROR,APPLICATION,1747191600000,1747191630000\n'
        'P2,D2,"two\nlines",NA,None,2025-05-14 03:00:00,2025-05-14 03:05:00\n'
        'P3,D3,,none,SERVICES,junk,\n',
        encoding="utf-8")
    rows = {r["problemId"]: r for r in read_alerts_csv(spark, str(csv), multi_line=True).collect()}
    assert rows["P1"]["title"] == "Network, timeout"
    assert rows["P2"]["title"] == "two\nlines"
    # pandas default null tokens ('NA', 'None', '') -> null; 'none' is kept
    assert rows["P2"]["severityLevel"] is None and rows["P2"]["impactLevel"] is None
    assert rows["P3"]["title"] is None and rows["P3"]["severityLevel"] == "none"
    # epoch ms and text parse to the same instant; junk and empty -> null
    assert rows["P1"]["startTime"] == rows["P2"]["startTime"]
    assert rows["P3"]["startTime"] is None and rows["P3"]["endTime"] is None
    assert rows["P1"]["status"] is None and "duration_minutes" not in rows["P1"].asDict()
    import pytest as _pt

    with _pt.raises(FileNotFoundError):
        read_alerts_csv(spark, str(tmp_path / "missing.csv"))
