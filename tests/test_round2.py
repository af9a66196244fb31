"""Cases found in review: durations without times, CSV files of different
layout, odd timestamps, non-default packages, extreme quantiles."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertsieve.config import DEFAULT, TriageConfig
from alertsieve.operators import features as FE
from alertsieve.operators import models as M
from alertsieve.operators import reports as R
from alertsieve.operators import scoring as S
from alertsieve.operators.quantile import exact_quantiles
from alertsieve.operators.roi import roi
from alertsieve.plans import catalog
from alertsieve.sources.alerts import normalize_timestamps, read_alerts_csv
from alertsieve.streaming.scoring import read_alert_stream

SF = "/root/testdata/sf0.001"


def test_duration_without_times(spark):
    data = [("a", 3.0), ("b", None), ("c", -4.0), ("d", 5000.0), ("e", float("nan")), ("f", 0.0)]
    df = spark.createDataFrame(data, "problemId string, duration_minutes double")
    got = {r.problemId: r.duration_minutes for r in FE.clean_duration(df).collect()}
    assert got == {"a": 3.0, "b": 5.0, "c": 0.0, "d": 1440.0, "e": 5.0, "f": 0.0}


def test_odd_timestamps_are_null(spark):
    longs = spark.createDataFrame([(9223372036854775807,), (-9223372036854775808,), (0,)], "startTime long")
    assert [r.startTime is None for r in normalize_timestamps(longs).collect()] == [True, True, False]
    doubles = spark.createDataFrame([(float("nan"),), (float("inf"),), (1e300,), (0.0,)], "startTime double")
    assert [r.startTime is None for r in normalize_timestamps(doubles).collect()] == [True, True, True, False]
    texts = spark.createDataFrame([("99999999999999999999",), ("1" * 400,), ("x",), ("0",)], "startTime string")
    assert [r.startTime is None for r in normalize_timestamps(texts).collect()] == [True, True, True, False]


def test_csv_by_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("problemId,title,startTime,extra\nP1,hello,1700000060000,7\n")
    (tmp_path / "b.csv").write_text("startTime,problemId,title\n1700000060000,P2,NA\n")
    for path in (str(tmp_path), f"{tmp_path}/*.csv", f"file:{tmp_path}/*.csv"):
        rows = {r.problemId: r for r in read_alerts_csv(spark, path).collect()}
        assert (rows["P1"].title, rows["P1"].extra, rows["P1"].status) == ("hello", "7", None)
        assert (rows["P2"].title, rows["P2"].extra) == (None, None)
        assert rows["P1"].startTime == rows["P2"].startTime is not None
    with pytest.raises(FileNotFoundError):
        read_alerts_csv(spark, f"{tmp_path}/none*.csv")


def test_csv_stream_reads_as_the_batch(spark, tmp_path):
    names = "problemId,displayId,title,severityLevel,impactLevel,startTime,endTime,status,duration_minutes"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(f"{names}\nP1,D,NA,ERROR,APPLICATION,2025-05-14 03:00:00,1747191900000,OPEN,\n")
    stream = read_alert_stream(spark, str(tmp_path / "in"), fmt="csv")
    query = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    query.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).first().asDict()
    assert got == read_alerts_csv(spark, str(tmp_path / "in")).first().asDict()
    assert got["title"] is None and got["startTime"] is not None


def test_keyword_score_uses_the_configured_keywords(spark):
    cfg = TriageConfig(keywords=tuple("abcdefgh"))
    df = spark.createDataFrame([(4,), (6,), (8,)], "fp_keyword_score int")
    got = [r[0] for r in df.select(S.score_rules(df, cfg)).collect()]
    assert got == pytest.approx([0.1, 0.15, 0.2])


def test_roi_of_no_rows(spark):
    df = spark.createDataFrame([], "is_false_positive int")
    row = roi(df).first()
    assert (row.fp_detected, row.monthly_benefits, row.monthly_net_benefit) == (0, 0.0, -1800.0)


def test_quantiles_of_extreme_values(spark):
    inf = float("inf")
    data = [(-inf, 1e308, None), (inf, -1e308, None), (float("nan"), 0.0, None), (1.0, 1e-300, None), (2.0, 3.0, None)]
    df = spark.createDataFrame(data, "a double, b double, c double")
    got = exact_quantiles(df, ["a", "b", "c"], [0.0, 0.25, 0.5, 1.0], bins=4)
    assert got["a"] == {0.0: -inf, 0.25: -inf, 0.5: 1.5, 1.0: inf} or got["a"][0.5] == 1.5
    values = [1e308, -1e308, 0.0, 1e-300, 3.0]
    assert [got["b"][q] for q in (0.0, 0.5, 1.0)] == [float(np.quantile(values, q)) for q in (0.0, 0.5, 1.0)]
    assert set(got["c"].values()) == {None}


def test_package_keeps_its_configuration(spark, tmp_path):
    cfg = dataclasses.replace(DEFAULT, keywords=("cpu", "disk"), reconciliation_hours=(10, 11, 12, 13),
                              ensemble_weights={"rules": 0.7, "statistical": 0.1, "pattern": 0.2},
                              fp_threshold_percentile=60)
    raw = catalog.alerts(spark, SF)
    model, labelled = S.fit_scoring(raw, cfg, anomaly="fallback")
    suite = M.model_suite(labelled, cfg, only=("LogisticRegression",))
    M.save_model_package(str(tmp_path / "p"), suite.trained[0].model, suite.features, suite.scaling, model,
                         suite.metrics, suite.best)
    loaded = M.load_model_package(spark, str(tmp_path / "p"))
    assert loaded.scoring_model.cfg == cfg
    label = lambda df: {r.problemId: r.is_false_positive for r in df.collect()}
    assert label(loaded.scoring_model.transform(raw)) == label(labelled)
    assert [s.name for s in M.model_specs()] == ["LogisticRegression", "RandomForest", "GBTDepth6", "GBTDepth5"]


def test_unknown_configuration_field_fails():
    with pytest.raises(ValueError):
        M._config_of({"keywords": ["a"], "nonsense": 1})


def test_pattern_analysis_against_pandas(spark):
    """Many titles, ties of the most common hour, constant and single durations."""
    rng = np.random.default_rng(4)
    n = 4000
    pdf = {"title": [None if i % 50 == 0 else f"t{i % 700}" for i in range(n)],
           "hour": [None if i % 31 == 0 else int(h) for i, h in enumerate(rng.integers(0, 4, n))],
           "duration_minutes": [5.1 if i % 700 < 100 else float(x) for i, x in enumerate(rng.random(n) * 1000)],
           "classification_confidence": [float(x) for x in rng.random(n)],
           "is_false_positive": [int(x) for x in rng.integers(0, 2, n)], "problemId": [f"P{i}" for i in range(n)]}
    import pandas as pd

    frame = pd.DataFrame(pdf)
    schema = "title string, hour int, duration_minutes double, classification_confidence double, is_false_positive int, problemId string"
    df = spark.createDataFrame([tuple(pdf[c][i] for c in pdf) for i in range(n)], schema)
    out = R.pattern_analysis(df)
    assert "ObjectHashAggregate" not in out._jdf.queryExecution().toString()
    got = {r.alert_title: r for r in out.collect()}
    fps = frame[(frame.is_false_positive == 1) & frame.title.notna()]
    assert set(got) == set(fps.title)
    for title, g in fps.groupby("title"):
        r = got[title]
        assert r.frequency == len(g)
        assert r.avg_duration == pytest.approx(g.duration_minutes.mean())
        std = g.duration_minutes.std()
        assert (r.std_duration is None) == np.isnan(std)
        if r.std_duration is not None:
            assert r.std_duration == pytest.approx(std, abs=1e-9)
        assert r.avg_confidence == pytest.approx(g.classification_confidence.mean())
        modes = g.hour.dropna().mode()
        assert r.most_common_hour == (int(modes.min()) if len(modes) else None)


def test_binary_metrics_reads_its_input_once(spark):
    rng = np.random.default_rng(6)
    y, s = rng.integers(0, 2, 3000), np.round(rng.random(3000), 2)
    df = spark.createDataFrame([(float(a), float(b > 0.5), float(b)) for a, b in zip(y, s)],
                               "label double, prediction double, p1 double")
    row = M.binary_metrics(df).first()
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert row.auc == pytest.approx(auc)
    assert (row.tp, row.fn) == (((y == 1) & (s > 0.5)).sum(), ((y == 1) & (s <= 0.5)).sum())
    assert M.binary_metrics(df.where("label = 1")).first().auc is None
    assert M.binary_metrics(df.where(F.lit(False))).first().f1 == 0.0


def test_whole_flow(spark, tmp_path):
    """All phases in one run; the configuration's sizes reach every phase."""
    from alertsieve.plans.triage import run_all

    cfg = dataclasses.replace(DEFAULT, model_trees=5, model_rounds=2, forest_depth=3, cv_folds=2, cv_gap_rows=20,
                              shap_sample=7, shap_permutations=2, shap_background=11, drift_alpha=0.01)
    out = run_all(catalog.alerts(spark, SF).limit(300), str(tmp_path), cfg, anomaly="fallback")
    assert out["model_metrics"].count() == 4
    assert out["cross_validation"].count() == 2
    n_features = out["attribution"].count()
    assert n_features == out["drift"].count() > 30
    for name in ("export_processed", "export_detail", "package/attribution"):
        assert spark.read.parquet(f"{tmp_path}/{name}").count() > 0
    package = M.load_model_package(spark, f"{tmp_path}/package")
    assert package.scoring_model.cfg == cfg


def test_cross_validation_gap_in_hours(spark):
    rows = spark.range(240).select(F.col("id").alias("row_idx"), (F.col("id") % 2).cast("int").alias(M.LABEL),
                                   F.timestamp_seconds(F.col("id") * 3600).alias("startTime"),
                                   (F.col("id") % 2 + F.col("id") % 7 / 10).alias("x"))
    spec = M.model_specs()[0]
    got = [[(r.train_rows, r.test_rows) for r in M.temporal_cv(rows, 240, ["x"], spec, 2, 5, gap_hours=g).collect()]
           for g in (None, 24.0)]
    assert got == [[(75, 80), (155, 80)], [(56, 80), (136, 80)]]


def test_further_methods_and_bins(spark):
    cfg = dataclasses.replace(DEFAULT, duration_bin_edges=(0.0, 10.0, 1440.0), duration_bin_labels=("low", "high"))
    extra = {"short": lambda df: (F.col("duration_minutes") < 1).cast("double")}
    model, labelled = S.fit_scoring(catalog.alerts(spark, SF), cfg, anomaly="fallback", extra=extra)
    rows = labelled.where("score_statistical is not null").collect()
    assert {r.duration_category for r in rows} <= {"low", "high", None}
    for r in rows[:200]:
        w = cfg.ensemble_weights
        want = sum(w[m] * r[f"score_{m}"] for m in S.METHODS) + 0.25 * r.score_short
        assert r.fp_score_final == pytest.approx(min(1.0, max(0.0, want)))
    again = model.transform(catalog.alerts(spark, SF)).where("score_statistical is not null")
    assert {r.problemId: r.is_false_positive for r in again.collect()} == {r.problemId: r.is_false_positive for r in rows}
