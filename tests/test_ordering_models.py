"""Global order, folds, metrics, drift, selection, attribution, packages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertsieve.operators import drift as DR
from alertsieve.operators import models as M
from alertsieve.operators import ordering as OR
from alertsieve.operators.selection import correlation_pairs, select_features, variance_profile


def test_global_row_index_matches_sort(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("k"), F.col("id").cast("string").alias("problemId"))
    idx = OR.global_row_index(df.withColumnRenamed("k", "startTime"), partitions=7)
    got = sorted((r["row_idx"], r["problemId"]) for r in idx.collect())
    want = sorted(df.collect(), key=lambda r: (r["k"], r["problemId"]))
    assert [g[1] for g in got] == [w["problemId"] for w in want]
    assert [g[0] for g in got] == list(range(5000))


def test_fold_bounds():
    b = OR.fold_bounds(1200, 5, 168)
    assert [x[2] for x in b] == [200, 400, 600, 800, 1000]
    assert [x[1] for x in b] == [32, 232, 432, 632, 832]
    with pytest.raises(ValueError):
        OR.fold_bounds(100, 5, 168)


def test_binary_metrics_no_positive_predictions(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.2), (0.0, 0.0, 0.1)], "label double, prediction double, p1 double")
    r = M.binary_metrics(df).first()
    assert r["precision"] == 0 and r["recall"] == 0 and r["f1"] == 0 and r["accuracy"] == 0.5
    assert r["auc"] == 1.0


def test_robust_scaling_keeps_sparse_flags(spark):
    df = spark.createDataFrame([(0.0,), (0.0,), (0.0,), (0.0,), (1.0,)], "f double")
    s = M.fit_robust_scaling(df, ["f"])
    assert s.scale["f"] == 1.0 and s.center["f"] == 0.0
    assert [r["f"] for r in s.transform(df).collect()] == [0.0, 0.0, 0.0, 0.0, 1.0]


def test_ks_same_and_disjoint(spark):
    a = spark.range(300).select((F.col("id") % 17).cast("double").alias("x"))
    b = spark.range(300).select(((F.col("id") % 17) + 100).cast("double").alias("x"))
    same = DR.ks_statistic(a, a, ["x"]).first()["d"]
    disjoint = DR.ks_statistic(a, b, ["x"]).first()["d"]
    assert same == 0 and disjoint == 1
    sym = DR.ks_statistic(b, a, ["x"]).first()["d"]
    assert sym == disjoint


def test_ks_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    x1, x2 = rng.normal(size=700).round(2), (rng.normal(size=400) + 0.3).round(2)
    a = spark.createDataFrame([(float(v),) for v in x1], "x double")
    b = spark.createDataFrame([(float(v),) for v in x2], "x double")
    got = DR.ks_statistic(a, b, ["x"]).first()["d"]
    grid = np.union1d(x1, x2)
    want = max(abs((x1 <= g).mean() - (x2 <= g).mean()) for g in grid)
    assert got == pytest.approx(want, abs=1e-12)
    p = DR.ks_drift(a, b, ["x"]).first()["p_value"]
    assert 0 <= p < 0.05


def test_correlation_pairs_pairwise_complete(spark):
    import pandas as pd

    rng = np.random.default_rng(2)
    x = rng.normal(size=500)
    y = 2 * x + rng.normal(size=500) * 0.1
    z = rng.normal(size=500)
    y[::7] = np.nan
    pdf = pd.DataFrame({"x": x, "y": y, "z": z, "c": 1.0})
    df = spark.createDataFrame(pdf).select([F.when(~F.isnan(c), F.col(c)).alias(c) for c in pdf.columns])
    got = {(r["feature_a"], r["feature_b"]): r["corr"] for r in correlation_pairs(df, list(pdf.columns)).collect()}
    want = pdf.corr()
    for (a, b), v in got.items():
        if a == "c" or b == "c":
            assert v is None
        else:
            assert v == pytest.approx(want.loc[a, b], abs=1e-9)
    var = {r["feature"]: r["variance"] for r in variance_profile(df, list(pdf.columns)).collect()}
    assert var["c"] == 0 and var["y"] == pytest.approx(np.nanvar(y), rel=1e-9)
    kept = select_features(df, list(pdf.columns), force=True)
    assert kept == ["x", "z"]


def test_shapley_efficiency(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from alertsieve.operators.attribution import shapley_contributions

    rng = np.random.default_rng(3)
    X = rng.normal(size=(300, 3))
    y = (X[:, 0] + 0.5 * X[:, 1] > 0).astype(float)
    rows = [(i, float(a), float(b), float(c), float(t)) for i, ((a, b, c), t) in enumerate(zip(X, y))]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double, label double")
    data = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    model = LogisticRegression(maxIter=50).fit(data)
    explained = df.where("row_id < 5")
    background = df.where("row_id >= 5 AND row_id < 6")  # one background row
    phi = shapley_contributions(model, explained, background, ["a", "b", "c"], permutations=4)
    total = {r["row_id"]: r["s"] for r in phi.groupBy("row_id").agg(F.sum("shapley").alias("s")).collect()}
    pred = {r["row_id"]: r["p"] for r in model.transform(data).select(
        "row_id", M.vector_to_array("probability")[1].alias("p")).collect()}
    for rid, s in total.items():
        assert s == pytest.approx(pred[rid] - pred[5], abs=1e-9)


def test_folds_with_time_gap(spark):
    import datetime as dt

    base = dt.datetime(2025, 1, 1)
    rows = [(f"p{i:04d}", base + dt.timedelta(hours=i)) for i in range(600)]
    df = spark.createDataFrame(rows, "problemId string, startTime timestamp")
    idx = OR.global_row_index(df, partitions=3)
    folds = OR.time_series_folds(idx, 600, k=5, gap_hours=24)
    got = {r["fold"]: r["n"] for r in folds.where("role = 'train'").groupBy("fold").count()
           .withColumnRenamed("count", "n").collect()}
    # one row per hour: a 24 h gap drops the 24 rows before each test block
    assert got == {i: (i + 1) * 100 - 24 for i in range(5)}
    tests = {r["fold"]: r["n"] for r in folds.where("role = 'test'").groupBy("fold").count()
             .withColumnRenamed("count", "n").collect()}
    assert tests == {i: 100 for i in range(5)}
