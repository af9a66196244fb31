"""Isolation forest properties (its random stream is our own, so no
golden values): bounds, planted outlier, partition independence."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertsieve.operators.iforest import average_path_length, fit_iforest, isolation_score, path_scores
from alertsieve.operators.scoring import fit_scoring
from alertsieve.plans.catalog import alerts
from alertsieve.session import reliable_table
from conftest import SF_SMALL


def test_average_path_length():
    assert average_path_length([1])[0] == 0 and average_path_length([2])[0] == 1
    assert average_path_length([256])[0] == pytest.approx(10.2448, abs=1e-3)


def test_planted_outlier_ranks_high(spark):
    rng = np.random.default_rng(0)
    rows = [(f"r{i}", float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(2000, 2)))]
    rows.append(("outlier", 12.0, -12.0))
    df = spark.createDataFrame(rows, "problemId string, a double, b double")
    model = fit_iforest(df, ["a", "b"], n_trees=50, max_samples=128, seed=3)
    scored = df.select("problemId", isolation_score(df, model).alias("s"))
    ranked = [r["problemId"] for r in scored.orderBy(F.desc("s")).limit(20).collect()]
    assert ranked[0] == "outlier"


def test_scores_in_unit_range_and_partition_independent(spark):
    raw = alerts(spark, SF_SMALL)
    _, a = fit_scoring(raw.repartition(1), materialize=reliable_table)
    _, b = fit_scoring(raw.repartition(7), materialize=reliable_table)
    agg = a.agg(F.min("score_anomaly"), F.max("score_anomaly")).first()
    assert agg[0] == pytest.approx(0.0) and agg[1] == pytest.approx(1.0)
    sa = {r["problemId"]: r["score_anomaly"] for r in a.select("problemId", "score_anomaly").collect()}
    sb = {r["problemId"]: r["score_anomaly"] for r in b.select("problemId", "score_anomaly").collect()}
    assert sa.keys() == sb.keys()
    assert max(abs(sa[k] - sb[k]) for k in sa) < 1e-12


def test_path_scores_shape():
    from alertsieve.operators.iforest import IForestModel

    # a single stump: feature 0 split at 0.5; leaves of size 1 and 3
    m = IForestModel(("a",), 4, 1, np.array([0, -1, -1]), np.array([0.5, 0, 0]),
                     np.array([1, -1, -1]), np.array([2, -1, -1]), np.array([4, 1, 3]), np.array([0]))
    s = path_scores(m, np.array([[0.0], [1.0]]))
    assert s[0] > s[1]


def test_forest_transform_reproduces_fit_and_package_roundtrip(spark):
    import tempfile

    from alertsieve.operators import models as M

    raw = alerts(spark, SF_SMALL)
    model, labelled = fit_scoring(raw, materialize=reliable_table)
    again = model.transform(raw)
    a = {r["problemId"]: (r["fp_score_final"], r["is_false_positive"]) for r in labelled.collect()}
    b = {r["problemId"]: (r["fp_score_final"], r["is_false_positive"]) for r in again.collect()}
    assert a.keys() == b.keys()
    assert all(abs(a[k][0] - b[k][0]) < 1e-12 and a[k][1] == b[k][1] for k in a if a[k][0] is not None)

    # package with the scoring state: the loaded model labels the same way
    from pyspark.ml.classification import LogisticRegression

    feats = M.feature_columns(labelled)
    filled = M.fill_features(labelled, feats, keep=["problemId", "is_false_positive"])
    scaling = M.fit_robust_scaling(filled, feats)
    data = M.assemble(scaling.transform(filled, keep=["is_false_positive"]), feats) \
        .withColumn("label", F.col("is_false_positive").cast("double"))
    clf = LogisticRegression(maxIter=20).fit(data)
    path = tempfile.mkdtemp(prefix="alertsieve-pkg-") + "/pkg"
    M.save_model_package(path, clf, feats, scaling, scoring_model=model)
    pkg = M.load_model_package(spark, path)
    assert pkg.scoring_model.forest is not None
    assert pkg.scoring_model.threshold == model.threshold
    c = {r["problemId"]: r["is_false_positive"] for r in pkg.scoring_model.transform(raw).collect()}
    assert c == {k: v[1] for k, v in a.items()}
