"""Forest sampling on repeated ids, weights from the configuration, the model slot."""

import dataclasses

import numpy as np
import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.sql import functions as F

from alertsieve.config import DEFAULT
from alertsieve.operators import iforest as IF
from alertsieve.operators import models as M
from alertsieve.operators import scoring as S


def points(spark, key, n=20_000):
    return spark.range(0, n, 1, 4).select(key.alias("problemId"), (F.rand(1) * 10).alias("a"), F.rand(2).alias("b"))


def test_all_trees_whatever_the_ids(spark):
    """Null ids, 40 ids, one id on a third of the rows: 100 trees of full samples."""
    i = F.col("id")
    keys = [F.lit(None).cast("string"), (i % 40).cast("string"), F.when(i % 3 == 0, "hot").otherwise(i.cast("string"))]
    for k in keys:
        df = spark.range(0, 20_000, 1, 4).withColumn("problemId", k)
        model = IF.fit_iforest(df.select("problemId", (F.rand(1) * 10).alias("a"), F.rand(2).alias("b")), ["a", "b"])
        assert len(model.roots) == 100
        assert (model.size[model.roots] == 256).all()


def test_equal_rows_are_told_apart(spark):
    """One row 5,000 times: every tree is grown, from the row's copies."""
    df = spark.range(5000).select(F.lit("x").alias("problemId"), F.lit(1.0).alias("a"), F.lit(2.0).alias("b"))
    model = IF.fit_iforest(df, ["a", "b"], n_trees=20)
    assert len(model.roots) == 20 and (model.size[model.roots] == 256).all()


def test_sample_does_not_depend_on_partitions(spark):
    df = points(spark, (F.col("id") % 40).cast("string"), 3000).cache()
    one, two = (IF.fit_iforest(df.repartition(n), ["a", "b"], n_trees=5) for n in (2, 7))
    assert np.array_equal(one.threshold, two.threshold, equal_nan=True)


def test_weights_come_from_the_configuration(spark):
    cfg = dataclasses.replace(DEFAULT, rule_ultra_short=(1.0, 0.7), rule_very_short=(3.0, 0.05), rule_reconciliation=0.1,
                              stat_rare_hour=0.5, stat_zscore_limit=1.0, stat_zscore_weight=0.25, pattern_short_night=0.9)
    df = spark.createDataFrame([(0.8, 1, 0.2, 1.5, 1, 0), (2.0, 0, 0.2, 0.5, 0, 1)],
                               "duration_minutes double, is_reconciliacion int, hour_frequency_ratio double, "
                               "duration_zscore double, short_night_alert int, quincena_reconciliation int")
    got = df.select(S.score_rules(df, cfg), S.score_statistical(df, cfg), S.score_pattern(df, cfg)).collect()
    assert [tuple(r) for r in got] == [pytest.approx((0.8, 0.65, 0.9)), pytest.approx((0.05, 0.4, 0.3))]
    assert M._config_of(dataclasses.asdict(cfg)) == cfg


def test_a_further_estimator_has_a_slot(spark, tmp_path):
    """An estimator that the library does not know is fitted, packaged and loaded."""
    from alertsieve.plans import catalog

    raw = catalog.alerts(spark, "/root/testdata/sf0.001")
    labelled = S.fit_scoring(raw, anomaly="fallback")[1]
    specs = [M.ModelSpec("Bayes", False, lambda n: NaiveBayes(modelType="gaussian"))]
    suite = M.model_suite(labelled, specs=specs)
    assert [t.name for t in suite.trained] == ["Bayes"] and suite.best == "Bayes"
    M.save_model_package(str(tmp_path / "p"), suite.trained[0].model, suite.features, suite.scaling, metrics=suite.metrics)
    loaded = M.load_model_package(spark, str(tmp_path / "p"))
    assert type(loaded.model).__name__ == "NaiveBayesModel"
    assert loaded.predict(suite.test).count() == suite.test.count()


def test_boosted_model_in_the_package(spark, tmp_path):
    from alertsieve.plans import catalog
    from alertsieve.plans.triage import best_attribution

    raw = catalog.alerts(spark, "/root/testdata/sf0.001")
    labelled = S.fit_scoring(raw, anomaly="fallback")[1]
    suite = M.model_suite(labelled, rounds=4, only=("HistBoostDepth6",))
    M.save_model_package(str(tmp_path / "p"), suite.trained[0].model, suite.features, suite.scaling, metrics=suite.metrics)
    test = suite.test.select("problemId", *suite.features)
    want = M.ModelPackage(suite.trained[0].model, suite.features, suite.scaling).predict(test)
    got = M.load_model_package(spark, str(tmp_path / "p")).predict(test)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    ranking = best_attribution(suite).collect()
    assert len(ranking) == len(suite.features) and all(r.importance >= 0 for r in ranking)


def test_many_columns_are_selected_in_the_flow(spark):
    """With twelve more keywords there are over 50 columns: the models see the selection."""
    from alertsieve.operators.selection import select_features, selected_table
    from alertsieve.plans import catalog

    cfg = dataclasses.replace(DEFAULT, keywords=(*DEFAULT.keywords, *[f"word{i}" for i in range(12)]))
    raw = catalog.alerts(spark, "/root/testdata/sf0.001")
    labelled = S.fit_scoring(raw, cfg, anomaly="fallback")[1]
    columns = M.feature_columns(labelled)
    assert len(columns) > cfg.selection_min_columns
    want = select_features(labelled, columns, cfg)
    suite = M.model_suite(labelled, cfg, only=("LogisticRegression",))
    assert suite.features == want and len(want) < len(columns)
    assert not any(f.startswith("has_word") for f in suite.features)  # constant columns go
    table = selected_table(labelled, columns, cfg)
    assert table.columns[:2] == ["problemId", "title"] and set(want) <= set(table.columns)
