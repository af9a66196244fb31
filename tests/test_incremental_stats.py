"""The additive fit state against one fit over everything."""

import pytest
from pyspark.sql import functions as F

from alertsieve.operators import stats as ST


def batches(spark):
    return spark.range(0, 5000, 1, 4).select(
        "id", F.when(F.col("id") % 17 > 0, (F.col("id") % 24)).cast("int").alias("hour"),
        (F.col("id") % 7).cast("int").alias("day_of_week"),
        F.when(F.col("id") % 13 > 0, 1e6 + F.rand(1) * 100).alias("duration_minutes"))


def test_ten_batches_equal_one_fit(spark, tmp_path):
    df = batches(spark).persist()
    whole = ST.fit_alert_stats(df)
    path = str(tmp_path / "state")
    for i in range(10):
        got = ST.add_batch(path, df.where(F.col("id") % 10 == i), f"b{i}")
    assert (got.n_rows, got.hour_counts, got.day_counts) == (whole.n_rows, whole.hour_counts, whole.day_counts)
    assert got.duration_mean == pytest.approx(whole.duration_mean, rel=1e-12)
    assert got.duration_std == pytest.approx(whole.duration_std, rel=1e-12)
    # a batch that comes again replaces itself; an earlier version stays readable
    assert ST.add_batch(path, df.where(F.col("id") % 10 == 3), "b3") == got
    first = ST.load_alert_stats(spark, path, upto="b0")
    assert first.n_rows == 500 and first.duration_mean == pytest.approx(ST.fit_alert_stats(df.where("id % 10 = 0")).duration_mean)


def test_empty_batches_and_absent_columns(spark, tmp_path):
    df = batches(spark)
    path = str(tmp_path / "state")
    ST.add_batch(path, df.select("duration_minutes"), "a")
    got = ST.add_batch(path, df.where("false"), "b")
    assert got.n_rows == 5000 and got.hour_counts == {}
    none = ST.fit_alert_stats(df.where("false"))
    assert none.n_rows == 0 and none.duration_mean is None
    with pytest.raises(ValueError):
        ST.add_batch(path, df, "")
