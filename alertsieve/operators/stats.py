"""Global statistics fitted once and then applied row-locally.

``fit_alert_stats`` runs ONE Spark job: a plain aggregation grouped by
(hour, day_of_week) computing count, mean and second central moment of
the cleaned duration per group.  Partial aggregation happens map side, so
the shuffle carries at most 25 x 8 rows per partition whatever the data
size.  The <= 200 group summaries are combined on the driver: hour and
weekday counts are sums, and the global mean / sample standard deviation
follow from the parallel-variance merge of (n, mean, M2) (Chan, Golub &
LeVeque), which is exact up to rounding and avoids the row duplication of
a grouping-sets Expand.  The result is inlined into later plans as
literals: the transform stays a map-only stage, and works unchanged on a
streaming DataFrame.

The group summaries are additive: ``add_batch`` keeps those of every batch in a
small table and fits on their merge, so new alerts do not cost a pass over the
old ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class AlertStats:
    n_rows: int
    duration_mean: float | None
    duration_std: float | None
    hour_counts: dict = field(default_factory=dict)   # hour -> rows (non-null hours)
    day_counts: dict = field(default_factory=dict)    # day_of_week -> rows

    def to_rows(self) -> list[tuple]:
        """Long form (kind, key, value) for persistence."""
        rows = [("n_rows", None, float(self.n_rows)),
                ("duration_mean", None, self.duration_mean),
                ("duration_std", None, self.duration_std)]
        rows += [("hour", int(k), float(v)) for k, v in sorted(self.hour_counts.items())]
        rows += [("day_of_week", int(k), float(v)) for k, v in sorted(self.day_counts.items())]
        return rows

    @staticmethod
    def from_rows(rows) -> "AlertStats":
        scalars, hours, days = {}, {}, {}
        for kind, key, value in rows:
            if kind == "hour":
                hours[int(key)] = int(value)
            elif kind == "day_of_week":
                days[int(key)] = int(value)
            else:
                scalars[kind] = value
        return AlertStats(int(scalars["n_rows"]), scalars.get("duration_mean"),
                          scalars.get("duration_std"), hours, days)


def alert_state(df: DataFrame) -> DataFrame:
    """The additive state of a batch: ``hour, day_of_week`` (null where absent),
    ``n`` rows, ``nd`` durations, their ``mean`` and second central moment
    ``m2`` -- at most 25 x 8 rows, whatever the batch."""
    keys = [c for c in ("hour", "day_of_week") if c in df.columns]
    d = F.col("duration_minutes")
    aggs = [F.count(F.lit(1)).alias("n"), F.count(d).alias("nd"), F.avg(d).alias("mean"),
            (F.var_pop(d) * F.count(d)).alias("m2")]
    grouped = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    return grouped.select(*[(F.col(c) if c in keys else F.lit(None)).cast("int").alias(c) for c in ("hour", "day_of_week")],
                          "n", "nd", "mean", "m2")


def merge_alert_states(states: DataFrame) -> DataFrame:
    """One state from those of several batches (any rows of ``alert_state``;
    ``batch`` tells them apart), by the parallel-variance merge in the order
    of the batches: the same states give the same sums."""
    part = F.struct("batch", F.col("nd").cast("double").alias("nd"), "mean", "m2")
    zero = F.struct(F.lit(0.0).alias("nd"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def merge(acc, x):
        total = acc["nd"] + x["nd"]
        delta = x["mean"] - acc["mean"]
        joined = F.struct(total.alias("nd"), (acc["mean"] + delta * x["nd"] / total).alias("mean"),
                          (acc["m2"] + x["m2"] + delta * delta * acc["nd"] * x["nd"] / total).alias("m2"))
        return F.when(x["nd"] > 0, joined).otherwise(acc)

    merged = states.groupBy("hour", "day_of_week").agg(
        F.sum("n").alias("n"), F.aggregate(F.sort_array(F.collect_list(part)), zero, merge).alias("s"))
    some = F.col("s.nd") > 0
    return merged.select("hour", "day_of_week", "n", F.col("s.nd").cast("long").alias("nd"),
                         F.when(some, F.col("s.mean")).alias("mean"), F.when(some, F.col("s.m2")).alias("m2"))


def stats_of_state(state: DataFrame) -> AlertStats:
    """The statistics of a state (at most 200 rows are fetched)."""
    rows = state.collect()
    # merge in key order so the result does not depend on collect order
    rows.sort(key=lambda r: tuple((r[k] is None, r[k] or 0) for k in ("hour", "day_of_week")))
    n_rows = 0
    hour_counts: dict = {}
    day_counts: dict = {}
    nd, mean, m2 = 0, 0.0, 0.0
    for r in rows:
        n_rows += int(r["n"])
        for k, counts in (("hour", hour_counts), ("day_of_week", day_counts)):
            if r[k] is not None:
                counts[int(r[k])] = counts.get(int(r[k]), 0) + int(r["n"])
        if r["nd"]:
            # merge (n_b, mean_b, M2_b) into the running (nd, mean, m2)
            nb, mb, m2b = int(r["nd"]), float(r["mean"]), float(r["m2"])
            total = nd + nb
            delta = mb - mean
            mean = mean + delta * nb / total
            m2 = m2 + m2b + delta * delta * nd * nb / total
            nd = total
    duration_mean = mean if nd else None
    duration_std = math.sqrt(m2 / (nd - 1)) if nd > 1 else None
    return AlertStats(n_rows, duration_mean, duration_std, hour_counts, day_counts)


def fit_alert_stats(df: DataFrame) -> AlertStats:
    """n, mean and sample std of cleaned duration, hour and weekday counts.

    ``df`` must carry ``duration_minutes`` (cleaned) and may carry ``hour``
    and ``day_of_week``.
    """
    return stats_of_state(alert_state(df))


def add_batch(path: str, df: DataFrame, batch: str) -> AlertStats:
    """Put a batch's state into the state table at ``path`` and return the
    statistics of all its batches; the history is not read again.

    A batch is a partition of the table, so that adding it a second time (a
    retry, a corrected batch) replaces it.  A null batch name raises.
    """
    if not batch:
        raise ValueError("a batch needs a name")
    (alert_state(df).withColumn("batch", F.lit(batch)).coalesce(1).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path))
    return load_alert_stats(df.sparkSession, path)


def load_alert_stats(spark: SparkSession, path: str, upto: str | None = None) -> AlertStats:
    """The statistics of the state table at ``path``, or of its batches up to
    and with ``upto`` (by name): an earlier version of the fit."""
    schema = "hour int, day_of_week int, n long, nd long, mean double, m2 double, batch string"
    states = spark.read.schema(schema).parquet(path)
    return stats_of_state(merge_alert_states(states if upto is None else states.where(F.col("batch") <= upto)))


def _lookup(counts: dict, key: Column) -> Column:
    if not counts:
        return F.lit(None).cast("long")
    pairs = []
    for k, v in sorted(counts.items()):
        pairs += [F.lit(int(k)), F.lit(int(v)).cast("long")]
    return F.try_element_at(F.create_map(*pairs), key.cast("int"))


def frequency_features(df: DataFrame, stats: AlertStats) -> DataFrame:
    """hour_frequency, hour_frequency_ratio, day_frequency (null key -> null).

    The ratio divides by ALL rows, including those whose hour is null.
    """
    cols = []
    if "hour" in df.columns:
        hf = _lookup(stats.hour_counts, F.col("hour"))
        cols += [hf.alias("hour_frequency"),
                 (hf / F.lit(float(stats.n_rows))).alias("hour_frequency_ratio")]
    if "day_of_week" in df.columns:
        cols.append(_lookup(stats.day_counts, F.col("day_of_week")).alias("day_frequency"))
    return df.select("*", *cols) if cols else df


def duration_stats(df: DataFrame) -> DataFrame:
    """One-row lazy aggregate: n, mean, sample std of duration_minutes."""
    d = F.col("duration_minutes")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(d).alias("duration_mean"),
                  F.stddev_samp(d).alias("duration_std"))
