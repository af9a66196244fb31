"""Two-sample Kolmogorov-Smirnov drift test per feature (W4, M10).

Spark ML's KS test is one-sample only, so the two-sample statistic is a
DataFrame job: the features are unpivoted to (feature, value) rows, both
samples are pre-aggregated to one row per (feature, distinct value) with
map-side partial aggregation, and running counts of each sample over the
sorted distinct values give the two empirical CDFs.  D is the largest
gap between them.  The running counts are a distributed prefix sum
(range-partitioned on (feature, value), sorted within partitions, per
partition totals -> offsets), so no single task ever holds one feature's
values, however many distinct values it has.

p-value: asymptotic Kolmogorov distribution,
``p = 2 * sum_{i>=1} (-1)^(i-1) exp(-2 i^2 lam^2)`` with
``lam = D * sqrt(n1 n2 / (n1 + n2))`` (100 terms; the series is useless
near 0, where p is 1).  Drift: any p below alpha / number of features
(Bonferroni).

Small samples have an exact p-value: the share of lattice paths from (0, 0) to
(n1, n2) that reach a gap of at least D (``method="auto"`` uses it up to
``EXACT_ROWS`` rows a side).  ``ks_by_period`` tests every period against one
reference sample; the reference is sorted and summed once for all of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertsieve.session import reliable_table

KS_TERMS = 100
#: Rows a side up to which the exact p-value is computed (rows x rows steps, vectorised).
EXACT_ROWS = 10_000


def unpivot(df: DataFrame, features: list[str], side: str) -> DataFrame:
    args = []
    for f in features:
        args += [F.lit(f), F.coalesce(F.col(f).cast("double"), F.lit(0.0))]
    return df.select(F.lit(side).alias("side"),
                     F.stack(F.lit(len(features)), *args).alias("feature", "value"))


def value_counts_by_side(ref: DataFrame, cur: DataFrame, features: list[str]) -> DataFrame:
    """(feature, value, c1, c2): counts per distinct value in each sample."""
    long = unpivot(ref, features, "ref").unionByName(unpivot(cur, features, "cur"))
    return (long.groupBy("feature", "value")
            .agg(F.count_if(F.col("side") == "ref").alias("c1"),
                 F.count_if(F.col("side") == "cur").alias("c2")))


_LOCAL_SCHEMA = T.StructType([
    T.StructField("feature", T.StringType()), T.StructField("value", T.DoubleType()),
    T.StructField("c1", T.LongType()), T.StructField("c2", T.LongType()),
    T.StructField("_pid", T.IntegerType()), T.StructField("l1", T.LongType()),
    T.StructField("l2", T.LongType()),
])


def _local_running_sums(batches):
    """Running c1/c2 sums per feature within one (sorted) partition.

    mapInPandas hands over a partition as a sequence of Arrow batches in
    order, so the running totals are carried from batch to batch.
    """
    carry: dict[str, tuple[int, int]] = {}
    for pdf in batches:
        if pdf.empty:
            continue
        g = pdf.groupby("feature", sort=False)
        l1 = g["c1"].cumsum().to_numpy()
        l2 = g["c2"].cumsum().to_numpy()
        base1 = pdf["feature"].map({f: v[0] for f, v in carry.items()}).fillna(0).to_numpy("int64")
        base2 = pdf["feature"].map({f: v[1] for f, v in carry.items()}).fillna(0).to_numpy("int64")
        pdf = pdf.assign(l1=l1 + base1, l2=l2 + base2)
        last = pdf.groupby("feature", sort=False)[["l1", "l2"]].last()
        for f, row in last.iterrows():
            carry[f] = (int(row["l1"]), int(row["l2"]))
        yield pdf[["feature", "value", "c1", "c2", "_pid", "l1", "l2"]]


def running_counts(counts: DataFrame, partitions: int | None = None,
                   materialize=reliable_table) -> DataFrame:
    """Add cum1/cum2: running sums of c1/c2 per feature in value order.

    Distributed prefix sum: range partitioning places each feature's
    values in consecutive partitions, sorted; each partition computes its
    local running sums in one pass (no further shuffle); the (partition,
    feature) totals, a table of at most partitions x features rows, give
    the offsets, which are broadcast and added.  The local sums are written
    once so the totals and the final join see the same partitioning.
    """
    spark = counts.sparkSession
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (counts.select("feature", F.col("value").cast("double").alias("value"),
                            F.col("c1").cast("long").alias("c1"), F.col("c2").cast("long").alias("c2"))
              .repartitionByRange(n_parts, "feature", "value")
              .sortWithinPartitions("feature", "value")
              .select("*", F.spark_partition_id().alias("_pid")))
    local = ranged.mapInPandas(_local_running_sums, _LOCAL_SCHEMA)
    local = materialize(local, "ks_running") if materialize else local
    totals = local.groupBy("_pid", "feature").agg(F.max("l1").alias("t1"), F.max("l2").alias("t2"))
    w_off = Window.partitionBy("feature").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", "feature",
                            F.coalesce(F.sum("t1").over(w_off), F.lit(0)).alias("o1"),
                            F.coalesce(F.sum("t2").over(w_off), F.lit(0)).alias("o2"))
    # offsets: at most partitions x features rows -> broadcast.
    out = local.join(F.broadcast(offsets), ["_pid", "feature"])
    return out.select("feature", "value", "c1", "c2",
                      (F.col("l1") + F.col("o1")).alias("cum1"),
                      (F.col("l2") + F.col("o2")).alias("cum2"))


def ks_statistic(ref: DataFrame, cur: DataFrame, features: list[str],
                 materialize=reliable_table) -> DataFrame:
    """(feature, n_ref, n_cur, d): two-sample KS statistic per feature.

    Missing values are read as 0, so every feature has exactly one value
    per row: the sample sizes are the two row counts.
    """
    n_ref, n_cur = ref.count(), cur.count()
    counts = value_counts_by_side(ref, cur, features)
    cum = running_counts(counts, materialize=materialize)
    gap = F.abs(F.col("cum1") / F.lit(float(n_ref)) - F.col("cum2") / F.lit(float(n_cur)))
    return (cum.groupBy("feature")
            .agg(F.max(gap).alias("d"))
            .select("feature", F.lit(n_ref).alias("n_ref"), F.lit(n_cur).alias("n_cur"), "d"))


def ks_pvalue(d, n1, n2):
    """Asymptotic two-sided p-value as a column expression."""
    lam = d * F.sqrt(n1 * n2 / (n1 + n2))
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(KS_TERMS)), F.lit(0.0),
        lambda acc, i: acc + F.pow(F.lit(-1.0), i - 1) * F.exp(-2.0 * i * i * lam * lam))
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * terms))
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(p)


def exact_pvalue(d: float, n1: int, n2: int) -> float:
    """P(D >= d) of two samples of one continuous distribution, exactly.

    All orders of the pooled sample are equally likely, each a lattice path.
    ``u[i]`` is the probability that a random path to (i, k - i) has met a gap
    of ``d`` or more; one vector step goes from each diagonal k to the next.
    All values are probabilities, so nothing overflows and small p keep their
    digits.
    """
    n1, n2 = sorted((int(n1), int(n2)))
    least = round(d * n1 * n2)  # gaps are multiples of 1 / (n1 n2)
    if not n1 or least <= 0:
        return 1.0
    u = np.zeros(n1 + 1)
    for k in range(1, n1 + n2 + 1):
        a, b = max(0, k - n2), min(n1, k)
        i = np.arange(a, b + 1)
        before = np.zeros(len(i))
        before[i > 0] = u[i[i > 0] - 1]
        step = (i * before + (k - i) * u[a:b + 1]) / k
        step[np.abs(i * n2 - (k - i) * n1) >= least] = 1.0
        u[a:b + 1] = step
    return float(min(1.0, u[n1]))


def _exact_column(d: Column, n1: Column, n2: Column) -> Column:
    @F.pandas_udf(T.DoubleType())
    def exact(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
        known: dict[tuple, float] = {}  # ties make many features share D
        return pd.Series([known[x] if x in known else known.setdefault(x, exact_pvalue(*x)) for x in zip(d, n1, n2)])

    return exact(d, n1, n2)


def _p_value(stats: DataFrame, method: str) -> DataFrame:
    """``stats`` with ``p_value``; one row a feature (and period)."""
    if method not in ("asymptotic", "auto"):
        raise ValueError("method is 'asymptotic' or 'auto'")
    n1, n2 = F.col("n_ref"), F.col("n_cur")
    far = ks_pvalue(F.col("d"), n1.cast("double"), n2.cast("double"))
    if method == "asymptotic":
        return stats.select("*", far.alias("p_value"))
    small = F.greatest(n1, n2) <= EXACT_ROWS
    near = _exact_column(F.when(small, F.col("d")).otherwise(F.lit(0.0)), F.when(small, n1).otherwise(F.lit(0)),
                         F.when(small, n2).otherwise(F.lit(0)))
    return stats.select("*", F.when(small, near).otherwise(far).alias("p_value"))


def ks_by_period(ref: DataFrame, cur: DataFrame, features: list[str], period: Column, alpha: float = 0.05,
                 method: str = "asymptotic", materialize=reliable_table) -> DataFrame:
    """(feature, period, n_ref, n_cur, d, p_value, drift): every period of
    ``cur`` against ``ref``.

    Missing feature values are read as 0; rows without a period are left out.
    The gap between two step functions is largest at a value of the period,
    before or after its step, so the reference's running counts are needed at
    the periods' values only: one prefix sum over the reference's and all
    periods' values by feature, one over the periods' by (feature, period).
    ``drift``: p below ``alpha`` / (features x periods).
    """
    n_ref = ref.count()
    per = cur.withColumn("__period", period.cast("string")).where("__period IS NOT NULL")
    long = per.select("__period", F.stack(F.lit(len(features)), *[x for f in features for x in (
        F.lit(f), F.coalesce(F.col(f).cast("double"), F.lit(0.0)))]).alias("feature", "value"))
    counts = long.groupBy("feature", "__period", "value").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "ks_periods") if materialize else counts
    base = (unpivot(ref, features, "ref").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c1"))
            .unionByName(counts.select("feature", "value").distinct().withColumn("c1", F.lit(0).cast("long")))
            .groupBy("feature", "value").agg(F.sum("c1").alias("c1")).withColumn("c2", F.lit(0)))
    below = running_counts(base, materialize=materialize).select("feature", "value", "c1", "cum1")
    names = counts.select(F.concat_ws("\u0001", "feature", "__period").alias("feature"), "value", F.lit(0).alias("c1"),
                          F.col("n").alias("c2"))
    own = running_counts(names, materialize=materialize)
    key = F.split("feature", "\u0001")
    own = own.select(F.get(key, 0).alias("feature"), F.get(key, 1).alias("period"), "value", "c2", "cum2")
    sizes = per.groupBy(F.col("__period").alias("period")).agg(F.count(F.lit(1)).alias("n_cur"))
    at = own.join(below, ["feature", "value"]).join(sizes, "period")
    n1, n2 = F.lit(float(n_ref)), F.col("n_cur")
    gap = F.greatest(F.abs(F.col("cum1") / n1 - F.col("cum2") / n2),
                     F.abs((F.col("cum1") - F.col("c1")) / n1 - (F.col("cum2") - F.col("c2")) / n2))
    stats = at.groupBy("feature", "period").agg(F.max(gap).alias("d"), F.first("n_cur").alias("n_cur")).select(
        "feature", "period", F.lit(n_ref).alias("n_ref"), "n_cur", "d")
    with_p = _p_value(stats, method)
    tests = with_p.agg(F.count(F.lit(1)).alias("__tests"))  # one row
    return with_p.crossJoin(F.broadcast(tests)).select(
        "feature", "period", "n_ref", "n_cur", "d", "p_value", (F.col("p_value") < alpha / F.col("__tests")).alias("drift"))


def ks_drift(ref: DataFrame, cur: DataFrame, features: list[str], alpha: float = 0.05,
             materialize=reliable_table, method: str = "asymptotic") -> DataFrame:
    """Per-feature D and p, plus the overall Bonferroni drift decision."""
    with_p = _p_value(ks_statistic(ref, cur, features, materialize), method)
    threshold = alpha / max(len(features), 1)
    summary = with_p.agg(F.min("p_value").alias("min_p"), F.max("p_value").alias("max_p"))
    return (with_p.crossJoin(F.broadcast(summary))
            .select("feature", "n_ref", "n_cur", "d", "p_value", "min_p", "max_p",
                    (F.col("min_p") < F.lit(threshold)).alias("drift_detected"),
                    (F.col("p_value") < F.lit(threshold)).alias("feature_drift")))

