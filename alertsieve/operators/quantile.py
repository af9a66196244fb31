"""Exact quantiles with bounded memory per task.

Spark's ``percentile`` is exact but keeps every distinct value of a group
in ONE aggregation buffer, which does not survive a continuous column over
10^11 rows.  Here order statistics are found by histogram refinement, the
same way at every size:

* one aggregate gives each column's count, finite minimum and maximum and
  its infinities (null and NaN values are skipped);
* each pass unpivots the columns that still have an open search, keeps the
  values inside an open range and counts them with a map-side partial
  ``groupBy(range, bucket)``; the driver gets at most ``ranges x bins``
  rows of (count, min, max), never values of the table as such;
* the bucket holding a wanted rank becomes that search's next range.  The
  bucket function is monotonic, so a bucket is exactly the closed interval
  [its min, its max]; a search ends when both are equal.  The smallest and
  the largest value of a range fall into different buckets, so every pass
  strictly narrows it (by about ``bins`` where values are spread).

Interpolation is numpy's "linear" rule (two-sided lerp).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 1024


def _lerp(a: float, b: float, t: float) -> float:
    diff = b - a
    if t >= 0.5:
        return b - diff * (1 - t)
    return a + diff * t


def _value(c: str):
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def _long(df: DataFrame, cols: list[str]) -> DataFrame:
    args = []
    for i, c in enumerate(cols):
        args += [F.lit(i), _value(c)]
    return (df.select(F.stack(F.lit(len(cols)), *args).alias("ci", "v"))
            .where(F.col("v").isNotNull() & (F.abs("v") < float("inf"))))


def column_summaries(df: DataFrame, cols: list[str]) -> dict[str, tuple]:
    """(count, finite min, finite max, -inf count, +inf count) of each column, one pass."""
    inf = float("inf")
    aggs = []
    for i, c in enumerate(cols):
        x = _value(c)
        finite = F.when(F.abs(x) < inf, x)
        aggs += [F.count(x).alias(f"n{i}"), F.min(finite).alias(f"lo{i}"), F.max(finite).alias(f"hi{i}"),
                 F.count_if(x == -inf).alias(f"a{i}"), F.count_if(x == inf).alias(f"b{i}")]
    row = df.agg(*aggs).first()
    return {c: tuple(row[f"{k}{i}"] for k in ("n", "lo", "hi", "a", "b")) for i, c in enumerate(cols)}


def order_statistics(df: DataFrame, requests: list[tuple[str, int]], bins: int = BINS,
                     summaries: dict | None = None) -> dict[tuple[str, int], float]:
    """Values at 0-based ranks of the values: {(col, rank): value}."""
    summaries = summaries or column_summaries(df, sorted({c for c, _ in requests}))
    result: dict[tuple[str, int], float] = {}
    pending = []  # open searches: [col, rank within range, lo, hi, request key]
    for c, r in requests:
        n, lo, hi, below, above = summaries[c]
        if r >= n:
            result[(c, r)] = None
        elif r < below or r >= n - above:
            result[(c, r)] = -math.inf if r < below else math.inf
        else:
            pending.append([c, r - below, float(lo), float(hi), (c, r)])
    return _search(df, pending, result, bins)


def _search(df: DataFrame, pending: list, result: dict, bins: int) -> dict:
    while True:
        for s in pending:
            if s[2] == s[3]:
                result[s[4]] = s[2]
        pending = [s for s in pending if s[2] != s[3]]
        if not pending:
            return result
        groups = _groups(pending)
        pending = _descend(pending, groups, _histogram(df, groups, bins))


def _groups(searches) -> dict[tuple, int]:
    keys = {}
    for s in searches:
        keys.setdefault((s[0], s[2], s[3]), len(keys))
    return keys


def _histogram(df: DataFrame, groups: dict[tuple, int], bins: int) -> dict[int, list]:
    """One pass: (count, min, max) per equal-width bucket of every open range.

    Ranges of one column are equal or disjoint, so each value meets at most
    one; the range table (one row an open range) is broadcast.
    """
    cols = sorted({c for c, _, _ in groups})
    table = df.sparkSession.createDataFrame(
        [(cols.index(c), lo, hi, g) for (c, lo, hi), g in groups.items()], "gci int, glo double, ghi double, g int")
    inside = (F.col("ci") == F.col("gci")) & F.col("v").between(F.col("glo"), F.col("ghi"))
    tagged = _long(df, cols).join(F.broadcast(table), inside)
    # halves first: the width of the widest range of doubles would overflow
    raw = F.floor((F.col("v") / 2 - F.col("glo") / 2) / (F.col("ghi") / 2 - F.col("glo") / 2) * F.lit(float(bins)))
    bucket = (F.when(F.col("v") == F.col("glo"), 0).when(F.col("v") == F.col("ghi"), bins - 1)
              .otherwise(F.least(F.greatest(F.coalesce(raw, F.lit(0)), F.lit(0)), F.lit(bins - 1))).cast("int"))
    hist = (tagged.groupBy("g", bucket.alias("b"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .collect())  # bounded: <= ranges x bins rows
    by_group: dict[int, list] = {}
    for h in sorted(hist, key=lambda h: h["b"]):
        by_group.setdefault(h["g"], []).append(h)
    return by_group


def _descend(searches, groups, by_group):
    """Move each search into the bucket holding its rank."""
    nxt = []
    for c, rank, lo, hi, key in searches:
        for h in by_group[groups[(c, lo, hi)]]:
            if rank < h["n"]:
                nxt.append([c, rank, float(h["lo"]), float(h["hi"]), key])
                break
            rank -= h["n"]
    return nxt


def _plan(n: int, q: float):
    h = (n - 1) * q
    k = int(math.floor(h))
    t = h - k
    return ([k] if t == 0 or k + 1 >= n else [k, k + 1]), t


def exact_quantiles(df: DataFrame, cols: list[str], qs: list[float],
                    bins: int = BINS) -> dict[str, dict[float, float]]:
    """Linear-interpolated quantiles ``qs`` of each column (null and NaN skipped)."""
    summaries = column_summaries(df, cols)
    plans = {(c, q): _plan(summaries[c][0], q) for c in cols for q in qs if summaries[c][0]}
    requests = sorted({(c, r) for (c, _), (ranks, _) in plans.items() for r in ranks})
    stats = order_statistics(df, requests, bins, summaries) if requests else {}
    out: dict[str, dict[float, float]] = {c: dict.fromkeys(qs) for c in cols}
    for (c, q), (ranks, t) in plans.items():
        values = [stats[(c, r)] for r in ranks]
        out[c][q] = values[0] if len(set(values)) == 1 else _lerp(*values, t)
    return out


def exact_quantile(df: DataFrame, col: str, q: float, **kw) -> float | None:
    """Linear-interpolated quantile of the non-null values of ``col``."""
    return exact_quantiles(df, [col], [q], **kw)[col][q]


def approx_quantile(df: DataFrame, col: str, q: float, accuracy: int = 1_000_000) -> float | None:
    """percentile_approx: rank error at most n / accuracy, one pass."""
    return df.agg(F.percentile_approx(F.col(col), q, accuracy).alias("q")).first()["q"]
