"""Exact p-values by enumeration; drift by period against plain searches."""

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertsieve.operators import drift as DR


@pytest.mark.parametrize("n1, n2", [(1, 1), (2, 5), (4, 4), (5, 7), (12, 3), (6, 6)])
def test_exact_pvalue_by_enumeration(n1, n2):
    gaps = Counter()
    for steps in itertools.combinations(range(n1 + n2), n1):
        i = j = most = 0
        for k in range(n1 + n2):
            i, j = (i + 1, j) if k in steps else (i, j + 1)
            most = max(most, abs(i * n2 - j * n1))
        gaps[most] += 1
    total = sum(gaps.values())
    for g in gaps:
        want = sum(c for x, c in gaps.items() if x >= g) / total
        assert DR.exact_pvalue(g / (n1 * n2), n1, n2) == pytest.approx(want, rel=1e-12)
    assert DR.exact_pvalue(0.0, n1, n2) == 1.0


def test_exact_meets_the_series_and_small_p_keep_their_digits():
    n1, n2 = 900, 700
    lam = 1.3
    series = 2 * sum((-1) ** (i - 1) * np.exp(-2 * i * i * lam * lam) for i in range(1, 50))
    assert DR.exact_pvalue(lam / np.sqrt(n1 * n2 / (n1 + n2)), n1, n2) == pytest.approx(series, rel=0.08)
    from math import comb

    assert DR.exact_pvalue(1.0, 40, 60) == pytest.approx(2 / comb(100, 40), rel=1e-9)


def test_auto_uses_the_exact_value_for_small_samples(spark):
    rng = np.random.default_rng(1)
    ref = spark.createDataFrame([(float(x), 1.0) for x in rng.normal(size=30)], "a double, b double")
    cur = spark.createDataFrame([(float(x), 1.0) for x in rng.normal(size=20) + 0.8], "a double, b double")
    got = {r.feature: r for r in DR.ks_drift(ref, cur, ["a", "b"], method="auto").collect()}
    assert got["a"].p_value == pytest.approx(DR.exact_pvalue(got["a"].d, 30, 20)) and got["b"].p_value == 1.0
    with pytest.raises(ValueError):
        DR.ks_drift(ref, cur, ["a"], method="guess")


def test_periods_equal_single_tests(spark):
    """Each period's D is that of a test of its own; ties, gaps and constants included."""
    rng = np.random.default_rng(2)
    rows = [(int(p), float(rng.integers(0, 9)) + (p == 3) * 4, float(rng.normal()), None if i % 5 == 0 else 2.0)
            for p in range(5) for i in range(40 + 30 * p)]
    df = spark.createDataFrame(rows + [(None, 1.0, 1.0, 1.0)], "p int, ties double, cont double, odd double").repartition(4)
    ref, feats = df.where("p = 0"), ["ties", "cont", "odd"]
    got = {(r.feature, r.period): r for r in DR.ks_by_period(ref, df.where("p > 0 OR p IS NULL"), feats, F.col("p")).collect()}
    assert len(got) == 12
    for p in range(1, 5):
        for r in DR.ks_statistic(ref, df.where(F.col("p") == p), feats).collect():
            mine = got[(r.feature, str(p))]
            assert mine.d == pytest.approx(r.d, abs=1e-12) and (mine.n_ref, mine.n_cur) == (r.n_ref, r.n_cur)
    assert got[("ties", "3")].drift and not got[("ties", "1")].drift
    assert DR.ks_by_period(ref, df.where("false"), feats, F.col("p")).count() == 0
