"""Further named queries: tree attribution, unlimited forest, quantile state, drift by month."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertsieve import config as C
from alertsieve.operators import models as M
from alertsieve.operators import drift as DR
from alertsieve.operators import features as FE
from alertsieve.operators import selection as SEL
from alertsieve.operators import sketch as SK
from alertsieve.operators import stats as ST
from alertsieve.operators import tree_attribution as TA
from alertsieve.operators.trees import NODE_SCHEMA
from alertsieve.plans import oracle as O
from alertsieve.plans.catalog import (MODEL_FEATURES, REGISTRY, _check_features, _spread, _suite, features, labelled_fallback,
                                      register, spread_alerts)
from alertsieve.session import ensure_checkpoint_dir, reliable_table

#: A fixed tree: duration above 2 -> 0.1; else hour up to 5 -> 0.9, above -> 0.6.
_CUT_MINUTES, _CUT_HOUR, _LONG, _NIGHT, _DAY = 2.0, 5.0, 0.1, 0.9, 0.6


@register("tree_shapley", O.with_(O.FEATURES + f""",
r AS (SELECT "problemId", coalesce(duration_minutes, 0)::DOUBLE AS d, coalesce(hour, 0)::DOUBLE AS h FROM feat),
c AS (SELECT avg(CASE WHEN d <= 2 THEN 1 ELSE 0 END)::DOUBLE AS p_short,
             avg(CASE WHEN h <= 5 THEN 1 ELSE 0 END) FILTER (WHERE d <= 2)::DOUBLE AS p_night FROM r),
f AS (SELECT "problemId", p_short * (p_night * 0.9 + (1 - p_night) * 0.6) + (1 - p_short) * 0.1 AS f0,
             CASE WHEN d <= 2 THEN p_night * 0.9 + (1 - p_night) * 0.6 ELSE 0.1 END AS fd,
             p_short * (CASE WHEN h <= 5 THEN 0.9 ELSE 0.6 END) + (1 - p_short) * 0.1 AS fh,
             CASE WHEN d > 2 THEN 0.1 WHEN h <= 5 THEN 0.9 ELSE 0.6 END AS fdh FROM r, c)""", f"""
  SELECT "problemId", {O.rnd('((fd - f0) + (fdh - fh)) / 2')} AS duration_minutes,
         {O.rnd('((fh - f0) + (fdh - fd)) / 2')} AS hour, {O.rnd('f0')} AS base, {O.rnd('fdh')} AS prediction FROM f"""))
def q_tree_shapley(spark, sf_dir):
    """Exact Shapley values of a fixed two-split tree for every alert; its
    covers are counted on the alerts.  The twin writes out all coalitions."""
    rows = M.fill_features(features(spark, sf_dir), ["duration_minutes", "hour"], keep=["problemId"])
    rows = reliable_table(rows, "tree_shapley")
    short, night = F.col("duration_minutes") <= _CUT_MINUTES, F.col("hour") <= _CUT_HOUR
    n = rows.agg(F.count(F.lit(1)), F.count_if(short), F.count_if(short & night)).first()
    n, n_short, n_night = (float(x) for x in n)
    nodes = spark.createDataFrame([
        (0, 0, 0, _CUT_MINUTES, 1, 2, n, 0.0), (0, 1, 1, _CUT_HOUR, 3, 4, n_short, 0.0),
        (0, 2, -1, None, -1, -1, n - n_short, _LONG), (0, 3, -1, None, -1, -1, n_night, _NIGHT),
        (0, 4, -1, None, -1, -1, n_short - n_night, _DAY)], NODE_SCHEMA)
    return TA.tree_contributions(nodes, rows, ["duration_minutes", "hour"], id_col="problemId")


@register("tree_attribution", None)
def q_tree_attribution(spark, sf_dir):
    """Exact Shapley values of the boosted trees (100 rounds, depth 6) over the
    first 1,000 test rows: mean |value| a feature, ranked."""
    from alertsieve.plans.triage import tree_attribution

    suite = _suite(spark, sf_dir, only=("HistBoostDepth6",))
    return TA.attribution_ranking(tree_attribution(suite, "HistBoostDepth6"), suite.features)


@register("deep_forest", None)
def q_deep_forest(spark, sf_dir):
    """The random forest without a depth limit (100 trees): metrics on the test rows."""
    from dataclasses import replace

    return M.model_suite(labelled_fallback(spark, sf_dir), replace(C.DEFAULT, forest_depth=None), only=("RandomForest",)).metrics


_STATE_COLUMNS = ("duration_minutes", "fp_score_final", "title_length")
_STATE_QS = (0.05, 0.25, 0.5, 0.75, 0.99)


@register("quantile_state", O.with_(O.SCORED + f""",
v AS (SELECT * FROM (SELECT {", ".join(f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in _STATE_COLUMNS)} FROM labelled)
      UNPIVOT (v FOR "column" IN ({", ".join(f'"{c}"' for c in _STATE_COLUMNS)}))),
n AS (SELECT "column", count(*) AS n FROM v GROUP BY "column")""", f"""
  SELECT "column", q::DOUBLE AS q, n, true AS within
  FROM n CROSS JOIN (VALUES {", ".join(f"({q})" for q in _STATE_QS)}) AS t(q)"""))
def q_quantile_state(spark, sf_dir):
    """Quantiles from sketches of 50 batches, merged: for each, how many rows
    the state has seen and whether its true rank keeps the stated bound."""
    lab = reliable_table(labelled_fallback(spark, sf_dir).select("problemId", *_STATE_COLUMNS), "quantile_state")
    batches = lab.withColumn("batch", F.pmod(F.xxhash64("problemId"), F.lit(50)))
    state = SK.merge_states(SK.sketch_columns(batches, list(_STATE_COLUMNS), k=64, by="batch"), k=64)
    found = reliable_table(SK.state_quantiles(state, list(_STATE_QS), k=64), "quantile_answers")
    long = lab.select(F.stack(F.lit(len(_STATE_COLUMNS)), *[x for c in _STATE_COLUMNS for x in (
        F.lit(c), F.col(c).cast("double"))]).alias("column", "v")).where("v IS NOT NULL")
    # a few answers a column, at most columns x quantiles rows
    ranks = (long.join(F.broadcast(found), "column").groupBy("column", "q", "n", "rank_error")
             .agg(F.count_if(F.col("v") < F.col("value")).alias("below"), F.count_if(F.col("v") <= F.col("value")).alias("upto")))
    target = F.col("q") * (F.col("n") - 1)
    gap = F.greatest(F.col("below") - target, target - (F.col("upto") - 1), F.lit(0.0))
    return ranks.select("column", "q", "n", (gap <= F.col("rank_error") + 1).alias("within"))


_DRIFT_COLUMNS = ("duration_minutes", "hour", "fp_keyword_score", "title_length")


def _monthly_sql() -> str:
    """All values of the reference and of one month, sorted month by month."""
    long = " UNION ALL ".join(f"SELECT m, '{c}' AS feature, coalesce({c}, 0)::DOUBLE AS v FROM months" for c in _DRIFT_COLUMNS)
    terms = ("list_sum(list_transform(range(1, 101), lambda i: (CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END)"
             " * exp(-2 * i * i * lam * lam)))")
    return O.with_(O.FEATURES + f""",
months AS (SELECT *, strftime("startTime", '%Y-%m') AS m FROM feat WHERE "startTime" IS NOT NULL),
long AS ({long}),
ref AS (SELECT min(m) AS m0 FROM months),
cnt AS (SELECT p.m, l.feature, l.v, count(*) FILTER (WHERE l.m = m0) AS c1, count(*) FILTER (WHERE l.m = p.m) AS c2
        FROM long l, ref, (SELECT DISTINCT m FROM months) p
        WHERE p.m <> m0 AND (l.m = m0 OR l.m = p.m) GROUP BY ALL),
cum AS (SELECT m, feature, sum(c1) OVER w AS cum1, sum(c2) OVER w AS cum2,
               sum(c1) OVER (PARTITION BY m, feature) AS n1, sum(c2) OVER (PARTITION BY m, feature) AS n2
        FROM cnt WINDOW w AS (PARTITION BY m, feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
d AS (SELECT feature, m, max(n1)::BIGINT AS n_ref, max(n2)::BIGINT AS n_cur, max(abs(cum1 / n1 - cum2 / n2)) AS d
      FROM cum GROUP BY feature, m),
lam AS (SELECT *, d * sqrt(n_ref::DOUBLE * n_cur / (n_ref + n_cur)) AS lam FROM d),
p AS (SELECT *, CASE WHEN lam < 0.2 THEN 1.0::DOUBLE ELSE least(1, greatest(0, 2 * {terms})) END AS p FROM lam)""", f"""
  SELECT feature, m AS period, n_ref, n_cur, {O.rnd('d')} AS d, {O.rnd('p')} AS p_value,
         p < 0.05::DOUBLE / (count(*) OVER ()) AS drift FROM p""")


@register("ks_drift_monthly", _spread(_monthly_sql()))
def q_ks_drift_monthly(spark, sf_dir):
    """Every later month of the wider input against its first month."""
    feats = reliable_table(FE.engineer_features(spread_alerts(spark, sf_dir))[0].where("startTime IS NOT NULL").select(
        F.date_format("startTime", "yyyy-MM").alias("month"), *_DRIFT_COLUMNS), "drift_months")
    first = F.lit(feats.agg(F.min("month")).first()[0])
    return DR.ks_by_period(feats.where(F.col("month") == first), feats.where(F.col("month") != first),
                           list(_DRIFT_COLUMNS), F.col("month"), C.DRIFT_ALPHA)


@register("incremental_stats", REGISTRY["duration_stats"].sql)
def q_incremental_stats(spark, sf_dir):
    """``duration_stats`` from the states of ten batches, added one by one."""
    import uuid

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/alertsieve/alert-state-{uuid.uuid4().hex}"
    feats = reliable_table(features(spark, sf_dir).select("problemId", "hour", "day_of_week", "duration_minutes"), "state_batches")
    for i in range(10):
        got = ST.add_batch(path, feats.where(F.pmod(F.xxhash64("problemId"), F.lit(10)) == i), f"batch-{i}")
    return spark.createDataFrame([(got.n_rows, got.duration_mean, got.duration_std)],
                                 "n_rows long, duration_mean double, duration_std double")


def _selected_sql() -> str:
    """Values of the kept features, a row a value, from the selection's own twin."""
    chosen = REGISTRY["select_features"].sql
    at = chosen.rindex("SELECT feature, CAST(position AS BIGINT)")
    names = ", ".join(f'"{f}"' for f in MODEL_FEATURES)
    values = ", ".join(f'CAST("{f}" AS DOUBLE) AS "{f}"' for f in MODEL_FEATURES)
    return chosen[:at].rstrip() + f""",
chosen AS ({chosen[at:]})
SELECT "problemId", feature, {O.rnd('v')} AS value
FROM (SELECT "problemId", {values} FROM feat) UNPIVOT INCLUDE NULLS (v FOR feature IN ({names}))
JOIN chosen USING (feature) WHERE kept"""


@register("selected_values", _selected_sql())
def q_selected_values(spark, sf_dir):
    """The selection's table (A14), its features unpivoted: which are kept is
    decided by the data."""
    feats = features(spark, sf_dir)
    table = SEL.selected_table(feats, _check_features(feats), force=True)
    kept = [c for c in table.columns if c not in ("problemId", *SEL.identity_columns(feats))]
    return table.select("problemId", F.stack(F.lit(len(kept)), *[x for c in kept for x in (F.lit(c), F.col(c).cast("double"))])
                        .alias("feature", "value"))
