"""End-to-end triage run: fit once, write the labelled table once, report.

This is the method's whole batch flow (load, features, scoring and
labelling, ROI, report tables) arranged for a cluster:

1. ``fit_scoring`` fits the statistics, the forest and the threshold
   (a fixed number of jobs; raw forest scores written once);
2. the labelled table is written once as Parquet (``out_dir/labelled``,
   or the checkpoint folder), so every report reads only the columns it
   needs from it instead of recomputing features and scores;
3. every report table is computed from that table and written next to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertsieve.config import DEFAULT, TriageConfig
from alertsieve.operators import models as M
from alertsieve.operators import reports as R
from alertsieve.operators.attribution import shapley_ranking
from alertsieve.operators.drift import ks_drift
from alertsieve.operators.roi import roi, roi_breakdown
from alertsieve.operators.scoring import ScoringModel, fit_scoring
from alertsieve.operators.tree_attribution import attribution_ranking, tree_contributions
from alertsieve.operators.trees import spark_tree_nodes
from alertsieve.session import reliable_table
from alertsieve.sources import sinks
from alertsieve.sources.sinks import write_table

REPORTS = {
    "classification_summary": R.classification_summary,
    "fp_summary": R.fp_summary,
    "severity_distribution": R.severity_distribution,
    "impact_distribution": R.impact_distribution,
    "hour_distribution": R.hour_distribution,
    "first_hours": R.first_hours,
    "busiest_hours": R.busiest_hours,
    "pattern_analysis": R.pattern_analysis,
    "daily_trend": R.daily_trend,
    "score_histogram": R.score_histogram,
    "fp_pattern_flags": R.fp_pattern_flags,
    "top_fp": R.top_fp,
    "top_titles": R.top_titles,
    "roi": roi,
    "roi_breakdown": roi_breakdown,
}


def run_triage(raw: DataFrame, out_dir: str | None = None, cfg: TriageConfig = DEFAULT,
               anomaly: str = "iforest") -> tuple[ScoringModel, DataFrame, dict[str, DataFrame]]:
    """Score ``raw`` and build every report table.

    With ``out_dir`` the labelled table goes to ``out_dir/labelled`` and each
    report to ``out_dir/<name>`` (Parquet); otherwise the labelled table is
    kept in the checkpoint folder and the reports are returned lazily.
    """
    model, labelled = fit_scoring(raw, cfg, anomaly=anomaly, materialize=reliable_table)
    if out_dir:
        write_table(labelled, f"{out_dir}/labelled")
        table = raw.sparkSession.read.parquet(f"{out_dir}/labelled")
    else:
        table = reliable_table(labelled, "labelled")
    reports = {name: fn(table, cfg) if name.startswith("roi") else fn(table) for name, fn in REPORTS.items()}
    if out_dir:
        for name, df in reports.items():
            write_table(df, f"{out_dir}/{name}")
    return model, table, reports


def explained_rows(suite: M.SuiteResult, cfg: TriageConfig = DEFAULT) -> DataFrame:
    """The first ``cfg.shap_sample`` test rows, scaled, with ``row_idx``."""
    first = suite.test.agg(F.min("row_idx")).first()[0]
    return _scaled(suite, suite.test).where(F.col("row_idx") < F.lit((first or 0) + cfg.shap_sample))


def _scaled(suite: M.SuiteResult, rows: DataFrame) -> DataFrame:
    return suite.scaling.transform(M.fill_features(rows, suite.features, keep=["row_idx"]), keep=["row_idx"])


def tree_attribution(suite: M.SuiteResult, name: str, cfg: TriageConfig = DEFAULT) -> DataFrame:
    """Exact Shapley values of one of the suite's tree models for the explained
    rows: ``row_idx``, a column a feature, ``base``, ``prediction`` (P(class 1)
    of a random forest; the margin, without the model's constant, of boosted
    trees)."""
    model = next(t for t in suite.trained if t.name == name).model
    rows = explained_rows(suite, cfg)
    nodes = model.node_table(rows.sparkSession) if hasattr(model, "node_table") else spark_tree_nodes(model)
    return tree_contributions(nodes, rows, suite.features, id_col="row_idx")


def best_attribution(suite: M.SuiteResult, cfg: TriageConfig = DEFAULT) -> DataFrame:
    """Ranking of the suite's best model over the first ``cfg.shap_sample``
    test rows: exact for boosted trees, sampled Shapley values of P(class 1)
    for other models."""
    best = next(t for t in suite.trained if t.name == suite.best).model
    feats = suite.features
    if hasattr(best, "node_table"):
        return attribution_ranking(tree_attribution(suite, suite.best, cfg), feats)
    explained = explained_rows(suite, cfg)
    return shapley_ranking(best, explained, _scaled(suite, suite.train), feats, permutations=cfg.shap_permutations,
                           seed=cfg.seed, id_col="row_idx", background_rows=cfg.shap_background)


def run_all(raw: DataFrame, out_dir: str, cfg: TriageConfig = DEFAULT, anomaly: str = "iforest") -> dict[str, DataFrame]:
    """The whole method: scoring and reports, model suite, temporal
    cross-validation, attribution, drift, exports and the model package.

    Every result is written below ``out_dir``; returns them by name.  All
    sizes and thresholds come from ``cfg``.
    """
    spark = raw.sparkSession
    model, table, out = run_triage(raw, out_dir, cfg, anomaly)
    suite = M.model_suite(table, cfg)
    out["model_metrics"] = suite.metrics
    spec = next(s for s in M.method_specs(cfg) if s.name == suite.best)
    out["cross_validation"] = M.temporal_cv(suite.indexed, suite.n_rows, suite.features, spec, cfg.cv_folds,
                                            cfg.cv_gap_rows, gap_hours=cfg.cv_gap_hours)
    out["attribution"] = best_attribution(suite, cfg)
    out["drift"] = ks_drift(suite.train, suite.test, suite.features, cfg.drift_alpha)
    for name in ("model_metrics", "cross_validation", "attribution", "drift"):
        write_table(out[name], f"{out_dir}/{name}")
        out[name] = spark.read.parquet(f"{out_dir}/{name}")
    sinks.export_processed(table, f"{out_dir}/export_processed")
    sinks.export_fp_detail(table, f"{out_dir}/export_detail")
    sinks.export_patterns(out["pattern_analysis"], f"{out_dir}/export_patterns")
    sinks.export_attribution(out["attribution"], f"{out_dir}/export_attribution")
    best = next(t for t in suite.trained if t.name == suite.best).model
    M.save_model_package(f"{out_dir}/package", best, suite.features, suite.scaling, model, suite.metrics, suite.best,
                         out["attribution"])
    return out
