"""Four scoring methods, their weighted ensemble, the label and confidence.

Fitting and applying are separate.  ``fit_scoring`` computes the global
state (feature statistics, forest, anomaly min/max, label threshold) with
a fixed number of Spark jobs; ``ScoringModel.transform`` is then a
map-only projection of row-local expressions with that state inlined as
literals, so it scales linearly, needs no shuffle, and also runs on a
streaming DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertsieve import config as C
from alertsieve.config import DEFAULT, TriageConfig
from alertsieve.functions import clip, clip_nullable, flag, popstd
from alertsieve.operators.features import engineer_features
from alertsieve.operators.iforest import IForestModel, fit_iforest, isolation_score
from alertsieve.operators.quantile import approx_quantile, exact_quantile
from alertsieve.operators.stats import AlertStats
from alertsieve.session import prepare, reliable_table

METHODS = ("rules", "statistical", "anomaly", "pattern")
SCORE_COLUMNS = tuple(f"score_{m}" for m in METHODS)
# Scores are rounded here before the quantile so that a last-bit difference
# between evaluation orders can never flip a whole tie group at the threshold.
SCORE_DIGITS = 12


def score_rules(df: DataFrame, cfg: TriageConfig = DEFAULT) -> Column:
    """Short duration, night window and keyword rules; max reachable .75."""
    names = set(df.columns)
    parts = []
    if "duration_minutes" in names:
        d = F.col("duration_minutes")
        (ultra, w_ultra), (short, w_short) = cfg.rule_ultra_short, cfg.rule_very_short
        parts.append(flag(d < ultra) * F.lit(w_ultra))
        parts.append(flag((d >= ultra) & (d < short)) * F.lit(w_short))
    if "is_reconciliacion" in names:
        parts.append(F.col("is_reconciliacion") * F.lit(cfg.rule_reconciliation))
    if "fp_keyword_score" in names:
        kw = clip(F.col("fp_keyword_score") / F.lit(float(max(len(cfg.keywords), 1))), 0.0, 1.0)
        parts.append(kw * F.lit(cfg.rule_keywords))
    return clip(_sum(parts), 0.0, 1.0)


def score_statistical(df: DataFrame, cfg: TriageConfig = DEFAULT) -> Column:
    """Rare hour and duration outlier; null hour -> null score."""
    names = set(df.columns)
    parts = []
    if "hour_frequency_ratio" in names:
        parts.append((F.lit(1.0) - F.col("hour_frequency_ratio")) * F.lit(cfg.stat_rare_hour))
    if "duration_zscore" in names:
        parts.append(flag(F.abs(F.col("duration_zscore")) > cfg.stat_zscore_limit)
                     * F.lit(cfg.stat_zscore_weight))
    return clip_nullable(_sum(parts), 0.0, 1.0)


def score_pattern(df: DataFrame, cfg: TriageConfig = DEFAULT) -> Column:
    """Short night alert and pay-day x reconciliation; max .7."""
    names = set(df.columns)
    parts = []
    if "short_night_alert" in names:
        parts.append(F.col("short_night_alert") * F.lit(cfg.pattern_short_night))
    if "quincena_reconciliation" in names:
        parts.append(F.col("quincena_reconciliation") * F.lit(cfg.pattern_quincena_recon))
    return clip(_sum(parts), 0.0, 1.0)


def _sum(parts: list[Column]) -> Column:
    if not parts:
        return F.lit(0.0)
    out = parts[0].cast("double")
    for p in parts[1:]:
        out = out + p
    return out


def ensemble(scores: dict[str, Column], weights: dict | None = None) -> Column:
    """Weighted sum in method order; unknown methods weigh .25; clipped."""
    weights = C.ENSEMBLE_WEIGHTS if weights is None else weights
    parts = [col * F.lit(weights.get(name, C.DEFAULT_METHOD_WEIGHT)) for name, col in scores.items()]
    return clip_nullable(_sum(parts), 0.0, 1.0)


def confidence(score_cols: list[Column]) -> Column:
    """1 - population std of the method scores / .5, clipped; null if any is null."""
    return clip_nullable(F.lit(1.0) - popstd(score_cols) / F.lit(C.CONFIDENCE_SCALE), 0.0, 1.0)


def anomaly_inputs(df: DataFrame) -> list[str]:
    return [f for f in C.IFOREST_FEATURES if f in df.columns]


def method_scores(df: DataFrame, anomaly: Column, cfg: TriageConfig = DEFAULT, extra: dict | None = None) -> DataFrame:
    """Adds score_rules, score_statistical, score_anomaly, score_pattern and
    ``score_<name>`` of each further method in ``extra`` ({name: function of
    the feature table giving a score column in [0, 1]})."""
    return df.select("*", score_rules(df, cfg).alias("score_rules"),
                     score_statistical(df, cfg).alias("score_statistical"),
                     anomaly.alias("score_anomaly"),
                     score_pattern(df, cfg).alias("score_pattern"),
                     *[make(df).cast("double").alias(f"score_{name}") for name, make in (extra or {}).items()])


def score_columns(extra=()) -> list[str]:
    return [*SCORE_COLUMNS, *(f"score_{name}" for name in extra or ())]


def final_score(df: DataFrame, cfg: TriageConfig = DEFAULT, extra=()) -> DataFrame:
    """Adds fp_score_final (the ensemble, rounded to 12 places)."""
    scores = {m: F.col(f"score_{m}") for m in (*METHODS, *(extra or ()))}
    return df.select("*", F.round(ensemble(scores, cfg.ensemble_weights), SCORE_DIGITS)
                     .alias("fp_score_final"))


def fp_threshold(df: DataFrame, cfg: TriageConfig = DEFAULT, col: str = "fp_score_final") -> float | None:
    """Score quantile at ``cfg.fp_threshold_percentile`` (linear, nulls skipped)."""
    q = cfg.fp_threshold_percentile / 100.0
    if cfg.quantile_method == "approx":
        return approx_quantile(df, col, q, cfg.quantile_accuracy)
    return exact_quantile(df, col, q)


def label(df: DataFrame, threshold: float | None, extra=()) -> DataFrame:
    """is_false_positive (score >= threshold; null -> 0) and the confidence."""
    t = F.lit(threshold).cast("double")
    return df.select(
        "*",
        flag(F.col("fp_score_final") >= t).alias("is_false_positive"),
        confidence([F.col(c) for c in score_columns(extra)]).alias("classification_confidence"),
    )


@dataclass(frozen=True)
class ScoringModel:
    """Everything fitted on a reference batch; applying it is row-local."""

    stats: AlertStats
    forest: IForestModel | None
    anomaly_min: float | None
    anomaly_max: float | None
    threshold: float | None
    cfg: TriageConfig = DEFAULT
    extra: dict | None = None  # further methods: code, so not part of a saved package

    def anomaly_column(self, df: DataFrame) -> Column:
        if self.forest is None:
            return F.lit(C.ANOMALY_FALLBACK)
        raw = isolation_score(df, self.forest)
        return normalise_anomaly(raw, self.anomaly_min, self.anomaly_max)

    def transform(self, raw: DataFrame) -> DataFrame:
        """Features, method scores, final score, label and confidence."""
        feats, _ = engineer_features(raw, self.stats, self.cfg)
        scored = final_score(method_scores(feats, self.anomaly_column(feats), self.cfg, self.extra), self.cfg, self.extra)
        return label(scored, self.threshold, self.extra)


def normalise_anomaly(raw: Column, lo: float | None, hi: float | None) -> Column:
    """(s - min) / (max - min) so the most isolated row scores 1.

    A constant score (max = min) has no ranking, so it falls back to .5.
    Rows scored later with frozen bounds are clipped to [0, 1].
    """
    if lo is None or hi is None or hi == lo:
        return F.lit(C.ANOMALY_FALLBACK)
    return clip((raw - F.lit(lo)) / F.lit(hi - lo), 0.0, 1.0)


def fit_scoring(raw: DataFrame, cfg: TriageConfig = DEFAULT, anomaly: str = "iforest",
                materialize=reliable_table, extra: dict | None = None) -> tuple[ScoringModel, DataFrame]:
    """Fit the scoring state on ``raw`` and return it with the scored batch.

    ``extra`` adds methods (see :func:`method_scores`); a method without a
    weight in ``cfg.ensemble_weights`` weighs .25.  ``anomaly="iforest"`` fits the forest; ``"fallback"`` uses the constant
    .5 anomaly score.  The scored table is written once (``materialize``: a
    reliable table in the checkpoint folder; None keeps it lazy), so the
    min/max and quantile passes read one stored column instead of re-reading
    the source and re-running the features and the forest.
    """
    prepare(raw.sparkSession)
    feats, stats = engineer_features(raw, None, cfg)
    forest, lo, hi = None, None, None
    if anomaly == "iforest" and len(anomaly_inputs(feats)) >= 2 and stats.n_rows > 0:
        forest = fit_iforest(feats, anomaly_inputs(feats), n_trees=cfg.iforest_trees,
                             max_samples=cfg.iforest_max_samples, seed=cfg.seed,
                             n_rows=stats.n_rows)
        with_raw = feats.select("*", isolation_score(feats, forest).alias("_iso"))
        if materialize is not None:
            with_raw = materialize(with_raw, "isolation_scores")
        mm = with_raw.agg(F.min("_iso").alias("lo"), F.max("_iso").alias("hi")).first()
        lo, hi = mm["lo"], mm["hi"]
        anomaly_col = normalise_anomaly(F.col("_iso"), lo, hi)
        scored = final_score(method_scores(with_raw, anomaly_col, cfg, extra), cfg, extra).drop("_iso")
    else:
        scored = final_score(method_scores(feats, F.lit(C.ANOMALY_FALLBACK), cfg, extra), cfg, extra)
        if materialize is not None:
            # threshold passes then read one Parquet column, not the source
            scored = materialize(scored, "scores")
    threshold = fp_threshold(scored, cfg)
    model = ScoringModel(stats, forest, lo, hi, threshold, cfg, extra)
    return model, label(scored, threshold, extra)
