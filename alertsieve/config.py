"""Configuration of the alert-triage engine.

Every field here is read by some operator; nothing is decorative.  The
values marked FIXED VALUES are the ones the results depend on; they are
the defaults of the method being reproduced and are kept together, in
natural order, so that a reader can check them at a glance.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES (defaults of the method; results depend on them)
# ---------------------------------------------------------------------------

# False-alarm keywords searched in the cleaned title.
FP_KEYWORDS = ("network", "timeout", "synthetic", "availability")

# Pay-day ("quincena") and month-end days of the month.
QUINCENA_DAYS = (14, 15, 16, 29, 30, 31)
FIN_MES_DAYS = (28, 29, 30, 31, 1, 2, 3)

# Hours of the day for the operational windows.
LUNCH_HOURS = (12, 13, 14)
RECONCILIATION_HOURS = (0, 1, 2, 3, 4, 5)
BACKUP_HOURS = (0, 1, 2, 3)
BUSINESS_HOURS = (9, 17)          # inclusive range
SHORT_NIGHT_HOURS = (0, 6)        # inclusive range
SHORT_NIGHT_MAX_MINUTES = 2.0     # strictly below

# Duration handling (minutes).
DURATION_FILL_MINUTES = 5.0
DURATION_CLIP = (0.0, 1440.0)
ZSCORE_EPS = 0.001
# Right-closed bins; a duration of exactly 0 falls in no bin (null).
DURATION_BIN_EDGES = (0.0, 0.5, 1.0, 5.0, 15.0, 60.0, 1440.0)
DURATION_BIN_LABELS = ("ultra_short", "very_short", "short", "medium", "long", "very_long")

# Temporal criticality weights (quincena, reconciliation, backup).
CRITICALITY_WEIGHTS = (0.3, 0.4, 0.3)

# Rule score: ultra short (< .5 min), very short (.5 <= d < 2), night window, keywords.
RULE_ULTRA_SHORT = (0.5, 0.3)
RULE_VERY_SHORT = (2.0, 0.2)
RULE_RECONCILIATION = 0.25
RULE_KEYWORDS = 0.2

# Statistical score: rare hour, duration outlier (|z| > 2).
STAT_RARE_HOUR = 0.3
STAT_ZSCORE_LIMIT = 2.0
STAT_ZSCORE_WEIGHT = 0.2

# Pattern score: short night alert, pay-day x reconciliation.
PATTERN_SHORT_NIGHT = 0.4
PATTERN_QUINCENA_RECON = 0.3

# Ensemble weights; a method not listed gets DEFAULT_METHOD_WEIGHT.
ENSEMBLE_WEIGHTS = {"rules": 0.35, "statistical": 0.25, "anomaly": 0.25, "pattern": 0.15}
DEFAULT_METHOD_WEIGHT = 0.25
# Anomaly score when fewer than two anomaly inputs exist.
ANOMALY_FALLBACK = 0.5
# Confidence = 1 - popstd(method scores) / CONFIDENCE_SCALE.
CONFIDENCE_SCALE = 0.5

# Labelling: alerts at or above this percentile of the final score are false alarms.
FP_THRESHOLD_PERCENTILE = 75

# Isolation forest (Liu, Ting, Zhou 2008) defaults.
IFOREST_TREES = 100
IFOREST_MAX_SAMPLES = 256
IFOREST_FEATURES = ("duration_minutes", "hour", "fp_keyword_score")

# Report thresholds.
HIGH_CONFIDENCE = 0.9
SCORE_HISTOGRAM_BINS = 30
TOP_FP_ROWS = 20
TOP_TITLES = 10
FIRST_HOURS = 5
PROBLEM_ID_CHARS = 15
TITLE_CHARS = 80
TOP_TITLE_CHARS = 70
CRITICAL_SEVERITIES = ("CRITICAL", "ERROR")
WARNING_SEVERITIES = ("RESOURCE_CONTENTION",)

# Five false-alarm patterns checked on the means of the false alarms:
# (name, metric column, comparison, threshold, action).
FP_PATTERNS = (
    ("Ultra-Short Duration Alerts", "duration_minutes", "<", 2.0,
     "Alert only after a problem has lasted for a minimum time"),
    ("Reconciliation Window Alerts", "is_reconciliacion", ">", 0.5,
     "Mute alerts during the nightly reconciliation"),
    ("Weekend Maintenance Activity", "is_weekend", ">", 0.3,
     "Suppress alerts while planned weekend work runs"),
    ("Network/Timeout Keywords", "fp_keyword_score", ">", 2.0,
     "Filter alerts whose titles name known noisy checks"),
    ("Quincena Load Spikes", "is_quincena", ">", 0.2,
     "Use separate baselines for pay days"),
)

# ROI model (USD).
MINUTES_PER_ALERT = 15.0
ANALYST_HOURLY_RATE = 25.0
SLA_PENALTY = 500.0
SLA_RATE = 0.01
PRODUCTIVITY_PER_FP = 5.0
FATIGUE_PER_FP = 2.0
MONTHLY_FACTOR = 30.0
COSTS = (("implementation", 1000.0), ("maintenance", 500.0), ("training", 300.0))

# Models and validation.
TRAIN_FRACTION = 0.7
CV_FOLDS = 5
CV_GAP_ROWS = 168
SEED = 42
SHAP_SAMPLE = 1000
SHAP_BACKGROUND = 500
SHAP_PERMUTATIONS = 10
MODEL_TREES = 100
MODEL_ROUNDS = 100
FOREST_DEPTH = 30                 # the most Spark's trees allow; the method sets no limit
DRIFT_ALPHA = 0.05
VARIANCE_THRESHOLD = 0.01
CORRELATION_THRESHOLD = 0.95
SELECTION_MIN_COLUMNS = 50

# Columns written by the exports.
PROCESSED_EXPORT_COLUMNS = (
    "problemId", "title", "startTime", "duration_minutes",
    "is_false_positive", "fp_score_final", "classification_confidence",
)
FP_DETAIL_COLUMNS = (
    "problemId", "displayId", "title", "severityLevel", "impactLevel",
    "startTime", "endTime", "duration_minutes", "hour", "day_of_week",
    "fp_score_final", "classification_confidence", "status",
)
# Identifier and text columns kept next to a selected feature list.
IDENTITY_COLUMNS = ("title", "startTime", "endTime", "severityLevel", "impactLevel")


@dataclass(frozen=True)
class TriageConfig:
    """User-facing parameters; defaults reproduce the method."""

    keywords: tuple = FP_KEYWORDS
    quincena_days: tuple = QUINCENA_DAYS
    fin_mes_days: tuple = FIN_MES_DAYS
    lunch_hours: tuple = LUNCH_HOURS
    reconciliation_hours: tuple = RECONCILIATION_HOURS
    backup_hours: tuple = BACKUP_HOURS
    business_hours: tuple = BUSINESS_HOURS
    duration_bin_edges: tuple = DURATION_BIN_EDGES
    duration_bin_labels: tuple = DURATION_BIN_LABELS
    # rule score: (minutes, weight) of the two short durations, then plain weights
    rule_ultra_short: tuple = RULE_ULTRA_SHORT
    rule_very_short: tuple = RULE_VERY_SHORT
    rule_reconciliation: float = RULE_RECONCILIATION
    rule_keywords: float = RULE_KEYWORDS
    stat_rare_hour: float = STAT_RARE_HOUR
    stat_zscore_limit: float = STAT_ZSCORE_LIMIT
    stat_zscore_weight: float = STAT_ZSCORE_WEIGHT
    pattern_short_night: float = PATTERN_SHORT_NIGHT
    pattern_quincena_recon: float = PATTERN_QUINCENA_RECON
    ensemble_weights: dict = field(default_factory=lambda: dict(ENSEMBLE_WEIGHTS))
    fp_threshold_percentile: float = FP_THRESHOLD_PERCENTILE
    # "exact": distributed exact quantile (bounded memory per task);
    # "approx": percentile_approx with `quantile_accuracy`.
    quantile_method: str = "exact"
    quantile_accuracy: int = 1_000_000
    iforest_trees: int = IFOREST_TREES
    iforest_max_samples: int = IFOREST_MAX_SAMPLES
    seed: int = SEED
    minutes_per_alert: float = MINUTES_PER_ALERT
    analyst_hourly_rate: float = ANALYST_HOURLY_RATE
    sla_penalty: float = SLA_PENALTY
    train_fraction: float = TRAIN_FRACTION
    cv_folds: int = CV_FOLDS
    cv_gap_rows: int = CV_GAP_ROWS
    cv_gap_hours: float | None = None     # a gap in time in place of rows
    # attribution: rows explained, background rows drawn by hash, permutations a row
    shap_sample: int = SHAP_SAMPLE
    shap_background: int = SHAP_BACKGROUND
    shap_permutations: int = SHAP_PERMUTATIONS
    model_trees: int = MODEL_TREES
    model_rounds: int = MODEL_ROUNDS
    forest_depth: int | None = FOREST_DEPTH   # None: without a limit (the library's own forest)
    drift_alpha: float = DRIFT_ALPHA
    variance_threshold: float = VARIANCE_THRESHOLD
    correlation_threshold: float = CORRELATION_THRESHOLD
    selection_min_columns: int = SELECTION_MIN_COLUMNS


DEFAULT = TriageConfig()
