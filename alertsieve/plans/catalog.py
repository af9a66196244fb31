"""Named queries: Spark builder + DuckDB twin (or none, for row checks).

Each builder takes ``(spark, sf_dir)``, reads the test tables under
``sf_dir`` through the library's sources and returns a lazy DataFrame laid
out by :func:`alertsieve.plans.output.finalize`.  Queries whose result
depends on a random forest, a model fit or a sampled estimate have no SQL
twin (``sql=None``) and are checked by row counts and property tests.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertsieve import config as C
from alertsieve.operators import features as FE
from alertsieve.operators import reports as R
from alertsieve.operators import roi as ROI
from alertsieve.operators import scoring as S
from alertsieve.operators.stats import duration_stats
from alertsieve.plans import oracle as O
from alertsieve.plans.output import finalize
from alertsieve.session import prepare, reliable_table
from alertsieve.sources.alerts import alerts_from_events, concat_alerts, normalize_timestamps


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None, nullable_ints: tuple = ()):
    """Register a query; ``nullable_ints`` are integer columns that may hold
    nulls and are therefore returned as doubles (both engines)."""
    def deco(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return finalize(fn(spark, sf_dir), as_double=nullable_ints)
        build.__name__ = fn.__name__
        build.__doc__ = fn.__doc__
        REGISTRY[name] = Query(name, build, sql)
        return fn
    return deco


# ---------------------------------------------------------------- inputs --

def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of the events table; the session may ask for more partitions
    than the file has splits (``alertsieve.scan.partitions``, unset: as scanned)."""
    wanted = spark.conf.get("alertsieve.scan.partitions", None)
    return normalize_timestamps(alerts_from_events(spark, sf_dir, int(wanted) if wanted else None))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FE.engineer_features(alerts(spark, sf_dir))[0]


def labelled_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels from the ensemble with the constant .5 anomaly score."""
    return S.fit_scoring(alerts(spark, sf_dir), anomaly="fallback")[1]


def labelled_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels from the full ensemble (isolation forest included)."""
    return S.fit_scoring(alerts(spark, sf_dir), anomaly="iforest", materialize=reliable_table)[1]


def _cols(*names_kinds: str) -> list[tuple[str, str]]:
    out = []
    for item in names_kinds:
        name, kind = item.split(":")
        out.append((name, kind))
    return out


TEMPORAL = _cols("year:n", "month:n", "day:n", "hour:n", "minute:n", "day_of_week:n",
                 "day_of_year:n", "week_of_year:n", "quarter:n", "is_weekend:i",
                 "is_month_start:i", "is_month_end:i", "hour_sin:d", "hour_cos:d",
                 "day_sin:d", "day_cos:d")
DURATION = _cols("duration_seconds:d", "duration_minutes:d", "duration_category:s",
                 "duration_log:d", "duration_sqrt:d", "duration_zscore:d")
CALENDAR = _cols("is_quincena:i", "is_fin_mes:i", "is_almuerzo:i", "is_reconciliacion:i",
                 "is_backup:i", "is_business_hours:i", "temporal_criticality:d")
TEXT = _cols("title_clean:s", "title_length:i", "title_word_count:i",
             *[f"has_{k}:i" for k in C.FP_KEYWORDS], "fp_keyword_score:i")
INTERACTION = _cols("hour_duration_product:d", "short_night_alert:i", "quincena_reconciliation:i")
PID = [("problemId", "s")]


def _names(cols):
    return [n for n, _ in cols]


def _select(df: DataFrame, cols) -> DataFrame:
    return df.select(*[F.col(n).cast("double").alias(n) if k == "n" else F.col(n) for n, k in cols])


def _sql(cols, src: str, ctes: str, tail: str = "") -> str:
    return O.with_(ctes, O.out(cols, src, tail))


# ------------------------------------------------- sources and features --

RAW_OUT = _cols("problemId:s", "displayId:s", "title:s", "severityLevel:s", "impactLevel:s",
                "startTime:t", "endTime:t", "status:s")


@register("normalize_timestamps", _sql(RAW_OUT, "alerts", O.ALERTS))
def q_normalize_timestamps(spark, sf_dir):
    """Epoch-ms start/end of every alert typed as UTC timestamps."""
    return _select(alerts(spark, sf_dir), RAW_OUT)


_UNION_SPLIT = "coalesce(severityLevel IN ('ERROR', 'AVAILABILITY'), false)"


@register("union_alerts", O.with_(O.ALERTS, f"""
  {O.out(RAW_OUT, 'alerts', 'WHERE ' + _UNION_SPLIT)}
  UNION ALL
  {O.out(RAW_OUT[:-1], 'alerts', 'WHERE NOT ' + _UNION_SPLIT).replace(' FROM alerts', ', NULL AS status FROM alerts')}"""))
def q_union_alerts(spark, sf_dir):
    """Two alert batches (one lacking ``status``) appended by column name."""
    a = alerts(spark, sf_dir)
    split = F.coalesce(F.col("severityLevel").isin("ERROR", "AVAILABILITY"), F.lit(False))
    first = a.where(split)
    second = a.where(~split).drop("status")
    return _select(concat_alerts(first, second), RAW_OUT)


@register("temporal_features", _sql(PID + TEMPORAL, "feat", O.FEATURES))
def q_temporal_features(spark, sf_dir):
    return _select(features(spark, sf_dir), PID + TEMPORAL)


@register("duration_features", _sql(PID + DURATION, "feat", O.FEATURES))
def q_duration_features(spark, sf_dir):
    return _select(features(spark, sf_dir), PID + DURATION)


@register("duration_bins", O.with_(O.FEATURES, """
  SELECT duration_category, count(*) AS "count" FROM feat GROUP BY duration_category"""))
def q_duration_bins(spark, sf_dir):
    """Alerts per duration bin (the exactly-zero bin is null)."""
    return features(spark, sf_dir).groupBy("duration_category").agg(F.count(F.lit(1)).alias("count"))


@register("calendar_features", _sql(PID + CALENDAR, "feat", O.FEATURES))
def q_calendar_features(spark, sf_dir):
    return _select(features(spark, sf_dir), PID + CALENDAR)


@register("text_features", _sql(PID + TEXT, "feat", O.FEATURES))
def q_text_features(spark, sf_dir):
    return _select(features(spark, sf_dir), PID + TEXT)


@register("interaction_features", _sql(PID + INTERACTION, "feat", O.FEATURES))
def q_interaction_features(spark, sf_dir):
    return _select(features(spark, sf_dir), PID + INTERACTION)


HOUR_FREQ = _cols("problemId:s", "hour:n", "hour_frequency:n", "hour_frequency_ratio:d")
DAY_FREQ = _cols("problemId:s", "day_of_week:n", "day_frequency:n")


@register("hour_frequency", _sql(HOUR_FREQ, "feat", O.FEATURES))
def q_hour_frequency(spark, sf_dir):
    return _select(features(spark, sf_dir), HOUR_FREQ)


@register("day_frequency", _sql(DAY_FREQ, "feat", O.FEATURES))
def q_day_frequency(spark, sf_dir):
    return _select(features(spark, sf_dir), DAY_FREQ)


DSTATS = _cols("n_rows:i", "duration_mean:d", "duration_std:d")


@register("duration_stats", _sql(DSTATS, "ds", O.FEATURES))
def q_duration_stats(spark, sf_dir):
    return duration_stats(FE.base_features(alerts(spark, sf_dir)))


# ------------------------------------------------------------- scoring --

def _scored_fallback(spark, sf_dir):
    feats = features(spark, sf_dir)
    return S.final_score(S.method_scores(feats, F.lit(C.ANOMALY_FALLBACK)))


for _m in ("rules", "statistical", "pattern"):
    def _mk(method):
        cols = _cols("problemId:s", f"score_{method}:d")

        @register(f"score_{method}", _sql(cols, "sc", O.SCORED))
        def q(spark, sf_dir):
            return _select(_scored_fallback(spark, sf_dir), cols)
        q.__doc__ = f"The {method} method score of every alert."
        return q
    _mk(_m)

ENSEMBLE = _cols("problemId:s", "fp_score_final:d")


@register("ensemble_fallback", _sql(ENSEMBLE, "fin", O.SCORED))
def q_ensemble_fallback(spark, sf_dir):
    """Weighted ensemble with the constant .5 anomaly score."""
    return _select(_scored_fallback(spark, sf_dir), ENSEMBLE)


@register("fp_threshold", _sql(_cols("fp_threshold:d"), "thr", O.SCORED))
def q_fp_threshold(spark, sf_dir):
    """75th percentile of the ensemble score (distributed exact quantile)."""
    t = S.fp_threshold(_scored_fallback(spark, sf_dir))
    return spark.range(1).select(F.lit(t).cast("double").alias("fp_threshold"))


LABEL = _cols("problemId:s", "fp_score_final:d", "is_false_positive:i")
CONF = _cols("problemId:s", "score_rules:d", "score_statistical:d", "score_anomaly:d",
             "score_pattern:d", "classification_confidence:d")


@register("label_fallback", _sql(LABEL, "labelled", O.SCORED))
def q_label_fallback(spark, sf_dir):
    return _select(labelled_fallback(spark, sf_dir), LABEL)


@register("confidence_fallback", _sql(CONF, "labelled", O.SCORED))
def q_confidence_fallback(spark, sf_dir):
    return _select(labelled_fallback(spark, sf_dir), CONF)


# ------------------------------------------------------------- reports --

@register("classification_summary", O.with_(O.SCORED, f"""
  SELECT count(*) AS total_alerts, CAST(sum(is_false_positive) AS BIGINT) AS fp_count,
         {O.rnd('avg(CAST(is_false_positive AS DOUBLE))')} AS fp_ratio,
         {O.rnd('avg(classification_confidence)')} AS avg_confidence
  FROM labelled"""))
def q_classification_summary(spark, sf_dir):
    return R.classification_summary(labelled_fallback(spark, sf_dir))


@register("fp_summary", O.with_(O.SCORED, f"""
  SELECT count(*) AS fp_count, {O.rnd('avg(classification_confidence)')} AS avg_confidence,
         {O.rnd('avg(duration_minutes)')} AS avg_duration,
         CAST(count(*) FILTER (WHERE classification_confidence > {O.dbl(C.HIGH_CONFIDENCE)}) AS BIGINT) AS high_confidence,
         strftime(min(startTime), '%Y-%m-%d %H:%M:%S.%f') AS first_start,
         strftime(max(startTime), '%Y-%m-%d %H:%M:%S.%f') AS last_start
  FROM fp"""))
def q_fp_summary(spark, sf_dir):
    return R.fp_summary(labelled_fallback(spark, sf_dir))


def _dist_sql(col: str, levels: bool) -> str:
    if levels:
        src = f"""(SELECT lv.{col}, coalesce(c.n, 0) AS n FROM
                   (SELECT DISTINCT {col} FROM labelled WHERE {col} IS NOT NULL) lv
                   LEFT JOIN (SELECT {col}, count(*) AS n FROM fp WHERE {col} IS NOT NULL GROUP BY {col}) c
                   ON lv.{col} = c.{col})"""
    else:
        src = f"(SELECT {col}, count(*) AS n FROM fp WHERE {col} IS NOT NULL GROUP BY {col})"
    return O.with_(O.SCORED, f"""
  SELECT d.{col}, CAST(d.n AS BIGINT) AS "count",
         {O.rnd('d.n / t.total * 100')} AS percentage
  FROM {src} d CROSS JOIN (SELECT count(*) AS total FROM fp) t""")


@register("severity_distribution", _dist_sql("severityLevel", True))
def q_severity_distribution(spark, sf_dir):
    """False alarms per severity, listing every severity level (0 if absent)."""
    return R.severity_distribution(labelled_fallback(spark, sf_dir))


@register("impact_distribution", _dist_sql("impactLevel", True))
def q_impact_distribution(spark, sf_dir):
    return R.impact_distribution(labelled_fallback(spark, sf_dir))


@register("hour_distribution", _dist_sql("hour", False))
def q_hour_distribution(spark, sf_dir):
    return R.hour_distribution(labelled_fallback(spark, sf_dir))


@register("first_hours", _dist_sql("hour", False) + " ORDER BY d.hour LIMIT 5")
def q_first_hours(spark, sf_dir):
    """The five smallest hour values among false alarms (as the report lists)."""
    return R.first_hours(labelled_fallback(spark, sf_dir))


@register("busiest_hours", _dist_sql("hour", False) + ' ORDER BY "count" DESC, d.hour LIMIT 5')
def q_busiest_hours(spark, sf_dir):
    """The five hours with most false alarms."""
    return R.busiest_hours(labelled_fallback(spark, sf_dir))


@register("pattern_analysis", O.with_(O.SCORED, f""",
hcount AS (SELECT title, hour, count(*) AS c FROM fp
           WHERE title IS NOT NULL AND hour IS NOT NULL GROUP BY title, hour),
hmode AS (SELECT title, hour AS most_common_hour FROM (
            SELECT *, row_number() OVER (PARTITION BY title ORDER BY c DESC, hour) AS rn FROM hcount)
          WHERE rn = 1),
agg AS (SELECT title, count(problemId) AS frequency, avg(duration_minutes) AS avg_duration,
               stddev_samp(duration_minutes) AS std_duration,
               avg(classification_confidence) AS avg_confidence,
               min(classification_confidence) AS min_confidence,
               max(classification_confidence) AS max_confidence
        FROM fp WHERE title IS NOT NULL GROUP BY title)
SELECT agg.title AS alert_title, CAST(frequency AS BIGINT) AS frequency,
       {O.rnd('avg_duration')} AS avg_duration, {O.rnd('std_duration')} AS std_duration,
       {O.rnd('avg_confidence')} AS avg_confidence, {O.rnd('min_confidence')} AS min_confidence,
       {O.rnd('max_confidence')} AS max_confidence, CAST(most_common_hour AS DOUBLE) AS most_common_hour
FROM agg LEFT JOIN hmode ON agg.title = hmode.title"""), nullable_ints=("most_common_hour",))
def q_pattern_analysis(spark, sf_dir):
    return R.pattern_analysis(labelled_fallback(spark, sf_dir))


@register("daily_trend", O.with_(O.SCORED, """
  SELECT strftime(CAST(startTime AS DATE), '%Y-%m-%d') AS "date", count(*) AS alerts,
         CAST(sum(is_false_positive) AS BIGINT) AS false_positives
  FROM labelled WHERE startTime IS NOT NULL GROUP BY CAST(startTime AS DATE)"""))
def q_daily_trend(spark, sf_dir):
    return R.daily_trend(labelled_fallback(spark, sf_dir))


@register("score_histogram", O.with_(O.SCORED, f""",
b0 AS (SELECT is_false_positive, min(fp_score_final) AS mn, max(fp_score_final) AS mx
       FROM labelled WHERE fp_score_final IS NOT NULL GROUP BY is_false_positive),
b AS (SELECT is_false_positive,
             CASE WHEN mx = mn THEN mn - 0.5 ELSE mn END AS lo,
             CASE WHEN mx = mn THEN mx + 0.5 ELSE mx END AS hi FROM b0),
binned AS (SELECT l.is_false_positive, lo, hi,
                  CAST(least(greatest(floor((fp_score_final - lo) / (hi - lo) * 30), 0), 29) AS BIGINT) AS bin
           FROM labelled l JOIN b ON l.is_false_positive = b.is_false_positive
           WHERE fp_score_final IS NOT NULL)
SELECT is_false_positive, bin, {O.rnd('any_value(lo) + bin * (any_value(hi) - any_value(lo)) / 30')} AS bin_start,
       {O.rnd('any_value(lo) + (bin + 1) * (any_value(hi) - any_value(lo)) / 30')} AS bin_end,
       count(*) AS "count"
FROM binned GROUP BY is_false_positive, bin"""))
def q_score_histogram(spark, sf_dir):
    """30-bin histogram of the final score per class (chart data)."""
    return R.score_histogram(labelled_fallback(spark, sf_dir))


def _flags_sql() -> str:
    parts = []
    for name, metric, op, thr, action in C.FP_PATTERNS:
        value = f"(SELECT avg(CAST({metric} AS DOUBLE)) FROM fp)"
        found = f"coalesce({value} {op} {O.dbl(thr)}, false)"
        parts.append(f"SELECT '{name}' AS pattern, '{metric}' AS metric, '{op}' AS comparison, "
                     f"{O.rnd(O.dbl(thr))} AS threshold, {O.rnd(value)} AS value, "
                     f"{found} AS found, '{action}' AS action")
    return O.with_(O.SCORED, "\n  UNION ALL\n  ".join(parts))


@register("fp_pattern_flags", _flags_sql())
def q_fp_pattern_flags(spark, sf_dir):
    return R.fp_pattern_flags(labelled_fallback(spark, sf_dir))


@register("top_fp", O.with_(O.SCORED, f"""
  SELECT substring(coalesce(problemId, 'N/A'), 1, 15) AS problem_id,
         coalesce(substring(title, 1, 80), 'N/A') AS title,
         coalesce(severityLevel, 'N/A') AS severity,
         CASE WHEN severityLevel IN ('CRITICAL', 'ERROR') THEN 'critical'
              WHEN severityLevel IN ('RESOURCE_CONTENTION') THEN 'warning' ELSE '' END AS severity_class,
         {O.rnd('duration_minutes')} AS duration_minutes, CAST(hour AS DOUBLE) AS hour,
         {O.rnd('fp_score_final')} AS fp_score_final,
         {O.rnd('classification_confidence')} AS classification_confidence,
         coalesce(classification_confidence > {O.dbl(C.HIGH_CONFIDENCE)}, false) AS high_confidence
  FROM fp ORDER BY round(classification_confidence, 9) DESC NULLS LAST, problemId LIMIT 20"""),
          nullable_ints=("hour",))
def q_top_fp(spark, sf_dir):
    """The 20 highest-confidence false alarms, laid out for review."""
    return R.top_fp(labelled_fallback(spark, sf_dir))


@register("top_titles", O.with_(O.SCORED, """
  SELECT substring(title, 1, 70) AS title, "count" FROM (
    SELECT title, count(*) AS "count" FROM fp WHERE title IS NOT NULL GROUP BY title
    ORDER BY "count" DESC, title LIMIT 10)"""))
def q_top_titles(spark, sf_dir):
    return R.top_titles(labelled_fallback(spark, sf_dir))


PROCESSED = _cols("problemId:s", "title:s", "startTime:t", "duration_minutes:d",
                  "is_false_positive:i", "fp_score_final:d", "classification_confidence:d")
DETAIL = _cols("problemId:s", "displayId:s", "title:s", "severityLevel:s", "impactLevel:s",
               "startTime:t", "endTime:t", "duration_minutes:d", "hour:n", "day_of_week:n",
               "fp_score_final:d", "classification_confidence:d", "status:s")


@register("processed_export", _sql(PROCESSED, "labelled", O.SCORED))
def q_processed_export(spark, sf_dir):
    """The processed-table export projection."""
    return R.processed_columns(labelled_fallback(spark, sf_dir))


@register("fp_detail", _sql(DETAIL, "fp", O.SCORED), nullable_ints=("hour", "day_of_week"))
def q_fp_detail(spark, sf_dir):
    """False alarms with their detail columns, highest confidence first."""
    return R.fp_detail(labelled_fallback(spark, sf_dir))


# ------------------------------------------------------------------ ROI --

def _roi_sql() -> str:
    fm = "(CAST(fp_detected AS DOUBLE) * 30.0::DOUBLE / 30.0::DOUBLE)"
    return O.with_(O.SCORED, f""",
cnt AS (SELECT CAST(sum(is_false_positive) AS BIGINT) AS fp_detected, count(*) AS total_alerts FROM labelled),
b AS (SELECT *, {fm} AS fp_monthly FROM cnt),
b2 AS (SELECT *, fp_monthly * 15.0::DOUBLE / 60.0::DOUBLE * 25.0::DOUBLE AS labor_savings,
              fp_monthly * 5.0::DOUBLE AS productivity_gain,
              fp_monthly * 0.01::DOUBLE * 500.0::DOUBLE AS sla_improvement,
              fp_monthly * 2.0::DOUBLE AS fatigue_reduction FROM b),
b3 AS (SELECT *, 0.0::DOUBLE + labor_savings + productivity_gain + sla_improvement + fatigue_reduction AS monthly_benefits,
              1800.0::DOUBLE AS monthly_costs FROM b2),
b4 AS (SELECT *, monthly_benefits - monthly_costs AS monthly_net_benefit FROM b3)
SELECT fp_detected, total_alerts, {O.rnd('fp_monthly')} AS fp_monthly,
       {O.rnd('labor_savings')} AS labor_savings, {O.rnd('productivity_gain')} AS productivity_gain,
       {O.rnd('sla_improvement')} AS sla_improvement, {O.rnd('fatigue_reduction')} AS fatigue_reduction,
       {O.rnd('monthly_benefits')} AS monthly_benefits, {O.rnd('monthly_costs')} AS monthly_costs,
       {O.rnd('monthly_net_benefit')} AS monthly_net_benefit,
       {O.rnd('monthly_net_benefit * 12')} AS annual_net_benefit,
       {O.rnd('monthly_net_benefit / 1800.0::DOUBLE * 100')} AS roi_percentage,
       {O.rnd('monthly_costs / greatest(monthly_net_benefit, 1.0::DOUBLE)')} AS payback_months,
       {O.rnd('fp_detected / total_alerts')} AS fp_ratio
FROM b4""")


@register("roi", _roi_sql())
def q_roi(spark, sf_dir):
    return ROI.roi(labelled_fallback(spark, sf_dir))


@register("roi_breakdown", O.with_(O.SCORED, f""",
cnt AS (SELECT CAST(sum(is_false_positive) AS DOUBLE) * 30.0::DOUBLE / 30.0::DOUBLE AS fm FROM labelled)
SELECT 'benefit' AS kind, 'labor_savings' AS category, {O.rnd('fm * 15.0::DOUBLE / 60.0::DOUBLE * 25.0::DOUBLE')} AS value FROM cnt
UNION ALL SELECT 'benefit', 'productivity_gain', {O.rnd('fm * 5.0::DOUBLE')} FROM cnt
UNION ALL SELECT 'benefit', 'sla_improvement', {O.rnd('fm * 0.01::DOUBLE * 500.0::DOUBLE')} FROM cnt
UNION ALL SELECT 'benefit', 'fatigue_reduction', {O.rnd('fm * 2.0::DOUBLE')} FROM cnt
UNION ALL SELECT 'cost', 'implementation', 1000.0::DOUBLE
UNION ALL SELECT 'cost', 'maintenance', 500.0::DOUBLE
UNION ALL SELECT 'cost', 'training', 300.0::DOUBLE"""))
def q_roi_breakdown(spark, sf_dir):
    return ROI.roi_breakdown(labelled_fallback(spark, sf_dir))


# ------------------------------------------------- forest (rows checks) --

@register("score_anomaly", None)
def q_score_anomaly(spark, sf_dir):
    """Isolation-forest anomaly score of every alert (min 0, max 1)."""
    return labelled_forest(spark, sf_dir).select("problemId", "score_anomaly")


@register("score_alerts", None)
def q_score_alerts(spark, sf_dir):
    """Full ensemble labelling (forest included) of every alert."""
    return labelled_forest(spark, sf_dir).select(
        "problemId", "score_rules", "score_statistical", "score_anomaly", "score_pattern",
        "fp_score_final", "is_false_positive", "classification_confidence")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.build for name, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in REGISTRY.items() if q.sql is not None}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern analysis over the false alarms of the full ensemble."""
    prepare(spark)
    return finalize(R.pattern_analysis(labelled_forest(spark, sf_dir)))


# ------------------------------------------------------------- ordering --

from alertsieve.operators import drift as DR  # noqa: E402
from alertsieve.operators import models as M  # noqa: E402
from alertsieve.operators import ordering as OR  # noqa: E402
from alertsieve.operators import selection as SEL  # noqa: E402
from alertsieve.operators.attribution import linear_attribution, shapley_ranking  # noqa: E402
from alertsieve.plans.output import sig_round  # noqa: E402

# The 41 numeric feature columns, in table order.
MODEL_FEATURES = (
    [n for n, _ in TEMPORAL] + ["duration_seconds", "duration_minutes", "duration_log",
                                "duration_sqrt", "duration_zscore"]
    + [n for n, _ in CALENDAR] + ["title_length", "title_word_count"]
    + [f"has_{k}" for k in C.FP_KEYWORDS] + ["fp_keyword_score", "hour_frequency",
                                             "hour_frequency_ratio", "day_frequency"]
    + [n for n, _ in INTERACTION])


def _check_features(df: DataFrame) -> list[str]:
    found = M.feature_columns(df)
    if found != MODEL_FEATURES:
        raise AssertionError(f"feature columns changed: {found}")
    return list(MODEL_FEATURES)


def _indexed_features(spark, sf_dir):
    feats = features(spark, sf_dir)
    # index (and write once) only the id, the order key and the model features
    return OR.global_row_index(feats.select("problemId", "startTime", *MODEL_FEATURES)), feats


@register("global_row_index", O.with_(O.ALERTS + ",\n" + O.ordered_index("alerts"),
                                      "SELECT problemId, row_idx FROM idx"))
def q_global_row_index(spark, sf_dir):
    """0-based position of every alert in time order (startTime, problemId)."""
    return OR.global_row_index(alerts(spark, sf_dir).select("problemId", "startTime")) \
        .select("problemId", "row_idx")


@register("temporal_split", O.with_(O.ALERTS + ",\n" + O.ordered_index("alerts"), f"""
  SELECT problemId, row_idx, CASE WHEN row_idx < {O.train_cut()} THEN 'train' ELSE 'test' END AS role
  FROM idx"""))
def q_temporal_split(spark, sf_dir):
    """First 70 % of alerts in time order train, the rest test."""
    idx = OR.global_row_index(alerts(spark, sf_dir).select("problemId", "startTime"))
    n = idx.count()
    train, test = OR.temporal_split(idx, n, C.TRAIN_FRACTION)
    return (train.select("problemId", "row_idx", F.lit("train").alias("role"))
            .unionByName(test.select("problemId", "row_idx", F.lit("test").alias("role"))))


@register("time_series_folds", O.with_(O.ALERTS + ",\n" + O.ordered_index("alerts") + """,
nn AS (SELECT count(*) AS n, count(*) // 6 AS size FROM idx),
folds AS (SELECT f AS fold, n - (5 - f) * size AS test_start, n - (5 - f) * size + size AS test_end,
                 n - (5 - f) * size - 168 AS train_end FROM nn, range(5) t(f))""", """
  SELECT CAST(fold AS BIGINT) AS fold, problemId, row_idx,
         CASE WHEN row_idx < train_end THEN 'train' ELSE 'test' END AS role
  FROM idx JOIN folds ON row_idx < train_end OR (row_idx >= test_start AND row_idx < test_end)"""))
def q_time_series_folds(spark, sf_dir):
    """Rolling-origin folds (5 folds, 168-row gap): fold membership rows."""
    idx = OR.global_row_index(alerts(spark, sf_dir).select("problemId", "startTime"))
    n = idx.count()
    return OR.time_series_folds(idx, n, C.CV_FOLDS, C.CV_GAP_ROWS).select("fold", "problemId", "row_idx", "role")


def _train_test(spark, sf_dir):
    idx, _ = _indexed_features(spark, sf_dir)
    n = idx.count()
    train, test = OR.temporal_split(idx, n, C.TRAIN_FRACTION)
    return train, test, n


_FEAT_IDX = O.FEATURES + ",\n" + O.ordered_index("feat")


def _long_sql(src: str, fill: bool = True) -> str:
    if fill:
        inner = O.filled(MODEL_FEATURES, src)
    else:
        inner = "SELECT " + ", ".join(f'CAST("{f}" AS DOUBLE) AS "{f}"' for f in MODEL_FEATURES) + f" FROM {src}"
    names = ", ".join(f'"{f}"' for f in MODEL_FEATURES)
    return f"(SELECT * FROM ({inner}) UNPIVOT INCLUDE NULLS (v FOR feature IN ({names})))"


@register("robust_scale", O.with_(_FEAT_IDX + f""",
tr AS (SELECT * FROM idx WHERE row_idx < {O.train_cut()}),
q AS (SELECT feature, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2,
             quantile_cont(v, 0.75) AS q3 FROM {_long_sql('tr')} GROUP BY feature)""", f"""
  SELECT feature, {O.rnd('q2')} AS center,
         {O.rnd(f'CASE WHEN q3 - q1 = 0 THEN {O.dbl(1)} ELSE q3 - q1 END')} AS scale FROM q"""))
def q_robust_scale(spark, sf_dir):
    """Median / IQR scaling constants fitted on the training rows (exact quantiles)."""
    train, _, _ = _train_test(spark, sf_dir)
    feats = _check_features(train)
    scaling = M.fit_robust_scaling(M.fill_features(train, feats), feats)
    return spark.createDataFrame(scaling.to_rows(), "feature string, center double, scale double")


@register("class_weights", O.with_(O.SCORED, """
  SELECT is_false_positive, count(*) AS n_class,
         (SELECT count(*) FROM labelled) / (2 * count(*)) AS class_weight
  FROM labelled GROUP BY is_false_positive"""))
def q_class_weights(spark, sf_dir):
    """Balanced class weights n / (2 n_class)."""
    return M.class_weight_table(labelled_fallback(spark, sf_dir))


_RULE_CUT = 0.3


@register("binary_metrics", O.with_(O.SCORED + f""",
pr AS (SELECT is_false_positive AS y, CASE WHEN score_rules >= {O.dbl(_RULE_CUT)} THEN 1 ELSE 0 END AS p,
              score_rules AS s FROM labelled),
c AS (SELECT count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp,
             count(*) FILTER (WHERE y = 0 AND p = 0) AS tn, count(*) FILTER (WHERE y = 1 AND p = 0) AS fn FROM pr),
m AS (SELECT *, CASE WHEN tp + fp + tn + fn = 0 THEN 0 ELSE (tp + tn) / (tp + fp + tn + fn) END AS accuracy,
             CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS prec,
             CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS rec FROM c),
g AS (SELECT s, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM pr GROUP BY s),
g2 AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
a AS (SELECT sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc FROM g2)""", f"""
  SELECT tp, fp, tn, fn, {O.rnd('accuracy')} AS accuracy, {O.rnd('prec')} AS precision,
         {O.rnd('rec')} AS recall,
         {O.rnd('CASE WHEN prec + rec = 0 THEN 0 ELSE 2 * prec * rec / (prec + rec) END')} AS f1,
         {O.rnd('auc')} AS auc
  FROM m CROSS JOIN a"""))
def q_binary_metrics(spark, sf_dir):
    """Rule score as a classifier of the ensemble labels: confusion counts,
    accuracy, precision, recall, F1 and exact ROC AUC."""
    lab = labelled_fallback(spark, sf_dir)
    pred = lab.select(F.col("is_false_positive").cast("double").alias("label"),
                      (F.col("score_rules") >= _RULE_CUT).cast("double").alias("prediction"),
                      F.col("score_rules").alias("p1"))
    return M.binary_metrics(pred)


@register("variance_profile", O.with_(O.FEATURES + f""",
vp AS (SELECT feature, var_pop(v) AS variance FROM {_long_sql('feat', fill=False)} GROUP BY feature)""",
                                      f"SELECT feature, {O.sig('variance')} AS variance FROM vp"))
def q_variance_profile(spark, sf_dir):
    """Population variance of every numeric feature (9 significant digits)."""
    feats = features(spark, sf_dir)
    cols = _check_features(feats)
    vp = SEL.variance_profile(feats, cols)
    return vp.select("feature", sig_round(F.col("variance")).alias("variance"))


def _corr_sql() -> str:
    pairs = [(a, b) for i, a in enumerate(MODEL_FEATURES) for b in MODEL_FEATURES[i + 1:]]
    aggs = ", ".join(f'corr("{a}", "{b}") AS "{a}|{b}"' for a, b in pairs)
    return O.with_(O.FEATURES + f""",
fl AS (SELECT {", ".join(f'CAST("{f}" AS DOUBLE) AS "{f}"' for f in MODEL_FEATURES)} FROM feat),
cp AS (SELECT * FROM (SELECT {aggs} FROM fl)
       UNPIVOT INCLUDE NULLS (c FOR pair IN ({", ".join(f'"{a}|{b}"' for a, b in pairs)})))""", f"""
  SELECT split_part(pair, '|', 1) AS feature_a, split_part(pair, '|', 2) AS feature_b,
         {O.rnd('CASE WHEN isnan(c) THEN NULL ELSE c END')} AS corr FROM cp""")


@register("correlation_pairs", _corr_sql())
def q_correlation_pairs(spark, sf_dir):
    """Pearson correlation of every feature pair (a before b); NaN -> null."""
    feats = features(spark, sf_dir)
    cols = _check_features(feats)
    cp = SEL.correlation_pairs(feats, cols)
    return cp.select("feature_a", "feature_b",
                     F.when(F.isnan("corr"), F.lit(None)).otherwise(F.col("corr")).alias("corr"))


@register("ks_statistic", O.with_(_FEAT_IDX + f""",
sides AS (SELECT *, CASE WHEN row_idx < {O.train_cut()} THEN 'ref' ELSE 'cur' END AS side FROM idx),
lr AS (SELECT 'ref' AS side, * FROM {_long_sql("(SELECT * FROM sides WHERE side = 'ref')")}),
lc AS (SELECT 'cur' AS side, * FROM {_long_sql("(SELECT * FROM sides WHERE side = 'cur')")}),
cnt AS (SELECT feature, v, count(*) FILTER (WHERE side = 'ref') AS c1,
               count(*) FILTER (WHERE side = 'cur') AS c2
        FROM (SELECT * FROM lr UNION ALL SELECT * FROM lc) GROUP BY feature, v),
cum AS (SELECT feature, sum(c1) OVER w AS cum1, sum(c2) OVER w AS cum2,
               sum(c1) OVER (PARTITION BY feature) AS n1, sum(c2) OVER (PARTITION BY feature) AS n2
        FROM cnt WINDOW w AS (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""", f"""
  SELECT feature, CAST(max(n1) AS BIGINT) AS n_ref, CAST(max(n2) AS BIGINT) AS n_cur,
         {O.rnd('max(abs(cum1 / n1 - cum2 / n2))')} AS d
  FROM cum GROUP BY feature"""))
def q_ks_statistic(spark, sf_dir):
    """Two-sample KS statistic of every feature: first 70 % vs last 30 %."""
    train, test, _ = _train_test(spark, sf_dir)
    feats = _check_features(train)
    return DR.ks_statistic(train, test, feats)


def _drift_sql() -> str:
    terms = ("list_sum(list_transform(range(1, 101), lambda i: (CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END)"
             " * exp(-2 * i * i * lam * lam)))")
    return _KS_CTES + f""",
kd AS (SELECT feature, CAST(max(n1) AS BIGINT) AS n_ref, CAST(max(n2) AS BIGINT) AS n_cur,
              max(abs(cum1 / n1 - cum2 / n2)) AS d FROM cum GROUP BY feature),
kl AS (SELECT *, d * sqrt(n_ref::DOUBLE * n_cur / (n_ref + n_cur)) AS lam FROM kd),
kp AS (SELECT *, CASE WHEN lam < {O.dbl(0.2)} THEN {O.dbl(1)}
                      ELSE least(1, greatest(0, 2 * {terms})) END AS p FROM kl)
SELECT feature, n_ref, n_cur, {O.rnd('d')} AS d, {O.rnd('p')} AS p_value,
       {O.rnd('min(p) OVER ()')} AS min_p, {O.rnd('max(p) OVER ()')} AS max_p,
       min(p) OVER () < {O.dbl(C.DRIFT_ALPHA)} / (count(*) OVER ()) AS drift_detected,
       p < {O.dbl(C.DRIFT_ALPHA)} / (count(*) OVER ()) AS feature_drift
FROM kp"""


_KS_SQL = REGISTRY["ks_statistic"].sql
_KS_CTES = _KS_SQL[:_KS_SQL.rindex("  SELECT feature, CAST(max(n1)")].rstrip()


@register("ks_drift", _drift_sql())
def q_ks_drift(spark, sf_dir):
    """KS drift test per feature with asymptotic p-values, Bonferroni decision."""
    train, test, _ = _train_test(spark, sf_dir)
    feats = _check_features(train)
    return DR.ks_drift(train, test, feats, C.DRIFT_ALPHA)


def _select_sql() -> str:
    pairs = REGISTRY["correlation_pairs"].sql
    ctes = pairs[:pairs.rindex("  SELECT split_part(pair")].rstrip()
    at = ", ".join(f"('{f}', {i})" for i, f in enumerate(MODEL_FEATURES))
    return ctes + f""",
pos(feature, position) AS (VALUES {at}),
vp AS (SELECT feature, var_pop(v) AS variance FROM {_long_sql('feat', fill=False)} GROUP BY feature),
varied AS (SELECT feature FROM vp WHERE variance > {O.dbl(C.VARIANCE_THRESHOLD)}),
twins AS (SELECT split_part(pair, '|', 2) AS feature FROM cp
          WHERE NOT isnan(c) AND abs(c) > {O.dbl(C.CORRELATION_THRESHOLD)}
            AND split_part(pair, '|', 1) IN (SELECT feature FROM varied))
SELECT feature, CAST(position AS BIGINT) AS position,
       feature IN (SELECT feature FROM varied) AND feature NOT IN (SELECT feature FROM twins) AS kept FROM pos"""


@register("select_features", _select_sql())
def q_select_features(spark, sf_dir):
    """Variance + correlation filter over the features (forced to run; the
    method only runs it above 50 numeric columns)."""
    feats = features(spark, sf_dir)
    cols = _check_features(feats)
    kept = set(SEL.select_features(feats, cols, force=True))
    rows = [(c, i, c in kept) for i, c in enumerate(cols)]
    return spark.createDataFrame(rows, "feature string, position int, kept boolean")


@register("selected_table", _sql(_cols("problemId:s", "title:s", "startTime:t", "endTime:t", "severityLevel:s",
                                       "impactLevel:s", "duration_minutes:d"), "feat", O.FEATURES))
def q_selected_table(spark, sf_dir):
    """The selection's table (A14): identifying text and time columns beside a
    selected feature."""
    feats = features(spark, sf_dir)
    return feats.select("problemId", *SEL.identity_columns(feats), "duration_minutes")


# ------------------------------------------- a wider input of the same rows --

def spread_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts with starts and ends moved by up to 400 days and every third
    title replaced by one of about 2,000, so that months, month ends, many
    titles and tied hours occur."""
    raw = alerts_from_events(spark, sf_dir)
    eid = F.substring("problemId", 3, 20).cast("long")
    shift = (eid * 37 % 400) * 86_400_000
    title = F.when(eid % 3 == 0, F.concat(F.lit("Title "), (eid * 7919 % 2003).cast("string"))).otherwise(F.col("title"))
    return normalize_timestamps(raw.withColumns({"startTime": F.col("startTime") + shift,
                                                 "endTime": F.col("endTime") + shift, "title": title}))


def _spread(sql: str, varied: bool = False) -> str:
    """The twin of a query over the wider input (and a varying anomaly score)."""
    wide = (O.RAW.replace("epoch_us(ts) // 1000", "(epoch_us(ts) // 1000 + (event_id * 37 % 400) * 86400000)")
            .replace(f"{O._TITLE} AS title", "CASE WHEN event_id % 3 = 0 THEN 'Title ' || CAST(event_id * 7919 % 2003 "
                     f"AS VARCHAR) ELSE {O._TITLE} END AS title"))
    assert O.RAW in sql and wide != O.RAW
    sql = sql.replace(O.RAW, wide)
    if varied:
        fixed = f"{O.dbl(C.ANOMALY_FALLBACK)} AS score_anomaly"
        assert fixed in sql
        sql = sql.replace(fixed, "(CAST(substr(problemId, 3) AS BIGINT) * 7907 % 1000) / 999.0::DOUBLE AS score_anomaly")
    return sql


def _spread_labelled(spark, sf_dir):
    """Labels over the wider input; the anomaly score varies with the event."""
    feats = FE.engineer_features(spread_alerts(spark, sf_dir))[0]
    anomaly = (F.substring("problemId", 3, 20).cast("long") * 7907 % 1000) / F.lit(999.0)
    scored = reliable_table(S.final_score(S.method_scores(feats, anomaly)), "spread_scores")
    return S.label(scored, S.fp_threshold(scored))


def _register_spread():
    def add(name, build, varied, nullable=()):
        def q(spark, sf_dir):
            return build(spark, sf_dir)
        q.__name__ = f"q_{name}_spread"
        q.__doc__ = f"``{name}`` over the wider input."
        register(f"{name}_spread", _spread(REGISTRY[name].sql, varied), nullable_ints=nullable)(q)

    for name, cols in (("temporal_features", PID + TEMPORAL), ("calendar_features", PID + CALENDAR),
                       ("text_features", PID + TEXT), ("hour_frequency", HOUR_FREQ), ("day_frequency", DAY_FREQ)):
        add(name, lambda s, d, cols=cols: _select(FE.engineer_features(spread_alerts(s, d))[0], cols), False)
    for name, cols in (("label_fallback", LABEL), ("confidence_fallback", CONF)):
        add(name, lambda s, d, cols=cols: _select(_spread_labelled(s, d), cols), True)
    add("pattern_analysis", lambda s, d: R.pattern_analysis(_spread_labelled(s, d)), True, ("most_common_hour",))
    add("top_titles", lambda s, d: R.top_titles(_spread_labelled(s, d)), True)
    add("daily_trend", lambda s, d: R.daily_trend(_spread_labelled(s, d)), True)


_register_spread()


# --------------------------------------------------------------- sources --

@register("duration_passthrough", """
SELECT 'P-' || CAST(event_id AS VARCHAR) AS "problemId",
       round(greatest(0, least(coalesce(CASE WHEN event_id % 7 = 0 THEN NULL ELSE value * 20 - 100 END, 5), 1440))::DOUBLE, 9)
           + 0.0 AS duration_minutes FROM events""")
def q_duration_passthrough(spark, sf_dir):
    """Cleaned durations of alerts that carry minutes but no times (D3)."""
    eid = F.substring("problemId", 3, 20).cast("long")
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.concat(F.lit("P-"), F.col("event_id").cast("string")).alias("problemId"), "value")
    given = F.when(eid % 7 != 0, F.col("value") * 20 - 100)
    return FE.clean_duration(ev.select("problemId", given.alias("duration_minutes")))


def _suite(spark, sf_dir, only=None):
    """The suite at its stated sizes, or the named models of it."""
    return M.model_suite(labelled_forest(spark, sf_dir), only=only)


@register("model_suite", None)
def q_model_suite(spark, sf_dir):
    """Four classifiers on the ensemble labels, 70/30 time split: metrics."""
    return _suite(spark, sf_dir).metrics


@register("temporal_cv", None)
def q_temporal_cv(spark, sf_dir):
    """Best classifier refitted on 5 rolling-origin folds (gap 168 rows): F1."""
    res = _suite(spark, sf_dir)
    spec = next(s for s in M.method_specs() if s.name == res.best)
    return M.temporal_cv(res.indexed, res.n_rows, res.features, spec, C.CV_FOLDS, C.CV_GAP_ROWS)


@register("attribution_ranking", None)
def q_attribution_ranking(spark, sf_dir):
    """Importance for the best classifier over the first 1,000 test rows,
    ranked: exact for boosted trees, else sampled (10 permutations, 500
    background rows)."""
    from alertsieve.plans.triage import best_attribution

    return best_attribution(_suite(spark, sf_dir))


@register("linear_attribution", None)
def q_linear_attribution(spark, sf_dir):
    """Exact log-odds attribution of the logistic regression, ranked."""
    res = _suite(spark, sf_dir, only=("LogisticRegression",))
    lr = res.trained[0].model
    feats = res.features
    test = res.scaling.transform(M.fill_features(res.test, feats), keep=())
    means_row = test.agg(*[F.avg(c).alias(c) for c in feats]).first()
    means = {c: means_row[c] for c in feats}
    return linear_attribution(test, feats, list(lr.coefficients.toArray()), means)


@register("model_roundtrip", O.with_(O.ALERTS + ",\n" + O.ordered_index("alerts"), f"""
  SELECT problemId, true AS equal FROM idx WHERE row_idx >= {O.train_cut()}"""))
def q_model_roundtrip(spark, sf_dir):
    """Save a classifier (the logistic regression) as a package, load it, score the test rows:
    predictions must equal the in-memory model's."""
    import uuid

    from alertsieve.session import ensure_checkpoint_dir

    res = _suite(spark, sf_dir, only=("LogisticRegression",))
    best = res.trained[0].model
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/alertsieve/package-{uuid.uuid4().hex}"
    M.save_model_package(path, best, res.features, res.scaling, metrics=res.metrics, name=res.best)
    pkg = M.load_model_package(spark, path)
    feats = res.test.select("problemId", *res.features)
    before = M.ModelPackage(best, res.features, res.scaling).predict(feats)
    after = pkg.predict(feats)
    return (before.join(after.withColumnRenamed("prediction", "prediction_loaded")
                        .withColumnRenamed("probability_fp", "probability_loaded"), "problemId")
            .select("problemId", ((F.col("prediction") == F.col("prediction_loaded"))
                                  & (F.col("probability_fp") == F.col("probability_loaded"))).alias("equal")))


def _csv_sql() -> str:
    from alertsieve.sources.alerts import CSV_NULL_TOKENS

    tokens = ", ".join("'" + t.replace("'", "''") + "'" for t in CSV_NULL_TOKENS)
    cols = []
    for name, kind in RAW_OUT:
        if kind == "s":
            cols.append(f'CASE WHEN "{name}" IN ({tokens}) THEN NULL ELSE "{name}" END AS "{name}"')
        else:
            cols.append(f'strftime("{name}", \'%Y-%m-%d %H:%M:%S.%f\') AS "{name}"')
    return O.with_(O.ALERTS, f"SELECT {', '.join(cols)} FROM alerts")


@register("csv_roundtrip", _csv_sql())
def q_csv_roundtrip(spark, sf_dir):
    """Alerts written as CSV (epoch-ms times, quoted text) and scanned back
    with the pinned-schema CSV reader."""
    import uuid

    from alertsieve.session import ensure_checkpoint_dir
    from alertsieve.sources.alerts import read_alerts_csv

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/alertsieve/alerts-csv-{uuid.uuid4().hex}"
    (alerts_from_events(spark, sf_dir).write.mode("overwrite").option("header", True)
     .option("escape", '"').option("quoteAll", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return _select(read_alerts_csv(spark, path), RAW_OUT)


@register("csv_union", _csv_sql())
def q_csv_union(spark, sf_dir):
    """Two CSV files with different column orders, read as one table."""
    import uuid

    from alertsieve.session import ensure_checkpoint_dir
    from alertsieve.sources.alerts import read_alerts_csv

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/alertsieve/alerts-csv-{uuid.uuid4().hex}"
    raw = alerts_from_events(spark, sf_dir)
    first = F.coalesce(F.col("impactLevel") == "SERVICES", F.lit(False))
    for rows in (raw.where(first), raw.where(~first).select(*reversed(raw.columns))):
        (rows.write.mode("append").option("header", True).option("escape", '"').option("quoteAll", True)
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return _select(read_alerts_csv(spark, path), RAW_OUT)


from alertsieve.plans import catalog_models  # noqa: E402,F401 - registers further queries
