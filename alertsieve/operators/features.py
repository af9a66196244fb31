"""Row-local feature projections (temporal, duration, calendar, text,
frequency, interaction).

Every family is one ``select`` of built-in expressions; Catalyst
collapses the chain into a single projection inside whole-stage codegen,
so the whole feature step is a map-only stage with no shuffle.  Families
guard on ``df.columns`` at plan-build time, as the method does: a missing
input column drops the features that need it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertsieve import config as C
from alertsieve.config import DEFAULT, TriageConfig
from alertsieve.functions import flag, in_range_flag, in_set_flag, strip_unicode, word_count
from alertsieve.operators.stats import AlertStats, fit_alert_stats, frequency_features

TWO_PI = 2 * math.pi


def temporal_features(df: DataFrame) -> DataFrame:
    """Calendar parts of startTime (Monday = 0, ISO week) and cyclic encodings."""
    if "startTime" not in df.columns:
        return df
    ts = F.col("startTime")
    hour = F.hour(ts)
    day = F.dayofmonth(ts)
    dow = F.weekday(ts)
    return df.select(
        "*",
        F.year(ts).alias("year"),
        F.month(ts).alias("month"),
        day.alias("day"),
        hour.alias("hour"),
        F.minute(ts).alias("minute"),
        dow.alias("day_of_week"),
        F.dayofyear(ts).alias("day_of_year"),
        F.weekofyear(ts).alias("week_of_year"),
        F.quarter(ts).alias("quarter"),
        in_set_flag(dow, (5, 6)).alias("is_weekend"),
        flag(day == 1).alias("is_month_start"),
        flag(F.last_day(ts) == F.to_date(ts)).alias("is_month_end"),
        F.sin(F.lit(TWO_PI) * hour / 24).alias("hour_sin"),
        F.cos(F.lit(TWO_PI) * hour / 24).alias("hour_cos"),
        F.sin(F.lit(TWO_PI) * day / 31).alias("day_sin"),
        F.cos(F.lit(TWO_PI) * day / 31).alias("day_cos"),
    )


def clean_duration(df: DataFrame) -> DataFrame:
    """duration_seconds (raw, may be negative) and cleaned duration_minutes.

    Minutes: missing or NaN -> 5, then clipped to [0, 1440] (fill before clip).
    Without start/end the given duration_minutes is cleaned the same way;
    with no duration information at all this raises.
    """
    lo, hi = C.DURATION_CLIP
    if "startTime" in df.columns and "endTime" in df.columns:
        secs = (F.unix_micros(F.col("endTime")) - F.unix_micros(F.col("startTime"))) / F.lit(1e6)
        minutes = secs / 60
        extra = [secs.alias("duration_seconds")]
    elif "duration_minutes" in df.columns:
        minutes = F.col("duration_minutes").cast("double")
        extra = []
    else:
        raise ValueError("alerts need startTime and endTime, or duration_minutes")
    filled = F.coalesce(F.when(~F.isnan(minutes), minutes), F.lit(C.DURATION_FILL_MINUTES))
    cleaned = F.greatest(F.lit(lo), F.least(filled, F.lit(hi)))
    others = [F.col(f"`{c}`") for c in df.columns if c not in ("duration_minutes", "duration_seconds")]
    return df.select(*others, *extra, cleaned.alias("duration_minutes"))


def duration_category(col, cfg: TriageConfig = DEFAULT) -> F.Column:
    """Right-closed bins (0,.5], (.5,1], ... (60,1440] by default; exactly 0 -> null."""
    edges, labels = cfg.duration_bin_edges, cfg.duration_bin_labels
    expr = None
    for i, label in enumerate(labels):
        cond = (col > edges[i]) & (col <= edges[i + 1])
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def duration_features(df: DataFrame, stats: AlertStats, cfg: TriageConfig = DEFAULT) -> DataFrame:
    """Bins, log1p, sqrt and z-score of the cleaned duration."""
    d = F.col("duration_minutes")
    mean = F.lit(stats.duration_mean).cast("double")
    std = F.lit(stats.duration_std).cast("double")
    return df.select(
        "*",
        duration_category(d, cfg).alias("duration_category"),
        F.log1p(d).alias("duration_log"),
        F.sqrt(d).alias("duration_sqrt"),
        ((d - mean) / (std + F.lit(C.ZSCORE_EPS))).alias("duration_zscore"),
    )


def calendar_features(df: DataFrame, cfg: TriageConfig = DEFAULT) -> DataFrame:
    """Pay-day, month-end, lunch, reconciliation, backup, business-hour flags."""
    cols = []
    if "day" in df.columns:
        day = F.col("day")
        cols += [in_set_flag(day, cfg.quincena_days).alias("is_quincena"),
                 in_set_flag(day, cfg.fin_mes_days).alias("is_fin_mes")]
    if "hour" in df.columns:
        hour = F.col("hour")
        cols += [in_set_flag(hour, cfg.lunch_hours).alias("is_almuerzo"),
                 in_set_flag(hour, cfg.reconciliation_hours).alias("is_reconciliacion"),
                 in_set_flag(hour, cfg.backup_hours).alias("is_backup"),
                 in_range_flag(hour, *cfg.business_hours).alias("is_business_hours")]
    out = df.select("*", *cols)
    names = set(out.columns)
    wq, wr, wb = C.CRITICALITY_WEIGHTS

    def part(name, w):
        return F.col(name) * F.lit(w) if name in names else F.lit(0.0)

    crit = part("is_quincena", wq) + part("is_reconciliacion", wr) + part("is_backup", wb)
    return out.select("*", crit.alias("temporal_criticality"))


def text_features(df: DataFrame, cfg: TriageConfig = DEFAULT) -> DataFrame:
    """Cleaned title, its length and word count, keyword flags and score."""
    if "title" not in df.columns:
        return df
    clean = strip_unicode(F.lower(F.coalesce(F.col("title"), F.lit(""))))
    out = df.select("*", clean.alias("title_clean"))
    tc = F.col("title_clean")
    flags = [flag(tc.contains(F.lit(kw))).alias(f"has_{kw}") for kw in cfg.keywords]
    out = out.select("*", F.char_length(tc).alias("title_length"),
                     word_count(tc).alias("title_word_count"), *flags)
    score = sum((F.col(f"has_{kw}") for kw in cfg.keywords[1:]), F.col(f"has_{cfg.keywords[0]}"))
    return out.select("*", score.alias("fp_keyword_score"))


def interaction_features(df: DataFrame) -> DataFrame:
    """hour x duration, short night alert, pay-day x reconciliation."""
    cols = []
    names = set(df.columns)
    if "hour" in names and "duration_minutes" in names:
        hour, d = F.col("hour"), F.col("duration_minutes")
        lo, hi = C.SHORT_NIGHT_HOURS
        cols += [(hour * d).alias("hour_duration_product"),
                 flag(hour.between(lo, hi) & (d < C.SHORT_NIGHT_MAX_MINUTES)).alias("short_night_alert")]
    if "is_quincena" in names and "is_reconciliacion" in names:
        cols.append((F.col("is_quincena") * F.col("is_reconciliacion")).alias("quincena_reconciliation"))
    return df.select("*", *cols) if cols else df


def base_features(raw: DataFrame) -> DataFrame:
    """Features that need no fitted statistics (input of ``fit_alert_stats``)."""
    return clean_duration(temporal_features(raw))


def engineer_features(raw: DataFrame, stats: AlertStats | None = None,
                      cfg: TriageConfig = DEFAULT) -> tuple[DataFrame, AlertStats]:
    """All feature families.  Fits the statistics (one job) unless given.

    Returns the lazy feature DataFrame and the statistics used, so the same
    statistics can later score new batches (or a stream) row-locally.
    """
    base = base_features(raw)
    if stats is None:
        stats = fit_alert_stats(base)
    out = duration_features(base, stats, cfg)
    out = calendar_features(out, cfg)
    out = text_features(out, cfg)
    out = frequency_features(out, stats)
    out = interaction_features(out)
    return out, stats
