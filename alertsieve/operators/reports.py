"""Report tables over a labelled alert DataFrame.

All are aggregates with map-side partial aggregation; the outputs are
small (per hour, per title, per day, per bin) and stay DataFrames, so a
caller can write them anywhere; nothing is collected.

The false-alarm subset is selected INSIDE the aggregates (``count_if``,
``avg(when(fp, x))``) and groups without false alarms are dropped after
aggregation.  A row filter on ``is_false_positive`` would be pushed by
the optimizer below the projection that computes the label, inlining the
whole scoring expression into the filter and evaluating it twice per row
(once to filter, once to project); conditional aggregation evaluates it
once, wherever the label comes from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertsieve import config as C
from alertsieve.functions import available


def false_positives(df: DataFrame) -> DataFrame:
    return df.where(F.col("is_false_positive") == 1)


def classification_summary(df: DataFrame) -> DataFrame:
    """Total alerts, false alarms, their share, mean confidence (nulls skipped)."""
    fp = F.col("is_false_positive")
    return df.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        F.sum(fp).cast("long").alias("fp_count"),
        F.avg(fp.cast("double")).alias("fp_ratio"),
        F.avg("classification_confidence").alias("avg_confidence"),
    )


def _is_fp() -> Column:
    return F.col("is_false_positive") == 1


def _fp(col) -> Column:
    """The value on false-alarm rows, null elsewhere (aggregates skip it)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(_is_fp(), c)


def fp_summary(df: DataFrame) -> DataFrame:
    """One row over the false alarms: count, means, high-confidence count, period."""
    conf = F.col("classification_confidence")
    return df.agg(
        F.count_if(_is_fp()).alias("fp_count"),
        F.avg(_fp(conf)).alias("avg_confidence"),
        F.avg(_fp("duration_minutes")).alias("avg_duration"),
        F.count_if(_is_fp() & (conf > F.lit(C.HIGH_CONFIDENCE))).alias("high_confidence"),
        F.min(_fp("startTime")).alias("first_start"),
        F.max(_fp("startTime")).alias("last_start"),
    )


def distribution(df: DataFrame, col: str, all_levels: bool = False) -> DataFrame:
    """Counts and percentages of ``col`` among the false alarms of ``df``.

    With ``all_levels`` every non-null level present in the whole table is
    listed, with count 0 when no false alarm has it (categorical
    semantics).  Percentages divide by all false alarms, nulls included.
    """
    # One aggregation feeds both the per-level counts and the total (the
    # null group counts in the total only), so the data is scanned and
    # scored once.  The total is a window sum over the AGGREGATED table --
    # one row per level, i.e. the report's own rows -- not over the data;
    # predicates after the window cannot be pushed below it.
    grouped = df.groupBy(col).agg(F.count_if(_is_fp()).alias("count"))
    with_total = grouped.select("*", F.sum("count").over(Window.partitionBy()).alias("_total"))
    counts = with_total.where(F.col(col).isNotNull())
    if not all_levels:
        counts = counts.where(F.col("count") > 0)
    return counts.select(col, "count", (F.col("count") / F.col("_total") * 100).alias("percentage"))


def severity_distribution(df: DataFrame) -> DataFrame:
    return distribution(df, "severityLevel", all_levels=True)


def impact_distribution(df: DataFrame) -> DataFrame:
    return distribution(df, "impactLevel", all_levels=True)


def hour_distribution(df: DataFrame) -> DataFrame:
    return distribution(df, "hour")


def first_hours(df: DataFrame, k: int = C.FIRST_HOURS) -> DataFrame:
    """The k smallest hour values among false alarms, with counts (as reported)."""
    return hour_distribution(df).orderBy("hour").limit(k)


def busiest_hours(df: DataFrame, k: int = C.FIRST_HOURS) -> DataFrame:
    """The k hours with most false alarms (ties: smaller hour first)."""
    return hour_distribution(df).orderBy(F.desc("count"), "hour").limit(k)


def pattern_analysis(df: DataFrame) -> DataFrame:
    """Per alert title among false alarms: frequency, duration and confidence
    statistics, most common hour (ties -> smallest).  Null titles excluded.

    Counted by (title, hour) first, so the most common hour is a maximum over
    at most 25 rows a title and every step is a hash aggregation with a
    map-side part; means and deviations are merged from centred moments.
    """
    conf, minutes = _fp("classification_confidence"), _fp("duration_minutes")
    hours = (df.where(F.col("title").isNotNull()).groupBy(F.col("title").alias("alert_title"), "hour")
             .agg(F.count_if(_is_fp()).alias("fps"), F.count(_fp("problemId")).alias("n"),
                  F.count(minutes).alias("n_min"), F.sum(minutes).alias("s_min"),
                  (F.var_pop(minutes) * F.count(minutes)).alias("m2"),
                  F.count(conf).alias("n_conf"), F.sum(conf).alias("s_conf"),
                  F.min(conf).alias("lo"), F.max(conf).alias("hi"))
             .where("fps > 0"))
    title = Window.partitionBy("alert_title")  # at most 25 rows, dealt as the aggregation after it
    mean = F.col("s_min") / F.col("n_min")
    centre = F.sum("s_min").over(title) / F.sum("n_min").over(title)
    # count and hour in one number: the largest is the most common hour, the smallest of ties
    rank = F.when(F.col("hour").isNotNull(), F.col("fps") * 32 + (24 - F.col("hour")))
    merged = (hours.withColumn("m2", F.col("m2") + F.col("n_min") * F.pow(mean - centre, F.lit(2.0)))
              .withColumn("busiest", rank.cast("long")).groupBy("alert_title")
              .agg(F.sum("n").alias("frequency"), F.sum("s_min").alias("s"), F.sum("n_min").alias("w"),
                   F.sum("m2").alias("m2"), F.sum("s_conf").alias("sc"), F.sum("n_conf").alias("nc"),
                   F.min("lo").alias("min_confidence"), F.max("hi").alias("max_confidence"),
                   F.max("busiest").alias("busiest")))
    # one value has no sample deviation
    deviation = F.when(F.col("w") > 1, F.sqrt(F.col("m2") / (F.col("w") - 1)))
    return (merged.select("alert_title", "frequency", (F.col("s") / F.nullif("w", F.lit(0))).alias("avg_duration"),
                          deviation.alias("std_duration"), (F.col("sc") / F.nullif("nc", F.lit(0))).alias("avg_confidence"),
                          "min_confidence", "max_confidence",
                          (24 - F.col("busiest") % 32).cast("int").alias("most_common_hour"))
            .orderBy(F.desc("frequency"), "alert_title"))


def daily_trend(df: DataFrame) -> DataFrame:
    """Alerts and false alarms per calendar day (rows without start dropped)."""
    return (df.where(F.col("startTime").isNotNull())
            .groupBy(F.to_date("startTime").alias("date"))
            .agg(F.count(F.lit(1)).alias("alerts"),
                 F.sum("is_false_positive").cast("long").alias("false_positives"))
            .orderBy("date"))


def score_histogram(df: DataFrame, bins: int = C.SCORE_HISTOGRAM_BINS) -> DataFrame:
    """Equal-width histogram of fp_score_final per class over the class's own
    [min, max]; the last bin is closed.  A constant class is centred in a
    unit-wide range, as the usual histogram routine does.  Empty bins are
    not listed."""
    s = F.col("fp_score_final")
    scored = df
    bounds = (scored.groupBy("is_false_positive").agg(F.min(s).alias("_min"), F.max(s).alias("_max"))
              .where(F.col("_min").isNotNull()))
    lo = F.when(F.col("_max") == F.col("_min"), F.col("_min") - 0.5).otherwise(F.col("_min"))
    hi = F.when(F.col("_max") == F.col("_min"), F.col("_max") + 0.5).otherwise(F.col("_max"))
    bounds = bounds.select("is_false_positive", lo.alias("lo"), hi.alias("hi"))
    # At most two classes: the bounds table has <= 2 rows.
    joined = scored.join(F.broadcast(bounds), "is_false_positive")
    raw_bin = F.floor((s - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    b = F.when(s.isNotNull(), F.least(F.greatest(raw_bin, F.lit(0)), F.lit(bins - 1)).cast("int"))
    return (joined.groupBy("is_false_positive", b.alias("bin"))
            .agg(F.count(F.lit(1)).alias("count"), F.first("lo").alias("lo"),
                 F.first("hi").alias("hi"))
            .where(F.col("bin").isNotNull())
            .select("is_false_positive", "bin",
                    (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("bin_start"),
                    (F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / bins).alias("bin_end"),
                    "count")
            .orderBy("is_false_positive", "bin"))


def fp_pattern_flags(df: DataFrame) -> DataFrame:
    """The five false-alarm patterns, tested on the means over false alarms.

    One aggregate pass computes all five means; ``stack`` turns them into
    one row per pattern (pattern, metric, comparison, threshold, value,
    found, action).  A pattern whose metric column is absent is skipped.
    """
    present = [p for p in C.FP_PATTERNS if p[1] in df.columns]
    if not present:
        return df.sparkSession.createDataFrame(
            [], "pattern string, metric string, comparison string, threshold double, "
                "value double, found boolean, action string")
    means = df.agg(*[F.avg(_fp(F.col(p[1]).cast("double"))).alias(f"m{i}") for i, p in enumerate(present)])
    rows = []
    for i, (name, metric, op, thr, action) in enumerate(present):
        rows += [F.lit(name), F.lit(metric), F.lit(op), F.lit(float(thr)), F.col(f"m{i}"), F.lit(action)]
    stacked = means.select(F.stack(F.lit(len(present)), *rows).alias(
        "pattern", "metric", "comparison", "threshold", "value", "action"))
    found = F.coalesce(
        F.when(F.col("comparison") == "<", F.col("value") < F.col("threshold"))
        .otherwise(F.col("value") > F.col("threshold")), F.lit(False))
    return stacked.select("pattern", "metric", "comparison", "threshold", "value",
                          found.alias("found"), "action")


def _rank_key(conf: Column) -> Column:
    """Confidence compared at 1e-9: equal values computed along different
    arithmetic paths must tie (and fall back to problemId) in any engine."""
    return F.round(conf, 9)


def _severity_class(sev: Column) -> Column:
    return (F.when(sev.isin(list(C.CRITICAL_SEVERITIES)), "critical")
            .when(sev.isin(list(C.WARNING_SEVERITIES)), "warning").otherwise(""))


def top_fp(df: DataFrame, k: int = C.TOP_FP_ROWS) -> DataFrame:
    """The k false alarms with highest confidence (ties by problemId), laid
    out for review: ids and titles cut, severity class, high-confidence flag."""
    conf = F.col("classification_confidence")
    # False alarms sort first, so the k-row cut followed by the filter keeps
    # exactly the top false alarms (the filter cannot move below a limit).
    top = (df.orderBy(F.desc("is_false_positive"), F.desc_nulls_last(_rank_key(conf)), "problemId")
           .limit(k).where(_is_fp()))
    title = F.coalesce(F.substring("title", 1, C.TITLE_CHARS), F.lit("N/A"))
    return top.select(
        F.substring(F.coalesce(F.col("problemId"), F.lit("N/A")), 1, C.PROBLEM_ID_CHARS).alias("problem_id"),
        title.alias("title"),
        F.coalesce(F.col("severityLevel"), F.lit("N/A")).alias("severity"),
        _severity_class(F.col("severityLevel")).alias("severity_class"),
        F.col("duration_minutes"),
        F.col("hour"),
        F.col("fp_score_final"),
        conf.alias("classification_confidence"),
        F.coalesce(conf > F.lit(C.HIGH_CONFIDENCE), F.lit(False)).alias("high_confidence"),
    )


def top_titles(df: DataFrame, k: int = C.TOP_TITLES) -> DataFrame:
    """The k most frequent false-alarm titles (ties by title), cut to 70 chars."""
    counts = (df.groupBy("title").agg(F.count_if(_is_fp()).alias("count"))
              .where(F.col("title").isNotNull() & (F.col("count") > 0)))
    top = counts.orderBy(F.desc("count"), "title").limit(k)
    return top.select(F.substring("title", 1, C.TOP_TITLE_CHARS).alias("title"), "count")


def processed_columns(df: DataFrame) -> DataFrame:
    """The export projection of the processed table (columns present only)."""
    return df.select(*available(df, C.PROCESSED_EXPORT_COLUMNS))


def fp_detail(df: DataFrame) -> DataFrame:
    """False alarms with the detail columns, highest confidence first."""
    fp = false_positives(df)
    return (fp.select(*available(fp, C.FP_DETAIL_COLUMNS))
            .orderBy(F.desc_nulls_last(_rank_key(F.col("classification_confidence"))), "problemId"))
