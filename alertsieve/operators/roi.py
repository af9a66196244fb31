"""Return on investment of suppressing the detected false alarms.

One aggregate pass (false alarms, total) followed by arithmetic on the
one-row result; the formulas are the method's, evaluated in its order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertsieve import config as C
from alertsieve.config import DEFAULT, TriageConfig

BENEFITS = ("labor_savings", "productivity_gain", "sla_improvement", "fatigue_reduction")


def roi(df: DataFrame, cfg: TriageConfig = DEFAULT) -> DataFrame:
    counts = df.agg(F.coalesce(F.sum("is_false_positive"), F.lit(0)).cast("long").alias("fp_detected"),
                    F.count(F.lit(1)).alias("total_alerts"))
    fp = F.col("fp_detected").cast("double")
    monthly = fp * F.lit(C.MONTHLY_FACTOR) / F.lit(30.0)
    step = counts.select(
        "fp_detected", "total_alerts",
        monthly.alias("fp_monthly"),
    ).select(
        "*",
        (F.col("fp_monthly") * F.lit(cfg.minutes_per_alert) / F.lit(60.0)
         * F.lit(cfg.analyst_hourly_rate)).alias("labor_savings"),
        (F.col("fp_monthly") * F.lit(C.PRODUCTIVITY_PER_FP)).alias("productivity_gain"),
        (F.col("fp_monthly") * F.lit(C.SLA_RATE) * F.lit(cfg.sla_penalty)).alias("sla_improvement"),
        (F.col("fp_monthly") * F.lit(C.FATIGUE_PER_FP)).alias("fatigue_reduction"),
    )
    total_costs = 0.0
    for _, value in C.COSTS:
        total_costs += value
    benefits = F.lit(0.0)
    for b in BENEFITS:
        benefits = benefits + F.col(b)
    step = step.select("*", benefits.alias("monthly_benefits"),
                       F.lit(total_costs).alias("monthly_costs"))
    net = F.col("monthly_benefits") - F.col("monthly_costs")
    step = step.select("*", net.alias("monthly_net_benefit"))
    net = F.col("monthly_net_benefit")
    return step.select(
        "fp_detected", "total_alerts", "fp_monthly", *BENEFITS,
        "monthly_benefits", "monthly_costs", "monthly_net_benefit",
        (net * 12).alias("annual_net_benefit"),
        (net / F.lit(max(total_costs, 1.0)) * 100).alias("roi_percentage"),
        (F.col("monthly_costs") / F.greatest(net, F.lit(1.0))).alias("payback_months"),
        (F.col("fp_detected") / F.nullif("total_alerts", F.lit(0))).alias("fp_ratio"),
    )


def roi_breakdown(df: DataFrame, cfg: TriageConfig = DEFAULT) -> DataFrame:
    """Benefit and cost lines as long rows (kind, category, value)."""
    r = roi(df, cfg)
    items = []
    for b in BENEFITS:
        items += [F.lit("benefit"), F.lit(b), F.col(b)]
    for name, value in C.COSTS:
        items += [F.lit("cost"), F.lit(name), F.lit(value)]
    return r.select(F.stack(F.lit(len(BENEFITS) + len(C.COSTS)), *items)
                    .alias("kind", "category", "value"))
