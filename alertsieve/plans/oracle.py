"""DuckDB twins of the catalogue queries (the correctness oracle).

Only the base test tables are registered on the DuckDB side, so each
statement rebuilds the alert table from ``events`` in a CTE and then
re-derives the features, scores and reports in plain SQL, written
independently of the Spark code.  Doubles are DOUBLE on both sides
(``::DOUBLE`` literals: a bare ``0.3`` is DECIMAL in DuckDB), integers
BIGINT, timestamps formatted text, and doubles rounded to 9 places by the
final projection, exactly as :mod:`alertsieve.plans.output` does on the
Spark side.
"""

from __future__ import annotations

from alertsieve import config as C

DP = 9  # decimal places of every double in a catalogue result


def dbl(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def flag(cond: str) -> str:
    return f"CAST(coalesce({cond}, false) AS BIGINT)"


def clip(expr: str, lo: float = 0.0, hi: float = 1.0) -> str:
    return f"(CASE WHEN ({expr}) IS NULL THEN NULL ELSE greatest({dbl(lo)}, least(({expr}), {dbl(hi)})) END)"


def rnd(expr: str) -> str:
    """Round to DP places; negative zero becomes zero."""
    r = f"round(CAST({expr} AS DOUBLE), {DP})"
    return f"(CASE WHEN {r} = 0 THEN CAST(0.0 AS DOUBLE) ELSE {r} END)"


def in_list(values) -> str:
    return "(" + ", ".join(str(v) for v in values) + ")"


def out(cols: list[tuple[str, str]], src: str, tail: str = "") -> str:
    """Final projection: d = double (rounded), i = bigint, n = integer that
    may be null (as double, like a pandas column with gaps), s = text,
    t = timestamp text, date = date text, b = boolean."""
    sel = []
    for name, kind in cols:
        q = f'"{name}"'
        if kind == "d":
            sel.append(f"{rnd(q)} AS {q}")
        elif kind == "i":
            sel.append(f"CAST({q} AS BIGINT) AS {q}")
        elif kind == "n":
            sel.append(f"CAST({q} AS DOUBLE) AS {q}")
        elif kind == "t":
            sel.append(f"strftime({q}, '%Y-%m-%d %H:%M:%S.%f') AS {q}")
        elif kind == "date":
            sel.append(f"strftime({q}, '%Y-%m-%d') AS {q}")
        else:
            sel.append(q)
    return f"SELECT {', '.join(sel)} FROM {src} {tail}"


_TITLE = f"""CASE WHEN event_id % 1009 = 0 THEN NULL
             WHEN event_id % 12 = 0 THEN 'Network timeout on synthetic availability monitor'
             WHEN event_id % 12 IN (1, 2) THEN 'Network availability degraded'
             WHEN event_id % 12 IN (3, 4) THEN '  Synthetic monitor TIMEOUT '
             WHEN event_id % 12 = 5 THEN 'Availability drop'
             WHEN event_id % 12 IN (6, 7) THEN 'High CPU saturation'
             WHEN event_id % 12 = 8 THEN 'Failure rate increase'
             WHEN event_id % 12 = 9 THEN 'Response time degradation'
             WHEN event_id % 12 = 10 THEN 'Low disk space'
             ELSE '' END"""

RAW = f"""raw AS (
  SELECT 'P-' || CAST(event_id AS VARCHAR) AS problemId,
         'D' || CAST(event_id % 1000 AS VARCHAR) AS displayId,
         {_TITLE} AS title,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'AVAILABILITY'
              WHEN 'signup' THEN 'PERFORMANCE' WHEN 'view' THEN 'RESOURCE_CONTENTION'
              WHEN 'click' THEN 'CUSTOM_ALERT' END AS severityLevel,
         CASE user_id % 3 WHEN 0 THEN 'APPLICATION' WHEN 1 THEN 'SERVICES'
              ELSE 'INFRASTRUCTURE' END AS impactLevel,
         CASE WHEN event_id % 997 = 0 THEN NULL ELSE epoch_us(ts) // 1000 END AS startTime,
         CASE WHEN event_id % 97 = 0 THEN NULL ELSE epoch_us(ts) // 1000 +
              CASE WHEN event_id % 211 = 0 THEN 90000000 WHEN event_id % 101 = 0 THEN -60000
                   WHEN event_id % 103 = 0 THEN 0 WHEN event_id % 107 = 0 THEN 30000
                   ELSE CAST(floor(value * value * 250) AS BIGINT) END END AS endTime,
         CASE WHEN event_id % 97 = 0 THEN 'OPEN' ELSE 'CLOSED' END AS status
  FROM events)"""

ALERTS = f"""{RAW},
alerts AS (
  SELECT problemId, displayId, title, severityLevel, impactLevel,
         make_timestamp(startTime * 1000) AS startTime,
         make_timestamp(endTime * 1000) AS endTime, status
  FROM raw)"""

_BINS = " ".join(
    f"WHEN duration_minutes > {dbl(C.DURATION_BIN_EDGES[i])} AND duration_minutes <= {dbl(C.DURATION_BIN_EDGES[i + 1])} THEN '{lab}'"
    for i, lab in enumerate(C.DURATION_BIN_LABELS))

FEATURES = f"""{ALERTS},
t1 AS (
  SELECT *, year(startTime) AS year, month(startTime) AS month, day(startTime) AS day,
         hour(startTime) AS hour, minute(startTime) AS minute,
         isodow(startTime) - 1 AS day_of_week, dayofyear(startTime) AS day_of_year,
         weekofyear(startTime) AS week_of_year, quarter(startTime) AS quarter
  FROM alerts),
t2 AS (
  SELECT *, {flag('day_of_week IN (5, 6)')} AS is_weekend,
         {flag('day = 1')} AS is_month_start,
         {flag('last_day(startTime) = CAST(startTime AS DATE)')} AS is_month_end,
         sin(2 * pi() * hour / 24) AS hour_sin, cos(2 * pi() * hour / 24) AS hour_cos,
         sin(2 * pi() * day / 31) AS day_sin, cos(2 * pi() * day / 31) AS day_cos,
         (epoch_us(endTime) - epoch_us(startTime)) / 1e6 AS duration_seconds
  FROM t1),
d1 AS (
  SELECT *, greatest({dbl(0)}, least(coalesce(duration_seconds / 60, {dbl(5)}), {dbl(1440)})) AS duration_minutes
  FROM t2),
ds AS (SELECT count(*) AS n_rows, avg(duration_minutes) AS duration_mean,
              stddev_samp(duration_minutes) AS duration_std FROM d1),
hc AS (SELECT hour AS hc_hour, count(*) AS hour_frequency FROM d1 WHERE hour IS NOT NULL GROUP BY hour),
dc AS (SELECT day_of_week AS dc_dow, count(*) AS day_frequency FROM d1
       WHERE day_of_week IS NOT NULL GROUP BY day_of_week),
f1 AS (
  SELECT d1.*, CASE {_BINS} END AS duration_category,
         ln(1 + duration_minutes) AS duration_log, sqrt(duration_minutes) AS duration_sqrt,
         (duration_minutes - ds.duration_mean) / (ds.duration_std + {dbl(C.ZSCORE_EPS)}) AS duration_zscore,
         {flag('day IN ' + in_list(C.QUINCENA_DAYS))} AS is_quincena,
         {flag('day IN ' + in_list(C.FIN_MES_DAYS))} AS is_fin_mes,
         {flag('hour IN ' + in_list(C.LUNCH_HOURS))} AS is_almuerzo,
         {flag('hour IN ' + in_list(C.RECONCILIATION_HOURS))} AS is_reconciliacion,
         {flag('hour IN ' + in_list(C.BACKUP_HOURS))} AS is_backup,
         {flag(f'hour BETWEEN {C.BUSINESS_HOURS[0]} AND {C.BUSINESS_HOURS[1]}')} AS is_business_hours,
         regexp_replace(lower(coalesce(title, '')), '^\\s+|\\s+$', '', 'g') AS title_clean,
         hc.hour_frequency, hc.hour_frequency / ds.n_rows AS hour_frequency_ratio,
         dc.day_frequency
  FROM d1 CROSS JOIN ds
  LEFT JOIN hc ON d1.hour = hc.hc_hour
  LEFT JOIN dc ON d1.day_of_week = dc.dc_dow),
f2 AS (
  SELECT *, is_quincena * {dbl(0.3)} + is_reconciliacion * {dbl(0.4)} + is_backup * {dbl(0.3)} AS temporal_criticality,
         length(title_clean) AS title_length,
         len(list_filter(string_split_regex(title_clean, '\\s+'), lambda w: w <> '')) AS title_word_count,
         {", ".join(f"{flag(f'contains(title_clean, {chr(39)}{kw}{chr(39)})')} AS has_{kw}" for kw in C.FP_KEYWORDS)},
         hour * duration_minutes AS hour_duration_product,
         {flag(f'hour BETWEEN {C.SHORT_NIGHT_HOURS[0]} AND {C.SHORT_NIGHT_HOURS[1]} AND duration_minutes < {dbl(C.SHORT_NIGHT_MAX_MINUTES)}')} AS short_night_alert,
         is_quincena * is_reconciliacion AS quincena_reconciliation
  FROM f1),
feat AS (
  SELECT *, {" + ".join(f"has_{kw}" for kw in C.FP_KEYWORDS)} AS fp_keyword_score FROM f2)"""

_RULES = clip(
    f"CAST(duration_minutes < {dbl(0.5)} AS INTEGER) * {dbl(0.3)}"
    f" + CAST(duration_minutes >= {dbl(0.5)} AND duration_minutes < {dbl(2)} AS INTEGER) * {dbl(0.2)}"
    f" + is_reconciliacion * {dbl(0.25)}"
    f" + {clip(f'fp_keyword_score / {dbl(4)}')} * {dbl(0.2)}")
_STAT = clip(
    f"({dbl(1)} - hour_frequency_ratio) * {dbl(0.3)}"
    f" + {flag(f'abs(duration_zscore) > {dbl(2)}')} * {dbl(0.2)}")
_PATTERN = clip(f"short_night_alert * {dbl(0.4)} + quincena_reconciliation * {dbl(0.3)}")

SCORED = f"""{FEATURES},
sc AS (
  SELECT *, {_RULES} AS score_rules, {_STAT} AS score_statistical,
         {dbl(C.ANOMALY_FALLBACK)} AS score_anomaly, {_PATTERN} AS score_pattern
  FROM feat),
fin AS (
  SELECT *, round({clip(f'score_rules * {dbl(0.35)} + score_statistical * {dbl(0.25)} + score_anomaly * {dbl(0.25)} + score_pattern * {dbl(0.15)}')}, 12) AS fp_score_final
  FROM sc),
thr AS (SELECT quantile_cont(fp_score_final, {C.FP_THRESHOLD_PERCENTILE / 100}) AS fp_threshold FROM fin),
mean4 AS (
  SELECT *, (score_rules + score_statistical + score_anomaly + score_pattern) / {dbl(4)} AS m4 FROM fin),
labelled AS (
  SELECT mean4.*, {flag('fp_score_final >= thr.fp_threshold')} AS is_false_positive,
         {clip(f"{dbl(1)} - sqrt(((score_rules - m4) * (score_rules - m4) + (score_statistical - m4) * (score_statistical - m4) + (score_anomaly - m4) * (score_anomaly - m4) + (score_pattern - m4) * (score_pattern - m4)) / {dbl(4)}) / {dbl(0.5)}")} AS classification_confidence
  FROM mean4 CROSS JOIN thr),
fp AS (SELECT * FROM labelled WHERE is_false_positive = 1)"""


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def sig(expr: str, digits: int = 9) -> str:
    """Round to ``digits`` significant digits (for large-magnitude values)."""
    e = f"floor(log10(abs({expr})))"
    return (f"(CASE WHEN ({expr}) IS NULL THEN NULL WHEN ({expr}) = 0 THEN CAST(0.0 AS DOUBLE) "
            f"ELSE round(({expr}) / pow(10, {e}), {digits - 1}) * pow(10, {e}) END)")


def ordered_index(src: str, name: str = "idx") -> str:
    """CTE adding the 0-based time-order index (startTime nulls first, problemId)."""
    return (f"{name} AS (SELECT *, row_number() OVER (ORDER BY startTime ASC NULLS FIRST, problemId) - 1 "
            f"AS row_idx FROM {src})")


def train_cut(src: str = "idx", fraction: float = 0.7) -> str:
    return f"(SELECT CAST(floor(CAST(count(*) AS DOUBLE) * {dbl(fraction)}) AS BIGINT) FROM {src})"


def filled(features, src: str) -> str:
    cols = ", ".join(f'coalesce(CAST("{f}" AS DOUBLE), {dbl(0)}) AS "{f}"' for f in features)
    return f"SELECT {cols} FROM {src}"
