"""Result layout shared by every catalogue query.

Doubles are rounded to 9 places (engines differ in the last bits of sums
and transcendental functions), integers widened to bigint, timestamps and
dates rendered as ISO text.  The DuckDB twins apply the same layout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DP = 9

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)


def finalize(df: DataFrame, as_double=()) -> DataFrame:
    """Apply the result layout; ``as_double`` names integer columns that may
    hold nulls (returned as doubles, as a pandas column with gaps is)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in as_double or isinstance(f.dataType, _FRACTIONAL):
            r = F.round(c.cast("double"), DP)
            c = F.when(r == 0, F.lit(0.0)).otherwise(r)  # no negative zero
        elif isinstance(f.dataType, _INTEGRAL):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def sig_round(c, digits: int = 9):
    """Round to ``digits`` significant digits; same arithmetic as the SQL twin."""
    e = F.floor(F.log10(F.abs(c)))
    scaled = F.round(c / F.pow(F.lit(10.0), e), digits - 1) * F.pow(F.lit(10.0), e)
    return F.when(c.isNull(), F.lit(None)).when(c == 0, F.lit(0.0)).otherwise(scaled)
