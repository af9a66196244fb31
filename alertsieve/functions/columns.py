"""Small column builders shared by the operators.

Null rule: a comparison on a missing value is *false* for flags (so a
flag is 0, never null), while continuous values stay null.  Every flag is
built through :func:`flag` to keep that rule in one place.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flag(cond: Column) -> Column:
    """0/1 integer flag; a null condition counts as false."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def in_set_flag(col: Column, values: Iterable) -> Column:
    return flag(col.isin(list(values)))


def in_range_flag(col: Column, low, high) -> Column:
    """Inclusive range flag."""
    return flag(col.between(low, high))


def clip(col: Column, low: float, high: float) -> Column:
    """Clip a never-null value to [low, high].

    ``greatest``/``least`` skip nulls, so a null input would come back as
    ``low``; use :func:`clip_nullable` where nulls can occur.  This form
    mentions ``col`` once, so nesting it keeps expressions linear in size.
    """
    return F.greatest(F.lit(float(low)), F.least(col, F.lit(float(high))))


def clip_nullable(col: Column, low: float, high: float) -> Column:
    """Clip to [low, high]; null stays null (``col`` appears twice)."""
    return F.when(col.isNull(), F.lit(None)).otherwise(clip(col, low, high))


def strip_unicode(col: Column) -> Column:
    """Strip leading/trailing whitespace of any script (trim strips blanks only)."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def word_count(stripped: Column) -> Column:
    """Number of whitespace-separated tokens of an already stripped string;
    the empty string has none.  (No lambda: stays inside codegen.)"""
    return F.when(stripped == F.lit(""), F.lit(0)).otherwise(F.size(F.split(stripped, r"(?U)\s+")))


def popstd(cols: Sequence[Column]) -> Column:
    """Population standard deviation across columns of one row.

    Centred form (sum of squared deviations) to avoid cancellation; null
    if any input is null.
    """
    n = float(len(cols))
    mean = sum(cols[1:], cols[0]) / F.lit(n)
    sq = [(c - mean) * (c - mean) for c in cols]
    return F.sqrt(sum(sq[1:], sq[0]) / F.lit(n))


def available(df: DataFrame, cols: Iterable[str]) -> list[str]:
    """Columns of ``cols`` present in ``df`` (resolved at plan time)."""
    present = set(df.columns)
    return [c for c in cols if c in present]
