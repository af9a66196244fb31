"""Small column helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the white space of the contracts, ``[\\x20\\x09-\\x0D]``.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(col, UPPER, UPPER.lower())


def word_count(col: Column) -> Column:
    """Number of words of a text (null: 0), as long."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def hash128(*cols: Column) -> list[Column]:
    """Two differently seeded 64-bit hashes of the columns (with their null
    pattern): a 128-bit key that tells rows apart at any corpus size."""
    parts = [x for c in cols for x in (c.isNull(), c)]
    return [F.xxhash64(*parts), F.xxhash64(F.lit(0x9E3779B9), *parts)]


def with_columns(df: DataFrame, **cols: Column) -> DataFrame:
    """Append columns; a column of ``df`` with such a name (in any case) gives way."""
    names = {n.lower() for n in cols}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names],
                     *[c.alias(n) for n, c in cols.items()])


def paths_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written under the shared checkpoint folder and read back."""
    from alertsieve.session import reliable_table

    return reliable_table(df, f"llm-{name}")
