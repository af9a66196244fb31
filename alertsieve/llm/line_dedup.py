"""Line dedup: drop lines whose key occurs in many documents.

Lines are exploded to narrow rows (row key, position, 128-bit key hash), the
distinct documents of each hash are counted, occurrences of frequent hashes
return their positions to the row, and the kept lines are joined by position.
Only hashes and positions are counted and shuffled by line; texts move once,
to meet their own list of dropped positions.

Scale: the count first removes repeats of a line within a document and then
aggregates map-side per hash, so a line in a third of all documents is no hot
task; the join of occurrences with frequent hashes is a plain equi-join whose
hot hash AQE splits (no aggregate needs its rows together).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertsieve.llm.common import SPACES, ascii_lower, hash128, paths_table, with_columns


def line_key(line: Column) -> Column:
    """The line stripped of white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def dedup_lines(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove lines whose key (of at least ``min_chars`` code points) is found
    in at least ``min_docs`` documents.

    Returns the rows of ``docs`` with ``text_col`` rebuilt from the kept lines
    and ``n_lines``, ``n_dropped`` (long) appended; columns with these names
    give way.  A null or empty text is one empty line, and its result is the
    empty text.  Documents are counted by id (a null id is one document), so
    repeated rows count once and are cut alike.  A document that loses every
    line keeps its row with the empty text.  Empty tables give empty results.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    r1, r2 = hash128(F.col(id_col), F.col(text_col))
    keyed = docs.select("*", r1.alias("__r1"), r2.alias("__r2"))
    h1, h2 = hash128(F.col("key"))
    lines = (keyed.select("__r1", "__r2", F.col(id_col).alias("id"),
                          F.posexplode(F.split(text, "\n")).alias("pos", "line"))
             .select("__r1", "__r2", "id", "pos", line_key(F.col("line")).alias("key"))
             .where(F.length("key") >= min_chars)
             .select("__r1", "__r2", "id", "pos", h1.alias("h1"), h2.alias("h2")))
    # written, so that the join below deals both its sides anew and AQE may split a hot hash
    frequent = paths_table(lines.select("h1", "h2", "id").distinct()
                           .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
                           .where(F.col("n") >= min_docs).select("h1", "h2"), "frequent-lines")
    dropped = (lines.select("__r1", "__r2", "pos", "h1", "h2").join(frequent, ["h1", "h2"])
               .groupBy("__r1", "__r2").agg(F.collect_set("pos").alias("__drop")))
    # the text travels as its lines, split before the exchange and never again
    split = with_columns(keyed, **{text_col: F.split(text, "\n")})
    joined = split.join(dropped.hint("shuffle_hash"), ["__r1", "__r2"], "left")
    line_list, n = F.col(text_col), F.size(text_col)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), "__drop"), lambda i: F.get(line_list, i))
    out = with_columns(joined, **{
        text_col: F.array_join(F.when(F.col("__drop").isNull(), line_list).otherwise(kept), "\n"),
        "n_lines": n.cast("long"),
        "n_dropped": F.when(F.col("__drop").isNull(), 0).otherwise(F.size("__drop")).cast("long")})
    stay = [f"`{c}`" for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return out.select(*stay, "n_lines", "n_dropped")
