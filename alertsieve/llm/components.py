"""Connected components of a link table by alternating stars.

Large-star hangs every larger neighbour of a node on its smallest neighbour,
small-star every smaller one; the rounds repeat until no link changes, and
every node then hangs on the smallest node of its component.  All steps are
map-side aggregated minima and equi-joins; each round is a written table, so a
lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertsieve.llm.common import paths_table


def _sign(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def smallest_reachable(links: DataFrame) -> DataFrame:
    """``links`` (``a``, ``b``: long, any direction) -> ``node``, ``root``:
    each linked node but the roots, with the smallest node of its component."""
    links = paths_table(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .distinct(), "links")
    before = _sign(links)
    while True:
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(least, "a").where("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        large = paths_table(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        links = paths_table(small, "small-star")
        now = _sign(links)
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
