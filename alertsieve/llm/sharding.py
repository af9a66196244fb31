"""Uniform shuffle into shards of exact size by a communication matrix.

Rows lie in blocks (by hash).  How many rows of each block go to each shard is
drawn once from the multivariate hypergeometric law, so the counts are exactly
those of a uniform shuffle with fixed shard sizes.  Each block is permuted
locally and dealt by its row of the matrix; each shard is permuted again on
its side.  All randomness comes from the seed and the row's content, so a
task that runs again after a lost executor makes the same choices.

Scale: the driver sees one count per block (rows / ``block_rows``, at most
``MOST_BLOCKS``: then blocks grow) and one per (shard, bucket); every window sorts narrow rows of one block or one bucket of
about ``block_rows`` rows, never a whole shard.  Rows that are equal in every
column are counted first and told apart by a copy number, so a group of
repeats is spread like any other rows.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertsieve.llm.common import hash128, paths_table

BLOCK_ROWS = 200_000
MOST_BLOCKS = 1 << 16


def hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many of ``n`` rows drawn without return are good ones.

    Inversion of the law around its mode: probabilities relative to the mode's
    are products of neighbour ratios, over 12 standard deviations to either
    side (what lies beyond has a weight below 1e-30).  Counts of any size.
    """
    total, low, high = good + bad, max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    share = good / total
    wide = int(12 * math.sqrt(n * share * (1 - share) * (total - n) / max(1, total - 1))) + 40
    a, b = max(low, mode - wide), min(high, mode + wide)
    x = np.arange(a, b, dtype=np.float64)
    # p(x + 1) / p(x)
    ratio = (good - x) / (x + 1) * ((n - x) / (bad - n + x + 1))
    split = mode - a
    p = np.concatenate([np.cumprod(1 / ratio[:split][::-1])[::-1], [1.0], np.cumprod(ratio[split:])])
    upto = np.cumsum(p)
    return a + min(int(np.searchsorted(upto, rng.random() * upto[-1], side="right")), len(p) - 1)


def communication_matrix(block_sizes: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Counts ``a[block, shard]`` with the given row sums and shard sizes at
    most one apart, drawn as a uniform shuffle would give them."""
    total = sum(block_sizes)
    left = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    rng = np.random.default_rng(seed)
    rows = []
    for n in block_sizes:
        row, rest = [], sum(left)
        for here in left:  # shard by shard: a marginal draw from what is left
            rest -= here
            row.append(hypergeometric(here, rest, n - sum(row), rng))
        left = [x - y for x, y in zip(left, row)]
        rows.append(row)
    return np.array(rows, dtype=np.int64).reshape(len(block_sizes), n_shards)


def _blocks(n_rows: int, block_rows: int) -> int:
    return min(max(1, -(-n_rows // block_rows)), MOST_BLOCKS)


def assign_shards(rows: DataFrame, n_shards: int, *, seed: int = 7,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Deal ``rows`` (narrow: identifying columns only) into shards 0 to
    ``n_shards`` - 1 whose sizes are at most one apart.

    Returns the rows with ``shard`` (int) and ``slot`` (long, gapless from 0
    in each shard); columns with these names must not be in ``rows``.  Nulls
    are values like others; equal rows get a place each; an empty table gives
    an empty result.  The same rows and seed give the same places.
    """
    spark = rows.sparkSession
    cols = rows.columns
    copies = rows.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.count(F.lit(1)).alias("__m"))
    copies = copies.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__m").cast("int")))).drop("__m")
    of_row = [F.col(f"`{c}`") for c in (*cols, "__copy")]
    one, two = hash128(F.lit(seed), *of_row), hash128(F.lit(seed + 1), F.lit("slot"), *of_row)
    keyed = paths_table(copies.select("*", one[0].alias("__a"), one[1].alias("__b"),
                                      two[0].alias("__c"), two[1].alias("__d")), "shard-keys")
    n_rows = keyed.count()
    n_blocks = _blocks(n_rows, block_rows)
    keyed = keyed.withColumn("__block", F.pmod("__a", F.lit(n_blocks)).cast("int"))
    counts = {r["__block"]: r["n"] for r in keyed.groupBy("__block").agg(F.count(F.lit(1)).alias("n")).collect()}
    matrix = communication_matrix([counts.get(b, 0) for b in range(n_blocks)], n_shards, seed)
    bounds = spark.createDataFrame([(b, [int(x) for x in np.cumsum(row)]) for b, row in enumerate(matrix)],
                                   "__block int, __upto array<bigint>")
    local = Window.partitionBy("__block").orderBy("__b", "__a")
    rank = keyed.withColumn("__rank", F.row_number().over(local) - 1)
    dealt = paths_table(
        rank.join(bounds, "__block")
        .withColumn("shard", F.size(F.filter("__upto", lambda x: x <= F.col("__rank"))).cast("int"))
        .withColumn("__bucket", F.pmod("__c", F.lit(_blocks(n_rows // n_shards, block_rows))).cast("int"))
        .drop("__block", "__upto", "__rank", "__a", "__b"), "shard-dealt")
    sizes = {(r["shard"], r["__bucket"]): r["n"] for r in
             dealt.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts = []
    for s in range(n_shards):
        own = sorted(k for k in sizes if k[0] == s)
        starts += [(*k, n) for k, n in zip(own, accumulate((sizes[k] for k in own), initial=0))]
    offsets = spark.createDataFrame(starts, "shard int, __bucket int, __start bigint")
    within = Window.partitionBy("shard", "__bucket").orderBy("__d", "__c")
    out = (dealt.withColumn("__rank", F.row_number().over(within) - 1)
           .join(offsets, ["shard", "__bucket"]))
    return out.select(*[f"`{c}`" for c in cols], "shard", (F.col("__start") + F.col("__rank")).cast("long").alias("slot"))


def shuffle_documents(docs: DataFrame, n_shards: int, *, seed: int = 7,
                      block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Whole rows of ``docs`` with their ``shard`` and ``slot``; columns with
    these names give way.  Write it with ``repartition("shard")`` or range
    partitions of ``(shard, slot)``.  Column types must be hashable (no maps).
    """
    stay = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    k1, k2 = hash128(*[F.col(f"`{c}`") for c in stay])
    keyed = docs.select(*[f"`{c}`" for c in stay], k1.alias("__k1"), k2.alias("__k2"))
    places = assign_shards(keyed.select("__k1", "__k2"), n_shards, seed=seed, block_rows=block_rows)
    return keyed.dropDuplicates(["__k1", "__k2"]).join(places, ["__k1", "__k2"]).drop("__k1", "__k2")
