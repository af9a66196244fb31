"""Isolation forest (Liu, Ting & Zhou, ICDM 2008) as Spark jobs.

Spark ML has no isolation forest, so:

* **sample** -- a deterministic Bernoulli pre-filter on a hash of the row
  key (map side, no shuffle) keeps about 3x the pool size, then a
  ``orderBy(hash).limit(pool)`` on that small remainder picks the pool.
  Each tree then draws ``max_samples`` rows from the pool without
  replacement, ranked by a per-tree hash (a map-side hash pre-filter keeps
  only the candidates, ~3 x max_samples per tree): independent
  subsamples, and results do not depend on partitioning.
* **fit** -- ``groupBy("tree").applyInPandas``: one task grows one tree
  (random feature, uniform split point, depth cap ceil(log2 psi)).  The
  flat node table is at most trees x (2 psi - 1) rows (51,100 for the
  defaults), a proven bound, so it is collected and broadcast.
* **score** -- an Arrow-batched ``pandas_udf`` walks every tree for a whole
  batch at once in NumPy; path length = depth + c(leaf size); the score is
  ``2 ** (-mean path / c(psi))`` (1 = most isolated).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertsieve.session import reliable_table

EULER_GAMMA = 0.5772156649015329

_NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()),
    T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()),
    T.StructField("right", T.IntegerType()),
    T.StructField("size", T.IntegerType()),
])


def average_path_length(n):
    """c(n): mean unsuccessful-search path length in a BST of n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _grow_tree(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    """Grow one isolation tree; returns parallel node lists."""
    feature, threshold, left, right, size = [], [], [], [], []
    stack = [(np.arange(len(x)), 0, -1, False)]
    while stack:
        rows, depth, parent, is_right = stack.pop()
        node = len(feature)
        feature.append(-1)
        threshold.append(0.0)
        left.append(-1)
        right.append(-1)
        size.append(len(rows))
        if parent >= 0:
            (right if is_right else left)[parent] = node
        if depth >= max_depth or len(rows) <= 1:
            continue
        sub = x[rows]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        candidates = np.flatnonzero(hi > lo)
        if len(candidates) == 0:
            continue
        f = int(rng.choice(candidates))
        thr = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] <= thr
        feature[node] = f
        threshold[node] = thr
        stack.append((rows[~go_left], depth + 1, node, True))
        stack.append((rows[go_left], depth + 1, node, False))
    return feature, threshold, left, right, size


@dataclass(frozen=True)
class IForestModel:
    features: tuple
    psi: int
    n_trees: int
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray
    roots: np.ndarray

    def to_pandas(self) -> pd.DataFrame:
        return pd.DataFrame({"feature": self.feature, "threshold": self.threshold,
                             "left": self.left, "right": self.right, "size": self.size,
                             "is_root": np.isin(np.arange(len(self.feature)), self.roots)})

    @staticmethod
    def from_pandas(pdf: pd.DataFrame, features, psi: int) -> "IForestModel":
        roots = np.flatnonzero(pdf["is_root"].to_numpy())
        return IForestModel(tuple(features), int(psi), len(roots),
                            pdf["feature"].to_numpy(np.int64), pdf["threshold"].to_numpy(float),
                            pdf["left"].to_numpy(np.int64), pdf["right"].to_numpy(np.int64),
                            pdf["size"].to_numpy(np.int64), roots)


def _hash01(*cols: Column) -> Column:
    """Deterministic pseudo-uniform value in [0, 1) from the given columns."""
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") / F.lit(float(1 << 52))


def _sample_pool(x: DataFrame, n: int, pool_size: int, seed: int) -> DataFrame:
    """The ``pool_size`` rows first by a hash of their key, written once."""
    keep = min(1.0, 3.0 * pool_size / n)
    h = _hash01(F.col("_key"), F.lit(seed))
    pool = (x.where(h < F.lit(keep)) if keep < 1.0 else x).select("*", h.alias("_h"))
    return reliable_table(pool.orderBy("_h", "_key").limit(pool_size), "forest_pool")


def _row_keys(x: DataFrame) -> DataFrame:
    """Keys that tell all rows apart: a digest of key, features and, among
    equal rows, a copy number (rows are counted first, so a group of repeats
    is one row a task)."""
    columns = [c for c in x.columns]
    copies = x.groupBy(*columns).agg(F.count(F.lit(1)).alias("_m")).withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.col("_m").cast("int"))))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in (*columns, "_copy")]
    return copies.select(F.sha2(F.concat_ws("\u0001", *parts), 256).alias("_key"), *columns[1:])


def fit_iforest(df: DataFrame, features, key: str = "problemId", n_trees: int = 100,
                max_samples: int = 256, seed: int = 42, n_rows: int | None = None) -> IForestModel:
    """Fit the forest on ``features`` (nulls read as 0) of ``df``.

    Rows are sampled by a hash of ``key``.  Where keys repeat or are null in the
    sample, rows are sampled again by a key of their own, so that all trees
    get their rows whatever the ids.
    """
    features = tuple(features)
    x = df.select(F.col(key).cast("string").alias("_key"),
                  *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    n = n_rows if n_rows is not None else x.count()
    if n == 0:
        raise ValueError("cannot fit an isolation forest on no rows")
    psi = int(min(max_samples, n))
    pool_size = int(min(n, n_trees * psi))
    pool = _sample_pool(x, n, pool_size, seed)
    held, different = pool.agg(F.count(F.lit(1)), F.count_distinct("_key")).first()
    if held < pool_size or different < held:
        pool = _sample_pool(_row_keys(x), n, pool_size, seed)
    trees = F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree")
    # Per tree, rows are ranked by their own hash; only the ~3 psi lowest
    # hashes of the pool can be among the psi chosen, so a map-side filter
    # keeps the shuffle at about 3 x trees x psi rows.
    keep_tree = min(1.0, 3.0 * psi / max(pool_size, 1))
    per_tree = pool.select("*", trees).select(
        "*", _hash01(F.col("_key"), F.lit(seed), F.col("tree")).alias("_th"))
    chosen = per_tree.where(F.col("_th") < F.lit(keep_tree)) if keep_tree < 1.0 else per_tree
    max_depth = int(math.ceil(math.log2(max(psi, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values(["_th", "_key"]).head(psi)
        rng = np.random.default_rng([seed, tree])
        feat, thr, left, right, size = _grow_tree(pdf[list(features)].to_numpy(float), rng, max_depth)
        return pd.DataFrame({"tree": tree, "node": np.arange(len(feat), dtype=np.int32),
                             "feature": np.asarray(feat, np.int32), "threshold": thr,
                             "left": np.asarray(left, np.int32), "right": np.asarray(right, np.int32),
                             "size": np.asarray(size, np.int32)})

    nodes = (chosen.select("tree", "_key", "_th", *features)
             .groupBy("tree").applyInPandas(build, _NODE_SCHEMA)
             .toPandas())  # bounded: <= n_trees * (2 * psi - 1) rows
    if nodes["tree"].nunique() != n_trees:
        raise RuntimeError(f"{nodes['tree'].nunique()} of {n_trees} trees were grown")
    nodes = nodes.sort_values(["tree", "node"]).reset_index(drop=True)
    counts = nodes.groupby("tree").size()
    starts = pd.DataFrame({"tree": counts.index.to_numpy(),
                           "start": np.concatenate([[0], np.cumsum(counts.to_numpy())[:-1]])})
    nodes = nodes.merge(starts, on="tree", how="left")
    shift = nodes["start"].to_numpy()
    left = nodes["left"].to_numpy(np.int64)
    right = nodes["right"].to_numpy(np.int64)
    return IForestModel(
        features, psi, int(len(starts)), nodes["feature"].to_numpy(np.int64),
        nodes["threshold"].to_numpy(float),
        np.where(left >= 0, left + shift, -1), np.where(right >= 0, right + shift, -1),
        nodes["size"].to_numpy(np.int64), starts["start"].to_numpy(np.int64),
    )


def path_scores(model: IForestModel, x: np.ndarray) -> np.ndarray:
    """Isolation score 2^(-E[h(x)]/c(psi)) for each row of ``x``."""
    n = len(x)
    idx = np.tile(model.roots, (n, 1))            # rows x trees, current node
    depth = np.zeros(idx.shape, dtype=float)
    rows = np.arange(n)[:, None]
    while True:
        feat = model.feature[idx]
        inner = feat >= 0
        if not inner.any():
            break
        f = np.where(inner, feat, 0)
        val = x[rows, f]
        go_left = val <= model.threshold[idx]
        nxt = np.where(go_left, model.left[idx], model.right[idx])
        idx = np.where(inner, nxt, idx)
        depth += inner
    path = depth + average_path_length(model.size[idx])
    mean_path = path.mean(axis=1)
    return np.power(2.0, -mean_path / average_path_length([model.psi])[0])


def isolation_score(df: DataFrame, model: IForestModel) -> Column:
    """Column expression: raw isolation score of each row (Arrow batches)."""
    try:
        bc = df.sparkSession.sparkContext.broadcast(model)
        get = lambda: bc.value  # noqa: E731 - one copy per executor
    except Exception:  # noqa: BLE001 - no SparkContext: ship with the function
        get = lambda: model

    @F.pandas_udf(T.DoubleType())
    def _score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.fillna(0.0).to_numpy(float) for c in cols])
        return pd.Series(path_scores(get(), x))

    return _score(*[F.col(f).cast("double") for f in model.features])
