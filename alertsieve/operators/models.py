"""Classifiers on the heuristic labels, with time-ordered validation.

* feature matrix: every numeric feature column (null -> 0) except the label
  and the final score; the method scores and the confidence are excluded
  by default because they are functions of the label's own inputs
  (``compat=True`` keeps the confidence, as the method does).
* robust scaling: (x - median) / IQR with IQR 0 -> 1, the quantiles fitted
  on the training rows by the bounded-memory exact quantile (all columns
  per pass); applied as plain column arithmetic.
* estimators: Spark ML logistic regression and random forest with "balanced"
  class weights, second-order boosting on histograms (:mod:`boosting`), to
  depth 6 and to 31 leaves; any other estimator through ``model_suite(specs=)``.
* evaluation: one aggregate of the confusion counts + exact ROC AUC.
* temporal CV: the best estimator refitted per rolling-origin fold; the
  fits run concurrently from a small driver thread pool (Spark schedules
  the jobs side by side, as ``CrossValidator(parallelism=...)`` does).
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, fields

from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertsieve.config import DEFAULT, FOREST_DEPTH, TriageConfig
from alertsieve.operators.boosting import DEPTH_WISE, FIT_ROWS, LEAF_WISE, HistBoostClassifier
from alertsieve.operators.deep_forest import DeepForestClassifier
from alertsieve.operators.quantile import exact_quantiles
from alertsieve.operators.selection import select_features
from alertsieve.session import reliable_table

LABEL = "is_false_positive"
EXCLUDED = {"is_false_positive", "fp_score_final", "score_rules", "score_statistical",
            "score_anomaly", "score_pattern", "classification_confidence", "row_idx"}
#: Rows times trees whose node numbers a Spark ML forest keeps (4 bytes each) instead
#: of walking every tree again a level; the trees are the same.
NODE_IDS = 1 << 28
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType)


def feature_columns(df: DataFrame, compat: bool = False) -> list[str]:
    """Numeric feature columns in table order (M1)."""
    excluded = EXCLUDED - ({"classification_confidence"} if compat else set())
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, _NUMERIC) and f.name not in excluded and not f.name.startswith("score_")
            and not f.name.startswith("_")]


def fill_features(df: DataFrame, features: list[str], keep=()) -> DataFrame:
    """Features as doubles with nulls read as 0, plus the ``keep`` columns."""
    return df.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
                              for c in features])


@dataclass(frozen=True)
class RobustScaling:
    features: tuple
    center: dict
    scale: dict

    def transform(self, df: DataFrame, keep=()) -> DataFrame:
        cols = [((F.col(c) - F.lit(self.center[c])) / F.lit(self.scale[c])).alias(c)
                for c in self.features]
        others = [c for c in df.columns if c not in set(self.features)] if not keep else list(keep)
        return df.select(*others, *cols)

    def to_rows(self):
        return [(c, float(self.center[c]), float(self.scale[c])) for c in self.features]

    @staticmethod
    def from_rows(rows) -> "RobustScaling":
        feats = tuple(r[0] for r in rows)
        return RobustScaling(feats, {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows})


def fit_robust_scaling(filled: DataFrame, features: list[str]) -> RobustScaling:
    """Median and inter-quartile range per column (M2); IQR 0 -> scale 1."""
    q = exact_quantiles(filled, list(features), [0.25, 0.5, 0.75])
    center, scale = {}, {}
    for c in features:
        q1, q2, q3 = q[c][0.25], q[c][0.5], q[c][0.75]
        iqr = (q3 - q1) if q1 is not None else 0.0
        center[c] = q2 if q2 is not None else 0.0
        scale[c] = iqr if iqr != 0 else 1.0
    return RobustScaling(tuple(features), center, scale)


def class_weight_table(df: DataFrame, label: str = LABEL) -> DataFrame:
    """n / (2 * n_class) per class (M3): a two-row aggregate."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    total = counts.agg(F.sum("n_class").alias("n_total"))  # same shuffle, reused
    return (counts.crossJoin(F.broadcast(total))
            .select(label, "n_class", (F.col("n_total") / (2 * F.col("n_class"))).alias("class_weight")))


def with_class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    # At most two classes: the weight table is two rows, broadcast.
    w = class_weight_table(df, label).select(label, "class_weight")
    return df.join(F.broadcast(w), label)


@dataclass
class ModelSpec:
    name: str
    weighted: bool
    make: object  # callable(n_train) -> estimator


def model_specs(trees: int = 100, rounds: int = 100, seed: int = 42, rf_depth: int = FOREST_DEPTH) -> list[ModelSpec]:
    """The suite, in the order used to break F1 ties."""
    def lr(n):
        # C = 1 and tol = 1e-4 as in the method's estimator defaults.
        return LogisticRegression(featuresCol="features", labelCol="label", weightCol="class_weight",
                                  maxIter=1000, tol=1e-4, regParam=1.0 / max(n, 1), elasticNetParam=0.0,
                                  standardization=False)

    def rf(n):
        return RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="class_weight",
                                      numTrees=trees, maxDepth=rf_depth, featureSubsetStrategy="sqrt",
                                      seed=seed, cacheNodeIds=n * trees <= NODE_IDS)

    def gbt(depth):
        def make(n):
            return GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds,
                                 stepSize=0.1, maxDepth=depth, seed=seed)
        return make

    return [ModelSpec("LogisticRegression", True, lr), ModelSpec("RandomForest", True, rf),
            ModelSpec("GBTDepth6", False, gbt(6)), ModelSpec("GBTDepth5", False, gbt(5))]


def method_specs(cfg: TriageConfig = DEFAULT, trees: int | None = None, rounds: int | None = None) -> list[ModelSpec]:
    """The method's four models: logistic regression, random forest (Spark ML's
    to ``forest_depth``; None: without a depth limit), then second-order
    boosting on histograms, depth-wise (depth 6) and leaf-wise (31 leaves)."""
    from dataclasses import replace

    rounds, trees = rounds or cfg.model_rounds, trees or cfg.model_trees
    first = model_specs(trees, rounds, cfg.seed, cfg.forest_depth or FOREST_DEPTH)[:2]
    if cfg.forest_depth is None:
        first[1] = ModelSpec("RandomForest", True, lambda n: DeepForestClassifier(trees=trees, seed=cfg.seed))
    return first + [
        ModelSpec("HistBoostDepth6", False, lambda n: HistBoostClassifier(replace(DEPTH_WISE, rounds=rounds))),
        ModelSpec("HistBoostLeaves31", False, lambda n: HistBoostClassifier(replace(LEAF_WISE, rounds=rounds)))]


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def binary_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                   score: str | None = "p1") -> DataFrame:
    """accuracy, precision, recall, f1 (class 1; 0 when undefined), auc (M7).

    ``pred`` is read once: one aggregation by (score, label, prediction), kept
    as a small table when scores repeat and never larger than the input;
    counts and the exact ROC area (ties count one half) both come from it.
    """
    keys = [F.col(label).cast("double").alias("y"), F.col(prediction).cast("double").alias("p")]
    if score is not None:
        keys.append(F.col(score).cast("double").alias("s"))
    levels = pred.select(*keys).groupBy(*(["y", "p"] + (["s"] if score is not None else []))).agg(
        F.count(F.lit(1)).alias("n"))
    if score is not None:
        levels = reliable_table(levels, "score_levels")
    y, p = F.col("y"), F.col("p")
    counts = levels.agg(*[F.coalesce(F.sum(F.when((y == a) & (p == b), F.col("n"))), F.lit(0)).alias(name)
                          for name, a, b in (("tp", 1, 1), ("fp", 0, 1), ("tn", 0, 0), ("fn", 1, 0))])
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    precision = F.coalesce(tp / F.nullif(tp + fp, F.lit(0.0)), F.lit(0.0))
    recall = F.coalesce(tp / F.nullif(tp + fn, F.lit(0.0)), F.lit(0.0))
    out = counts.select(
        "tp", "fp", "tn", "fn",
        F.coalesce((tp + tn) / F.nullif(tp + fp + tn + fn, F.lit(0.0)), F.lit(0.0)).alias("accuracy"),
        precision.alias("precision"), recall.alias("recall"))
    out = out.select("*", F.coalesce(2 * F.col("precision") * F.col("recall")
                                     / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)),
                                     F.lit(0.0)).alias("f1"))
    if score is not None:
        out = out.select("*", F.lit(roc_auc(levels)).cast("double").alias("auc"))
    return out


def roc_auc(levels: DataFrame) -> float | None:
    """Exact area under the ROC curve from counts ``n`` by (``y``, ``s``).

    The negatives below each score are a running sum over score levels in
    range partitions (partition totals on the driver, one row a partition), so
    no task holds all levels.
    """
    by_score = levels.where(F.col("s").isNotNull()).groupBy("s").agg(
        F.coalesce(F.sum(F.when(F.col("y") == 1, F.col("n"))), F.lit(0)).alias("pos"),
        F.coalesce(F.sum(F.when(F.col("y") == 0, F.col("n"))), F.lit(0)).alias("neg"))
    parts = reliable_table(by_score.repartitionByRange("s").withColumn("part", F.spark_partition_id()), "auc_levels")
    totals = parts.groupBy("part").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
                                       F.min("s").alias("s")).collect()
    n_pos, n_neg, before, offsets = sum(r.pos for r in totals), sum(r.neg for r in totals), 0, []
    if not n_pos or not n_neg:
        return None
    for r in sorted(totals, key=lambda r: r.s):
        offsets.append((r.part, before))
        before += r.neg
    starts = parts.sparkSession.createDataFrame(offsets, "part int, start long")
    running = Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(running), F.lit(0))
    area = (parts.withColumn("below", below).join(F.broadcast(starts), "part")
            .agg(F.sum(F.col("pos") * (F.col("start") + F.col("below") + 0.5 * F.col("neg")))).first()[0])
    return float(area) / (n_pos * n_neg)


def _positive_probability(pred: DataFrame) -> DataFrame:
    return pred.select("*", vector_to_array("probability")[1].alias("p1"))


@dataclass
class TrainedModel:
    name: str
    model: object
    metrics: dict = field(default_factory=dict)


def _prepare(df: DataFrame, features, scaling: RobustScaling) -> DataFrame:
    scaled = scaling.transform(fill_features(df, features, keep=[LABEL]), keep=[LABEL])
    return assemble(scaled.select(F.col(LABEL).cast("double").alias("label"), *features), features)


def fit_one(spec: ModelSpec, train: DataFrame, n_train: int):
    data = train
    if spec.weighted:
        data = with_class_weights(train, "label")
    return spec.make(n_train).fit(data)


def train_suite(train: DataFrame, test: DataFrame, features: list[str], specs: list[ModelSpec],
                scaling: RobustScaling, n_train: int, parallelism: int = 2):
    """Fit every spec on ``train``; metrics on ``test``.  Returns the fitted
    models (in spec order), a metrics DataFrame and the best model's name
    (max F1, first in spec order on ties)."""
    tr = _prepare(train, features, scaling).persist(StorageLevel.MEMORY_AND_DISK)
    te = _prepare(test, features, scaling).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        def run(spec):
            model = fit_one(spec, tr, n_train)
            pred = _positive_probability(model.transform(te))
            m = binary_metrics(pred).first().asDict()
            return TrainedModel(spec.name, model, m)

        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            trained = list(pool.map(run, specs))
    finally:
        tr.unpersist()
        te.unpersist()
    best = max(range(len(trained)), key=lambda i: (trained[i].metrics["f1"], -i))
    spark = train.sparkSession
    rows = [(t.name, i, float(t.metrics["accuracy"]), float(t.metrics["precision"]),
             float(t.metrics["recall"]), float(t.metrics["f1"]),
             None if t.metrics["auc"] is None else float(t.metrics["auc"]), i == best)
            for i, t in enumerate(trained)]
    metrics = spark.createDataFrame(
        rows, "model string, model_order int, accuracy double, precision double, recall double, "
              "f1 double, auc double, is_best boolean")
    return trained, metrics, trained[best].name


def temporal_cv(indexed: DataFrame, n_rows: int, features: list[str], spec: ModelSpec,
                k: int = 5, gap: int = 168, parallelism: int | None = None,
                index_col: str = "row_idx", gap_hours: float | None = None) -> DataFrame:
    """F1 of ``spec`` refitted on each rolling-origin fold (M8).

    Each fold fits its own robust scaling on its training rows.  The gap
    between training and test rows counts rows, or with ``gap_hours`` the time
    before the fold's first test row (``startTime`` must then be in the table).
    ``parallelism``: folds at once (None: all of a table that one task fits,
    else two).
    """
    from alertsieve.operators.ordering import fold_bounds

    parallelism = parallelism or (k if n_rows <= FIT_ROWS else 2)

    bounds = fold_bounds(n_rows, k, 0 if gap_hours is not None else gap)
    time = ["startTime"] if gap_hours is not None else []
    base = indexed.select(index_col, LABEL, *time, *features).persist(StorageLevel.MEMORY_AND_DISK)

    def run(b):
        fold, train_end, test_start, test_end = b
        idx = F.col(index_col)
        train = base.where(idx < train_end)
        if gap_hours is not None:
            first = base.where((idx >= test_start) & (idx < test_end)).agg(F.min("startTime")).first()[0]
            cut = F.lit(first) - F.make_dt_interval(secs=F.lit(gap_hours * 3600.0).cast("decimal(18,6)"))
            train = train.where(F.col("startTime").isNull() | (F.col("startTime") < cut))
            train_end = train.count()
        test = base.where((idx >= test_start) & (idx < test_end))
        scaling = fit_robust_scaling(fill_features(train, features), features)
        tr = _prepare(train, features, scaling)
        te = _prepare(test, features, scaling)
        model = fit_one(spec, tr, train_end)
        pred = model.transform(te)
        m = binary_metrics(pred, score=None).first()
        return (fold, int(train_end), int(test_end - test_start), float(m["f1"]))

    try:
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            rows = list(pool.map(run, bounds))
    finally:
        base.unpersist()
    spark = indexed.sparkSession
    scores = spark.createDataFrame(rows, "fold int, train_rows long, test_rows long, f1 double")
    summary = scores.agg(F.avg("f1").alias("cv_mean"), F.stddev_pop("f1").alias("cv_std"))
    return scores.crossJoin(F.broadcast(summary)).orderBy("fold")


# ---------------------------------------------------------------- package --

def _class_name(model) -> str:
    """Where a model's class is imported from; Spark ML's by their own module."""
    cls = type(model)
    return f"{cls.__module__}:{cls.__name__}"


def _class_of(name: str):
    """The class that ``_class_name`` named (a bare name: Spark ML's classifiers)."""
    import importlib

    module, _, cls = name.rpartition(":")
    if not module:
        module = "pyspark.ml" if cls == "PipelineModel" else "pyspark.ml.classification"
    found = getattr(importlib.import_module(module), cls)
    if not hasattr(found, "load"):
        raise ValueError(f"{name} cannot be loaded")
    return found


def save_model_package(path: str, model, features: list[str], scaling: RobustScaling,
                       scoring_model=None, metrics: DataFrame | None = None, name: str = "",
                       attribution: DataFrame | None = None) -> None:
    """Persist classifier + scaling + (optional) scoring state with its
    configuration, metrics and attribution (S9).

    Everything is written with Spark writers, so ``path`` may be any
    shared file system URI.
    """
    spark = metrics.sparkSession if metrics is not None else None
    from pyspark.sql import SparkSession

    spark = spark or SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/classifier")
    spark.createDataFrame(scaling.to_rows(), "feature string, center double, scale double") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/scaling")
    if metrics is not None:
        metrics.coalesce(1).write.mode("overwrite").parquet(f"{path}/metrics")
    if attribution is not None:
        attribution.write.mode("overwrite").parquet(f"{path}/attribution")
    meta = {"model_class": _class_name(model), "features": list(features), "name": name}
    if scoring_model is not None:
        sm = scoring_model
        if sm.extra:
            raise ValueError("a scoring model with further methods cannot be saved: they are code")
        meta["config"] = asdict(sm.cfg)
        spark.createDataFrame(sm.stats.to_rows(), "kind string, key int, value double") \
            .coalesce(1).write.mode("overwrite").parquet(f"{path}/alert_stats")
        meta.update({"threshold": sm.threshold, "anomaly_min": sm.anomaly_min,
                     "anomaly_max": sm.anomaly_max})
        if sm.forest is not None:
            spark.createDataFrame(sm.forest.to_pandas()).coalesce(1) \
                .write.mode("overwrite").parquet(f"{path}/forest")
            meta.update({"has_forest": True, "forest_features": list(sm.forest.features),
                         "forest_psi": sm.forest.psi})
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
        .write.mode("overwrite").text(f"{path}/meta")


@dataclass
class ModelPackage:
    model: object
    features: list
    scaling: RobustScaling
    scoring_model: object = None
    meta: dict = field(default_factory=dict)

    def predict(self, features_df: DataFrame, keep=("problemId",)) -> DataFrame:
        """Score a feature table with the saved classifier (M11)."""
        keep = [c for c in keep if c in features_df.columns]
        filled = fill_features(features_df, self.features, keep=keep)
        data = assemble(self.scaling.transform(filled, keep=keep), self.features)
        pred = _positive_probability(self.model.transform(data))
        return pred.select(*keep, F.col("prediction"), F.col("p1").alias("probability_fp"))


def _config_of(saved: dict) -> TriageConfig:
    """The saved configuration; an unknown field is an error."""
    known = {f.name for f in fields(TriageConfig)}
    if unknown := set(saved) - known:
        raise ValueError(f"package configuration has unknown fields: {sorted(unknown)}")
    return TriageConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in saved.items()})


def load_model_package(spark, path: str) -> ModelPackage:
    from alertsieve.operators.iforest import IForestModel
    from alertsieve.operators.scoring import ScoringModel
    from alertsieve.operators.stats import AlertStats

    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    model = _class_of(meta["model_class"]).load(f"{path}/classifier")
    scaling = RobustScaling.from_rows(
        [(r["feature"], r["center"], r["scale"]) for r in spark.read.parquet(f"{path}/scaling").collect()])
    # keep the saved feature order
    scaling = RobustScaling(tuple(meta["features"]), scaling.center, scaling.scale)
    scoring_model = None
    if "threshold" in meta:
        stats = AlertStats.from_rows(
            [(r["kind"], r["key"], r["value"]) for r in spark.read.parquet(f"{path}/alert_stats").collect()])
        forest = None
        if meta.get("has_forest"):
            forest = IForestModel.from_pandas(spark.read.parquet(f"{path}/forest").toPandas(),
                                              meta["forest_features"], meta["forest_psi"])
        scoring_model = ScoringModel(stats, forest, meta["anomaly_min"], meta["anomaly_max"],
                                     meta["threshold"], _config_of(meta["config"]))
    return ModelPackage(model, meta["features"], scaling, scoring_model, meta)


@dataclass
class SuiteResult:
    trained: list
    metrics: DataFrame
    best: str
    features: list
    scaling: RobustScaling
    train: DataFrame
    test: DataFrame
    n_rows: int
    indexed: DataFrame


def model_suite(labelled: DataFrame, cfg: TriageConfig = DEFAULT, trees: int | None = None,
                rounds: int | None = None, compat: bool = False, parallelism: int = 4,
                only: tuple | None = None, specs: list[ModelSpec] | None = None) -> SuiteResult:
    """Time-ordered 70/30 split, scaling fitted on the training rows, suite fit
    (``only``: the named models).

    ``specs`` takes the place of the method's four models.  Any estimator has
    a slot: ``make(n_train).fit(df)`` gets ``features`` (vector) and ``label``
    (with ``weighted`` also ``class_weight``) and returns a model whose
    ``transform`` adds ``probability`` (vector) and ``prediction``; to be
    packaged, the model has Spark ML's ``write`` and ``load``.
    """
    from alertsieve.operators.ordering import global_row_index, temporal_split

    # above ``cfg.selection_min_columns`` columns the variance and correlation filters run first
    features = select_features(labelled, feature_columns(labelled, compat), cfg)
    indexed = global_row_index(labelled.select("problemId", "startTime", LABEL, *features))
    n_rows = indexed.count()
    train, test = temporal_split(indexed, n_rows, cfg.train_fraction)
    fit_rows = indexed if compat else train
    scaling = fit_robust_scaling(fill_features(fit_rows, features), features)
    specs = method_specs(cfg, trees, rounds) if specs is None else specs
    specs = [s for s in specs if only is None or s.name in only]
    trained, metrics, best = train_suite(train, test, features, specs, scaling,
                                         int(n_rows * cfg.train_fraction), parallelism)
    return SuiteResult(trained, metrics, best, features, scaling, train, test, n_rows, indexed)
