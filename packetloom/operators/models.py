"""Classifier ensembles on Spark ML: training, voting, stacking, scoring."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from packetloom.functions.labels import is_attack_label
from packetloom.operators import evaluate, prep, sampling
from packetloom.operators.sizing import dense_codes, small
from packetloom.operators.trees import TreeModel, fit_boosted, fit_extra_trees

# --- Fixed values: default model sizes ---
FOREST = {"numTrees": 200, "maxDepth": 20}
BOOSTED = {"maxIter": 200, "maxDepth": 8, "stepSize": 0.05, "subsamplingRate": 0.8}
FOLDS, FOLD = 5, "__fold"
MODEL_NAMES = ["random_forest", "gbt", "extra_trees"]
ALIASES = {
    "rf": "random_forest", "randomforest": "random_forest", "random_forest": "random_forest",
    "xgb": "gbt", "xgboost": "gbt", "lgb": "gbt", "lgbm": "gbt", "lightgbm": "gbt", "gbt": "gbt",
    "et": "extra_trees", "extratrees": "extra_trees", "extra_trees": "extra_trees",
}


def model_names(names: str | list[str]) -> list[str]:
    """Canonical base model names; "auto" stands for all of them."""
    items = names.split(",") if isinstance(names, str) else list(names)
    out: list[str] = []
    for item in items:
        key = item.strip().lower()
        for name in MODEL_NAMES if key == "auto" else [ALIASES.get(key, key)]:
            if name not in MODEL_NAMES:
                raise ValueError(f"unsupported model: {item}")
            if name not in out:
                out.append(name)
    return out or ["random_forest"]


@dataclass
class BaseModel:
    """A fitted base model that turns a vector column into class probabilities."""

    name: str
    classes: int
    models: list[Model | TreeModel]

    def probabilities(self, df: DataFrame, features: str, out: str) -> DataFrame:
        model = self.models[0]
        if isinstance(model, TreeModel):
            return model.probabilities(df, features, out)
        scored = model.setFeaturesCol(features).setProbabilityCol("__prob").setRawPredictionCol("").setPredictionCol("")
        return scored.transform(df).withColumn(out, vector_to_array("__prob")).drop("__prob")


def train_base(name: str, df: DataFrame, classes: int, seed: int = 42, **overrides) -> BaseModel:
    """ML9-11: one base model on columns features / y / weight (and row_key, by which boosting takes part of the rows)."""
    if name == "random_forest":
        estimator = RandomForestClassifier(
            featuresCol="features", labelCol="y", seed=seed, weightCol="weight", featureSubsetStrategy="sqrt", **{**FOREST, **overrides}
        )
        return BaseModel(name, classes, [estimator.fit(df)])
    if name == "extra_trees":
        size = {**FOREST, **overrides}
        return BaseModel(name, classes, [fit_extra_trees(df, classes, seed, size["numTrees"], size["maxDepth"])])
    if name == "gbt":
        size = {**BOOSTED, **overrides}
        model = fit_boosted(df, classes, seed, size["maxIter"], size["maxDepth"], size["stepSize"], size["subsamplingRate"])
        return BaseModel(name, classes, [model])
    raise ValueError(f"unsupported model: {name}")


def _argmax(p: Column) -> Column:
    """Position of the largest entry, the lowest one on ties."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def soft_vote(
    df: DataFrame, probabilities: list[str], classes: int, votes: list[str] | None = None, digits: int = 6
) -> DataFrame:
    """ML13: mean of class probabilities, all within the row.

    ``votes`` are class numbers of models without probabilities; they count
    as one-hot rows. Means are compared after rounding to ``digits`` places,
    so that equal shares summed in another order still tie.
    """
    arrays = [F.col(c) for c in probabilities]
    arrays += [
        F.array(*[F.when(F.col(v) == k, 1.0).otherwise(0.0) for k in range(classes)]) for v in votes or []
    ]
    means = []
    for k in range(classes):
        total = arrays[0][k]
        for a in arrays[1:]:
            total = total + a[k]
        means.append(total / F.lit(float(len(arrays))))
    out = df.withColumn("probabilities", F.array(*means))
    rough = F.transform("probabilities", lambda x: F.round(x, digits))
    return out.withColumns({"prediction": _argmax(rough), "confidence": F.array_max("probabilities")})


def soft_vote_long(df: DataFrame, row_keys: list[str], cls: str, p: str, digits: int = 6) -> DataFrame:
    """ML13 for (row, model, class, probability) rows: two map-side-combined aggregates."""
    means = df.groupBy(*row_keys, cls).agg(F.avg(p).alias("__p"))
    best = F.min(F.struct((-F.round("__p", digits)).alias("q"), F.col(cls).alias("c"), F.col("__p").alias("p")))
    return means.groupBy(*row_keys).agg(best.alias("b")).select(
        *row_keys, F.col("b.c").alias("prediction"), F.col("b.p").alias("confidence")
    )


def decode_predictions(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """ML16: label text, confidence and attack flag of coded predictions.

    The mapping has one row per class; an unknown code prints as its number.
    """
    names = mapping.select(F.col("code").cast("int").alias("__code"), F.col("label").alias("__label"))
    joined = df.join(small(names), F.col("prediction") == F.col("__code"), "left")
    out = joined.withColumn("prediction_label", F.coalesce("__label", F.col("prediction").cast("string")))
    return out.withColumns(
        {
            "confidence": F.coalesce(F.array_max("probabilities"), F.lit(0.5)),
            "is_attack": is_attack_label(F.col("prediction_label")),
        }
    ).drop("__code", "__label")


@dataclass
class Ensemble:
    """Fitted preparation, base models and combiner.

    ``profile`` holds kinds, category codes, fills, means and deviations of the
    training columns; ``features`` are the columns the models read.
    """

    features: list[str]
    mapping: DataFrame
    classes: int
    profile: prep.Profile
    bases: list[BaseModel]
    meta: Model | None = None
    metrics: dict = field(default_factory=dict)

    def score(self, df: DataFrame) -> DataFrame:
        """ML16: predictions for raw rows, whose own columns stay as they are.

        Columns missing at score time, nulls, bad numbers and unseen categories
        get what the fit says, as in training.
        """
        return self._score_prepared(prepared(df.select(F.struct("*").alias("__row"), "*"), self.profile, ["__row"])).select(
            "__row.*", "probabilities", "prediction", "prediction_label", "confidence", "is_attack"
        )

    def _score_prepared(self, filled: DataFrame) -> DataFrame:
        scaled = prep.scale(filled, {c: self.profile.means[c] for c in self.features}, self.profile.stds)
        return decode_predictions(self._combine(_assemble(scaled, self.features)), self.mapping).drop("features")

    def _combine(self, work: DataFrame) -> DataFrame:
        names = []
        for base in self.bases:
            work = base.probabilities(work, "features", f"__p_{base.name}")
            names.append(f"__p_{base.name}")
        if self.meta is None:
            return soft_vote(work, names, self.classes).drop(*names)
        joined = work.withColumn("__meta", array_to_vector(F.concat(*names)))
        model = self.meta.setFeaturesCol("__meta").setProbabilityCol("__mp").setRawPredictionCol("").setPredictionCol("")
        done = model.transform(joined).withColumn("probabilities", vector_to_array("__mp"))
        return done.withColumn("prediction", _argmax(F.col("probabilities"))).drop("__mp", "__meta", *names)

    def save(self, path: str) -> None:
        """Spark ML models and small tables under a folder, which must not exist yet."""
        spark = self.mapping.sparkSession
        self.profile.to_df(spark).write.parquet(f"{path}/profile")
        if self.profile.categories is not None:
            self.profile.categories.write.parquet(f"{path}/categories")
        self.mapping.write.parquet(f"{path}/labels")
        for i, base in enumerate(self.bases):
            for k, model in enumerate(base.models):
                model.save(f"{path}/models/{i}-{k}")
        if self.meta is not None:
            self.meta.save(f"{path}/meta")
        parts = [(b.name, len(b.models)) for b in self.bases]
        # Written last: a folder without it is no complete ensemble.
        head = [(self.features, self.classes, parts, self.meta is not None, {k: float(v) for k, v in self.metrics.items()})]
        spark.createDataFrame(head, HEAD_SCHEMA).coalesce(1).write.parquet(f"{path}/ensemble")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Ensemble:
        head = spark.read.parquet(f"{path}/ensemble").first()
        rows = spark.read.parquet(f"{path}/profile").orderBy("ordinal").collect()  # one row per column
        value = lambda name: {r["column"]: r[name] for r in rows if r[name] is not None}
        profile = prep.Profile([r["column"] for r in rows], value("kind"), value("fill_value"), value("mean"), value("std"))
        if "categorical" in profile.kinds.values():
            profile.categories = spark.read.parquet(f"{path}/categories")
        bases = []
        for i, part in enumerate(head["bases"]):
            kind = RandomForestClassificationModel if part["name"] == "random_forest" else TreeModel
            models = [kind.load(f"{path}/models/{i}-{k}") for k in range(part["models"])]
            bases.append(BaseModel(part["name"], head["classes"], models))
        meta = LogisticRegressionModel.load(f"{path}/meta") if head["stacked"] else None
        mapping = spark.read.parquet(f"{path}/labels")
        return cls(list(head["features"]), mapping, head["classes"], profile, bases, meta, dict(head["metrics"]))


HEAD_SCHEMA = (
    "features array<string>, classes int, bases array<struct<name:string,models:int>>, stacked boolean, "
    "metrics map<string,double>"
)


def prepared(df: DataFrame, profile: prep.Profile, keep: list[str]) -> DataFrame:
    """``keep`` and the fitted columns as filled doubles."""
    return prep.apply_fill(prep.encode(df, profile, keep), profile.fills)


def dense_labels(df: DataFrame, label: str, out: str = "y") -> tuple[DataFrame, DataFrame]:
    """(labelled rows with codes 0..k-1, label table) for text and numeric labels alike."""
    labelled = df.where(F.col(label).isNotNull())
    codes = prep.pinned(dense_codes(labelled.select(F.col(label).alias("value")).distinct(), [], "value"))
    mapping = codes.select(F.col("value").cast("string").alias("label"), "code")
    key = codes.select(F.col("value").alias(label), F.col("code").alias(out))
    return labelled.join(small(key), label), mapping


def _assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


def fit_bases(train: DataFrame, names: list[str], classes: int, seed: int, params: dict) -> list[BaseModel]:
    return [train_base(name, train, classes, seed, **params.get(name, {})) for name in names]


def fold_of(keys: list[str], folds: int, seed: int) -> Column:
    return F.pmod(F.conv(F.substring(sampling.order_hash(f"{seed}-fold", keys), 1, 8), 16, 10).cast("bigint"), F.lit(folds))


def fit_stacking(
    train: DataFrame, names: list[str], classes: int, keys: list[str], folds: int = FOLDS, seed: int = 42, params: dict | None = None
) -> Model:
    """ML14: balanced logistic meta-model on out-of-fold probabilities.

    Folds come from the row hash, so every row is predicted by models that
    never saw it. A column ``FOLD`` of ``train`` stands for that hash. The
    probabilities are predicted once, into the shuffle that deals them evenly.
    """
    params = params or {}
    parted = train if FOLD in train.columns else train.withColumn(FOLD, fold_of(keys, folds, seed))
    pieces = None
    for k in range(folds):
        rest, held = parted.where(F.col(FOLD) != k).drop(FOLD), parted.where(F.col(FOLD) == k)
        cols = []
        for base in fit_bases(rest, names, classes, seed, params):
            held = base.probabilities(held, "features", f"__p_{base.name}")
            cols.append(f"__p_{base.name}")
        piece = held.select("y", "weight", array_to_vector(F.concat(*cols)).alias("meta"))
        pieces = piece if pieces is None else pieces.unionByName(piece)
    meta = LogisticRegression(
        featuresCol="meta", labelCol="y", weightCol="weight", maxIter=params.get("meta_iter", 100), family="multinomial"
    )
    # Every step of the fit is a task per partition, and each fold has as many as the table.
    return meta.fit(pieces.repartition(int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def train_pipeline(
    df: DataFrame,
    label: str,
    keys: list[str],
    features: list[str],
    models: str | list[str] = "random_forest,gbt",
    stacking: bool = False,
    k_best: int = 0,
    test_fraction: float = 0.2,
    seed: int = 42,
    params: dict | None = None,
) -> Ensemble:
    """ML18: clean, encode, split, scale, select, fit, combine, evaluate.

    ``features`` are raw columns: numbers, numeric text, times or categories;
    their preparation is fitted on the training rows and kept. Labels of any
    kind get dense codes. ``keys`` identify a row and shrink to one hash. The
    split, then the prepared rows in its place, are persisted to disk-backed
    storage only: a lost executor recomputes its part.
    """
    params = params or {}
    names = model_names(models)
    prep.check_two_classes(df, label)
    key = sampling.order_hash("row", keys).alias("row_key")
    keys = ["row_key"]
    coded, mapping = dense_labels(df.select(key, F.col(label).alias("__label"), *features), "__label")
    classes = mapping.count()
    split = sampling.stratified_split(coded.drop("__label"), "y", keys, test_fraction, seed).persist(StorageLevel.DISK_ONLY)
    filled = None
    try:
        profile = prep.fit_profile(split.where("NOT is_test").select(*features))
        filled = prepared(split, profile, [*keys, "y", "is_test"]).persist(StorageLevel.DISK_ONLY)
        train, test = filled.where("NOT is_test"), filled.where("is_test")
        profile.means, profile.stds = prep.fit_scaler(train, features)
        split.unpersist()
        chosen = features
        if 0 < k_best < len(features):
            scores = prep.anova_f(train, features, "y")
            chosen = [r["feature"] for r in prep.select_k_best(scores, k_best).collect()]  # one row per feature
        ready = prep.balanced_weights(prep.scale(train, {c: profile.means[c] for c in chosen}, profile.stds), "y")
        stacked = stacking and len(names) > 1
        fold = [fold_of(keys, FOLDS, seed).alias(FOLD)] if stacked else []
        ready = _assemble(ready, chosen).select(*keys, "y", "weight", "features", *fold).persist(StorageLevel.DISK_ONLY)
        try:
            bases = fit_bases(ready.drop(FOLD), names, classes, seed, params)
            meta = fit_stacking(ready, names, classes, keys, seed=seed, params=params) if stacked else None
        finally:
            ready.unpersist()
        ensemble = Ensemble(chosen, mapping, classes, profile, bases, meta)
        scored = ensemble._score_prepared(test)
        ensemble.metrics = evaluate_predictions(scored).first().asDict() | {"test_rows": float(scored.count())}
    finally:
        split.unpersist()
        if filled is not None:
            filled.unpersist()
    return ensemble


def evaluate_predictions(scored: DataFrame) -> DataFrame:
    """Overall metrics of scored rows that still carry the label code."""
    pairs = scored.groupBy(
        F.col("y").cast("string").alias("y_true"), F.col("prediction").cast("string").alias("y_pred")
    ).agg(F.count(F.lit(1)).alias("n"))
    return evaluate.overall_metrics(evaluate.per_class(pairs))
