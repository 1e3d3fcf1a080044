"""Duration models: random forest, gradient boosting, random search, importance and serving."""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import product

from pyspark.ml import Model, PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voltrail.functions.scalar import is_weekend, served_duration, start_hour_bin, valid_duration_request
from voltrail.models.heuristic import eval_metrics, residuals_by_station
from voltrail.models.preprocess import build_preprocessor, feature_names, is_test_row, prepared_rows
from voltrail.models.trees import Boosting, Forest, TreesModel, boosting_errors, nested_errors, take
from voltrail.operators.joins import modal_cluster_default
from voltrail.schema import (
    CATEGORICAL_FEATURES, ENERGY, MINUTES, NUMERIC_FEATURES, ROW_ID, STATION, WEEKDAYS,
)
from voltrail.session import stored
from voltrail.sources.sinks import save_model

SEED = 42

# The searched settings. A depth of None has no limit.
FOREST_GRID = {
    "numTrees": [200, 400, 600],
    "maxDepth": [None, 10, 20, 30],
    "minSamplesSplit": [2, 5, 10],
    "minInstancesPerNode": [1, 2, 4],
}
BOOSTING_GRID = {
    "stepSize": [0.03, 0.05, 0.1],
    "maxDepth": [None, 6, 10],
    "maxLeafNodes": [15, 31, 63],
    "minInstancesPerNode": [10, 20, 30],
    "l2": [0.0, 0.1, 0.5],
}
SEARCH_SETS, SEARCH_FOLDS = 12, 3


def random_forest(**params) -> Forest:
    return Forest(**params)


def boosting(**params) -> Boosting:
    return Boosting(**params)


MODELS = {"random_forest": (random_forest, FOREST_GRID), "hist_gradient_boosting": (boosting, BOOSTING_GRID)}
ERRORS = {"random_forest": nested_errors, "hist_gradient_boosting": boosting_errors}


@dataclass
class Prepared:
    """Encoded train and test rows on reliable storage, and the step that encodes new rows."""

    preprocessor: PipelineModel
    train: DataFrame
    test: DataFrame


def prepare(features: DataFrame, share: float = 0.2, seed: int = SEED, hash_columns: Sequence[str] = ()) -> Prepared:
    """Split by row, learn imputation and encoding on the train part, and store the encoded rows.

    Pass ``features`` as a stored table, as it is read for every learning step. The iterative fits and all scorings then read
    the encoded rows of both parts, which are stored here.
    """
    wanted = [ROW_ID, *NUMERIC_FEATURES, *CATEGORICAL_FEATURES, MINUTES]
    marked = features.select(*wanted, is_test_row(ROW_ID, share, seed).alias("is_test"))
    return encode(marked.filter(~F.col("is_test")), marked.filter("is_test"), hash_columns)


def encode(train: DataFrame, test: DataFrame, hash_columns: Sequence[str] = ()) -> Prepared:
    """Imputation and encoding learned on ``train``, both parts encoded and stored."""
    model = build_preprocessor(train, hash_columns).fit(train)
    return Prepared(model, stored(prepared_rows(model, train), "train"), stored(prepared_rows(model, test), "test"))


@dataclass
class Fitted:
    name: str
    model: Model
    params: dict = field(default_factory=dict)


def predict(model: Model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumnRenamed("prediction", "predicted_minutes")


@dataclass
class Scorer:
    """Encoding and trees as one predictor of feature rows; for permutation importance it scores all mixtures of a row together."""

    preprocessor: PipelineModel
    model: TreesModel
    encoded: str = "features"

    def __call__(self, rows: DataFrame) -> DataFrame:
        return predict(self.model, self.encode(rows))

    def encode(self, rows: DataFrame) -> DataFrame:
        return self.preprocessor.transform(rows)

    def mixed(self, rows: DataFrame, lent: str, columns: Sequence[str]) -> DataFrame:
        """A slot of the encoded vector is made of one column alone, so a mixed row's vector is put together of both vectors."""
        return self.model.transform_mixed(rows, lent, columns, feature_names(rows))


def sample_sets(grid: dict[str, list], n: int, seed: int = SEED) -> list[dict]:
    """``n`` distinct settings drawn at random from the grid."""
    every = [dict(zip(grid, values)) for values in product(*grid.values())]
    return random.Random(seed).sample(every, min(n, len(every)))


def fold_of(folds: int, row_id: str = ROW_ID, seed: int = SEED) -> Column:
    """Fold of a row, tied to its number and independent of the hold-out split."""
    digest = F.md5(F.concat_ws("-", F.lit(f"fold {seed}"), F.col(row_id).cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(folds)).cast("int")


def split_folds(prepared: Prepared, folds: int = SEARCH_FOLDS, hash_columns: Sequence[str] = ()) -> list[Prepared]:
    """For each fold the other folds as train part, with imputation and encoding learned on those alone."""
    marked = prepared.train.drop("features", "label").withColumn("_fold", fold_of(folds))
    return [encode(marked.filter(F.col("_fold") != k).drop("_fold"), marked.filter(F.col("_fold") == k).drop("_fold"), hash_columns)
            for k in range(folds)]


def tune(
    name: str,
    prepared: Prepared,
    n_sets: int = SEARCH_SETS,
    folds: int | list[Prepared] = SEARCH_FOLDS,
    grid: dict[str, list] | None = None,
    **fixed,
) -> tuple[Fitted, list[dict]]:
    """Random search with cross-validation on MAE; the best settings are refitted on all train rows.

    The preprocessing is part of what is validated: every fold learns its own (``split_folds``, which several models can share).
    Validation takes at most ``FIT_ROWS`` rows of each part; its fits are tasks of one job.
    """
    build, full_grid = MODELS[name]
    settings = sample_sets(grid or full_grid, n_sets)
    parts = split_folds(prepared, folds) if isinstance(folds, int) else folds
    samples = [(train, take(part.test.select("features", "label"), binning=train.binning))
               for part in parts for train in [take(part.train.select("features", "label"))]]
    means = ERRORS[name](prepared.train.sparkSession, [{**fixed, **chosen} for chosen in settings], samples)
    scores = [{"model": name, **chosen, "cv_mae": mean} for chosen, mean in zip(settings, means)]
    best = settings[min(range(len(settings)), key=means.__getitem__)]
    return Fitted(name, build(**fixed, **best).fit(prepared.train), best), scores


@dataclass
class Experiment:
    """Tuned models with their validation scores, hold-out errors, the best model with its residuals, and the rows fitted on."""

    models: list[Fitted]
    scores: list[dict]
    comparison: DataFrame
    best: Fitted
    residuals: DataFrame
    prepared: Prepared


def experiment(features: DataFrame, n_sets: int = SEARCH_SETS, folds: int = SEARCH_FOLDS, fit_rows: int | None = None,
               grids: dict[str, dict[str, list]] | None = None, hash_columns: Sequence[str] = (), prepared: Prepared | None = None,
               path: str | None = None) -> Experiment:
    """Tune both models, compare them and a mean predictor on the hold-out part, keep the best by MAE and save it.

    ``fit_rows`` bounds the labelled rows that are fitted on (by a hash of the row number, about); the hold-out part is whole.
    With ``path`` the best model is saved as a pipeline, with a table of its metadata beside it.
    """
    prepared = prepared or prepare(features, hash_columns=hash_columns)
    if fit_rows is not None:
        n = prepared.train.count()
        if n > fit_rows:
            chosen = prepared.train.filter(fold_of(1 << 20, seed=SEED + 1) < int(fit_rows / n * (1 << 20))).drop("features", "label")
            chosen = stored(chosen, "chosen")  # few rows of many, read for every learning step
            prepared = encode(chosen, prepared.test.drop("features", "label"), hash_columns)
    parts = split_folds(prepared, folds, hash_columns)
    models, scores = [], []
    for name in MODELS:
        fitted, found = tune(name, prepared, n_sets, parts, grid=(grids or {}).get(name))
        models.append(fitted)
        scores += found
    compared = stored(with_mean_predictor(comparison(models, prepared.test), prepared), "comparison")
    best_name = best_model(compared.filter(F.col("model") != MEAN_PREDICTOR)).first()["best_model"]
    best = next(m for m in models if m.name == best_name)
    residuals = residuals_by_station(predict(best.model, prepared.test))
    if path is not None:
        save_model(as_pipeline(prepared, best), path, best.name, best.params, compared.filter(F.col("model") == best.name))
    return Experiment(models, scores, compared, best, residuals, prepared)


MEAN_PREDICTOR = "mean_predictor"


def with_mean_predictor(scores: DataFrame, prepared: Prepared) -> DataFrame:
    """Adds the hold-out errors of predicting the train part's mean: what a model has to beat."""
    mean = prepared.train.agg(F.avg(MINUTES)).scalar()
    flat = eval_metrics(prepared.test.withColumn("predicted_minutes", mean))
    return scores.unionByName(flat.select(F.lit(99).alias("place"), F.lit(MEAN_PREDICTOR).alias("model"), "n", "mae", "rmse", "r2"))


def comparison(fitted: list[Fitted], test: DataFrame) -> DataFrame:
    """Hold-out errors of each model, in the order given."""
    tables = [
        eval_metrics(predict(f.model, test)).select(
            F.lit(i).alias("place"), F.lit(f.name).alias("model"), "n", "mae", "rmse", "r2"
        )
        for i, f in enumerate(fitted)
    ]
    table = tables[0]
    for other in tables[1:]:
        table = table.unionByName(other)
    return table


def best_model(scores: DataFrame) -> DataFrame:
    """The model with the least MAE, the first on a tie."""
    return scores.agg(
        F.min_by("model", F.struct("mae", "place")).alias("best_model"),
        F.min("mae").alias("mae"),
    )


def feature_importance(spark: SparkSession, fitted: Fitted, prepared: Prepared) -> DataFrame:
    """Importance of each input feature; the slots of an encoded text feature are added up."""
    totals = dict.fromkeys(NUMERIC_FEATURES + CATEGORICAL_FEATURES, 0.0)
    names = feature_names(prepared.train)
    vector = fitted.model.featureImportances
    for slot, value in zip(vector.indices, vector.values):
        totals[names[slot]] = totals.get(names[slot], 0.0) + float(value)
    return spark.createDataFrame(list(totals.items()), "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def request_features(requests: DataFrame, clusters: DataFrame) -> DataFrame:
    """Requests in the shape of the training table; what a request does not say is imputed."""
    day = F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.col("weekday") + 1)
    valid = requests.filter(valid_duration_request("energy_kwh", "start_hour", "weekday"))
    known = modal_cluster_default(valid, clusters).withColumns({
        ENERGY: F.col("energy_kwh"),
        "day_of_week": day,
        "is_weekend": is_weekend(day),
        "start_hour_bin": start_hour_bin("start_hour"),
        "station_cluster_label": F.col("cluster").cast("string"),
        MINUTES: F.lit(None).cast("double"),
    })
    absent = {c: F.lit(None).cast("double") for c in NUMERIC_FEATURES if c not in known.columns}
    absent |= {c: F.lit(None).cast("string") for c in CATEGORICAL_FEATURES if c not in known.columns}
    return known.withColumns(absent)


def serve(requests: DataFrame, clusters: DataFrame, preprocessor: PipelineModel, fitted: Fitted) -> DataFrame:
    """Predicted minutes per valid request, between 5 and 240, one decimal."""
    rows = preprocessor.transform(request_features(requests, clusters))
    return predict(fitted.model, rows).select(
        "request_id", STATION, "cluster", served_duration("predicted_minutes").alias("predicted_duration_minutes")
    )


def as_pipeline(prepared: Prepared, fitted: Fitted) -> PipelineModel:
    """Encoding and model as one persistable pipeline."""
    return PipelineModel([*prepared.preprocessor.stages, fitted.model])
