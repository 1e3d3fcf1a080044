"""Lookups, duration estimates, duration models and station segments."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from voltrail.models import duration as D, forecast as M, heuristic as H, preprocess as P, segments as G
from voltrail.models.permutation import permutation_importance
from voltrail.operators import joins as J, reports as R, tables as T
from voltrail.plans.forecasting import STATION_FIT, station_days
from voltrail.plans.history import FEATURE_COLUMNS, FEATURES, labelled_features, stored_labels
from voltrail.plans.registry import once, query
from voltrail.plans.reporting import FEATURE_DOUBLES, STATION_FEATURES
from voltrail.schema import (
    CATEGORICAL_FEATURES, ENERGY, MINUTES, NUMERIC_FEATURES, ROW_ID, SEGMENT_FEATURES, STATION,
)
from voltrail.session import scratch_path, stored
from voltrail.sources import sinks as OUT
from voltrail.sources.mapping import requests, sessions


# --- cluster lookups ------------------------------------------------------------------------------

TEXT_SQL = "CASE cluster " + " ".join(f"WHEN {n} THEN '{t}'" for n, t in J.CLUSTER_TEXTS.items())


@query("cluster_describe", "SELECT request_id, charging_station_id, cluster, " + TEXT_SQL +
       " ELSE concat('Cluster ', cluster, ' station') END AS description FROM requests JOIN labels USING "
       "(charging_station_id)")
def _(spark, sf_dir):
    asked = requests(spark, sf_dir).select("request_id", STATION)
    return J.cluster_describe(asked, stored_labels(spark, sf_dir))


@query("modal_cluster_default", "SELECT request_id, charging_station_id, coalesce(cluster, (SELECT cluster FROM labels GROUP "
       "BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS cluster FROM requests LEFT JOIN labels USING (charging_station_id)")
def _(spark, sf_dir):
    asked = requests(spark, sf_dir).select("request_id", STATION)
    return J.modal_cluster_default(asked, stored_labels(spark, sf_dir))


# --- median estimates -----------------------------------------------------------------------------

def estimate_sql(source: str, key: str, energy: str) -> str:
    return (
        f"SELECT s.*, coalesce(CASE WHEN p.charger_type IS NOT NULL THEN b.med ELSE c.med END, (SELECT "
        "median(charging_duration_minutes) FROM sessions)) * greatest(6e-1, least(16e-1, s." + energy + " / (SELECT "
        "greatest(median(energy_consumed_kwh), 1e0) FROM sessions))) AS predicted_minutes FROM (SELECT *, "
        f"CAST(start_hour // 4 * 4 AS INT) AS hour_block FROM {source}) s "
        "LEFT JOIN med_block b ON s.charger_type = b.charger_type AND s.day_of_week = b.day_of_week AND s.hour_block = "
        "b.hour_block LEFT JOIN med_charger c ON s.charger_type = c.charger_type AND s.hour_block = c.hour_block "
        "LEFT JOIN seen_pairs p ON s.charger_type = p.charger_type AND s.day_of_week = p.day_of_week"
    )


ESTIMATE = {
    "blocks": "SELECT charger_type, day_of_week, CAST(start_hour // 4 * 4 AS INT) AS hour_block, "
              "charging_duration_minutes AS m FROM sessions",
    "med_block": "SELECT charger_type, day_of_week, hour_block, median(m) AS med FROM blocks GROUP BY 1, 2, 3",
    "med_charger": "SELECT charger_type, hour_block, median(m) AS med FROM blocks GROUP BY 1, 2",
    "seen_pairs": "SELECT DISTINCT charger_type, day_of_week FROM blocks",
    "asked_estimates": estimate_sql("requests", "request_id", "energy_kwh"),
    "session_estimates": estimate_sql("sessions", "row_id", "energy_consumed_kwh"),
}


def medians(spark, sf_dir):
    return once(spark, sf_dir, "medians", lambda: H.duration_medians(sessions(spark, sf_dir)))


def asked_estimates(spark, sf_dir):
    return H.estimate_duration(requests(spark, sf_dir), medians(spark, sf_dir))


def session_estimates(spark, sf_dir):
    wanted = [ROW_ID, STATION, "charger_type", "day_of_week", "start_hour", ENERGY, MINUTES]
    return H.estimate_duration(sessions(spark, sf_dir).select(*wanted), medians(spark, sf_dir), ENERGY)


@query("heuristic_lookup", "SELECT 'block' AS level, charger_type, day_of_week, hour_block, med AS median_minutes FROM "
       "med_block UNION ALL SELECT 'charger', charger_type, NULL, hour_block, med FROM med_charger UNION ALL SELECT 'all', "
       "NULL, NULL, NULL, median(m) FROM blocks", ("median_minutes",), extra=ESTIMATE)
def _(spark, sf_dir):
    return H.duration_medians(sessions(spark, sf_dir)).drop("median_energy")


@query("estimate_duration", "SELECT request_id, predicted_minutes FROM asked_estimates", ("predicted_minutes",),
       extra=ESTIMATE)
def _(spark, sf_dir):
    return asked_estimates(spark, sf_dir).select("request_id", "predicted_minutes")


RANGE = ("predicted_minutes", "optimistic_minutes", "conservative_minutes")


@query("duration_range", "SELECT request_id, predicted_minutes, greatest(5e0, predicted_minutes * 85e-2) AS "
       "optimistic_minutes, predicted_minutes * 115e-2 AS conservative_minutes FROM asked_estimates", RANGE, extra=ESTIMATE)
def _(spark, sf_dir):
    return H.duration_range(asked_estimates(spark, sf_dir)).select("request_id", *RANGE)


@query("batch_predict", "SELECT row_id, charging_station_id, predicted_minutes FROM session_estimates",
       ("predicted_minutes",), extra=ESTIMATE)
def _(spark, sf_dir):
    return session_estimates(spark, sf_dir).select(ROW_ID, STATION, "predicted_minutes")


ERROR = "(charging_duration_minutes - predicted_minutes)"


@query("eval_metrics", f"SELECT count(*) AS n, avg(abs({ERROR})) AS mae, sqrt(avg({ERROR} * {ERROR})) AS rmse, 1 - "
       f"sum({ERROR} * {ERROR}) / (var_pop(charging_duration_minutes) * count(*)) AS r2 FROM session_estimates",
       ("mae", "rmse", "r2"), extra=ESTIMATE)
def _(spark, sf_dir):
    return H.eval_metrics(session_estimates(spark, sf_dir))


RESIDUALS = (f"SELECT charging_station_id, count(*) AS sessions, avg(abs({ERROR})) AS mae, avg({ERROR}) AS bias, "
             f"sqrt(avg({ERROR} * {ERROR})) AS rmse FROM session_estimates GROUP BY 1")
RESIDUAL_DOUBLES = ("mae", "bias", "rmse")


@query("residuals_by_station", RESIDUALS, RESIDUAL_DOUBLES, extra=ESTIMATE)
def _(spark, sf_dir):
    return H.residuals_by_station(session_estimates(spark, sf_dir))


@query("rmse_of", f"SELECT charging_station_id, sqrt(avg({ERROR} * {ERROR})) AS rmse FROM session_estimates GROUP BY 1",
       ("rmse",), extra=ESTIMATE)
def _(spark, sf_dir):
    from voltrail.functions.scalar import rmse_of
    error = F.col(MINUTES) - F.col("predicted_minutes")
    return session_estimates(spark, sf_dir).groupBy(STATION).agg(rmse_of(error).alias("rmse"))


@query("worst_residual_stations", RESIDUALS + " ORDER BY mae DESC, charging_station_id LIMIT 5", RESIDUAL_DOUBLES,
       extra=ESTIMATE)
def _(spark, sf_dir):
    return H.worst_residual_stations(H.residuals_by_station(session_estimates(spark, sf_dir)))


# --- model inputs ---------------------------------------------------------------------------------

@query("split_train_test", "SELECT row_id, substring(md5(concat('42-', row_id)), 1, 8) < '33333333' AS is_test FROM sessions")
def _(spark, sf_dir):
    return P.split_train_test(sessions(spark, sf_dir).select(ROW_ID))


@query("imputed_values", " UNION ALL ".join(
    [f"SELECT '{c}' AS column, median(CAST({c} AS DOUBLE)) AS median, NULL AS most_common FROM features"
     for c in NUMERIC_FEATURES] +
    [f"SELECT '{c}', NULL, (SELECT {c} FROM features WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
     for c in CATEGORICAL_FEATURES]), ("median",), extra=FEATURES)
def _(spark, sf_dir):
    return P.fill_table(stored_features(spark, sf_dir))


def stored_features(spark, sf_dir):
    """The feature table on reliable storage: imputation, encoding and scoring read it several times."""
    return once(spark, sf_dir, "features", lambda: stored(labelled_features(spark, sf_dir), "features"))


def prepared(spark, sf_dir) -> D.Prepared:
    return once(spark, sf_dir, "prepared", lambda: D.prepare(stored_features(spark, sf_dir)))


TRAIN = {**FEATURES, **{
    "train": "SELECT * FROM features WHERE NOT (substring(md5(concat('42-', row_id)), 1, 8) < '33333333')",
}}
FILLED = " + ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT median({c}) FROM train))" for c in NUMERIC_FEATURES)


@query("preprocess", f"SELECT row_id, {FILLED} AS numeric_sum, CAST({len(CATEGORICAL_FEATURES)} AS DOUBLE) AS "
       "active_categories FROM train", ("numeric_sum", "active_categories"), extra=TRAIN)
def _(spark, sf_dir):
    """Per train row: sum of the imputed numeric slots and number of one-hot slots set."""
    values = vector_to_array("features")
    n = len(NUMERIC_FEATURES)
    total = lambda part: F.aggregate(part, F.lit(0.0), lambda a, b: a + b)
    return prepared(spark, sf_dir).train.select(
        ROW_ID,
        total(F.slice(values, 1, n)).alias("numeric_sum"),
        total(F.slice(values, n + 1, F.size(values) - n)).alias("active_categories"),
    )


# --- duration models (rows only) ------------------------------------------------------------------
# All of these rest on the tuned models of the whole search: the library's grids, 12 sets and 3 folds for both models.

#: Labelled rows that the search is fitted on (the library's documented bound; the hold-out part is whole).
SEARCH_ROWS = 5000


def searched(spark, sf_dir) -> D.Experiment:
    return once(spark, sf_dir, "experiment", lambda: D.experiment(
        stored_features(spark, sf_dir), fit_rows=SEARCH_ROWS, prepared=prepared(spark, sf_dir), path=scratch_path(spark, "best-model")))


def tuned(spark, sf_dir, name: str) -> D.Fitted:
    return next(m for m in searched(spark, sf_dir).models if m.name == name)


def tuned_errors(spark, sf_dir):
    """Hold-out errors of the tuned models."""
    return searched(spark, sf_dir).comparison.filter(F.col("model") != D.MEAN_PREDICTOR)


def predicted(spark, sf_dir, name: str):
    rows = D.predict(tuned(spark, sf_dir, name).model, searched(spark, sf_dir).prepared.test)
    return rows.select(ROW_ID, STATION, MINUTES, "predicted_minutes")


@query("duration_rf")
def _(spark, sf_dir):
    return predicted(spark, sf_dir, "random_forest")


@query("duration_gbt")
def _(spark, sf_dir):
    return predicted(spark, sf_dir, "hist_gradient_boosting")


@query("tune")
def _(spark, sf_dir):
    """Validation scores of both models."""
    names = sorted({k for _, grid in D.MODELS.values() for k in grid})
    rows = [(s["model"], *[float(s[k]) if s.get(k) is not None else None for k in names], s["cv_mae"]) for s in searched(spark, sf_dir).scores]
    return spark.createDataFrame(rows, "model string, " + ", ".join(f"{k} double" for k in names) + ", cv_mae double")


@query("experiment")
def _(spark, sf_dir):
    """Hold-out errors of the tuned models and of a mean predictor; the best one is marked."""
    found = searched(spark, sf_dir)
    return found.comparison.withColumn("is_best", F.col("model") == found.best.name)


@query("experiment_residuals")
def _(spark, sf_dir):
    return searched(spark, sf_dir).residuals


@query("model_comparison")
def _(spark, sf_dir):
    return tuned_errors(spark, sf_dir)


@query("best_model")
def _(spark, sf_dir):
    return D.best_model(tuned_errors(spark, sf_dir))


@query("duration_report")
def _(spark, sf_dir):
    return T.duration_table(tuned_errors(spark, sf_dir))


@query("model_residuals")
def _(spark, sf_dir):
    return H.residuals_by_station(predicted(spark, sf_dir, "hist_gradient_boosting"))


@query("feature_importance")
def _(spark, sf_dir):
    return D.feature_importance(spark, tuned(spark, sf_dir, "random_forest"), searched(spark, sf_dir).prepared)


@query("permutation_importance")
def _(spark, sf_dir):
    """Growth of the tuned boosting's hold-out error, one mixed column at a time."""
    fitted, parts = tuned(spark, sf_dir, "hist_gradient_boosting"), searched(spark, sf_dir).prepared
    return permutation_importance(parts.test.drop("features", "label"), FEATURE_COLUMNS, D.Scorer(parts.preprocessor, fitted.model))


MIXED_COLUMNS = [ENERGY, "start_hour", "user_id"]
MIXED = {
    "dealt": "SELECT *, md5(concat('42-', row_id)) AS digest, (SELECT greatest(1, CAST(ceil(count(*) / 1e3) AS BIGINT)) FROM sessions) AS "
             "groups FROM sessions",
    "lending": "SELECT *, " + ", ".join(
        f"CASE WHEN place = n THEN first_value({c}) OVER w ELSE lead({c}) OVER w END AS lent_{c}" for c in MIXED_COLUMNS)
        + " FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY digest, row_id) AS place, count(*) OVER (PARTITION BY part) AS n "
        "FROM (SELECT *, CAST('0x' || substring(digest, 1, 8) AS BIGINT) % groups AS part FROM dealt)) "
        "WINDOW w AS (PARTITION BY part ORDER BY place)",
    "rule_errors": " UNION ALL ".join(
        f"SELECT '{mixed}' AS feature, avg(abs(charging_duration_minutes - (6e0 * {'lent_' if mixed == ENERGY else ''}{ENERGY} + "
        f"{'lent_' if mixed == 'start_hour' else ''}start_hour))) AS mae FROM lending" for mixed in ["", *MIXED_COLUMNS]),
}


@query("permutation_importance_of_rule", "SELECT feature, mae - (SELECT mae FROM rule_errors WHERE feature = '') AS importance, mae FROM rule_errors "
       "WHERE feature <> ''", ("importance", "mae"), extra=MIXED)
def _(spark, sf_dir):
    """The same on a predictor that SQL has too; it does not look at the user, whose importance is 0."""
    return permutation_importance(sessions(spark, sf_dir), MIXED_COLUMNS, lambda rows: rows.withColumn(
        "predicted_minutes", 6.0 * F.col(ENERGY) + F.col("start_hour")))


@query("duration_serve")
def _(spark, sf_dir):
    found = searched(spark, sf_dir)
    return D.serve(requests(spark, sf_dir), stored_labels(spark, sf_dir), found.prepared.preprocessor, found.best)


@query("saved_pipeline")
def _(spark, sf_dir):
    """Persist the encoding and the best model as one pipeline, load it and score all sessions with it."""
    found = searched(spark, sf_dir)
    path = OUT.save_model(D.as_pipeline(found.prepared, found.best), scratch_path(spark, "pipeline"))
    return PipelineModel.load(path).transform(stored_features(spark, sf_dir)).select(
        ROW_ID, F.col("prediction").alias("predicted_minutes")
    )


# --- checked properties of what has no SQL form ----------------------------------------------------
# The properties hold for any model, so they are checked on small ones; the SQL of the search's check fixes 2 sets.

def forest(spark, sf_dir) -> D.Fitted:
    def build():
        params = {"numTrees": 20, "maxDepth": 8}
        return D.Fitted("random_forest", D.random_forest(**params).fit(prepared(spark, sf_dir).train), params)
    return once(spark, sf_dir, "forest", build)


def boosted(spark, sf_dir) -> D.Fitted:
    def build():
        params = {"maxIter": 10, "stepSize": 0.1, "maxDepth": 5}
        return D.Fitted("hist_gradient_boosting", D.boosting(**params).fit(prepared(spark, sf_dir).train), params)
    return once(spark, sf_dir, "boosted", build)


def compared(spark, sf_dir):
    return D.comparison([forest(spark, sf_dir), boosted(spark, sf_dir)], prepared(spark, sf_dir).test)


LIGHT_GRIDS = {
    "random_forest": {"numTrees": [5, 10], "maxDepth": [3, 5], "minInstancesPerNode": [1, 2, 4]},
    "hist_gradient_boosting": {"stepSize": [0.05, 0.1], "maxDepth": [3, 4], "maxIter": [5]},
}


def light_search(spark, sf_dir) -> D.Experiment:
    return once(spark, sf_dir, "light search", lambda: D.experiment(
        stored_features(spark, sf_dir), n_sets=2, folds=3, fit_rows=SEARCH_ROWS, grids=LIGHT_GRIDS, prepared=prepared(spark, sf_dir)))


TEST_ROWS = "SELECT * FROM features WHERE substring(md5(concat('42-', row_id)), 1, 8) < '33333333'"


@query("best_of_predictors", "SELECT CASE WHEN a <= b THEN 'median_estimate' ELSE 'station_mean' END AS best_model, least(a, b) AS mae FROM "
       f"(SELECT avg(abs({ERROR})) AS a FROM session_estimates), (SELECT avg(abs(charging_duration_minutes - m)) AS b FROM (SELECT *, "
       "avg(charging_duration_minutes) OVER (PARTITION BY charging_station_id) AS m FROM sessions))", ("mae",), extra=ESTIMATE)
def _(spark, sf_dir):
    """The choice of the best model, on two predictors that SQL has too."""
    rows = session_estimates(spark, sf_dir)
    means = rows.groupBy(STATION).agg(F.avg(MINUTES).alias("predicted_minutes"))
    scored = [H.eval_metrics(rows), H.eval_metrics(rows.drop("predicted_minutes").join(means, STATION))]
    named = [s.withColumns({"place": F.lit(i), "model": F.lit(n)}) for i, (s, n) in enumerate(zip(scored, ("median_estimate", "station_mean")))]
    return D.best_model(named[0].unionByName(named[1]))


def _model_properties(name: str, which) -> None:
    @query(name, f"SELECT row_id, charging_station_id, charging_duration_minutes, true AS is_predicted, true AS better_on_train FROM ({TEST_ROWS})",
           (MINUTES,), extra=FEATURES)
    def _(spark, sf_dir):
        """A finite prediction for every test session, by a model with a smaller error than the mean on its train rows."""
        model, parts = which(spark, sf_dir).model, prepared(spark, sf_dir)
        mean = parts.train.agg(F.avg(MINUTES)).scalar()
        error = D.predict(model, parts.train).agg(
            (F.avg(F.abs(F.col(MINUTES) - F.col("predicted_minutes"))) < F.avg(F.abs(F.col(MINUTES) - mean))).alias("better")).scalar()
        known = F.col("predicted_minutes").isNotNull() & ~F.isnan("predicted_minutes")
        return D.predict(model, parts.test).select(ROW_ID, STATION, MINUTES, known.alias("is_predicted"), error.alias("better_on_train"))


_model_properties("duration_rf_properties", forest)
_model_properties("duration_gbt_properties", boosted)


@query("tune_properties", " UNION ALL ".join(
    f"SELECT '{name}' AS model, CAST({n} AS BIGINT) AS sets, true AS scored, true AS best_is_least" for name, n in
    (("random_forest", 2), ("hist_gradient_boosting", 2))))
def _(spark, sf_dir):
    """Each model has the number of distinct settings asked for, all scored, and keeps the one with the least error."""
    found = light_search(spark, sf_dir)
    rows = []
    for fitted in found.models:
        own = [s for s in found.scores if s["model"] == fitted.name]
        least = min(own, key=lambda s: s["cv_mae"])
        distinct = {tuple(sorted((k, v) for k, v in s.items() if k != "cv_mae")) for s in own}
        rows.append((fitted.name, len(distinct), all(0 < s["cv_mae"] < 1e6 for s in own), all(least[k] == v for k, v in fitted.params.items())))
    return spark.createDataFrame(rows, "model string, sets bigint, scored boolean, best_is_least boolean")


@query("duration_serve_properties", "SELECT request_id, charging_station_id, coalesce(cluster, (SELECT cluster FROM labels GROUP BY 1 ORDER BY "
       "count(*) DESC, 1 LIMIT 1)) AS cluster, true AS in_range FROM requests LEFT JOIN labels USING (charging_station_id) "
       "WHERE energy_kwh > 0 AND start_hour BETWEEN 0 AND 23 AND weekday BETWEEN 0 AND 6")
def _(spark, sf_dir):
    """Every valid request is served, with its cluster, between 5 and 240 minutes at one decimal."""
    served = D.serve(requests(spark, sf_dir), stored_labels(spark, sf_dir), prepared(spark, sf_dir).preprocessor, forest(spark, sf_dir))
    minutes = F.col("predicted_duration_minutes")
    return served.select("request_id", STATION, "cluster", (minutes.between(5, 240) & (F.bround(minutes, 1) == minutes)).alias("in_range"))


@query("importance_properties", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, true AS not_negative, true AS sums_to_one" for c in NUMERIC_FEATURES + CATEGORICAL_FEATURES))
def _(spark, sf_dir):
    rows = D.feature_importance(spark, forest(spark, sf_dir), prepared(spark, sf_dir))
    total = rows.agg(F.sum("importance")).scalar()
    return rows.select("feature", (F.col("importance") >= 0).alias("not_negative"), (F.abs(total - 1) < 1e-9).alias("sums_to_one"))


@query("kmeans_properties", "SELECT charging_station_id, true AS nearest, true AS centre_is_mean FROM station_table",
       extra={"station_table": STATION_FEATURES})
def _(spark, sf_dir):
    """Every station once, in the cluster of the nearest stored centre; the centres are the means of their clusters."""
    found = segmentation(spark, sf_dir)
    path = OUT.write_parquet(found.centres(), scratch_path(spark, "centres"))
    centres = spark.read.parquet(path).select(F.col("cluster").alias("of"), F.array(*SEGMENT_FEATURES).alias("centre"))
    points = found.vectors.select(STATION, vector_to_array("features").alias("point")).join(found.labels.select(STATION, "cluster"), STATION)
    gap = F.aggregate(F.zip_with("point", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    nearest = points.crossJoin(F.broadcast(centres)).groupBy(STATION, "cluster").agg(
        F.min(gap).alias("least"), F.min(F.when(F.col("of") == F.col("cluster"), gap)).alias("own"))
    means = points.select("cluster", F.posexplode("point").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("mean"))
    off = means.join(centres, F.col("of") == F.col("cluster")).agg(
        (F.max(F.abs(F.col("mean") - F.col("centre")[F.col("i")])) < 1e-3).alias("ok")).scalar()
    return nearest.select(STATION, (F.col("own") <= F.col("least") + 1e-9).alias("nearest"), off.alias("centre_is_mean"))


@query("pca_properties", "SELECT count(*) AS stations, true AS uncorrelated, true AS first_is_larger, true AS within_variance FROM station_table",
       extra={"station_table": STATION_FEATURES})
def _(spark, sf_dir):
    """Scores of the two components: uncorrelated, the first the larger, together within the z-scores' variance."""
    points = G.pca_projection(segmentation(spark, sf_dir))
    return points.agg(
        F.count(F.lit(1)).alias("stations"), (F.abs(F.covar_pop("pc1", "pc2")) < 1e-6).alias("uncorrelated"),
        (F.var_pop("pc1") >= F.var_pop("pc2")).alias("first_is_larger"),
        (F.var_pop("pc1") + F.var_pop("pc2") <= len(SEGMENT_FEATURES) + 1e-6).alias("within_variance"))


# --- station segments -----------------------------------------------------------------------------

ZSCORES = ", ".join(f"(f.{c} - avg(f.{c}) OVER ()) / coalesce(nullif(stddev_pop(f.{c}) OVER (), 0), 1) AS {c}"
                    for c in SEGMENT_FEATURES)


@query("scale_features", f"SELECT charging_station_id, {ZSCORES} FROM station_table f", SEGMENT_FEATURES,
       extra={"station_table": STATION_FEATURES})
def _(spark, sf_dir):
    return G.scale_features(R.station_features(sessions(spark, sf_dir)))


def segmentation(spark, sf_dir) -> G.Segmentation:
    return once(spark, sf_dir, "segments", lambda: G.segment(R.station_features(sessions(spark, sf_dir))))


def rule_segments(spark, sf_dir):
    return R.station_features(sessions(spark, sf_dir)).join(stored_labels(spark, sf_dir), STATION)


RULE_SEGMENTS = {"station_table": STATION_FEATURES,
                 "segments": "SELECT * FROM station_table JOIN labels USING (charging_station_id)"}
SUMMARY_TEXT = TEXT_SQL + " ELSE concat('Cluster ', cluster) END"


@query("cluster_counts", f"SELECT cluster, count(*) AS station_count, {SUMMARY_TEXT} AS description, (SELECT count(*) FROM "
       "segments) AS total_stations, (SELECT count(DISTINCT cluster) FROM segments) AS total_clusters FROM segments "
       "GROUP BY 1", extra=RULE_SEGMENTS)
def _(spark, sf_dir):
    return G.cluster_counts(rule_segments(spark, sf_dir))


@query("cluster_profile", "SELECT cluster, " + ", ".join(f"round_even(avg({c}), 2) AS {c}" for c in SEGMENT_FEATURES)
       + " FROM segments GROUP BY 1", SEGMENT_FEATURES, extra=RULE_SEGMENTS)
def _(spark, sf_dir):
    return G.cluster_profile(rule_segments(spark, sf_dir))


@query("cluster_extremes", "SELECT CAST(sum(n) AS BIGINT) AS total_stations, count(*) AS clusters, max(n) AS largest, min(n) "
       "AS smallest FROM (SELECT cluster, count(*) AS n FROM segments GROUP BY 1)", extra=RULE_SEGMENTS)
def _(spark, sf_dir):
    return G.cluster_extremes(rule_segments(spark, sf_dir))


@query("kmeans_segments")
def _(spark, sf_dir):
    return segmentation(spark, sf_dir).labels.select(STATION, "cluster")


@query("kmeans_counts")
def _(spark, sf_dir):
    return G.cluster_counts(segmentation(spark, sf_dir).labels)


@query("kmeans_profile")
def _(spark, sf_dir):
    return G.cluster_profile(segmentation(spark, sf_dir).labels)


@query("segment_export", f"SELECT *, true AS labelled, true AS in_profile FROM ({STATION_FEATURES})", FEATURE_DOUBLES)
def _(spark, sf_dir):
    """Labels and profile written as tables and read back: the features, a label from 0 to 3, and the label's row in the profile."""
    found = segmentation(spark, sf_dir)
    folder = scratch_path(spark, "segments")
    profile = spark.read.parquet(OUT.write_parquet(G.cluster_profile(found.labels), f"{folder}/profile"))
    labels = spark.read.parquet(OUT.write_parquet(found.labels, f"{folder}/labels"))
    known = profile.select(F.col("cluster").alias("_c"), F.lit(True).alias("in_profile"))
    return labels.join(known, F.col("cluster") == F.col("_c"), "left").withColumns({
        "labelled": F.col("cluster").between(0, G.CLUSTERS - 1), "in_profile": F.coalesce("in_profile", F.lit(False))}).drop("cluster", "_c")


@query("segment_report")
def _(spark, sf_dir):
    return T.segment_table(G.cluster_profile(segmentation(spark, sf_dir).labels))


@query("silhouette")
def _(spark, sf_dir):
    return G.silhouette(spark, segmentation(spark, sf_dir).vectors)


DISTANCE = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in SEGMENT_FEATURES)
QUALITY = {
    "station_table": STATION_FEATURES,
    "scaled": f"SELECT charging_station_id, {ZSCORES} FROM station_table f",
    "placed": "SELECT * FROM scaled JOIN labels USING (charging_station_id)",
    "nearness": "SELECT a.charging_station_id, a.cluster AS own, b.cluster AS other, count(*) AS n, "
                f"sum({DISTANCE}) AS d FROM placed a, placed b GROUP BY 1, 2, 3",
    "separation": "SELECT charging_station_id, max(CASE WHEN own = other THEN d / nullif(n - 1, 0) END) AS inner_d, "
                  "min(CASE WHEN own <> other THEN d / n END) AS outer_d FROM nearness GROUP BY 1",
}


@query("silhouette_of_labels", "SELECT avg(CASE WHEN inner_d IS NULL THEN 0e0 ELSE (outer_d - inner_d) / "
       "greatest(outer_d, inner_d) END) AS silhouette FROM separation", ("silhouette",), extra=QUALITY)
def _(spark, sf_dir):
    vectors = G.assemble(G.scale_features(R.station_features(sessions(spark, sf_dir))))
    return G.label_silhouette(vectors, stored_labels(spark, sf_dir))


@query("pca_projection")
def _(spark, sf_dir):
    return G.pca_projection(segmentation(spark, sf_dir))


REPORT_TABLES = {
    **STATION_FIT, **ESTIMATE, **RULE_SEGMENTS,
    "estimate_errors": f"SELECT avg(abs({ERROR})) AS mae, sqrt(avg({ERROR} * {ERROR})) AS rmse, 1 - sum({ERROR} * {ERROR}) "
                       "/ (var_pop(charging_duration_minutes) * count(*)) AS r2 FROM session_estimates",
    "rule_profile": "SELECT cluster, " + ", ".join(f"round_even(avg({c}), 2) AS {c}" for c in SEGMENT_FEATURES)
                    + " FROM segments GROUP BY 1",
}
MEANS_FORMAT = " | ".join(["%.2f"] * len(SEGMENT_FEATURES))


@query("report_tables", "SELECT 'forecast' AS report, printf('| %s | %d | %.2f | %.2f | %s |', charging_station_id, train_rows, "
       "mae, rmse, CASE WHEN mape IS NULL THEN 'n/a' ELSE printf('%.3f', mape) END) AS line FROM st_metrics UNION ALL SELECT "
       "'duration', printf('| median_estimate | %.2f | %.2f | %.3f |', mae, rmse, r2) FROM estimate_errors UNION ALL SELECT "
       f"'segments', printf('| %d | {MEANS_FORMAT} |', cluster, {', '.join(SEGMENT_FEATURES)}) FROM rule_profile",
       extra=REPORT_TABLES)
def _(spark, sf_dir):
    """The lines of the three report tables: forecast, duration (median estimates) and segments (rule labels)."""
    errors = H.eval_metrics(session_estimates(spark, sf_dir)).withColumns(
        {"place": F.lit(0), "model": F.lit("median_estimate")})
    tables = {
        "forecast": T.forecast_table(M.metrics(station_days(spark, sf_dir))),
        "duration": T.duration_table(errors),
        "segments": T.segment_table(G.cluster_profile(rule_segments(spark, sf_dir))),
    }
    parts = [table.select(F.lit(name).alias("report"), "line") for name, table in tables.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
