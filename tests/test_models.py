import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltrail.models import duration as D, forecast as M, heuristic as H, preprocess as P, segments as G
from voltrail.operators import joins as J, reports as R
from voltrail.plans import modelling as Q
from voltrail.schema import CATEGORICAL_FEATURES, MINUTES, NUMERIC_FEATURES, SEGMENT_FEATURES, STATION
from voltrail.sources.mapping import sessions

DAY = dt.date(2024, 1, 1)


def series_of(spark, **lengths):
    """One series per name; y = 3 + day number."""
    rows = [(name, DAY + dt.timedelta(days=i), 3 + i) for name, n in lengths.items() for i in range(n)]
    return spark.createDataFrame(rows, f"{STATION} string, ds date, y bigint")


# --- forecast -------------------------------------------------------------------------------------

def test_two_days_fit_exactly_and_one_day_has_no_model(spark):
    series = series_of(spark, one=1, two=2)
    fitted = {r[STATION]: r for r in M.fit(series).collect()}
    assert set(fitted) == {"two"}
    assert (fitted["two"]["slope"], fitted["two"]["intercept"], fitted["two"]["sigma"]) == (1.0, 3.0, 0.0)
    ahead = M.future(M.fit(series), 3).orderBy("ds").collect()
    assert [(r["ds"], r["yhat"]) for r in ahead] == [(DAY + dt.timedelta(days=2 + i), 5.0 + i) for i in range(3)]
    scores = {r[STATION]: r for r in M.metrics(series).collect()}
    assert set(scores) == {"two"} and scores["two"]["mae"] == 0.0


def test_forecast_joins_history_and_future(spark):
    series = series_of(spark, a=9, b=12)
    found = M.forecast(series, 5, ci=95)
    assert found.count() == 9 + 12 + 10
    future = M.future(M.fit(series), 5, ci=95)
    assert future.exceptAll(found).isEmpty()


def test_weekday_effect_is_shrunk(spark):
    rows = [("s", DAY + dt.timedelta(days=i), 17 if i % 7 == 0 else 10) for i in range(28)]
    series = spark.createDataFrame(rows, f"{STATION} string, ds date, y bigint")
    fitted = M.fit(series).first()
    x, y = np.arange(28.0), np.array([r[2] for r in rows], float)
    slope, intercept = np.polyfit(x, y, 1)
    residual = (y - intercept - slope * x)[0::7]
    assert fitted["slope"] == pytest.approx(slope)
    assert fitted["effect_mon"] == pytest.approx(residual.sum() / (4 + 3))


def test_holdout_rule(spark):
    found = {r[STATION]: r for r in M.holdout(series_of(spark, a=13, b=14, c=40)).collect()}
    assert [found[k]["test_days"] for k in "abc"] == [0, 4, 7]
    assert found["a"]["mae"] is None and found["b"]["mae"] == pytest.approx(0.0, abs=1e-9)


def test_naive_needs_seven_rows(spark):
    found = {r[STATION]: r for r in M.naive(series_of(spark, six=6, seven=7, long=20), 1).collect()}
    assert found["six"]["yhat"] is None and found["six"]["yhat_lower"] is None
    assert found["seven"]["yhat"] == 6.0
    assert found["long"]["yhat"] == round(sum(range(9, 23)) / 14, 1)
    std = np.std(range(9, 23), ddof=1)
    assert found["long"]["yhat_upper"] == pytest.approx(found["long"]["yhat"] + 1.96 * std)


def test_auto_picks_the_model_by_length(spark):
    names = {r[STATION]: r["model"] for r in M.auto(series_of(spark, nine=9, ten=10), 4).collect()}
    assert names == {"nine": M.BASELINE_NAME, "ten": M.MODEL_NAME}


def test_serve_drops_invalid_and_unknown(spark):
    coefficients = M.fit(series_of(spark, a=10))
    asked = spark.createDataFrame([(1, "a", 2), (2, "a", 0), (3, "a", 366), (4, "zz", 2)],
                                  f"request_id bigint, {STATION} string, days int")
    served = M.serve(asked, coefficients, dt.date(2024, 2, 1)).collect()
    assert [(r["request_id"], r["date"]) for r in served] == [(1, "2024-02-01"), (1, "2024-02-02")]
    assert J.unknown_stations(asked, coefficients).first()["request_id"] == 4


def test_forecast_has_one_shuffle_by_station(spark, sf_dir):
    series = R.station_series(R.daily_agg(sessions(spark, sf_dir)))
    plan = M.metrics(series)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Join" not in plan


def test_richer_model_beats_the_mean(spark):
    found = M.per_group_model(series_of(spark, a=30)).first()
    assert found["train_rows"] == 30 and found["rmse"] < np.std(range(30))


# --- heuristic ------------------------------------------------------------------------------------

def test_heuristic_fallbacks(spark):
    data = [("L1", "Monday", 1, 10.0, 10.0), ("L1", "Monday", 2, 30.0, 10.0), ("L1", "Friday", 9, 80.0, 10.0),
            ("L2", "Monday", 20, 200.0, 10.0)]
    history = spark.createDataFrame(
        data, f"charger_type string, day_of_week string, start_hour int, {MINUTES} double, energy_consumed_kwh double")
    medians = H.duration_medians(history)
    asked = spark.createDataFrame(
        [(1, "L1", "Monday", 3, 10.0), (2, "L1", "Monday", 9, 10.0), (3, "L1", "Sunday", 9, 10.0),
         (4, "L9", "Monday", 1, 10.0), (5, "L1", "Monday", 0, 1.0), (6, "L1", "Monday", 0, 1000.0)],
        "id int, charger_type string, day_of_week string, start_hour int, energy_kwh double")
    found = {r["id"]: r["predicted_minutes"] for r in H.estimate_duration(asked, medians).collect()}
    # Block; pair known but block empty: overall; pair unknown: charger and block; charger unknown: overall.
    assert found == pytest.approx({1: 20.0, 2: 55.0, 3: 80.0, 4: 55.0, 5: 12.0, 6: 32.0})


def test_modal_default_and_texts(spark):
    clusters = spark.createDataFrame([("a", 2), ("b", 1), ("c", 7)], f"{STATION} string, cluster int")
    asked = spark.createDataFrame([("a",), ("x",), ("c",)], f"{STATION} string")
    assert {r[STATION]: r["cluster"] for r in J.modal_cluster_default(asked, clusters).collect()} == {
        "a": 2, "x": 1, "c": 7}
    texts = {r[STATION]: r["description"] for r in J.cluster_describe(asked, clusters).collect()}
    assert texts == {"a": J.CLUSTER_TEXTS[2], "c": "Cluster 7 station"}
    labels = {r[STATION]: r["station_cluster_label"] for r in J.attach_cluster(asked, clusters).collect()}
    assert labels == {"a": "2", "x": "unknown", "c": "7"}
    assert {r["station_cluster_label"] for r in J.attach_cluster(asked, None).collect()} == {"unknown"}


def test_size_check_decides_the_broadcast(spark):
    def hinted(limit):
        return "UnresolvedHint" in J.size_checked(spark.range(50), limit)._jdf.queryExecution().logical().toString()
    assert hinted(50) and not hinted(49)


# --- duration models ------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def prepared(spark, sf_dir):
    return Q.prepared(spark, sf_dir)


def test_split_is_stable_and_near_a_fifth(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "row_id")
    a = P.split_train_test(rows).filter("is_test")
    b = P.split_train_test(rows.repartition(13)).filter("is_test")
    assert a.exceptAll(b).isEmpty() and abs(a.count() / 20_000 - 0.2) < 0.01


def test_encoding_imputes_and_ignores_unseen_values(spark, prepared):
    names = P.feature_names(prepared.train)
    assert set(names) == set(NUMERIC_FEATURES + CATEGORICAL_FEATURES)
    strange = prepared.train.limit(1).withColumns({
        "charger_type": F.lit("never seen"), "temperature_degc": F.lit(None).cast("double")
    }).drop("features", "label")
    row = prepared.preprocessor.transform(strange).first()
    assert row["features"].size == len(names)
    slots = [i for i, n in enumerate(names) if n == "charger_type"]
    assert all(row["features"][i] == 0.0 for i in slots)
    assert row["features"][names.index("temperature_degc")] == row["temperature_degc_f"]


@pytest.mark.parametrize("which", [Q.forest, Q.boosted])
def test_models_beat_the_mean_on_train(spark, sf_dir, prepared, which):
    rows = D.predict(which(spark, sf_dir).model, prepared.train)
    mean = prepared.train.agg(F.avg(MINUTES)).first()[0]
    found = H.eval_metrics(rows).first()
    flat = H.eval_metrics(rows.withColumn("predicted_minutes", F.lit(mean))).first()
    assert found["mae"] < flat["mae"] and found["r2"] > 0
    assert flat["r2"] == pytest.approx(0.0, abs=1e-9)


def test_importance_sums_to_one_over_all_features(spark, sf_dir, prepared):
    rows = D.feature_importance(spark, Q.forest(spark, sf_dir), prepared).collect()
    assert {r["feature"] for r in rows} == set(NUMERIC_FEATURES + CATEGORICAL_FEATURES)
    assert sum(r["importance"] for r in rows) == pytest.approx(1.0)


def test_search_samples_are_distinct_and_seeded():
    sets = D.sample_sets(D.BOOSTING_GRID, 12)
    assert len({tuple(s.items()) for s in sets}) == 12 and sets == D.sample_sets(D.BOOSTING_GRID, 12)


def test_tuned_model_is_the_best_of_the_scores(prepared):
    fitted, scores = D.tune("random_forest", prepared, 2, 2, grid={"numTrees": [3], "maxDepth": [2, 4]})
    assert len(scores) == 2
    assert fitted.params["maxDepth"] == min(scores, key=lambda s: s["cv_mae"])["maxDepth"]


def test_served_durations_are_clamped(spark, sf_dir):
    rows = D.serve(Q.requests(spark, sf_dir), Q.stored_labels(spark, sf_dir), Q.prepared(spark, sf_dir).preprocessor,
                   Q.forest(spark, sf_dir)).collect()
    minutes = [r["predicted_duration_minutes"] for r in rows]
    assert len(rows) == Q.requests(spark, sf_dir).count()
    assert all(5 <= m <= 240 and round(m, 1) == m for m in minutes)


def test_saved_pipeline_predicts_the_same(spark, sf_dir, prepared, tmp_path):
    from pyspark.ml import PipelineModel

    from voltrail.sources.sinks import save_model
    fitted = Q.forest(spark, sf_dir)
    path = save_model(D.as_pipeline(prepared, fitted), str(tmp_path / "model"))
    loaded = PipelineModel.load(path).transform(prepared.test.drop("features", "label"))
    direct = D.predict(fitted.model, prepared.test)
    pairs = loaded.select("row_id", "prediction").join(direct.select("row_id", "predicted_minutes"), "row_id")
    assert pairs.filter("abs(prediction - predicted_minutes) > 1e-9").isEmpty() and not pairs.isEmpty()


# --- segments -------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def features(spark, sf_dir):
    return R.station_features(sessions(spark, sf_dir))


def test_segments_label_every_station_once(spark, sf_dir, features):
    found = Q.segmentation(spark, sf_dir).labels.toPandas()
    assert sorted(found[STATION]) == sorted(features.toPandas()[STATION])
    assert set(found["cluster"]) == {0, 1, 2, 3}
    means = found.groupby("cluster")["session_count"].mean()
    assert means.is_monotonic_increasing


def test_segments_do_not_depend_on_the_input_layout(features):
    a = G.segment(features, restarts=3).labels.select(STATION, "cluster")
    b = G.segment(features.repartition(5, "session_count"), restarts=3).labels.select(STATION, "cluster")
    assert a.exceptAll(b).isEmpty()


def test_restarts_keep_the_least_cost(features):
    vectors = G.assemble(G.scale_features(features))
    costs = [G.fit_kmeans(vectors, restarts=1, seed=s).summary.trainingCost for s in (42, 43, 44)]
    assert G.fit_kmeans(vectors, restarts=3).summary.trainingCost == pytest.approx(min(costs))


def test_zscores(spark, features):
    frame = G.scale_features(features).toPandas()[SEGMENT_FEATURES]
    assert np.allclose(frame.mean(), 0, atol=1e-9) and np.allclose(frame.std(ddof=0), 1)
    flat = features.withColumn("avg_cost_usd", F.lit(2.0))
    assert set(G.scale_features(flat).toPandas()["avg_cost_usd"]) == {0.0}


def test_silhouette_equals_brute_force(spark, sf_dir):
    """Spark's squared Euclidean silhouette, computed pair by pair."""
    vectors = Q.segmentation(spark, sf_dir).vectors
    found = G.silhouette(spark, vectors, ks=[3]).first()["silhouette"]
    rows = G._one_kmeans(vectors, 3, G.SEED).transform(vectors).select("features", "raw_cluster").collect()
    x = np.array([r[0].toArray() for r in rows])
    label = np.array([r[1] for r in rows])
    distance = ((x[:, None] - x[None]) ** 2).sum(-1)
    score = []
    for i in range(len(x)):
        same = (label == label[i])
        if same.sum() == 1:
            score.append(0.0)
            continue
        a = distance[i, same].sum() / (same.sum() - 1)
        b = min(distance[i, label == c].mean() for c in set(label) - {label[i]})
        score.append((b - a) / max(a, b))
    assert found == pytest.approx(np.mean(score), abs=1e-6)


def test_projection_equals_svd(spark, sf_dir):
    found = G.pca_projection(Q.segmentation(spark, sf_dir)).toPandas().sort_values(STATION)
    z = G.scale_features(R.station_features(sessions(spark, sf_dir))).toPandas().sort_values(STATION)
    x = z[SEGMENT_FEATURES].to_numpy()
    _, _, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    for column, axis in zip(("pc1", "pc2"), axes):
        assert np.allclose(np.abs(found[column]), np.abs(x @ axis), atol=1e-6)


def test_residual_table_matches_pandas(spark, sf_dir):
    rows = Q.session_estimates(spark, sf_dir)
    frame = rows.toPandas()
    frame["e"] = frame[MINUTES] - frame["predicted_minutes"]
    found = H.residuals_by_station(rows).toPandas().set_index(STATION)
    want = frame.groupby(STATION)["e"].agg(["size", lambda e: e.abs().mean(), "mean", lambda e: math.sqrt((e**2).mean())])
    want = want.loc[found.index]
    assert np.allclose(found[["sessions", "mae", "bias", "rmse"]], want)
    assert found["mae"].is_monotonic_decreasing


def test_hashed_columns_are_chosen_by_the_caller(spark, sf_dir):
    train = Q.stored_features(spark, sf_dir).limit(300)
    model = P.build_preprocessor(train, hash_columns=[STATION], hash_slots=16).fit(train)
    names = P.feature_names(P.prepared_rows(model, train))
    assert names.count(STATION) == 16 and set(names) == set(NUMERIC_FEATURES + CATEGORICAL_FEATURES)


def test_features_without_values_are_left_out(spark, sf_dir):
    train = Q.stored_features(spark, sf_dir).limit(200).withColumns({
        "temperature_degc": F.lit(None).cast("double"), "user_type": F.lit(None).cast("string")})
    with pytest.warns(UserWarning, match="left out"):
        model = P.build_preprocessor(train).fit(train)
    names = P.feature_names(P.prepared_rows(model, train))
    assert "temperature_degc" not in names and "user_type" not in names and "charger_type" in names


def test_folds_learn_their_own_preprocessing(spark, prepared):
    parts = D.split_folds(prepared, 3)
    assert sum(p.test.count() for p in parts) == prepared.train.count()
    rows = [set(r["row_id"] for r in p.test.select("row_id").collect()) for p in parts]
    assert not rows[0] & rows[1] and not rows[0] & rows[2]
    fills = {p.preprocessor.stages[0].getStatement() for p in parts}
    assert len(fills) > 1


def test_experiment_keeps_and_saves_the_best(spark, sf_dir, prepared, tmp_path):
    grids = {"random_forest": {"numTrees": [3], "maxDepth": [2, 3]}, "hist_gradient_boosting": {"maxIter": [2], "maxDepth": [2]}}
    path = str(tmp_path / "best")
    found = D.experiment(Q.stored_features(spark, sf_dir), n_sets=2, folds=2, grids=grids, prepared=prepared, path=path)
    rows = {r["model"]: r["mae"] for r in found.comparison.collect()}
    assert set(rows) == {"random_forest", "hist_gradient_boosting", D.MEAN_PREDICTOR} and len(found.scores) == 3
    models = {k: v for k, v in rows.items() if k != D.MEAN_PREDICTOR}
    assert found.best.name == min(models, key=models.get)
    about = spark.read.parquet(f"{path}-metadata").first()
    assert about["model_type"] == found.best.name and "maxDepth" in about["params"] and about["mae"] == pytest.approx(models[found.best.name])
    assert found.residuals.agg(F.sum("sessions")).first()[0] == prepared.test.count()


def test_richer_forecast_equals_least_squares(spark):
    rows = [("s", DAY + dt.timedelta(days=i), 10 + i + (5 if i % 7 == 2 else 0)) for i in range(140)]
    ahead = M.per_group_forecast(spark.createDataFrame(rows, f"{STATION} string, ds date, y bigint"), 7).orderBy("ds").collect()
    assert [r["ds"] for r in ahead] == [DAY + dt.timedelta(days=140 + i) for i in range(7)]
    want = [10 + 140 + i + (5 if (140 + i) % 7 == 2 else 0) for i in range(7)]
    assert [r["yhat"] for r in ahead] == pytest.approx(want, abs=0.6)


def test_scope_series_have_a_key(spark, sf_dir):
    daily = R.daily_agg(sessions(spark, sf_dir))
    whole = R.scope_series(daily, "all")
    assert whole.select(STATION).distinct().count() == 1
    assert whole.agg(F.sum("y")).first()[0] == daily.agg(F.sum("total_sessions")).first()[0]
    assert R.scope_series(daily, "none", station="absent").isEmpty()


def test_registered_search_is_the_whole_one(spark, sf_dir, monkeypatch):
    import inspect
    asked = {}
    shape = inspect.signature(D.experiment)

    def record(*args, **kwargs):
        call = shape.bind(*args, **kwargs)
        call.apply_defaults()
        asked.update(call.arguments)

    monkeypatch.setattr(Q, "once", lambda spark, sf_dir, label, build: build())
    for name in ("stored_features", "prepared"):
        monkeypatch.setattr(Q, name, lambda *_: None)
    monkeypatch.setattr(D, "experiment", record)
    Q.searched(spark, sf_dir)
    assert (asked["n_sets"], asked["folds"], asked["grids"]) == (12, 3, None)


def test_duration_queries_rest_on_the_search(spark, sf_dir, prepared, monkeypatch):
    grids = {"random_forest": {"numTrees": [3], "maxDepth": [2]}, "hist_gradient_boosting": {"maxIter": [2], "maxDepth": [2]}}
    found = D.experiment(Q.stored_features(spark, sf_dir), n_sets=1, folds=2, grids=grids, fit_rows=200, prepared=prepared)
    monkeypatch.setattr(Q, "searched", lambda *_: found)
    from voltrail.plans.registry import REGISTRY
    run = lambda name: REGISTRY[name].run(spark, sf_dir)
    errors = {r["model"]: r["mae"] for r in run("model_comparison").collect()}
    assert errors == {r["model"]: r["mae"] for r in found.comparison.collect() if r["model"] != D.MEAN_PREDICTOR}
    assert run("best_model").first()["best_model"] == found.best.name and run("duration_report").count() == 2
    for name, model in zip(("duration_rf", "duration_gbt"), found.models):
        error = run(name).agg(F.avg(F.abs(F.col("charging_duration_minutes") - F.col("predicted_minutes")))).first()[0]
        assert error == pytest.approx(errors[model.name])
    assert run("model_residuals").agg(F.sum("sessions")).first()[0] == prepared.test.count()
    assert run("feature_importance").count() > 0 and run("duration_serve").count() > 0
    scored = run("saved_pipeline").join(D.predict(found.best.model, found.prepared.test).select("row_id", F.col("predicted_minutes").alias("direct")), "row_id")
    assert scored.count() == prepared.test.count() and scored.where("abs(predicted_minutes - direct) > 1e-9").isEmpty()
