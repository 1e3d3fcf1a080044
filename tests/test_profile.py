import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltrail.functions.quantiles import exact_quantiles
from voltrail.operators import profile as P, reports as R
from voltrail.sources.mapping import sessions

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


@pytest.fixture(scope="module")
def values(to_spark):
    rng = np.random.default_rng(3)
    n = 30_000
    frame = pd.DataFrame({
        # A third of all rows in one group; one group with a single row; one without values.
        "g": np.where(rng.random(n) < 0.4, "hot", [f"g{i}" for i in rng.integers(0, 5, n)]),
        "a": rng.lognormal(2, 2, n),
        "b": rng.integers(0, 7, n).astype(float),
    })
    frame.loc[rng.random(n) < 0.05, "a"] = np.nan
    frame = pd.concat([frame, pd.DataFrame({"g": ["one", "none"], "a": [1.5, np.nan], "b": [2.0, np.nan]})])
    return frame.reset_index(drop=True), to_spark(frame, "g string, a double, b double").repartition(6)


# Every group below the sketch's accuracy; real cuts; and several parts left in each round.
PATHS = [{}, {"accuracy": 500}, {"accuracy": 50, "buckets": 4}]


@pytest.mark.parametrize("path", PATHS)
def test_quantiles_equal_numpy(values, path):
    frame, df = values
    found = exact_quantiles(df, ["a", "b"], PROBS, **path).toPandas()
    assert len(found) == 2 * len(PROBS)
    for row in found.itertuples():
        assert row.value == pytest.approx(frame[row.column].quantile(row.prob), rel=1e-12)


@pytest.mark.parametrize("path", PATHS)
def test_grouped_quantiles_equal_numpy(values, path):
    frame, df = values
    found = exact_quantiles(df, ["a", "b"], PROBS, ["g"], **path).toPandas()
    assert len(found) == 2 * len(PROBS) * frame["g"].nunique()
    expected = frame.groupby("g")
    for row in found.itertuples():
        want = expected[row.column].quantile(row.prob)[row.g]
        assert (np.isnan(row.value) and np.isnan(want)) or row.value == pytest.approx(want, rel=1e-12)


def test_correlation_equals_pandas(to_spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame(rng.normal(1e6, 1.0, (2000, 3)), columns=["x", "y", "z"])
    frame["y"] += 0.5 * frame["x"]
    frame.loc[rng.random(2000) < 0.2, "z"] = np.nan
    frame["flat"] = 3.0
    df = to_spark(frame, "x double, y double, z double, flat double").repartition(5)
    found = P.correlation_matrix(df).toPandas()
    assert len(found) == 16
    expected = frame.corr()
    for row in found.itertuples():
        want = expected.loc[row.column_x, row.column_y]
        assert (np.isnan(row.corr) and np.isnan(want)) or row.corr == pytest.approx(want, abs=1e-8)


def test_describe_equals_pandas(spark, sf_dir):
    df = sessions(spark, sf_dir)
    frame = df.toPandas()
    found = P.describe_numeric(df, ["energy_consumed_kwh", "charging_rate_kw"], accuracy=100).toPandas()
    for row in found.to_dict("records"):
        want = frame[row["column"]].describe()
        got = [row[k] for k in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")]
        assert got == pytest.approx(want.tolist())


def test_categorical_tie_and_empty(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    assert tuple(P.describe_categorical(df).first()) == ("c", 2, 2, "a", 1)
    assert P.describe_categorical(spark.range(3)).isEmpty()


def test_histogram_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 2.0, 9.99, 10.0, None)], "v double")
    assert [tuple(r) for r in P.histogram(df, "v", 5).collect()] == [(0, 0.0, 2), (1, 2.0, 1), (4, 8.0, 2)]
    flat = spark.createDataFrame([(4.0,), (4.0,)], "v double")
    assert [tuple(r) for r in P.histogram(flat, "v", 5).collect()] == [(0, 4.0, 2)]


def test_top_values_are_limited_before_the_shuffle(spark, sf_dir):
    plan = P.category_top_values(sessions(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_missing_counts_nan_and_null(spark):
    df = spark.createDataFrame([(None, "x"), (float("nan"), None), (1.0, "y")], "v double, t string")
    assert [tuple(r) for r in P.missing_report_short(df).collect()] == [("v", 2, 66.67), ("t", 1, 33.33)]


def test_quantile_row_reports_agree_for_any_accuracy(spark, sf_dir):
    df = sessions(spark, sf_dir)
    row = R._quantile_row(df, "energy_consumed_kwh", {"m": 0.5}, accuracy=20).first()
    assert row["m"] == pytest.approx(R.energy_stats(df).first()["median_kwh"])


def test_ranks_in_brackets_are_cut_before_they_are_ordered(spark):
    """Many distinct values: the rounds leave only a few of them for the last window."""
    from voltrail.functions import quantiles as Q
    inside = spark.range(50_000).select(F.lit("c").alias("column"), F.lit(0.5).alias("prob"), F.col("id").cast("double").alias("v"), F.lit(2).alias("k"),
                                        F.lit(60_000).alias("first"), F.lit(60_001).alias("second"), F.lit(10_000).alias("base"))
    once = Q._narrowed(inside, ["column", "prob"], 128)
    twice = Q._narrowed(once, ["column", "prob"], 128).orderBy("v").collect()
    assert once.count() < 1500 and len(twice) < 30
    at = twice[0]["base"]
    for row in twice:
        if at <= 60_000 < at + row["k"]:
            assert row["v"] == 25_000.0
        at += row["k"]
    assert at > 60_001


def test_nan_is_missing_in_profiles(spark):
    df = spark.createDataFrame([(v, "x") for v in (1.0, 2.0, 6.0, float("nan"), None)], "v double, t string")
    row = P.describe_numeric(df).first()
    assert (row["count"], row["mean"], row["min"], row["p50"], row["max"]) == (3, 3.0, 1.0, 2.0, 6.0)
    assert [tuple(r) for r in P.histogram(df, "v", 5).collect()] == [(0, 1.0, 1), (1, 2.0, 1), (4, 5.0, 1)]
    assert P.describe_numeric(df.select("t")).isEmpty()


def test_every_column_that_is_asked_for_is_answered(spark):
    df = spark.createDataFrame([tuple("abcdefg")], ", ".join(f"c{i} string" for i in range(7)))
    assert P.category_top_values(df, df.columns).count() == 7
    assert P.category_top_values(df).count() == 5 and P.category_top_values(df, max_columns=6).count() == 6


def test_kpi_plans_expand_nothing(spark, sf_dir):
    for report in (R.kpi_dashboard, R.kpi_ratios, R.kpi_analytics):
        assert "Expand" not in report(sessions(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
