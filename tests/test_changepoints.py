"""Trend with bends: against least squares in numpy, on a series with a break, and the coverage of its bands."""

import datetime as dt

import numpy as np
import pytest

from voltrail.models import changepoints as C
from voltrail.plans.forecasting import station_days
from voltrail.schema import STATION

SCHEMA = f"{STATION} string, ds date, y double"
START = dt.date(2024, 1, 1)


def rows_of(name, days, values):
    return [(name, START + dt.timedelta(days=int(d)), None if v is None else float(v)) for d, v in zip(days, values)]


def design(days, last):
    x = np.asarray(days, float) / last
    weekday = np.array([(START + dt.timedelta(days=int(d))).weekday() for d in days])
    return np.column_stack([np.ones(len(x)), *[np.maximum(x - k, 0) for k in C.KNOTS], *[weekday == w for w in range(7)]])


def ridge(a, y, bend):
    inverse = np.linalg.inv(a.T @ a + np.diag([0, 0] + [bend] * C.CHANGES + [3] * 7))
    beta = inverse @ a.T @ y
    squares = ((y - a @ beta) ** 2).sum()
    return beta, inverse, squares if squares > C.EXACT * (y @ y) else 0.0


def direct(days, y):
    a, y = design(days, max(days)), np.asarray(y, float)
    beta, inverse, squares = ridge(a, y, C.FIRST_PENALTY)
    noise = squares / max(len(y) - 2 - C.CHANGES, 1)
    real = ((beta**2)[2:2 + C.CHANGES] - noise * np.diag(inverse)[2:2 + C.CHANGES]).mean()
    real = real if real > C.EXACT * (y @ y) / len(y) else 0.0
    bend = np.clip(noise / real, *C.PENALTY_RANGE) if real > 0 else C.PENALTY_RANGE[1]
    return bend, real, *ridge(a, y, bend)


def test_equals_least_squares(spark):
    rng = np.random.default_rng(3)
    series = {
        "long": (np.arange(300), rng.poisson(9, 300)),
        "gaps": (np.sort(rng.choice(np.arange(90), 31, replace=False) - 0), rng.normal(5, 2, 31)),
        "two": (np.array([0, 6]), np.array([4.0, 1.0])),
        "repeated": (np.array([0, 1, 1, 1, 9, 9, 12]), np.array([1, 2, 5, 3, 4, 4, 0.0])),
    }
    series["gaps"] = (series["gaps"][0] - series["gaps"][0][0], series["gaps"][1])
    rows = [r for name, (days, y) in series.items() for r in rows_of(name, days, y)]
    rows += rows_of("long", [5, 7], [None, None]) + rows_of("one", [3, 3], [1, 2]) + rows_of(None, [0, 1, 2], [1, 2, 3])
    found = {r[STATION]: r for r in C.fit(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(found) == {*series, None}
    for name, (days, y) in series.items():
        bend, real, beta, inverse, squares = direct(days, y)
        row = found[name]
        assert (row["bend_penalty"], row["bend_variance"]) == pytest.approx((bend, real), rel=1e-6)
        assert np.allclose([row[c] for c in C.PARAMETERS], beta, atol=1e-7), name
        assert row["sigma"] == pytest.approx(np.sqrt(squares / max(len(y) - 2, 1)), rel=1e-6)
        level, slope = np.array(C.LAST_LEVEL), np.array(C.LAST_SLOPE)
        assert np.allclose([row["level_spread"], row["level_slope_spread"], row["slope_spread"]],
                           [level @ inverse @ level, level @ inverse @ slope, slope @ inverse @ slope], rtol=1e-6)
        assert (row["train_rows"], row["last_day"]) == (len(y), START + dt.timedelta(days=int(max(days))))


def test_break_is_fitted_within_its_noise(spark):
    rng = np.random.default_rng(4)
    days = np.arange(240)
    truth = np.where(days < 120, 10 + days, 130 - 1.5 * (days - 120))
    coefficients = C.fit(spark.createDataFrame(rows_of("s", days, truth + rng.normal(0, 3, 240)), SCHEMA))
    row = coefficients.first()
    fitted = design(days, 239) @ [row[c] for c in C.PARAMETERS]
    assert np.sqrt(((fitted - truth) ** 2).mean()) < 3
    assert 2.4 < row["sigma"] < 4.5
    ahead = C.future(coefficients, 20).orderBy("ds").collect()
    assert [r.ds for r in ahead] == [START + dt.timedelta(days=240 + i) for i in range(20)]
    assert ahead[-1].yhat < ahead[0].yhat - 14


@pytest.mark.parametrize("rate", [15, 0])
def test_bands_widen_and_cover(spark, rate):
    """Series whose slope changes at random, also after the history: bands of 80 and 95 % hold about as many days."""
    rng = np.random.default_rng(5)
    history, horizon, rows, truth = 200, 60, [], {}
    for s in range(120):
        slopes = np.cumsum(np.where(rng.random(history + horizon) < rate / history, rng.laplace(0, 0.15, history + horizon), 0))
        y = 50 + np.cumsum(slopes) + rng.normal(0, 2, history + horizon)
        rows += rows_of(f"s{s}", range(history), y[:history])
        truth[f"s{s}"] = y[history:]
    coefficients = C.fit(spark.createDataFrame(rows, SCHEMA)).cache()
    for ci, low, high in ((80, 0.72, 0.88), (95, 0.85, 0.98)):
        ahead = C.future(coefficients, horizon, ci=ci).orderBy(STATION, "ds").collect()
        inside = [r.yhat_lower <= truth[r[STATION]][(r.ds - START).days - history] <= r.yhat_upper for r in ahead]
        assert low < np.mean(inside) < high, (ci, np.mean(inside))
        width = [r.yhat_upper - r.yhat_lower for r in ahead[:horizon]]
        assert all(b > a for a, b in zip(width, width[1:]))


def test_constant_and_empty_series(spark):
    row = C.fit(spark.createDataFrame(rows_of("flat", range(30), [7] * 30), SCHEMA)).first()
    assert row["sigma"] == 0 and row["intercept"] == pytest.approx(7) and row["bend_variance"] == 0
    assert C.future(C.fit(spark.createDataFrame([], SCHEMA))).count() == 0


def test_plan_is_one_shuffle_without_python(spark, sf_dir):
    days = station_days(spark, sf_dir)
    base = days._jdf.queryExecution().toString().count("Exchange hashpartitioning")
    plan = C.future(C.fit(days))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan
    assert plan.count("Exchange hashpartitioning") <= base + 1
