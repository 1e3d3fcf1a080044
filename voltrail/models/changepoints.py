"""Daily demand with a trend that may bend, fitted for all stations at once.

The trend is a line with ``CHANGES`` possible bends, evenly spread over the first ``RANGE`` of a series' days; bends and
weekday effects are shrunk (ridge). Between two bends every basis function is linear in time, so a few sums for each station and
segment hold all of the normal equations: one aggregation, then two small systems for each station, solved in column functions:
the first, hardly shrunk, gives the noise and the mean square of the bends less what the noise adds to it; their ratio is the
penalty of the second. Answers scale with the values; where nothing is left of the bends, the trend is nearly a line. One shuffle
by station, no Python.

Bands widen with the horizon for two reasons: level and slope at the last day are estimates, and bends go on after the last one
fitted, at the past rate and mean square, so that the trend's variance grows with the third power of time. Bends that drown in
the noise of a series are not found, and its bands are then far too narrow for them (figures in the README).

Days without a value are left out; repeated days count as several observations; series of a single day are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voltrail.functions.linear import dot, eliminated, solution, with_penalty
from voltrail.models.forecast import EFFECTS, WEEKDAY_SHRINKAGE, band_width
from voltrail.schema import STATION

CHANGES = 12
RANGE = 0.8
FIRST_PENALTY = 1e-3
PENALTY_RANGE = (1e-3, 1e3)
EXACT = 1e-9  # a smaller part of the values' squares is rounding

KNOTS = [RANGE * j / CHANGES for j in range(CHANGES + 1)]
BENDS = [f"change_{j}" for j in range(1, CHANGES + 1)]
SIZE = 2 + CHANGES + len(EFFECTS)
PARAMETERS = ["intercept", "slope", *BENDS, *EFFECTS]
LAST_LEVEL = [1.0, *[1 - knot for knot in KNOTS], *[0.0] * len(EFFECTS)]  # the last day in terms of the parameters
LAST_SLOPE = [0.0, *[1.0] * len(KNOTS), *[0.0] * len(EFFECTS)]

# Sums of a segment: over all days, then by weekday.
SUMS = {"n": "1D", "x": "x", "xx": "x * x", "y": "y", "xy": "x * y", "yy": "y * y"}
BY_DAY = ["n", "x", "y"]


def moments(series: DataFrame, key: str = STATION) -> DataFrame:
    """The sums of each series and segment of its time: all that a fit needs to know of the days."""
    whole = Window.partitionBy(key)
    days = (
        series.select(key, "ds", F.col("y").cast("double").alias("y")).filter("y IS NOT NULL AND ds IS NOT NULL")
        .withColumns({"first_day": F.min("ds").over(whole), "last_day": F.max("ds").over(whole)})
        .filter("first_day < last_day")
        .withColumn("x", F.datediff("ds", "first_day") / F.datediff("last_day", "first_day").cast("double"))
        .withColumns({
            "segment": F.least(F.lit(CHANGES), F.floor(F.col("x") * CHANGES / RANGE).cast("int")),
            "weekday": F.weekday("ds"),
        })
    )
    return days.groupBy(key, "segment").agg(
        F.min("first_day").alias("first_day"),
        F.max("last_day").alias("last_day"),
        *[F.sum(F.expr(value)).alias(name) for name, value in SUMS.items()],
        *[
            F.sum(F.when(F.col("weekday") == w, F.expr(SUMS[name])).otherwise(0.0)).alias(f"{name}_{w}")
            for name in BY_DAY for w in range(len(EFFECTS))
        ],
    )


def _above(segments: Column, width: int) -> Column:
    """For each knot the sums of the days above it, with the knot itself in front."""
    zeros = F.array(*[F.lit(0.0)] * width)
    return F.transform(F.array(*map(F.lit, KNOTS)), lambda knot, j: F.struct(
        knot.alias("knot"),
        F.aggregate(
            F.filter(segments, lambda s: s["segment"] >= j),
            zeros,
            lambda total, s: F.zip_with(total, s["sums"], lambda a, b: a + b),
        ).alias("sums"),
    ))


def _system(above: Column) -> Column:
    """Normal equations of (1, hinge at each knot, weekday), right side last."""
    place = {name: i for i, name in enumerate(SUMS)}
    start = {name: len(SUMS) + i * len(EFFECTS) for i, name in enumerate(BY_DAY)}

    def total(t: Column, name: str) -> Column:
        return t["sums"][place[name]]

    def by_day(t: Column, name: str) -> Column:
        return F.slice(t["sums"], start[name] + 1, len(EFFECTS))

    def hinge(t: Column, of: str, plain: str) -> Column:
        return total(t, of) - t["knot"] * total(t, plain)

    def both(t: Column, u: Column) -> Column:
        m = F.when(t["knot"] >= u["knot"], t["sums"]).otherwise(u["sums"])
        return m[place["xx"]] - (t["knot"] + u["knot"]) * m[place["x"]] + t["knot"] * u["knot"] * m[place["n"]]

    def hinge_days(t: Column) -> Column:
        return F.zip_with(by_day(t, "x"), by_day(t, "n"), lambda x, n: x - t["knot"] * n)

    every = above[0]
    ones = F.concat(F.array(total(every, "n")), F.transform(above, lambda t: hinge(t, "x", "n")), by_day(every, "n"),
                    F.array(total(every, "y")))
    hinges = F.transform(above, lambda t: F.concat(
        F.array(hinge(t, "x", "n")), F.transform(above, lambda u: both(t, u)), hinge_days(t), F.array(hinge(t, "xy", "y"))))
    weekdays = F.transform(by_day(every, "n"), lambda n, w: F.concat(
        F.array(n), F.transform(above, lambda t: F.get(hinge_days(t), w)),
        F.transform(by_day(every, "n"), lambda m, v: F.when(v == w, m).otherwise(0.0)), F.array(F.get(by_day(every, "y"), w))))
    return F.concat(F.array(ones), hinges, weekdays)


def _numbers(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _penalty(bend: Column) -> Column:
    return F.concat(_numbers([0, 0]), F.array_repeat(bend, CHANGES), _numbers([WEEKDAY_SHRINKAGE] * len(EFFECTS)))


def _squares(beta: str, bend: Column) -> Column:
    """Squares of the residuals, from the sums alone."""
    right = F.transform("system", lambda row: F.get(row, F.lit(SIZE)))
    shrunk = dot(F.transform(beta, lambda b: b * b), _penalty(bend))
    left_over = F.col("yy") - dot(F.col(beta), right) - shrunk
    return F.when(left_over > F.col("yy") * EXACT, left_over).otherwise(0.0)


def _with_sides(system: Column, sides: list[list[float]]) -> Column:
    wanted = F.array(*map(_numbers, sides))
    return F.transform(system, lambda row, i: F.concat(row, F.transform(wanted, lambda side: F.get(side, i))))


def fit(series: DataFrame, key: str = STATION) -> DataFrame:
    """One row of coefficients for each series of two days or more; slopes are in units of the whole span."""
    names = [*SUMS, *[f"{name}_{w}" for name in BY_DAY for w in range(len(EFFECTS))]]
    first, (least, most) = F.lit(FIRST_PENALTY), map(F.lit, PENALTY_RANGE)
    units = [[float(i == 2 + j) for i in range(SIZE)] for j in range(CHANGES)]
    bends = F.slice("first_beta", 3, CHANGES)
    own_noise = F.aggregate(
        F.sequence(F.lit(0), F.lit(CHANGES - 1)), F.lit(0.0),
        lambda total, j: total + F.get(F.get("first", j + 2), j + SIZE + 1) / F.get(F.get("first", j + 2), j + 2))
    noise = _squares("first_beta", first) / F.greatest(F.col("train_rows") - 2 - CHANGES, F.lit(1))
    real = (dot(bends, bends) - F.col("noise") * own_noise) / CHANGES
    return (
        moments(series, key)
        .groupBy(key)
        .agg(
            F.min("first_day").alias("first_day"),
            F.max("last_day").alias("last_day"),
            F.sum("n").cast("bigint").alias("train_rows"),
            F.sum("yy").alias("yy"),
            F.sort_array(F.collect_list(F.struct("segment", F.array(*names).alias("sums")))).alias("segments"),
        )
        .withColumn("above", _above(F.col("segments"), len(names)))
        .withColumn("system", _system(F.col("above")))
        .withColumn("first", eliminated(_with_sides(with_penalty(F.col("system"), _penalty(first)), units), SIZE))
        .withColumn("first_beta", solution(F.col("first"), SIZE))
        .withColumn("noise", noise)
        .withColumn("real", real)
        .withColumn("bend_variance", F.when(F.col("real") > F.col("yy") / F.col("train_rows") * EXACT, F.col("real")).otherwise(0.0))
        .withColumn("bend_penalty", F.when(F.col("bend_variance") > 0, F.greatest(least, F.least(
            most, F.col("noise") / F.col("bend_variance")))).otherwise(most))
        .withColumn("second", eliminated(_with_sides(
            with_penalty(F.col("system"), _penalty(F.col("bend_penalty"))), [LAST_LEVEL, LAST_SLOPE]), SIZE))
        .withColumns({
            "beta": solution(F.col("second"), SIZE),
            "level_side": solution(F.col("second"), SIZE, 1),
            "slope_side": solution(F.col("second"), SIZE, 2),
        })
        .select(
            key, "train_rows", "first_day", "last_day", "bend_penalty", "bend_variance",
            F.sqrt(_squares("beta", F.col("bend_penalty")) / F.greatest(F.col("train_rows") - 2, F.lit(1))).alias("sigma"),
            *[F.get("beta", F.lit(i)).alias(name) for i, name in enumerate(PARAMETERS)],
            dot(F.col("level_side"), _numbers(LAST_LEVEL)).alias("level_spread"),
            dot(F.col("slope_side"), _numbers(LAST_LEVEL)).alias("level_slope_spread"),
            dot(F.col("slope_side"), _numbers(LAST_SLOPE)).alias("slope_spread"),
        )
    )


def predict(points: DataFrame, ci: float = 80) -> DataFrame:
    """Fitted value and band on rows that hold a date ``ds`` and the coefficients; the band is level inside the history."""
    span = F.datediff("last_day", "first_day").cast("double")
    x = F.datediff("ds", "first_day") / span
    ahead = F.greatest(F.datediff("ds", "last_day") / span, F.lit(0.0))
    bent = sum((F.col(c) * F.greatest(x - knot, F.lit(0.0)) for c, knot in zip(BENDS, KNOTS[1:])), F.lit(0.0))
    effect = F.element_at(F.array(*[F.col(c) for c in EFFECTS]), F.weekday("ds") + 1)
    unknown = F.when(ahead > 0, ahead + (1 - RANGE)).otherwise(0.0)
    drift = F.col("bend_variance") * (CHANGES / RANGE) * unknown * unknown * unknown / 3
    estimate = F.col("level_spread") + 2 * ahead * F.col("level_slope_spread") + ahead * ahead * F.col("slope_spread")
    spread = F.sqrt(F.col("sigma") * F.col("sigma") * (1 + estimate) + drift) * band_width(ci)
    return points.withColumn("yhat", F.col("intercept") + F.col("slope") * x + bent + effect).withColumns({
        "yhat_lower": F.col("yhat") - spread,
        "yhat_upper": F.col("yhat") + spread,
    })


def future(coefficients: DataFrame, horizon: int = 30, key: str = STATION, ci: float = 80) -> DataFrame:
    """The ``horizon`` days after the last day of each series."""
    days = F.sequence(F.date_add("last_day", 1), F.date_add("last_day", horizon))
    return predict(coefficients.withColumn("ds", F.explode(days)), ci).select(key, "ds", "yhat", "yhat_lower", "yhat_upper")
