"""Permutation importance: how much a model's error grows when one column is mixed up among the rows.

Rows are dealt by a seeded hash of their id to groups of about ``GROUP_ROWS`` and ordered by it; each row lends its
values to the row before it. So every column is mixed at random without an order over all rows. All columns are scored in one
job, which reads the rows once. A predictor that says how (``mixed``) encodes a row once and scores all its mixtures together; for any
other function a row is repeated for each column after the only shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from voltrail.schema import MINUTES, ROW_ID

GROUP_ROWS = 1000


def permutation_importance(rows: DataFrame, columns: Sequence[str], predict: Callable[[DataFrame], DataFrame], row_id: str = ROW_ID,
                           actual: str = MINUTES, predicted: str = "predicted_minutes", seed: int = 42) -> DataFrame:
    """feature, importance (growth of the mean absolute error), mae: one row for each column, the most important first.

    ``predict`` adds the column ``predicted``. Rows without an actual value are left out; null values of a column are mixed as any others.
    An empty table gives no rows.

    ``predict`` may also have ``encode``, which adds the column ``predict.encoded`` made of the ``columns`` one by one, and ``mixed(rows, lent,
    columns)``, which adds the array ``predictions``: of the row itself, and for each column of the row with that column's part of ``lent``.
    """
    known = rows.filter(F.col(actual).isNotNull())
    groups = max(1, math.ceil(known.count() / GROUP_ROWS))
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(row_id).cast("string")))
    group = F.conv(F.substring("_digest", 1, 8), 16, 10).cast("bigint") % groups
    place = Window.partitionBy("_group").orderBy("_digest", row_id)
    if hasattr(predict, "mixed"):
        lending = (
            predict.encode(known).select(row_id, actual, predict.encoded)
            .withColumn("_digest", digest).withColumn("_group", group)
            .withColumn("_lent", _lent(F.col(predict.encoded), place))
        )
        scored = predict.mixed(lending, "_lent", columns)
        names = F.array(F.lit(""), *[F.lit(c) for c in columns])
        # an outer explode, as Spark would score every row once more to leave out empty arrays, of which there are none
        errors = scored.select(actual, F.posexplode_outer("predictions").alias("_at", predicted)) \
            .groupBy("_at").agg(_error(actual, predicted)).select(names[F.col("_at")].alias("_mixed"), "mae")
    else:
        mixed = (
            known.withColumn("_digest", digest).withColumn("_group", group)
            .withColumn("_lent", _lent(F.struct(*columns), place))
            .withColumn("_mixed", F.explode(F.array(F.lit(""), *[F.lit(c) for c in columns])))
            .withColumns({c: F.when(F.col("_mixed") == c, F.col(f"_lent.{c}")).otherwise(F.col(c)) for c in columns})
            .drop("_digest", "_group", "_lent")
        )
        errors = predict(mixed).groupBy("_mixed").agg(_error(actual, predicted))
    base = F.max(F.when(F.col("_mixed") == "", F.col("mae"))).over(Window.partitionBy())  # a row for each column
    return errors.withColumn("importance", F.col("mae") - base).filter("_mixed <> ''") \
        .select(F.col("_mixed").alias("feature"), "importance", "mae").orderBy(F.desc("importance"), "feature")


def _lent(value: Column, place: WindowSpec) -> Column:
    """What the next row of the group lends; the last row takes from the first."""
    return F.coalesce(F.lead(value).over(place), F.first(value).over(place))


def _error(actual: str, predicted: str) -> Column:
    return F.avg(F.abs(F.col(actual) - F.col(predicted))).alias("mae")
