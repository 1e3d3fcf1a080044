"""Exact quantiles (linear interpolation) that do not gather a large group in one task.

The built-in ``percentile`` keeps every distinct value of a group in one buffer. Here, for any number of rows:

1. one mergeable sketch per group (``approx_percentile``) gives two values that enclose each wanted
   rank with a wide margin over the sketch's error bound;
2. one counting pass finds how many values lie below each bracket and at its ends;
3. the values strictly inside a bracket, a fixed small fraction of the group's rows, are counted, and cut ``ROUNDS`` times
   in ``BUCKETS`` parts of which only those with a wanted rank stay;
4. the ranks are read off the cumulative counts of what is left, about 1 / 2,500 of the rows / ``BUCKETS`` ** ``ROUNDS``.

The result is exact. If a bracket ever missed its rank the job fails; it cannot return a wrong value.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from voltrail.operators.joins import size_checked
from voltrail.session import cut_lineage, stored

# The rank error of a sketch is n / accuracy, and a bracket spans six such errors. A task holds one sketch per group,
# so grouped sketches are smaller.
ACCURACY, GROUPED_ACCURACY = 15_000, 2_000
BUCKETS, ROUNDS = 128, 2
# A table of cuts is broadcast up to this size.
BROADCAST_BYTES = 64 << 20


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Long form: the ``by`` columns, ``column``, ``prob``, ``value`` (null for a group without values)."""
    wanted = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    return _bracketed(wanted, columns, probs, by, accuracy or (GROUPED_ACCURACY if by else ACCURACY), buckets)


# Three counters per cell: 32 cells stay below the 100 fields up to which Spark generates code.
CELLS_PER_SCAN = 32


def _bracketed(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str], accuracy: int, buckets: int
) -> DataFrame:
    margin = 3.0 / accuracy
    edges = [e for p in probs for e in (max(0.0, p - margin), min(1.0, p + margin))]
    points = F.array(*[F.lit(e) for e in edges])
    # A group of fewer rows than the accuracy is bounded and gets no cuts: all its values are inside. Beyond
    # that the margin of three sketch errors is at least three rows, so it also covers the rounding of ranks.
    sketch = cut_lineage(df.groupBy(*by).agg(*[F.count(c).alias(f"n_{c}") for c in columns], *[
        F.when(F.count(c) > accuracy, F.approx_percentile(c, points, accuracy)).alias(f"cut_{c}") for c in columns
    ]))
    cells = [(c, float(p), i) for c in columns for i, p in enumerate(probs)]
    rows = _with_cuts(df, sketch, columns, by, edges)

    brackets = sketch.select(*by, F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.lit(p).alias("prob"), F.col(f"n_{c}").alias("n"),
            _low(c, i).alias("low"), _high(c, i).alias("high"),
        )
        for c, p, i in cells
    ])))
    chunks = [cells[i:i + CELLS_PER_SCAN] for i in range(0, len(cells), CELLS_PER_SCAN)]
    counted = reduce(DataFrame.unionByName, [_edge_counts(rows, chunk, by) for chunk in chunks])
    key = [*by, "column", "prob"]
    rank = F.col("prob") * (F.col("n") - 1)
    known = cut_lineage(_join(brackets, counted, key).withColumns({"first": F.floor(rank), "second": F.ceil(rank), "rank": rank}))

    # Strictly inside a bracket there are few rows, however often its end values occur. ``stack`` keeps the
    # reshape in generated code, and its filter is not pushed (and so not copied) into the scan.
    long = rows.select(*by, F.stack(
        F.lit(len(columns)), *[part for c in columns for part in (F.lit(c), F.col(c), F.col(f"cut_{c}"))]
    ).alias("column", "v", "cut"))
    hits = [_inside(F.col("v"), F.col("cut"), i) for i in range(len(probs))]
    inside = long.filter(reduce(or_, hits)).select(*by, "column", "v", F.inline(F.filter(F.array(*[
        F.struct(F.lit(float(p)).alias("prob"), hit.alias("hit")) for p, hit in zip(probs, hits)
    ]), lambda x: x["hit"]))).groupBy(*key, "v").agg(F.count(F.lit(1)).alias("k"))
    ranks = known.select(*key, "first", "second", F.col("upto_low").alias("base"))
    left = stored(_join(inside, ranks, key), "inside")
    for _ in range(ROUNDS):
        left = stored(_narrowed(left, key, buckets), "inside")
    upto = F.col("base") + F.sum("k").over(Window.partitionBy(*key).orderBy("v"))
    looked_up = left.withColumn("upto", upto).groupBy(*key).agg(
        F.min(F.when(F.col("upto") > F.col("first"), F.col("v"))).alias("first_inside"),
        F.min(F.when(F.col("upto") > F.col("second"), F.col("v"))).alias("second_inside"),
    )

    def value_at(index: str) -> Column:
        within = F.coalesce(F.col(f"{index}_inside"), F.col("high"))
        return F.when(F.col(index) < F.col("upto_low"), F.col("low")).otherwise(within)

    missed = (F.col("first") < F.col("below")) | (F.col("second") >= F.col("upto_high"))
    a, b = value_at("first"), value_at("second")
    value = F.when(missed, F.raise_error(F.lit("quantile bracket missed its rank")).cast("double")).otherwise(
        a + (b - a) * (F.col("rank") - F.col("first"))
    )
    return _join(known, looked_up, key, "left").select(*key, F.when(F.col("n") > 0, value).alias("value"))


def _narrowed(inside: DataFrame, key: Sequence[str], buckets: int) -> DataFrame:
    """Of the values (v, k times) only those in the parts that hold a wanted rank; ``base`` values lie before them.

    The parts' limits come from a sketch of the distinct values, and are alike for all rows of a key whatever its error.
    """
    points = F.array(*[F.lit((i + 1) / buckets) for i in range(buckets - 1)])
    limits = inside.groupBy(*key).agg(F.approx_percentile("v", points, 10 * buckets).alias("limits"))
    placed = _join(inside, limits, key).withColumn("part", F.size(F.filter("limits", lambda x: x < F.col("v")))).drop("limits")
    sizes = placed.groupBy(*key, "part").agg(F.sum("k").alias("size"), *[F.first(c).alias(c) for c in ("first", "second", "base")])
    # one row for each part
    before = F.col("base") + F.coalesce(
        F.sum("size").over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    holds = [(F.col("before") <= F.col(r)) & (F.col("before") + F.col("size") > F.col(r)) for r in ("first", "second")]
    kept = sizes.withColumn("before", before).filter(holds[0] | holds[1]) \
        .select(*key, "part", F.min("before").over(Window.partitionBy(*key)).alias("start"))
    return _join(placed.drop("base"), kept, [*key, "part"]).withColumnRenamed("start", "base").drop("part")


def _low(column: str, i: int) -> Column:
    return F.col(f"cut_{column}")[2 * i]


def _high(column: str, i: int) -> Column:
    return F.col(f"cut_{column}")[2 * i + 1]


def _inside(v: Column, cut: Column, i: int) -> Column:
    return v.isNotNull() & (cut.isNull() | ((v > cut[2 * i]) & (v < cut[2 * i + 1])))


def _edge_counts(rows: DataFrame, cells: Sequence[tuple[str, float, int]], by: Sequence[str]) -> DataFrame:
    """Values below the bracket, up to its low end and up to its high end, per group and cell."""
    def counters(column: str, i: int) -> list[Column]:
        v, high = F.col(column), _high(column, i)
        return [F.count_if(v < _low(column, i)), F.count_if(v <= _low(column, i)),
                F.count_if(v.isNotNull() & (F.col(f"cut_{column}").isNull() | (v <= high)))]

    names = ["below", "upto_low", "upto_high"]
    wide = rows.groupBy(*by).agg(*[
        counter.alias(f"{name}_{j}")
        for j, (c, _, i) in enumerate(cells)
        for name, counter in zip(names, counters(c, i))
    ])
    return wide.select(*by, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(p).alias("prob"), *[F.col(f"{n}_{j}").alias(n) for n in names])
        for j, (c, p, _) in enumerate(cells)
    ])))


def _with_cuts(df: DataFrame, sketch: DataFrame, columns: Sequence[str], by: Sequence[str], edges: Sequence[float]) -> DataFrame:
    cuts = [f"cut_{c}" for c in columns]
    if by:
        row_bytes = 64 * len(by) + sum(8 * len(cut) + 32 for cut in [edges] * len(cuts))
        return _join(df, size_checked(sketch.select(*by, *cuts), BROADCAST_BYTES // row_bytes), by)
    only = sketch.first()  # one row of a few dozen numbers
    return df.withColumns({
        name: F.lit(None).cast("array<double>") if only[name] is None else F.array(*[F.lit(v) for v in only[name]])
        for name in cuts
    })


def _join(left: DataFrame, right: DataFrame, key: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null group keys match, as they form a group too."""
    other = right.withColumnsRenamed({k: f"_{k}" for k in key})
    # A rename keeps a broadcast mark of the right side.
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    return left.join(other, same, how).drop(*[f"_{k}" for k in key])
