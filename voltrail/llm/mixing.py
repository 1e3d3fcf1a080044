"""Mixing sources to target weights by hash thresholds.

Every source gets a target number of words. A document lies at a point u of [0, 2^60), a hash of its id and text.
Each source takes all its documents ``epochs`` times, and once more those with ``u < cut``. The cut comes from
histograms: words are summed by source and leading hash bits, the bucket in which the remaining budget ends is found, and
only that bucket is summed again by its next bits, until it holds one point. Documents are then filtered by comparison
with the cut, nothing is sorted, and targets of a smaller budget take a subset of what a larger budget takes.

Defined results: a null text has size 0 and is taken with words 0. A null source is a source of its own, after all
others. Rows with equal id and text have the same point and are taken or left together. An empty table gives no rows.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from voltrail.llm.common import WORD, fresh, store, text_of

#: Hash bits of a document's point, and bits refined at a time (4096 buckets for each source).
BITS, STEP = 60, 12
#: A target is at most so many times the words of its source.
MOST = 3


def point(doc_id: Column, text: Column) -> Column:
    digits = F.substring(F.md5(F.concat_ws(":", doc_id.cast("string"), text).cast("binary")), 1, BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
                       point(F.col(id_col), F.col(text_col).cast("string")).alias("u"))


def targets(rows: DataFrame, weights: Sequence[float] = (1, 2, 3), budget: float = 1.0, most: int = MOST) -> DataFrame:
    """One row per source: source, source_size, target, epochs, rest (words of the last, partial epoch).

    ``weights`` repeat over the sources in code point order. ``budget`` is a share of all words. A target above
    ``most`` times its source stops there, and the excess goes to the others by weight: sources fill up in the
    order of size by weight, so one pass over them finds the level where the rest of the budget fits.
    """
    per = store(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * most
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    level = per.withColumn("weight", weight).withColumn("cap", cap) \
        .withColumn("all", F.sum("source_size").over(Window.partitionBy())) \
        .withColumn("level", (F.col("all") * F.lit(float(budget)) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
                    / F.sum("weight").over(after)) \
        .withColumn("place", F.row_number().over(full)) \
        .withColumn("level", F.min(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct("place", "level")))
                    .over(Window.partitionBy())["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return level.withColumn("target", target) \
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)) \
        .select("source", "source_size", "target", F.col("epochs").cast("long").alias("epochs"),
                (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"))


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """One row per source of ``goals`` with its ``cut``: points below it are taken once more."""
    goals = store(goals, "goals")  # a few values for each source: the planner broadcasts it while its files are small
    # open: the bucket in which the budget ends, as its leading bits, and the words below it
    found = goals.select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for left in range(BITS - STEP, -1, -STEP):
        inside = rows.join(found.withColumnRenamed("source", "s"),
                           F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("u", left + STEP) == F.col("prefix")))
        counts = inside.groupBy("source", F.shiftright("u", left).alias("bucket")) \
            .agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("below").alias("below"))
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        steps = counts.withColumn("below", F.col("below") + F.coalesce(F.sum("words").over(running), F.lit(0)))
        # the last bucket that starts at or below the budget
        found = store(steps.where(F.col("below") <= F.col("rest")).groupBy("source")
                      .agg(F.max_by(F.struct(F.col("bucket").alias("prefix"), "below", "words", "rest"), "bucket").alias("b"))
                      .select("source", "b.*"), "edges")
    # one point is left: take it when that comes nearer to the budget
    nearer = F.col("prefix") + F.when((F.col("rest") - F.col("below")) * 2 > F.col("words"), 1).otherwise(0)
    cuts = found.select(F.col("source").alias("s"), nearer.alias("cut"))
    return store(goals.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
                 .withColumn("cut", F.when(F.col("rest") > 0, F.coalesce("cut", F.lit(0))).otherwise(0)), "cuts")


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), budget: float = 1.0, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, repeats, taken."""
    rows = store(sizes(docs, id_col, text_col, source_col), "sizes")
    plan = thresholds(rows, targets(rows, weights, budget)).withColumnRenamed("source", "s")
    repeats = F.col("epochs") + F.when(F.col("u") < F.col("cut"), 1).otherwise(0)
    return rows.join(plan, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("repeats", repeats) \
        .select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), budget: float = 1.0, id_col: str = "doc_id",
          text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken, with all their columns."""
    rows = store(sizes(docs, id_col, text_col, source_col), "sizes")
    s, epochs, edge, times = (fresh(docs, x) for x in ("mix_source", "mix_epochs", "mix_cut", "mix_times"))
    plan = thresholds(rows, targets(rows, weights, budget)) \
        .select(F.col("source").alias(s), F.col("epochs").alias(epochs), F.col("cut").alias(edge))
    once = F.when(point(F.col(id_col), F.col(text_col).cast("string")) < F.col(edge), 1).otherwise(0)
    return docs.join(plan, F.col(source_col).cast("string").eqNullSafe(F.col(s))) \
        .withColumn(times, F.explode(F.array_repeat(F.lit(1), (F.col(epochs) + once).cast("int")))) \
        .select(*[F.col(f"`{c}`") for c in docs.columns])
