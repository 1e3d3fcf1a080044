"""Connected components of an undirected graph in Spark, by alternating large and small stars.

Every round hangs neighbours under the smallest node they see, until each component is one star. A round is two
aggregations with map-side minimum, each joined back to the edges, so a node with very many edges is split by the
engine's skew join instead of meeting in one task. Rounds are cut by checkpoints in the shared folder. They end when every
node has one edge up or only edges down: the edges are stars then, and another round would change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voltrail.llm.common import cut, shuffles_go

MAX_ROUNDS = 100


def _with_least(edges: DataFrame) -> DataFrame:
    """(a, b, m): m is the smallest of a and its neighbours b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").withColumn("m", F.least("a", "m"))


def _each(edges: DataFrame, *columns: tuple[Column, Column], names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """A row for each of the pairs of ``columns`` from every edge; one pass, where a union would read the edges for each."""
    return edges.select(F.explode(F.array(*[F.struct(x.alias(names[0]), y.alias(names[1])) for x, y in columns])).alias("e")).select("e.*")


def _settled(stars: DataFrame) -> bool:
    """Whether no node has two edges up, or one up and one down."""
    a, b = F.col("a"), F.col("b")
    with shuffles_go(stars.sparkSession):
        return _each(stars, (a, F.lit(1)), (b, F.lit(0)), names=("node", "up")) \
            .groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n")) \
            .agg(F.count_if(F.expr("up > 0 and n > 1"))).first()[0] == 0


def stars_of(edges: DataFrame) -> DataFrame:
    """``edges``: (a, b) of longs. One row (node, component) for each node but the smallest of its component, which is the component."""
    a, b, m = F.col("a"), F.col("b"), F.col("m")
    stars = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(MAX_ROUNDS):
        large = _with_least(_each(stars, (a, b), (b, a))).where("b > a").select(b.alias("a"), m.alias("b"))  # repeated edges go below
        stars = cut(_each(_with_least(large), (a, m), (b, m)).where("a != b").distinct())
        if _settled(stars):
            return stars.select(a.alias("node"), b.alias("component"))
    raise RuntimeError("components did not settle")


def components(edges: DataFrame) -> DataFrame:
    """``edges``: (a, b) of longs. One row (node, component) for each node with an edge to another; component is its smallest node."""
    stars = stars_of(edges)
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
