"""Lookups against station-sized tables, with the broadcast decision made on a measured size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voltrail.schema import ENERGY, STATION
from voltrail.session import stored

# A side is broadcast only when it was counted and holds at most this many (narrow) rows.
BROADCAST_ROWS = 200_000


def size_checked(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if it holds at most ``limit`` rows; else leave the join to AQE.

    ``df`` should be a stored or cheap table, as counting evaluates it. Beyond the limit the join is a
    shuffle join, and AQE splits the partitions of hot keys.
    """
    return F.broadcast(df) if df.count() <= limit else df


def keep_members(df: DataFrame, members: DataFrame, key: str = STATION, top_n: bool = False) -> DataFrame:
    """Rows whose key is in ``members``; ``top_n`` says that a limit already bounds their number."""
    ids = members.select(key)
    return df.join(F.broadcast(ids) if top_n else size_checked(ids), key, "left_semi")


def drop_members(df: DataFrame, members: DataFrame, key: str = STATION) -> DataFrame:
    """Rows whose key is not in ``members``; AQE broadcasts ``members`` if its shuffled size is small."""
    return df.join(members.select(key), key, "left_anti")


def attach_cluster(sessions: DataFrame, clusters: DataFrame | None, unknown: str = "unknown") -> DataFrame:
    """Cluster label of each session's station as text; ``unknown`` where there is none."""
    if clusters is None:
        return sessions.withColumn("station_cluster_label", F.lit(unknown))
    labels = clusters.select(STATION, F.col("cluster").cast("string").alias("station_cluster_label"))
    return sessions.join(size_checked(labels), STATION, "left").withColumn(
        "station_cluster_label", F.coalesce("station_cluster_label", F.lit(unknown))
    )


def label_totals(sessions: DataFrame, clusters: DataFrame, unknown: str = "unknown") -> DataFrame:
    """Sessions and energy of each station with its label. On tables bucketed alike by station nothing is exchanged."""
    labels = clusters.select(STATION, F.col("cluster").cast("string").alias("station_cluster_label"))
    return sessions.join(labels.hint("merge"), STATION, "left") \
        .groupBy(STATION, F.coalesce("station_cluster_label", F.lit(unknown)).alias("station_cluster_label")) \
        .agg(F.count(F.lit(1)).alias("sessions"), F.sum(ENERGY).alias("total_energy_kwh"))


# The text served for each cluster number.
CLUSTER_TEXTS = {
    0: "Low demand – occasional use station",
    1: "Medium demand – steady weekday station",
    2: "High demand – peak hour dominant station",
    3: "Very high demand – busy urban charging hub",
}


def cluster_text(cluster: Column | str, fallback_suffix: str = " station") -> Column:
    cluster = F.col(cluster) if isinstance(cluster, str) else cluster
    text = F.concat(F.lit("Cluster "), cluster.cast("string"), F.lit(fallback_suffix))
    for number, description in CLUSTER_TEXTS.items():
        text = F.when(cluster == number, F.lit(description)).otherwise(text)
    return text


def cluster_describe(requests: DataFrame, clusters: DataFrame) -> DataFrame:
    """Known requests with cluster and text; the rest is reported by ``unknown_stations``."""
    return requests.join(size_checked(clusters.select(STATION, "cluster")), STATION).withColumn(
        "description", cluster_text("cluster")
    )


def unknown_stations(requests: DataFrame, known: DataFrame) -> DataFrame:
    return drop_members(requests, known.select(STATION).distinct())


def unknown_station_sample(requests: DataFrame, known: DataFrame, n: int = 5) -> DataFrame:
    """Requested unknown stations, each with the first ``n`` known ids as a hint."""
    # The sample is n ids, whatever the number of stations.
    hint = (
        known.select(STATION).distinct().orderBy(STATION).limit(n)
        .agg(F.array_join(F.sort_array(F.collect_list(STATION)), ", ").alias("hint"))
    )
    return (
        unknown_stations(requests, known).select(STATION).distinct()
        .withColumn("available_sample", hint.scalar())
    )


def modal_cluster_default(requests: DataFrame, clusters: DataFrame) -> DataFrame:
    """Cluster of each request's station; the most common cluster (smallest on a tie) where unknown."""
    common = clusters.agg(F.mode("cluster", True).alias("cluster"))
    return requests.join(size_checked(clusters.select(STATION, "cluster")), STATION, "left").withColumn(
        "cluster", F.coalesce("cluster", common.scalar())
    )


def numbered(ordered: DataFrame) -> DataFrame:
    """Adds ``place``: 1, 2, ... in the order in which the rows of an ordered table come.

    The table is stored with the number of its partition and the place within; the window holds one row for each partition.
    """
    kept = stored(ordered.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}), "ordered")
    parts = kept.groupBy("_part").agg(F.min("_place").alias("_least"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.col("_start") + F.col("_place") - F.col("_least") + 1
    return kept.join(starts, "_part").withColumn("place", place).drop("_part", "_place", "_least", "_start")
