"""Station segments: scaling, k-means with restarts, quality, projection and profile tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from voltrail.operators.joins import cluster_text
from voltrail.schema import SEGMENT_FEATURES, STATION
from voltrail.session import cut_lineage

SEED, RESTARTS, CLUSTERS = 42, 20, 4


def scale_features(features: DataFrame, columns: list[str] = SEGMENT_FEATURES) -> DataFrame:
    """Z-scores with the population deviation; a constant column becomes 0."""
    moments = features.agg(F.struct(*[
        F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in columns
    ])).scalar()
    scaled = [
        ((F.col(c) - F.col(f"_m.{c}.mean")) / F.coalesce(F.nullif(F.col(f"_m.{c}.std"), F.lit(0.0)), F.lit(1.0)))
        .alias(c)
        for c in columns
    ]
    return features.withColumn("_m", moments).select(STATION, *scaled)


def assemble(scaled: DataFrame, partitions: int | None = None) -> DataFrame:
    """Feature vectors in a layout that depends on the station ids and the number of partitions, stored for the iterative fits.

    The layout decides which rows seed k-means. The number is that of the session's shuffles unless given.
    Cached on top of the stored copy: an iteration reads memory, a lost executor re-reads the files. Unpersist it after use.
    """
    partitions = partitions or int(scaled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vectors = VectorAssembler(inputCols=SEGMENT_FEATURES, outputCol="features").transform(scaled)
    laid_out = vectors.select(STATION, "features").repartition(partitions, STATION).sortWithinPartitions(STATION)
    return cut_lineage(laid_out).persist()


@dataclass
class Segmentation:
    labels: DataFrame
    vectors: DataFrame
    model: KMeansModel
    cost: float

    def release(self) -> None:
        """Drop the cached vectors; their stored copy stays."""
        self.vectors.unpersist()

    def centres(self) -> DataFrame:
        """The stored centres in scaled units: cluster and one column for each feature."""
        raw = [[float(x) for x in c] for c in self.model.clusterCenters()]
        volume = SEGMENT_FEATURES.index("session_count")
        ordered = sorted(raw, key=lambda c: (c[volume], c))
        return self.vectors.sparkSession.createDataFrame(
            [(i, *c) for i, c in enumerate(ordered)], "cluster int, " + ", ".join(f"{c} double" for c in SEGMENT_FEATURES))


def fit_kmeans(vectors: DataFrame, k: int = CLUSTERS, restarts: int = RESTARTS, seed: int = SEED,
               parallelism: int = 8) -> KMeansModel:
    """Best of several seeded runs by training cost; the runs are independent Spark jobs side by side."""
    def one(s: int) -> tuple[float, int, KMeansModel]:
        model = _one_kmeans(vectors, k, s)
        return model.summary.trainingCost, s, model

    return min(_side_by_side(vectors.sparkSession, one, range(seed, seed + restarts), parallelism), key=lambda r: r[:2])[2]


def _one_kmeans(vectors: DataFrame, k: int, seed: int) -> KMeansModel:
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="raw_cluster").fit(vectors)


def _side_by_side(spark: SparkSession, work, items, parallelism: int) -> list:
    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), items))


def segment(features: DataFrame, k: int = CLUSTERS, restarts: int = RESTARTS, seed: int = SEED) -> Segmentation:
    """Label every station; clusters are numbered by mean session count, least first.

    The station table is stored first, so the sessions are aggregated once.
    """
    features = cut_lineage(features)
    vectors = assemble(scale_features(features))
    model = fit_kmeans(vectors, k, restarts, seed)
    volume = SEGMENT_FEATURES.index("session_count")
    # k centres of nine numbers. Scaling keeps the order of the means.
    centers = [tuple(c) for c in model.clusterCenters()]
    order = sorted(range(len(centers)), key=lambda i: (centers[i][volume], centers[i]))
    number = F.element_at(
        F.create_map(*[F.lit(v) for raw, new in zip(order, range(len(order))) for v in (raw, new)]), F.col("raw_cluster")
    )
    assigned = model.transform(vectors).select(STATION, number.alias("cluster"))
    labels = cut_lineage(features.join(assigned, STATION).select(*features.columns, "cluster"))
    return Segmentation(labels, vectors, model, model.summary.trainingCost)


def cluster_profile(labels: DataFrame) -> DataFrame:
    """Mean of the nine features per cluster, two decimals."""
    return labels.groupBy("cluster").agg(*[F.bround(F.avg(c), 2).alias(c) for c in SEGMENT_FEATURES]).orderBy("cluster")


def cluster_counts(labels: DataFrame) -> DataFrame:
    """Stations per cluster with the text served for it, and the overall totals."""
    counts = labels.groupBy("cluster").agg(F.count(STATION).alias("station_count"))
    totals = labels.agg(F.struct(
        F.count(F.lit(1)).alias("total_stations"), F.countDistinct("cluster").alias("total_clusters")
    )).scalar()
    return counts.withColumn("_t", totals).select(
        "cluster", "station_count", cluster_text("cluster", "").alias("description"),
        "_t.total_stations", "_t.total_clusters",
    ).orderBy("cluster")


def cluster_extremes(labels: DataFrame) -> DataFrame:
    sizes = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.sum("n").alias("total_stations"),
        F.count(F.lit(1)).alias("clusters"),
        F.max("n").alias("largest"),
        F.min("n").alias("smallest"),
    )


SILHOUETTE_SCHEMA = "k int, silhouette double"


def silhouette(spark: SparkSession, vectors: DataFrame, ks=range(2, 11), seed: int = SEED) -> DataFrame:
    """Mean silhouette for each number of clusters (one number per k reaches the driver)."""
    evaluator = ClusteringEvaluator(featuresCol="features", predictionCol="raw_cluster")

    def one(k: int) -> tuple[int, float]:
        return k, float(evaluator.evaluate(_one_kmeans(vectors, k, seed).transform(vectors)))

    return spark.createDataFrame(_side_by_side(spark, one, ks, 8), SILHOUETTE_SCHEMA)


def label_silhouette(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean silhouette (squared Euclidean distance) of given labels, as one row."""
    labelled = vectors.join(labels.select(STATION, "cluster"), STATION)
    value = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(labelled)
    return vectors.sparkSession.createDataFrame([(float(value),)], "silhouette double")


def pca_projection(segmentation: Segmentation) -> DataFrame:
    """First two principal components of the scaled features, with the cluster."""
    model = PCA(k=2, inputCol="features", outputCol="pc").fit(segmentation.vectors)
    parts = vector_to_array("pc")
    points = model.transform(segmentation.vectors).select(STATION, parts[0].alias("pc1"), parts[1].alias("pc2"))
    return points.join(segmentation.labels.select(STATION, "cluster"), STATION)
