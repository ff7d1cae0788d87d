"""Topics of embeddings: dense regions, or a fixed number of clusters that also takes new rows."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.operators.density import OUTLIER, dense_topics


def discover_topics(df: DataFrame, min_size: int = 10, embedding: str = "embedding", **options) -> DataFrame:
    """Add ``topic``: dense regions of at least ``min_size`` rows, as many as there are; see ``density.dense_topics``."""
    return dense_topics(df, embedding, min_size, **options)


def train_topics(df: DataFrame, k: int = 20, embedding: str = "embedding", seed: int = 42,
                 iterations: int = 20) -> KMeansModel:
    """Cluster embeddings; centroids are all that ever reaches the driver."""
    vectors = df.select(array_to_vector(F.col(embedding).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=iterations, featuresCol="features", predictionCol="topic").fit(vectors)


def assign_topics(df: DataFrame, model: KMeansModel, embedding: str = "embedding") -> DataFrame:
    """Add ``topic``: the nearest cluster of each row."""
    vectors = df.withColumn("features", array_to_vector(F.col(embedding).cast("array<double>")))
    return model.transform(vectors).drop("features")


def relabel_small(df: DataFrame, min_size: int = 10) -> DataFrame:
    """Topics with fewer than ``min_size`` rows become the outlier topic -1."""
    sizes = df.groupBy("topic").agg(F.count("*").alias("_size"))
    merged = df.join(sizes, "topic")
    return merged.withColumn("topic", F.when(F.col("_size") < min_size, OUTLIER).otherwise(F.col("topic"))).drop("_size")


def cluster_topics(df: DataFrame, min_size: int = 10, k: int = 20, embedding: str = "embedding", seed: int = 42) -> DataFrame:
    """Train ``k`` clusters, assign and relabel in one go."""
    return relabel_small(assign_topics(df, train_topics(df, k, embedding, seed), embedding), min_size)


def topic_info(assigned: DataFrame) -> DataFrame:
    """``(topic, size, is_outlier)``, largest first."""
    return (assigned.groupBy("topic").agg(F.count("*").alias("size"))
            .withColumn("is_outlier", F.col("topic") == OUTLIER).orderBy(F.col("size").desc(), "topic"))


def topic_count(assigned: DataFrame) -> DataFrame:
    """Number of topics without the outlier topic."""
    return assigned.where(F.col("topic") != OUTLIER).agg(F.count_distinct("topic").alias("n"))
