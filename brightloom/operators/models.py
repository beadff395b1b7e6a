"""Clusters and plane embeddings of feature columns or vectors."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.operators.scale import zscore


def as_vectors(df: DataFrame, features: list[str] | str, out: str = "__vector", scaled: bool = True) -> DataFrame:
    """A vector column from an array column, or from feature columns, z-scored if asked for."""
    if isinstance(features, str):
        return df.withColumn(out, array_to_vector(F.col(features).cast("array<double>")))
    parts = zscore(df, features, "__z") if scaled else df.withColumns({f"{c}__z": F.col(c).cast("double") for c in features})
    return VectorAssembler(inputCols=[f"{c}__z" for c in features], outputCol=out).transform(parts).drop(*[f"{c}__z" for c in features])


def kmeans(df: DataFrame, features: list[str] | str, k: int = 4, seed: int = 42, starts: int = 20, scaled: bool = True, out: str = "cluster") -> DataFrame:
    """Adds a cluster from 0 on: the best of several starts, numbered by the order of the centres."""
    rows = as_vectors(df, features, scaled=scaled)
    rows.persist()
    fits = [KMeans(k=k, seed=seed + i, featuresCol="__vector", predictionCol="__c").fit(rows) for i in range(starts)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    order = sorted(range(len(best.clusterCenters())), key=lambda i: tuple(best.clusterCenters()[i]))
    rank = F.create_map(*[F.lit(x) for new, old in enumerate(order) for x in (old, new)])
    named = best.transform(as_vectors(df, features, scaled=scaled)).withColumn(out, rank[F.col("__c")])
    rows.unpersist()
    return named.drop("__c", "__vector")


def plane(df: DataFrame, features: list[str] | str, scaled: bool = True) -> DataFrame:
    """Adds pc1 and pc2, the first two principal components."""
    rows = as_vectors(df, features, scaled=scaled)
    out = PCA(k=2, inputCol="__vector", outputCol="__pc").fit(rows).transform(rows).withColumn("__pc", vector_to_array("__pc"))
    return out.withColumns({"pc1": F.col("__pc")[0], "pc2": F.col("__pc")[1]}).drop("__pc", "__vector")
