"""Clusters of meters' vectors and of events."""

from __future__ import annotations

from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _vectors(rows: DataFrame, columns: list[str]) -> DataFrame:
    filled = rows.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0)) for c in columns})
    return VectorAssembler(inputCols=columns, outputCol="_raw").transform(filled)


def cluster_vectors(rows: DataFrame, columns: list[str], most: int = 8, seed: int = 1) -> DataFrame:
    """rows with `cluster`: k-means of the standardised columns (nulls are 0), of k from 2 to most - 1 the one of the best silhouette.

    One different vector, or none, makes one cluster, 0.
    """
    raw = _vectors(rows, columns)
    different = raw.select(*columns).distinct().limit(most).count()  # enough to know whether k clusters can be
    if different < 2:
        return rows.withColumn("cluster", F.lit(0))
    scaled = StandardScaler(withMean=True, withStd=True, inputCol="_raw", outputCol="_scaled").fit(raw).transform(raw).persist()
    try:
        tried = []
        for k in range(2, max(3, min(most, different + 1))):
            model = KMeans(k=k, seed=seed, featuresCol="_scaled", predictionCol="cluster").fit(scaled)
            found = model.transform(scaled)
            single = found.select("cluster").distinct().count() < 2
            tried.append((-1.0 if single else ClusteringEvaluator(featuresCol="_scaled", predictionCol="cluster").evaluate(found), -k, model))
        best = max(tried, key=lambda x: x[:2])[2]
    finally:
        scaled.unpersist()
    return best.transform(scaled).select(*rows.columns, "cluster")


def gaussian_mixture(rows: DataFrame, columns: list[str], k: int, seed: int = 1) -> DataFrame:
    """rows with `component` and its probability `p`, by a mixture of k Gaussians fitted on all rows."""
    raw = _vectors(rows, columns)
    model = GaussianMixture(k=k, seed=seed, featuresCol="_raw", predictionCol="component", probabilityCol="_p").fit(raw)
    return model.transform(raw).withColumn("p", F.array_max(vector_to_array("_p"))).select(*rows.columns, "component", "p")
