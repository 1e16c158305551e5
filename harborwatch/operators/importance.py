"""Feature importance per port from random forests on labelled windows."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborwatch.schema import MODEL_FEATURES


def rf_importance(labelled: DataFrame, ports: list[int], columns: list[str] = MODEL_FEATURES,
                  trees: int = 100, max_depth: int = 30, max_bins: int = 256, seed: int = 0) -> DataFrame:
    """(port, feature, weight), rounded to 4 places.

    Each port's forest is trained by Spark ML over all its windows; only the importance vector (one number per
    feature) comes back to build the result. Ports without both labels have no forest. Cuts are taken among
    ``max_bins`` quantiles of a feature, and trees end at ``max_depth``, 30 being the most Spark ML can grow.
    """
    assembler = VectorAssembler(inputCols=columns, outputCol="vector")
    data = assembler.transform(labelled.select(
        "port", F.col("label").cast("int").alias("target"), *[F.col(c).cast("double").alias(c) for c in columns]))
    forest = RandomForestClassifier(featuresCol="vector", labelCol="target", numTrees=trees, maxDepth=max_depth, maxBins=max_bins,
                                    seed=seed)
    learnable = {r.port for r in data.groupBy("port").agg(F.count_distinct("target").alias("n")).filter("n = 2").collect()}
    rows = []
    for port in ports:
        if port in learnable:
            weights = forest.fit(data.filter(F.col("port") == port)).featureImportances.toArray()
            rows += [(port, c, round(float(w), 4)) for c, w in zip(columns, weights)]
    return labelled.sparkSession.createDataFrame(rows, "port int, feature string, weight double")
