"""Iterative models as MLlib jobs: every step is an aggregation over all rows, so nothing but parameters comes to the driver."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """Adds `features`; rows with a null or non-finite one are kept with 0 in its place."""
    clean = {f: F.when(F.isnan(f) | (F.abs(f) == float("inf")), None).otherwise(F.col(f).cast("double")) for f in features}
    rows = df.withColumns({f"_f_{f}": F.coalesce(c, F.lit(0.0)) for f, c in clean.items()})
    return VectorAssembler(inputCols=[f"_f_{f}" for f in features], outputCol="features").transform(rows).drop(*[f"_f_{f}" for f in features])


def fit_elastic_net(df: DataFrame, features: list[str], y: str, strength: float = 0.01, l1: float = 0.5):
    """Least squares with l1 and l2 penalties on standardised features."""
    return LinearRegression(labelCol=y, regParam=strength, elasticNetParam=l1, maxIter=50).fit(assembled(df, features))


def fit_huber(df: DataFrame, features: list[str], y: str, epsilon: float = 1.35):
    """Robust regression: squared errors near, absolute ones far."""
    return LinearRegression(labelCol=y, loss="huber", epsilon=epsilon, maxIter=50).fit(assembled(df, features))


def fit_boosted_trees(df: DataFrame, features: list[str], y: str, rounds: int = 20, depth: int = 3, seed: int = 7):
    """Gradient-boosted trees over binned features."""
    return GBTRegressor(labelCol=y, maxIter=rounds, maxDepth=depth, stepSize=0.2, seed=seed).fit(assembled(df, features))


def testlike_scores(train: DataFrame, test: DataFrame, features: list[str], key: str) -> DataFrame:
    """(key, testlike): how much a row of train looks like one of test, by a classifier of the two that sees features only."""
    both = assembled(train.select(key, *features), features).withColumn("side", F.lit(0.0)).unionByName(assembled(test.select(key, *features), features).withColumn("side", F.lit(1.0)))
    model = LogisticRegression(labelCol="side", regParam=0.01, maxIter=30).fit(both)
    return model.transform(both.filter("side = 0")).select(key, vector_to_array("probability")[1].alias("testlike"))
