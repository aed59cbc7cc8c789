"""Scoring units (§2: P0-P9, L1-L4). A predictor is a function that adds ``score`` to a table of distinct ``unit``.

One that needs no more than an expression has it as ``by_row``: it is worked out
where a unit stands, which costs less than finding the distinct ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgrain.session import checkpointed

Predictor = Callable[[DataFrame], DataFrame]


def length(units: DataFrame) -> DataFrame:
    """§2: P5."""
    return units.withColumn("score", length.by_row(F.col("unit")))


length.by_row = lambda unit: F.char_length(unit).cast("double")


def lexicon_depth(depths: DataFrame) -> Predictor:
    """§2: P6. The mean depth of a unit's senses in a hierarchy; depths: lemma, depth. Unknown units have no score."""
    mean = depths.groupBy(F.lower("lemma").alias("_lemma")).agg(F.avg("depth").alias("score"))
    return lambda units: units.join(mean, F.lower("unit") == F.col("_lemma"), "left").drop("_lemma")


def hypernym_depths(edges: DataFrame, most: int = 30) -> DataFrame:
    """§2: P6. node and depth (mean over its paths from a root, root = 0) of a hierarchy; edges: node, parent (null at a root)."""
    level = edges.filter("parent is null").select("node", F.lit(1).cast("long").alias("paths"), F.lit(0).cast("long").alias("total"))
    out = level
    for _ in range(most):
        level = checkpointed( edges.alias("e").join(level.alias("l"), F.col("e.parent") == F.col("l.node")).groupBy(F.col("e.node").alias("node")).agg(F.sum("l.paths").alias("paths"), F.sum(F.col("l.total") + F.col("l.paths")).alias("total")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    else:
        raise RuntimeError(f"more than {most} levels, or a cycle")
    return out.groupBy("node").agg((F.sum("total") / F.sum("paths")).alias("depth"))


# Fixed value: a grade from 1 to 4 that stands alone in a reply.
GRADE = r"\b([1-4])\b"


def likert_reply(reply: Column) -> Column:
    """§2: P7. The first grade in a model's reply; null if there is none."""
    return F.nullif(F.regexp_extract(reply, GRADE, 1), F.lit("")).cast("int")


def fit_gbt(rows: DataFrame, features: str = "features", target: str = "y", iterations: int = 20, depth: int = 5, seed: int = 42):
    """§2: L1, L2, L4, P9. Boosted trees on an array of features."""
    data = rows.select(array_to_vector(features).alias("_x"), F.col(target).cast("double").alias("_y"))
    return GBTRegressor(featuresCol="_x", labelCol="_y", predictionCol="score", maxIter=iterations, maxDepth=depth, seed=seed).fit(data)


def gbt(model, features: str = "features") -> Predictor:
    """§2: P1-P4. Scores rows that carry a feature array."""
    return lambda rows: model.transform(rows.withColumn("_x", array_to_vector(features))).drop("_x")


def pairwise_rows(rows: DataFrame, group: str = "id", features: str = "features", target: str = "y") -> DataFrame:
    """§2: L3. Feature differences of pairs inside a group and which is greater: input of a pairwise logistic ranker."""
    a, b = rows.alias("a"), rows.alias("b")
    met = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col(f"a.{target}") != F.col(f"b.{target}")))
    diff = F.zip_with(F.col(f"a.{features}"), F.col(f"b.{features}"), lambda x, y: x - y)
    return met.select(F.col(f"a.{group}").alias(group), diff.alias(features), (F.col(f"a.{target}") > F.col(f"b.{target}")).cast("int").alias("y"))


def fit_pairwise(rows: DataFrame, group: str = "id", features: str = "features", target: str = "y") -> Predictor:
    """§2: L3. A linear ranker: logistic regression without intercept on ``pairwise_rows``; gives a function that adds ``score``."""
    data = pairwise_rows(rows, group, features, target).select(array_to_vector(features).alias("_x"), F.col("y").cast("double").alias("_y"))
    weights = [float(w) for w in LogisticRegression(featuresCol="_x", labelCol="_y", fitIntercept=False, regParam=1e-3).fit(data).coefficients]
    held = F.array(*[F.lit(w) for w in weights])
    return lambda df: df.withColumn("score", F.aggregate(F.zip_with(F.col(features), held, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x))


REGISTRY: dict[str, object] = {"length": length, "lexicon": lexicon_depth, "reply": likert_reply, "hyperbolic": gbt, "similarity": gbt}


def named(kind: str):
    """§2: P8."""
    if kind not in REGISTRY:
        raise ValueError(f"unknown predictor: {kind}")
    return REGISTRY[kind]
