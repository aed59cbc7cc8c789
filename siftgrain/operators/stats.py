"""Tests and models (§2: H3-H14). Sums and ranks come from Spark; distributions are evaluated on what is left, a few numbers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from siftgrain.operators import nulls
from siftgrain.operators.ordered import numbered, running
from siftgrain.session import checkpointed


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        top = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + top * d or tiny)
        c = 1 + top / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: int) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def mann_whitney(df: DataFrame, flag: str, value: str) -> DataFrame:
    """§2: H6, H8, H10. n1, n0, u1, z (tie-corrected), cliffs_delta, auc and p (two-sided, exact for small sides) of ``value`` for flag = 1 against 0.

    Ranks are taken over (value, counts by side), so nothing of the size of
    the rows is ordered in one place, and no pairs are formed.
    """
    sides = df.filter(f"{flag} is not null and {value} is not null").groupBy(value).agg(F.sum(F.col(flag).cast("int")).alias("n1"), F.count("*").alias("n"))
    ranked = running(checkpointed(sides), value, "n", "below").withColumn("rank", F.col("below") + (F.col("n") + 1) / 2.0)
    s = ranked.agg(F.sum("n1").cast("double").alias("n1"), F.sum("n").cast("double").alias("N"), F.sum(F.col("rank") * F.col("n1")).alias("r1"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"))
    s = s.withColumn("n0", F.col("N") - F.col("n1")).withColumn("u1", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2)
    # Null where a side is empty, or all values are one.
    pairs = F.nullif(F.col("n1") * F.col("n0"), F.lit(0.0))
    var = F.nullif(pairs / 12 * ((F.col("N") + 1) - F.col("ties") / (F.col("N") * (F.col("N") - 1))), F.lit(0.0))
    return s.select(
        F.col("n1").cast("long").alias("n1"), F.col("n0").cast("long").alias("n0"), "u1", ((F.col("u1") - pairs / 2) / F.sqrt(var)).alias("z"),
        (2 * F.col("u1") / pairs - 1).alias("cliffs_delta"), (F.col("u1") / pairs).alias("auc"), "ties",
    ).withColumn("p", nulls.rank_sum_p()).drop("ties")


def wilcoxon(df: DataFrame, difference: Column, groups: list[str] = [], alternative: str = "two-sided") -> DataFrame:  # noqa: B006
    """§2: H3, M10. n, w_plus, w_minus, z and p of signed ranks (of each group); zeros are dropped, ties share ranks, and p is exact for few pairs."""
    d = df.select(*groups, difference.cast("double").alias("d")).filter("d is not null and not isnan(d)").withColumn("a", F.abs("d"))
    counts = checkpointed(d.groupBy(*groups, "a").agg(F.count("*").alias("n"), F.sum((F.col("d") > 0).cast("int")).alias("pos")))
    ranked = running(counts.filter("a > 0"), "a", "n", "below", groups).withColumn("rank", F.col("below") + (F.col("n") + 1) / 2.0).select(*groups, "n", "pos", "rank", F.lit(0).cast("long").alias("zero"))
    none = counts.filter("a = 0").select(*groups, F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("pos"), F.lit(0.0).alias("rank"), F.col("n").alias("zero"))
    s = ranked.unionByName(none).groupBy(*groups).agg(F.sum("n").cast("double").alias("n"), F.sum(F.col("rank") * F.col("pos")).alias("w_plus"), F.sum(F.col("rank") * (F.col("n") - F.col("pos"))).alias("w_minus"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"), F.sum("zero").alias("zeros")).filter("n > 0")
    var = F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24 - F.col("ties") / 48
    out = s.select(*groups, F.col("n").cast("long").alias("n"), "w_plus", "w_minus", ((F.col("w_plus") - F.col("n") * (F.col("n") + 1) / 4) / F.sqrt(var)).alias("z"), "ties", "zeros")
    return out.withColumn("p", nulls.signed_rank_p(alternative)).drop("ties", "zeros")


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t, for the few rows of a report."""
    return pd.Series([t_two_sided(x, int(n)) if pd.notna(x) else None for x, n in zip(t, df, strict=True)], dtype=float)


def paired(df: DataFrame, a: str, b: str) -> DataFrame:
    """§2: H4, H5, H13. n, means, population deviations, share of a > b, t with its two-sided p, and Cohen's dz (population deviation)."""
    d = F.col(a) - F.col(b)
    s = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(
        F.count("*").alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.stddev_pop(a).alias("sd_a"), F.stddev_pop(b).alias("sd_b"),
        F.avg((F.col(a) > F.col(b)).cast("int")).alias("share"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"), F.stddev_pop(d).alias("sp"),
    )
    return s.select("n", "mean_a", "mean_b", "sd_a", "sd_b", "share", (F.col("m") / (F.col("s") / F.sqrt("n"))).alias("t"), (F.col("m") / F.col("sp")).alias("cohen_dz")).withColumn("p", t_p("t", F.col("n") - 1))


def bonferroni(df: DataFrame, p: str = "p") -> DataFrame:
    """§2: H7. One row for each test, so the count is small."""
    return df.withColumn("p_adjusted", F.least(F.col(p) * F.count("*").over(Window.partitionBy()), F.lit(1.0)))


def logistic(df: DataFrame, features: list[str], target: str):
    """§2: H9. Unregularised logistic regression: (coefficients, odds ratios, model)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=features, outputCol="_x").transform(df.select(*features, F.col(target).cast("double").alias("_y")).dropna())
    model = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=0.0, standardization=False).fit(data)
    return list(model.coefficients), [math.exp(c) for c in model.coefficients], model


def stratified_folds(df: DataFrame, target: str, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """§2: H11. Adds a fold: equal shares of each class, by a hash's order."""
    order = [F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), F.col(key)]
    return numbered(df, order, (target,), "fold").withColumn("fold", F.pmod("fold", F.lit(folds)).cast("int"))


def cross_validated_auc(df: DataFrame, features: list[str], target: str, key: str, folds: int = 5, seed: int = 42) -> tuple[float, float]:
    """§2: H11. Mean and population deviation over folds of the AUC of a logistic regression fitted on the other folds."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = checkpointed(stratified_folds(df.select(key, *features, F.col(target).cast("int").alias("_y")).dropna(), "_y", key, folds, seed))
    aucs = []
    for i in range(folds):
        model = logistic(rows.filter(F.col("fold") != i), features, "_y")[2]
        held = VectorAssembler(inputCols=features, outputCol="_x").transform(rows.filter(F.col("fold") == i))
        scored = model.transform(held).select("_y", vector_to_array("probability")[1].alias("p"))
        aucs.append(mann_whitney(scored, "_y", "p").first()["auc"])
    return float(np.mean(aucs)), float(np.std(aucs))
