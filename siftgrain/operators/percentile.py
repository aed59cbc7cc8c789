"""Percentiles against a reference distribution, and buckets (§2: B1-B7, N12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftgrain.operators.ordered import running
from siftgrain.session import checkpointed

#: Distinct scores (of two numbers each) up to which they are sent to the rows.
BROADCAST_SCORES = 100_000


def distribution(reference: DataFrame, score: str = "score") -> DataFrame:
    """A row for each distinct score with the count at it."""
    return reference.filter(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(F.col(score).cast("double").alias("ref_score")).agg(F.count("*").alias("n_at"))


def rank_formula(below: Column, upto: Column, n: Column) -> Column:
    return F.lit(50.0) / n * (below + upto + F.when(below < upto, 1).otherwise(0))


def percentile_rank(df: DataFrame, reference: DataFrame, score: str = "score", out: str = "percentile") -> DataFrame:
    """§2: B1. Adds the percentile of a score by rank; scores that the reference lacks fall between its scores.

    Distinct scores of both sides are merged, summed up by ranges of scores and joined back; rows stay where they are if these are few.
    """
    ref = distribution(reference)
    asked = df.select(F.col(score).cast("double").alias("x")).distinct().filter("x is not null and not isnan(x)")
    both = asked.join(ref, asked["x"] == ref["ref_score"], "full").select(F.coalesce("x", "ref_score").alias("x"), F.coalesce("n_at", F.lit(0)).alias("n_at"))
    both = checkpointed(both)
    placed = running(both, "x", "n_at", "b").crossJoin(F.broadcast(both.agg(F.sum("n_at").alias("n"))))
    placed = placed.select(F.col("x").alias("_x"), rank_formula(F.col("b"), F.col("b") + F.col("n_at"), F.col("n")).alias(out))
    few = both.count() <= BROADCAST_SCORES
    return df.join(F.broadcast(checkpointed(placed)) if few else placed, F.col(score).cast("double") == F.col("_x"), "left").drop("_x")


def score_of_percentile(reference: DataFrame, percentiles: list[float], score: str = "score") -> DataFrame:
    """§2: B2. percentile and score, by linear interpolation."""
    got = F.percentile(F.col(score), F.array(*[F.lit(p / 100.0) for p in percentiles]))
    names = F.array(*[F.lit(float(p)) for p in percentiles])
    return reference.agg(got.alias("s")).select(F.explode(F.arrays_zip(names.alias("percentile"), F.col("s").alias("score"))).alias("z")).select("z.percentile", "z.score")


def bucket(percentile: Column) -> Column:
    """§2: B3. Thirds of the percentile scale; NaN is high, null stays null."""
    return F.when(percentile.isNull(), None).when(percentile < 33.33, "low").when(percentile < 66.66, "medium").otherwise("high")


def near_percentile(scored: DataFrame, targets: list[float], band: float = 2.5, k: int = 10, seed: int = 0, key: str = "unit") -> DataFrame:
    """§2: B6, B7. At most k rows for each target within the band, chosen by a hash of the key; scored has a percentile."""
    rows = scored.select("*", F.explode(F.array(*[F.lit(float(t)) for t in targets])).alias("target")).filter(F.abs(F.col("percentile") - F.col("target")) <= band)
    order = Window.partitionBy("target").orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key)
    return rows.withColumn("pick", F.row_number().over(order)).filter(F.col("pick") <= k).drop("pick")


def reference_sentences(sentences: DataFrame, n: int = 100_000, least: int = 5, most: int = 40, seed: int = 0) -> DataFrame:
    """§2: B4, B5. n sentences of a fitting length, in the order of a hash."""
    from siftgrain.functions.text import word_count

    fit = sentences.filter(word_count(F.col("sentence")).between(least, most))
    return fit.orderBy(F.md5(F.concat_ws("|", F.col("sentence"), F.lit(str(seed)))), "sentence").limit(n)
