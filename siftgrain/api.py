"""Scores for texts at hand: the thin call that takes strings and gives numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftgrain.operators.percentile import bucket
from siftgrain.operators.pooling import score_texts, score_unsplit
from siftgrain.operators.predictors import length


def granularity(spark: SparkSession, texts: str | list[str], reference: DataFrame | None = None, *, split: bool = True, buckets: bool = False, predictor=length, **how):
    """§2: A10-A13. A score (or, with a reference, a percentile; or a bucket) for each text, in order; a string gives one."""
    many = [texts] if isinstance(texts, str) else list(texts)
    if buckets and reference is None:
        raise ValueError("buckets need a reference")
    if not many:
        return []
    docs = spark.createDataFrame(list(enumerate(many)), "doc_id long, text string")
    if split:
        rows = score_texts(docs, predictor, reference, **how)
    else:
        rows = score_unsplit(docs, predictor, reference=reference)
    if buckets:
        rows = rows.withColumn("score", bucket(rows["percentile"]))
    elif reference is not None:
        rows = rows.withColumn("score", rows["percentile"])
    got = {r["doc_id"]: r["score"] for r in rows.collect()}
    out = [got.get(i) for i in range(len(many))]
    return out[0] if isinstance(texts, str) else out
