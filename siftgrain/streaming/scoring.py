"""Scoring a stream of texts (§2.19): cleaning, splitting, length scores and array pools keep no state, so append mode needs none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgrain.functions.text import clean
from siftgrain.operators.pooling import array_pool
from siftgrain.operators.split import sentences, units


def scored(docs: DataFrame, pool: str = "mean", scope_pool: str = "lower_quantile_mean", tail: float = 0.5, scope_tail: float = 0.8) -> DataFrame:
    """doc_id and score of every text, row by row; for batches and streams alike."""
    scopes = F.transform(sentences(clean(F.coalesce("text", F.lit("")))), lambda s: array_pool(F.transform(units(s), lambda u: F.char_length(u).cast("double")), pool, tail))
    held = docs.select("doc_id", F.explode(F.array(scopes)).alias("_scopes"))
    return held.select("doc_id", array_pool(F.col("_scopes"), scope_pool, scope_tail).alias("score"))


def score_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: str = "doc_id long, text string"):
    """Scores Parquet files as they arrive in a folder, until all that are there are done."""
    stream = spark.readStream.schema(schema).parquet(source)
    return scored(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
