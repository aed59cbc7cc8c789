"""A score cache as a bucketed table (§2: C1-C5, K5): misses by anti-join, appends, the latest row of a key counts.

Each configuration has a folder with numbered versions, of which the last whole
one counts; a version is a table of ``buckets`` by hash, so that joins and the
choice of the latest row move the asked units, never the cache. ``compact``
writes a version with one row for each key, in one file for each bucket.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "text_hash string, unit string, score double, created_at timestamp"


def fingerprint(**config: object) -> str:
    """All that a score depends on, so that no two configurations share rows."""
    import hashlib

    return hashlib.md5(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


class ScoreCache:
    def __init__(self, spark: SparkSession, path: str, config: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, f"{path}/config={config}/buckets={buckets}", buckets

    def versions(self) -> list[int]:
        """Versions that were written to their end."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/version=*/_SUCCESS")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(int(str(x.getPath().getParent().getName()).split("=")[1]) for x in found)

    def table(self, version: int) -> str:
        """The name of a version's table, declared anew over its folder."""
        name = f"score_cache_{fingerprint(root=self.root, version=version)}"
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        # The folder outlives the declaration: the table is external.
        self.spark.sql(f"CREATE TABLE {name} ({SCHEMA}) USING parquet CLUSTERED BY (text_hash) INTO {self.buckets} BUCKETS LOCATION '{self.root}/version={version}'")
        return name

    def rows(self) -> DataFrame:
        """All rows of the last version."""
        found = self.versions()
        return self.spark.table(self.table(found[-1])) if found else self.spark.createDataFrame([], SCHEMA)

    def read(self) -> DataFrame:
        """The latest row of each hash."""
        last = F.max(F.struct("created_at", F.negative("score").alias("s"), "unit", "score")).alias("last")
        return self.rows().groupBy("text_hash").agg(last).select("text_hash", "last.unit", "last.score", "last.created_at")

    def misses(self, units: DataFrame) -> DataFrame:
        keyed = units.select("unit").distinct().withColumn("text_hash", F.md5("unit"))
        return keyed.join(self.rows().select("text_hash"), "text_hash", "left_anti")

    def write(self, rows: DataFrame, version: int) -> None:
        """Rows come in one part for each bucket, so that a write makes as many files as there are buckets."""
        rows.select("text_hash", "unit", "score", "created_at").repartition(self.buckets, "text_hash").write.insertInto(self.table(version))

    def upsert(self, scored: DataFrame) -> None:
        rows = scored.select(F.md5("unit").alias("text_hash"), "unit", F.col("score").cast("double").alias("score"), F.current_timestamp().alias("created_at"))
        self.write(rows, (self.versions() or [1])[-1])

    def compact(self) -> None:
        """Writes the latest rows as the next version; readers of the former one keep it."""
        found = self.versions()
        if found:
            self.write(self.read(), found[-1] + 1)

    def score(self, units: DataFrame, predictor) -> DataFrame:
        """Scores of all units: what the cache has, and the rest scored and stored."""
        self.upsert(predictor(self.misses(units).select("unit")))
        known = self.read().select("text_hash", "score")
        return units.withColumn("text_hash", F.md5("unit")).join(known, "text_hash", "left").drop("text_hash")
