"""Readers and writers (§2: S1-S12, S14, K1-K6). Paths are Spark's own, so any store it reads will do."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where))


def read(spark: SparkSession, path: str, kind: str | None = None, schema: str | None = None, **options) -> DataFrame | None:
    """§2: S1-S5, S7, S8, S11. A missing path gives None; the kind follows from the name unless it is given.

    JSON lines that don't parse are dropped; gzipped lines can't be split, so
    they are dealt out after reading.
    """
    if not exists(spark, path):
        return None
    name = path.removesuffix(".gz")
    kind = kind or {".jsonl": "jsonl", ".json": "json", ".txt": "lines", ".tsv": "tsv", ".csv": "csv", ".parquet": "parquet"}.get(Path(name).suffix, "parquet")
    reader = spark.read.options(**options)
    if schema:
        reader = reader.schema(schema)
    if kind == "jsonl":
        out = reader.option("mode", "DROPMALFORMED").json(path)
        return out.repartition(spark.sparkContext.defaultParallelism) if path.endswith(".gz") else out
    if kind == "json":
        return reader.option("multiLine", "true").json(path)
    if kind == "lines":
        return reader.text(path)
    if kind == "tsv":
        return reader.option("sep", "\t").csv(path)
    if kind == "csv":
        return reader.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    return reader.parquet(path)


def numbered(df: DataFrame, name: str = "id") -> DataFrame:
    """§2: S6. Adds a row's place in the order of its files' parts, gapless from 0; ``df`` is a scan, whose parts don't change."""
    rows = df.withColumn("_at", F.monotonically_increasing_id())
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each part of the input.
    parts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    met = rows.withColumn("_part", part).join(F.broadcast(parts), "_part")
    return met.select((F.col("_base") + inside).alias(name), *df.columns)


def paired_lines(spark: SparkSession, texts: str, values: str) -> DataFrame:
    """§2: S9. Two files of lines side by side: line, text, value (a number)."""
    a, b = numbered(spark.read.text(texts), "line"), numbered(spark.read.text(values), "line")
    return a.withColumnRenamed("value", "text").join(b.select("line", F.col("value").cast("double").alias("value")), "line")


def rated_sentences(spark: SparkSession, glob: str) -> DataFrame:
    """§2: S10. file, sentence and mean rating of whole-file JSON lists; blank sentences and empty ratings are dropped."""
    rows = spark.read.schema("sentid string, tkn string, ratings array<double>").option("multiLine", "true").json(glob).withColumn("file", F.input_file_name())
    mean = F.aggregate("ratings", F.lit(0.0), lambda a, x: a + x) / F.size("ratings")
    return rows.filter("trim(tkn) <> '' and size(ratings) > 0").select("file", "sentid", F.col("tkn").alias("sentence"), mean.alias("rating"))


def write(df: DataFrame, path: str, kind: str = "jsonl", mode: str = "append") -> None:
    """§2: K1-K4. Appends unless told otherwise; JSON documents are always written anew, since two make no document."""
    if kind == "json":
        mode = "overwrite"
    out = df.write.mode(mode)
    if kind in ("jsonl", "json"):
        out.json(path)
    elif kind == "lines":
        out.text(path)
    elif kind in ("tsv", "csv"):
        out.option("sep", "\t" if kind == "tsv" else ",").option("header", str(kind == "csv").lower()).csv(path)
    else:
        out.parquet(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """§2: K6, N8. One folder for each split."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def digest(spark: SparkSession, path: str) -> str:
    """sha256 of one file in any store that Spark reads; the file is read on an executor."""
    found = [r[0] for r in spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{path}: {len(found) or 'no'} files")
    return found[0]


def resolved(spark: SparkSession, name: str, folders: list[str], sha256: str | None = None) -> str:
    """§2: S14. The path of a file in the first of the folders (a cache, what is bundled, ...) that has it whole.

    With a digest, files that differ from it are passed over, and so never
    used; nothing is fetched or deleted. If no folder has it, all that was
    found is named in the error.
    """
    wrong = []
    for folder in folders:
        path = f"{folder.rstrip('/')}/{name}"
        if not exists(spark, path):
            continue
        if sha256 is None or (got := digest(spark, path)) == sha256:
            return path
        wrong.append(f"{path} has {got}")
    raise FileNotFoundError(f"{name} is in none of {folders}" + (f", or differs: {'; '.join(wrong)}" if wrong else ""))


def verified(path: str, sha256: str | None) -> str:
    """A local model file whose digest is checked; a wrong file raises and stays."""
    if sha256:
        with open(path, "rb") as f:
            digest = hashlib.file_digest(f, "sha256").hexdigest()
        if digest != sha256:
            raise ValueError(f"{path}: sha256 is {digest}")
    return path
