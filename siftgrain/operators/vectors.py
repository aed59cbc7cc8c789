"""Vector operators (§2: V1-V16, J10): similarities, neighbours, anchors and hyperbolic features, as array expressions.

Anchors are a table of a stated size (k rows, 10,000 at most), which workers
hold as a matrix; searches against an index go block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-12
MOST_ANCHORS = 10_000
#: Similarities that a task holds at a time.
CELLS = 1 << 21


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """§2: V2."""
    # The norm goes in as an array, so that it is worked out once and not by component.
    return F.zip_with(a, F.array_repeat(norm(a) + EPSILON, F.size(a)), lambda x, n: x.cast("double") / n)


def token_hash_encoder(units: DataFrame, dims: int = 64, text: str = "unit") -> DataFrame:
    """§2: V1. A deterministic stand-in for a neural encoder: signed hashes of the words and their trigrams, added up."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 2, F.lit(1))), lambda i: F.substring(w, i, F.lit(3)))))
    hashes = F.transform(F.concat(words, grams), lambda t: F.xxhash64(t))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema.fields if f.name != "embedding"]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("_hashes")
            n, flat = b.num_rows, column.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(n), np.diff(column.offsets.to_numpy()))
            sums = np.bincount(row * dims + flat % dims, np.where(flat > 0, 1.0, -1.0), n * dims)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dims), pa.array(sums))
            names = [c for c in b.schema.names if c != "_hashes"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], vectors], names=[*names, "embedding"])

    return units.drop("embedding").withColumn("_hashes", hashes).mapInArrow(encoded, ", ".join([*fields, "embedding array<double>"]))


def best_places(sims: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k greatest numbers, falling; of equal ones the first."""
    least = -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k]
    if np.isnan(least).any():
        return np.argsort(-sims, axis=1, kind="stable")[:, :k]
    row, at = np.nonzero(sims >= least)
    order = np.lexsort((at, -sims[row, at], row))
    first = np.searchsorted(row, np.arange(len(sims)))
    return at[order][first[:, None] + np.arange(k)]


def top_k(queries: DataFrame, index: DataFrame, k: int, block: int = 65_536) -> DataFrame:
    """§2: V3, V11, V12. query_id, rank, vec_id, similarity: exact cosine, ties by vec_id; both: vec_id, embedding.

    Queries are dealt into blocks that meet every fragment of the index once
    (products of matrices in Arrow batches); each fragment gives its best k.
    The index is sent once for each block and the queries once for each
    fragment, so both are of one size where all rows ask.
    """
    n, q = index.count(), queries.count()
    fragments, blocks = max(8, math.ceil(n / 65_536)), max(1, math.ceil(q / block))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    deal = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    left = index.select("vec_id", "embedding", deal(fragments).alias("f")).select("*", every(blocks).alias("b"))
    right = queries.select("vec_id", "embedding", deal(blocks).alias("b")).select("*", every(fragments).alias("f"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "similarity": []}).astype({"query_id": "int64", "vec_id": "int64", "similarity": "float64"})
        unit = lambda x: x / (np.linalg.norm(x, axis=1, keepdims=True) + EPSILON)
        a = a.sort_values("vec_id")
        left, right = unit(np.stack(b["embedding"]).astype(np.float64)), unit(np.stack(a["embedding"]).astype(np.float64))
        top, found, step = [], [], max(1, CELLS // len(a))
        for i in range(0, len(left), step):
            sims = left[i : i + step] @ right.T
            top.append(best_places(sims, min(k, len(a))))
            found.append(np.take_along_axis(sims, top[-1], axis=1))
        top = np.concatenate(top)
        return pd.DataFrame({"query_id": np.repeat(b["vec_id"].to_numpy(), top.shape[1]), "vec_id": a["vec_id"].to_numpy()[top.ravel()], "similarity": np.concatenate(found).ravel()})

    found = left.groupBy("f", "b").cogroup(right.groupBy("f", "b")).applyInPandas(best, "query_id long, vec_id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def drawn(query_id: Column, k: int, n: int, seed: int) -> Column:
    """Draws with replacement: an array of (j, position in 0..n-1), by a digest of query, draw and seed."""
    digits = lambda j: F.substring(F.md5(F.concat_ws("|", query_id.cast("string"), j.cast("string"), F.lit(str(seed)))), 1, 15)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.struct(j.alias("j"), (F.conv(digits(j), 16, 10).cast("long") % F.lit(max(1, n))).alias("position")))


def random_neighbours(queries: DataFrame, index: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """§2: V4. query_id, j, vec_id and similarity of k index rows for each query, with replacement; index: position (0..n-1), vec_id, embedding."""
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.inline(drawn(F.col("vec_id"), k, index.count(), seed)))
    return asked.join(index, "position").select("query_id", "j", "vec_id", dot(normalised(F.col("q")), normalised(F.col("embedding"))).alias("similarity"))


def drawn_anchors(index: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """§2: V15. j, vec_id and embedding of k rows drawn with replacement for one dummy query; index: position, vec_id, embedding."""
    dummy = index.sparkSession.range(1).select(F.inline(drawn(F.lit(-1), k, index.count(), seed)))
    return index.join(F.broadcast(dummy), "position").select("j", "vec_id", "embedding")


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / (np.sqrt((x * x).sum(axis=1, keepdims=True)) + EPSILON)


def anchor_matrix(anchors: DataFrame) -> np.ndarray:
    """Anchors as rows, in falling order of their components, which decides between equal similarities; at most ``MOST_ANCHORS``."""
    rows = anchors.select(F.col("embedding").cast("array<double>").alias("e")).limit(MOST_ANCHORS + 1).collect()
    if len(rows) > MOST_ANCHORS:
        raise ValueError(f"more than {MOST_ANCHORS} anchors")
    return np.array(sorted((list(r.e) for r in rows), reverse=True), np.float64)


def nearest_anchors(x: np.ndarray, anchors: np.ndarray, k: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """§2: V5, V10, J10. Cosines to the (k nearest) anchors, falling, and the anchors' places."""
    sims = unit_rows(x) @ unit_rows(anchors).T
    order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(sims, order, axis=1), order


def dist0(a: Column, c: float = 1.0) -> Column:
    """§2: V6. Distance to the origin of a Poincaré ball of curvature c."""
    return 2 / F.lit(math.sqrt(c)) * F.atanh(F.lit(math.sqrt(c)) * norm(a))


def poincare(a: Column, b: Column, c: float = 1.0) -> Column:
    """§2: V7. Distance in a Poincaré ball, in the form that needs inner products only."""
    aa, bb, ab = dot(a, a), dot(b, b), dot(a, b)
    return 1 / F.lit(math.sqrt(c)) * F.acosh(F.greatest(F.lit(1.0), 1 + 2 * c * (aa + bb - 2 * ab) / ((1 - c * aa) * (1 - c * bb))))


def features(vectors: DataFrame, anchors: DataFrame, kind: str = "hyperbolic", c: float = 1.0, k: int | None = None) -> DataFrame:
    """§2: V8-V11, G13. Adds ``features``: hyperbolic (1 + 2k), no_origin (2k) or similarity (k) numbers, of all anchors or the k nearest.

    Products of matrices in Arrow batches; the anchors go to the workers once.
    """
    if kind not in ("hyperbolic", "no_origin", "similarity"):
        raise ValueError(f"unknown features: {kind}")
    sent = vectors.sparkSession.sparkContext.broadcast(anchor_matrix(anchors))

    @F.arrow_udf("array<double>")
    def made(embedding: pa.Array) -> pa.Array:
        a, out = sent.value, []
        for i in range(0, len(embedding), 1024):
            some = embedding[i : i + 1024]
            x = np.stack(some.drop_null().to_numpy(zero_copy_only=False)).astype(np.float64) if some.null_count < len(some) else np.zeros((0, a.shape[-1]))
            sims, order = nearest_anchors(x, a, k) if len(a) else (np.zeros((len(x), 0)), np.zeros((len(x), 0), np.int64))
            cols = [sims]
            if kind != "similarity":
                xx, aa = (x * x).sum(axis=1)[:, None], (a * a).sum(axis=1)[order]
                gap = xx + aa - 2 * np.take_along_axis(x @ a.T, order, axis=1)
                cols.append(np.arccosh(np.maximum(1.0, 1 + 2 * c * gap / ((1 - c * xx) * (1 - c * aa)))) / math.sqrt(c))
                if kind == "hyperbolic":
                    cols.insert(0, 2 / math.sqrt(c) * np.arctanh(math.sqrt(c) * np.sqrt(xx)))
            rows = iter(np.concatenate(cols, axis=1).tolist())
            out += [next(rows) if there else None for there in some.is_valid().to_pylist()]
        return pa.array(out, pa.list_(pa.float64()))

    return vectors.withColumn("features", made(F.col("embedding").cast("array<double>")))


def hash_order(key: str, seed: int) -> list[Column]:
    return [F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), F.col(key)]


def random_anchors(vectors: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """§2: V14. k rows without replacement, the first in a hash's order."""
    return vectors.orderBy(*hash_order("vec_id", seed)).limit(k)


def radial_anchors(vectors: DataFrame, k: int, seed: int = 42, c: float = 1.0) -> DataFrame:
    """§2: V16, J8. k anchors, a third from each third of the distance to the origin, the remainder from what is left."""
    placed = vectors.withColumn("dist0", dist0(F.col("embedding"), c))
    cuts = placed.agg(F.percentile("dist0", F.array(F.lit(0.33), F.lit(0.66))).alias("q"))
    met = placed.crossJoin(F.broadcast(cuts))
    met = met.withColumn("bin", F.when(F.col("dist0") <= F.col("q")[0], 0).when(F.col("dist0") <= F.col("q")[1], 1).otherwise(2)).drop("q")
    ranked = met.withColumn("pick", F.row_number().over(Window.partitionBy("bin").orderBy(*hash_order("vec_id", seed))))
    chosen = ranked.filter(F.col("pick") <= k // 3)
    rest = ranked.join(chosen.select("vec_id"), "vec_id", "left_anti").orderBy(*hash_order("vec_id", seed + 1)).limit(k - 3 * (k // 3))
    return chosen.unionByName(rest).drop("pick")


def build_index(labels: DataFrame, encoder=token_hash_encoder, take: int | None = None) -> DataFrame:
    """§2: V13, W17. vec_id, label, embedding, unit vector of each distinct label."""
    rows = labels.filter("label is not null").groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    if take is not None:
        rows = rows.orderBy("vec_id").limit(take)
    return encoder(rows.withColumnRenamed("label", "unit")).withColumnRenamed("unit", "label").withColumn("unit_vector", normalised(F.col("embedding")))
