"""Centroid clustering by annulus search, in whole numbers.

Centroids are sorted by norm. The distance to one of them, the nearer of the two
whose norms lie next to a vector's own, is an upper bound of the distance to the
nearest; by the triangle inequality, only centroids whose norm differs from the
vector's by no more than the bound can be as near. Two binary searches give this
annulus, which is widened by more than the rounding of norms, so that ties at its
edge stay inside; the centroids in it are compared exactly.

Vectors stay where they are: each round reads them once and sends one row of
sums for each task and cluster; only sums of clusters (k times the components)
reach the driver, which sends the next centroids. A round that changes no
centroid ends the search, since those that follow would repeat it.

Edge cases: a vector that is null, of another length, or holds a null or
non-finite component takes no part; of rows repeated with one vec_id each is a
vector of its own, and rows of one hash start in the order of their components;
a vector without an id is assigned, but starts no centroid; fewer vectors than
centroids make fewer centroids; equal distances go to the smaller number; an
empty table gives an empty result; extra columns are ignored. Components of
2**27 or more after scaling, whose squared distances may not fit 64 bits, raise.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Pairs of a vector and a centroid that are compared at a time (of 64 components: 32 MB).
PAIRS = 1 << 16
#: What norms and bounds are widened by, against rounding (1e-16) of their roots.
SLACK = 1e-9
LIMIT = 1 << 27


def whole_vectors(ids: pa.Array, vectors: pa.Array, dims: int, scale: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and floor(scale * x) of the vectors that take part."""
    fit = pc.fill_null(pc.equal(pc.list_value_length(vectors), dims), False)
    ids, vectors = ids.filter(fit), vectors.filter(fit)
    x = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    finite = np.isfinite(x).all(axis=1)
    x = np.floor(scale * x[finite])
    if x.size and np.abs(x).max() >= LIMIT:
        raise ValueError(f"a component times {scale} reaches 2**27")
    return ids.filter(pa.array(finite)), x.astype(np.int64)


class Annulus:
    """Centroids by norm, and the search for the nearest."""

    def __init__(self, centroids: np.ndarray):
        norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(axis=1))
        self.number = np.argsort(norms, kind="stable")
        self.norms, self.sorted = norms[self.number], centroids[self.number]

    def nearest(self, x: np.ndarray, seen: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Number of and squared distance to each vector's nearest centroid; ``seen`` counts what was compared."""
        n, k = len(x), len(self.norms)
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        after = np.searchsorted(self.norms, norm)
        bound = np.full(n, np.iinfo(np.int64).max)
        for at in (np.maximum(after - 1, 0), np.minimum(after, k - 1)):
            bound = np.minimum(bound, ((x - self.sorted[at]) ** 2).sum(axis=1))
        reach = np.sqrt(bound.astype(np.float64))
        reach += SLACK * (1 + reach + norm)
        first, last = np.searchsorted(self.norms, norm - reach, "left"), np.searchsorted(self.norms, norm + reach, "right")
        if seen is not None:
            seen["compared"] += int((last - first).sum())
            seen["all"] += n * k
        number, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
        ends = np.cumsum(last - first)
        at = 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            sizes = (last - first)[at:end]
            row = np.repeat(np.arange(at, end), sizes)
            begin = np.cumsum(sizes) - sizes
            place = np.arange(len(row)) - np.repeat(begin, sizes) + np.repeat(first[at:end], sizes)
            d = ((x[row] - self.sorted[place]) ** 2).sum(axis=1)
            least = np.minimum.reduceat(d, begin)
            distance[at:end] = least
            number[at:end] = np.minimum.reduceat(np.where(d == np.repeat(least, sizes), self.number[place], k), begin)
            at = end
        return number, distance


@dataclass
class Clustering:
    """What the search ends with: whole components, and the sum of squared distances and number of vectors of each cluster."""

    centroids: np.ndarray
    inertia: list[int]
    sizes: list[int]


def cluster_sums(vectors: DataFrame, centroids: np.ndarray, scale: int) -> dict[tuple[int, int], int]:
    """By (cluster, place): sums of components behind place 0, the number of vectors, and place 1, the sum of distances in two halves of 32 bits."""
    k, dims = centroids.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annulus(centroids)
        total = np.zeros((k, dims + 3), np.int64)
        for b in batches:
            _, x = whole_vectors(b.column(0), b.column(1), dims, scale)
            if not len(x):
                continue
            number, distance = search.nearest(x)
            rows = np.column_stack([np.ones(len(x), np.int64), distance >> 32, distance & 0xFFFFFFFF, x])
            order = np.argsort(number, kind="stable")
            begin = np.flatnonzero(np.r_[True, np.diff(number[order]) != 0])
            total[number[order][begin]] += np.add.reduceat(rows[order], begin, axis=0)
        met = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(list(total[met]), pa.list_(pa.int64()))], ["cluster", "sums"])

    sums = vectors.mapInArrow(partial, "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("place", "x"))
    return {(r.cluster, r.place): int(r.x) for r in sums.groupBy("cluster", "place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()}


def first_centroids(vectors: DataFrame, k: int, dims: int, scale: int, salt: int) -> np.ndarray:
    """The ``k`` vectors with the least sha256 of ``salt:vec_id``, in that order."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = whole_vectors(b.column(0), b.column(1), dims, scale)
            yield pa.RecordBatch.from_arrays([ids, pa.array(list(x), pa.list_(pa.int64()))], ["vec_id", "terms"])

    known = vectors.filter("vec_id is not null").mapInArrow(whole, "vec_id long, terms array<long>")
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = known.withColumn("digest", digest).orderBy("digest", "terms").limit(k).collect()
    return np.array([r.terms for r in sorted(rows, key=lambda r: (r.digest, r.terms))], np.int64).reshape(-1, dims)


def narrow(embeddings: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    return embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))


def fit(embeddings: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: int = 3, vec_id: str = "vec_id", embedding: str = "embedding") -> Clustering:
    """Centroids after ``rounds`` rounds, and the inertia of the vectors assigned to them."""
    vectors = narrow(embeddings, vec_id, embedding)
    centroids = first_centroids(vectors, k, dims, scale, salt)
    if not len(centroids):
        return Clustering(centroids, [], [])
    sums = cluster_sums(vectors, centroids, scale)
    for _ in range(rounds):
        moved = centroids.copy()
        for j in range(len(centroids)):
            if n := sums.get((j, 0), 0):
                moved[j] = [sums[j, 3 + d] // n for d in range(dims)]
        if (moved == centroids).all():
            break
        centroids, sums = moved, cluster_sums(vectors, moved, scale)
    each = range(len(centroids))
    return Clustering(centroids, [(sums.get((j, 1), 0) << 32) + sums.get((j, 2), 0) for j in each], [sums.get((j, 0), 0) for j in each])


def assign(embeddings: DataFrame, found: Clustering, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, cluster and distance (squared) of every vector that takes part."""
    centroids = found.centroids

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annulus(centroids)
        for b in batches:
            ids, x = whole_vectors(b.column(0), b.column(1), centroids.shape[1], scale)
            number, distance = search.nearest(x) if len(x) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    vectors = narrow(embeddings, vec_id, embedding)
    # Without a centroid no vector takes part, but for those without an id.
    run: Callable = nearest if len(centroids) else lambda batches: iter(())
    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def op13_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = fit(vectors)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    of = lambda values, kind: F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("cluster"))
    return assign(vectors, found).select(
        "vec_id",
        "cluster",
        "distance",
        of(found.inertia, "bigint").alias("cluster_inertia"),
        F.lit(sum(found.inertia)).cast("long").alias("inertia"),
        of(digests, "string").alias("centroid_sha256"),
    )


def twin(rounds: int = 10) -> str:
    """DuckDB SQL: a chain of rounds."""
    nearest = "SELECT v, arg_min(j, s) AS j, min(s) AS s FROM (SELECT v, j, sum((e.x - c.x) * (e.x - c.x)) * 8 + j AS s FROM e JOIN {c} c USING (d) GROUP BY v, j) GROUP BY v"
    moved = """SELECT c.j, c.d, CASE WHEN n IS NULL THEN c.x ELSE ((t - (((t % n) + n) % n)) // n)::BIGINT END AS x FROM {c} c
  LEFT JOIN (SELECT j, d, sum(x) AS t, count(*) AS n FROM {a} JOIN e USING (v) GROUP BY j, d) USING (j, d)"""
    out = """WITH k AS MATERIALIZED (SELECT row_number() OVER () AS v, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS t FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS MATERIALIZED (SELECT v, unnest(t) AS x, generate_subscripts(t, 1) AS d FROM k),
f AS MATERIALIZED (SELECT t, row_number() OVER (ORDER BY sha256('3:' || vec_id), t) - 1 AS j FROM k WHERE vec_id IS NOT NULL QUALIFY j < 8),
c0 AS MATERIALIZED (SELECT j, unnest(t) AS x, generate_subscripts(t, 1) AS d FROM f),
"""
    for r in range(rounds):
        out += f"a{r} AS MATERIALIZED ({nearest.format(c=f'c{r}')}),\nc{r + 1} AS MATERIALIZED ({moved.format(c=f'c{r}', a=f'a{r}')}),\n"
    return (
        out
        + f"""z AS MATERIALIZED ({nearest.format(c=f"c{rounds}")}),
h AS (SELECT j, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS digest FROM c{rounds} GROUP BY j)
SELECT vec_id, z.j::INTEGER AS cluster, (s // 8)::BIGINT AS distance, (sum(s // 8) OVER (PARTITION BY z.j))::BIGINT AS cluster_inertia,
  (sum(s // 8) OVER ())::BIGINT AS inertia, digest AS centroid_sha256 FROM z JOIN k USING (v) JOIN h USING (j)"""
    )


SQL = twin()
