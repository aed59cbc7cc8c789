"""Exact top-k search by inner product over signed postings, with MaxScore.

A vector's terms are its components, counted from its shard's centre; a query's
term has a score bound, the most that any vector of a shard can add through it.
The query's terms are split at a running threshold: the non-essential ones are
those whose bounds, summed from the smallest, stay below what the threshold
leaves above the centre's own score. Postings of essential terms (vectors whose
component lies on the query's side of the centre) are traversed; other terms are
probed, largest bound first, only for vectors that can still compete. Shards
give their best k, which are merged.

The threshold of a query starts as its k-th best score against ``SEEDS`` rows
that are chosen by a hash and broadcast, and rises with the shards of a
fragment, which are visited by falling bound, those below it not at all. A
fragment's shards are leaves of a k-d tree, so that their bounds are close.

The grid: candidates are dealt over fragments and queries over blocks, each
of a bounded number of rows; each fragment meets each block once.

Edge cases: a vector that is null or holds a null or non-finite component
takes no part, as a query or candidate; vectors of unequal length are padded
with zeros; equal vectors rank by vec_id; of rows repeated with one vec_id
each is a candidate of its own, and a query is never its own id's candidate;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

FRAGMENT_ROWS = 65_536
BLOCK_ROWS = 4_096
SHARD_ROWS = 4_096
LEAST_FRAGMENTS = 12
SEEDS = 2_048
#: Below any score.
NONE = -(2**63)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of rows; in floating point where all sums fit its whole numbers."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**52:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


class Shard:
    """Candidates as residuals from their centre, with postings: for each component, the rows above the centre and those below."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, vectors = ids[order], vectors[order]
        self.centre = np.median(vectors, axis=0).astype(np.int64)
        self.columns = np.ascontiguousarray((vectors - self.centre).T)
        self.high, self.low = self.columns.max(axis=1), self.columns.min(axis=1)
        self.held: dict[tuple[int, bool], np.ndarray] = {}

    def postings(self, d: int, above: bool) -> np.ndarray:
        if (d, above) not in self.held:
            self.held[d, above] = np.flatnonzero(self.columns[d] > 0 if above else self.columns[d] < 0)
        return self.held[d, above]

    def best(self, query_id: int, query: np.ndarray, base: int, k: int, threshold: int, seen: Counter) -> list[tuple[int, int]]:
        """(score, vec_id) of the shard's best k that reach ``threshold``, ties by vec_id; ``base`` is the centre's score."""
        bound = np.maximum(np.maximum(query * self.high, query * self.low), 0)
        order = np.argsort(-bound, kind="stable")
        rest = np.r_[np.cumsum(bound[order][::-1])[::-1], 0]
        wanted = threshold - base if threshold > NONE else NONE
        essential = int(np.searchsorted(-rest, -wanted, "right")) if wanted > 0 else len(order)
        seen["terms"] += len(order)
        seen["non-essential terms"] += len(order) - essential
        if wanted > 0:
            found = np.zeros(len(self.ids), bool)
            for d in order[:essential]:
                if query[d]:
                    found[self.postings(d, query[d] > 0)] = True
            alive = np.flatnonzero(found)
        else:
            alive = np.arange(len(self.ids))
        score = np.zeros(len(alive), np.int64)
        for at in range(0, len(order), 8):
            terms = order[at : at + 8]
            score += query[terms] @ (self.columns[terms] if len(alive) == len(self.ids) else self.columns[np.ix_(terms, alive)])
            go = score + rest[min(at + 8, len(order))] >= wanted
            if not go.all():
                alive, score = alive[go], score[go]
            if not len(alive):
                return []
        seen["rows summed up"] += len(alive)
        own = self.ids[alive] != query_id
        alive, score = alive[own], score[own] + base
        top = np.lexsort((self.ids[alive], -score))[:k]
        return list(zip(score[top].tolist(), self.ids[alive[top]].tolist(), strict=True))


def leaves(vectors: np.ndarray, most: int = SHARD_ROWS) -> list[np.ndarray]:
    """Rows of the leaves of a k-d tree: cut in two at the middle of the component with the widest spread until few are left."""
    out, todo = [], [np.arange(len(vectors))]
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            out.append(rows)
            continue
        x = vectors[rows]
        order = np.argsort(x[:, int(np.argmax(x.std(axis=0)))], kind="stable")
        todo += [rows[order[len(rows) // 2 :]], rows[order[: len(rows) // 2]]]
    return out


def kth_best(query_id: int, query: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> int:
    """The k-th best score of a query among some candidates: a lower bound for all; ``NONE`` if there are fewer."""
    score = products(vectors, query[None, :])[:, 0][ids != query_id] if len(ids) else np.zeros(0, np.int64)
    return int(np.partition(score, len(score) - k)[len(score) - k]) if len(score) >= k else NONE


def padded(rows: pd.Series, width: int) -> np.ndarray:
    if all(len(x) == width for x in rows):
        return np.stack(rows.to_numpy()).astype(np.int64)
    return np.stack([np.r_[x, np.zeros(width - len(x), np.int64)] for x in rows]).astype(np.int64)


def search(candidates: pd.DataFrame, queries: pd.DataFrame, k: int, seen: Counter | None = None) -> pd.DataFrame:
    """Best k of the fragment for each query of the block; ``seen`` counts what was looked at."""
    out, seen = [], Counter() if seen is None else seen
    if len(candidates) and len(queries):
        width = max(candidates["terms"].map(len).max(), queries["terms"].map(len).max())
        vectors, ids, asked = padded(candidates["terms"], width), candidates["vec_id"].to_numpy(), padded(queries["terms"], width)
        shards = [Shard(ids[x], vectors[x]) for x in leaves(vectors)]
        base = products(asked, np.stack([s.centre for s in shards]))
        bounds = base + products(np.maximum(asked, 0), np.stack([s.high for s in shards])) + products(np.minimum(asked, 0), np.stack([s.low for s in shards]))
        for i, (query_id, row, least) in enumerate(zip(queries["vec_id"], queries["row"], queries["least"], strict=True)):
            best: list[tuple[int, int]] = []
            seen["rows"] += len(ids)
            for j in np.argsort(-bounds[i], kind="stable"):
                threshold = max(int(least), best[-1][0] if len(best) == k else NONE)
                if bounds[i, j] < threshold:
                    break
                seen["shards"] += 1
                found = shards[j].best(query_id, asked[i], int(base[i, j]), k, threshold, seen)
                best = sorted(best + found, key=lambda x: (-x[0], x[1]))[:k]
            out += [(query_id, row, vec_id, score) for score, vec_id in best]
    return pd.DataFrame(out, columns=["query_id", "row", "vec_id", "score"]).astype("int64")


def with_thresholds(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Adds least: what a query's k-th best score reaches at any rate, by ``SEEDS`` rows."""
    some = vectors.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(SEEDS).toPandas()
    width = int(some["terms"].map(len).max()) if len(some) else 0
    seeds = queries.sparkSession.sparkContext.broadcast((some["vec_id"].to_numpy(np.int64), padded(some["terms"], width) if len(some) else np.zeros((0, 0), np.int64)))

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, rows = seeds.value
        for b in batches:
            fit = lambda t: np.r_[t, np.zeros(max(0, rows.shape[1] - len(t)), np.int64)][: rows.shape[1]].astype(np.int64)
            # What a longer query has beyond the seeds' width meets padding, which adds nothing.
            yield b.assign(least=np.array([kth_best(i, fit(t), ids, rows, k) for i, t in zip(b["vec_id"], b["terms"], strict=True)], np.int64))

    return queries.mapInPandas(least, "vec_id long, terms array<long>, row long, least long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score; both inputs: vec_id long, terms array<long>."""
    n, q = vectors.count(), queries.count()
    fragments = max(LEAST_FRAGMENTS, math.ceil(n / FRAGMENT_ROWS))
    blocks = max(1, math.ceil(q / BLOCK_ROWS))
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select("vec_id", "terms", deal(fragments, 1).alias("fragment")).select("*", every(blocks).alias("block"))
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), "terms", F.xxhash64("vec_id", "terms").alias("row")).dropDuplicates(["row"])
    right = with_thresholds(asked, vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "terms"), k).withColumn("block", deal(blocks, 2)).select("*", every(fragments).alias("fragment"))
    keys = ["fragment", "block"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: search(a, b, k), "query_id long, row long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """Whole vectors only, each component as floor(scale * x)."""
    whole = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return embeddings.filter(whole).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("terms"))


def op2_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"))


SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS t FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, unnest(t) AS x, generate_subscripts(t, 1) AS d FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score FROM e q JOIN e c ON q.d = c.d AND q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10"""
