"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms of a text: trigrams of character classes over its whole bytes (so that
no vocabulary or language matters) and words, lines and windows that repeat.
Log counts, weighted by inverse document frequency and scaled to length one,
are projected on the leading singular directions of a bounded sample of
labelled rows. The sample's vectors are broadcast (at most SAMPLE x RANK
floats), each block of documents is multiplied with all of them, and the
nearest neighbours vote with weights that grow with their cosine.

Edge cases: null and empty texts are the same text, with a vector of zeros
that gets the sample's own share of good rows; labels that are null are no
labels, repeated labels of a row count once (the smallest); without labelled
rows every score is 0.5; repeated rows get equal scores; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, pack, row_key, table, unpack
from .vec import Words, slices, utf8

SAMPLE = 4096
RANK = 64
NEIGHBOURS = 25
CLASSES = 16
EXTRA = 4
WIDTH = CLASSES**3 + EXTRA
BLOCK = 512


def byte_classes() -> np.ndarray:
    """A class for each byte: letters by case, digits, blanks, line ends, kinds of punctuation, parts of longer characters."""
    out = np.full(256, 15, np.int64)
    groups = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\v\f", "\n", ".,;:", "!", "?", "|", "#*$%&", "<>", "-_/=+~^", "()[]{}", "\"'`"]
    for i, group in enumerate(groups):
        out[[ord(c) for c in group]] = i
    out[128:] = 14
    return out


KIND = byte_classes()


def repeated(keys: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row: how many keys, and how many are equal to another key of the row."""
    order = np.lexsort((keys, rows))
    k, r = keys[order], rows[order]
    same = (k[1:] == k[:-1]) & (r[1:] == r[:-1]) if len(k) else np.zeros(0, bool)
    twice = np.r_[same, False] | np.r_[False, same] if len(k) else np.zeros(0, bool)
    return np.bincount(r, minlength=n), np.bincount(r[twice], minlength=n)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of term weights for each text, before idf."""
    n, out = len(offsets) - 1, np.zeros((len(offsets) - 1, WIDTH), np.float32)
    row = np.repeat(np.arange(n), np.diff(offsets))
    kind = KIND[data]
    if len(data) >= 3:
        code = (kind[:-2] * CLASSES + kind[1:-1]) * CLASSES + kind[2:]
        inside = row[:-2] == row[2:]
        counts = np.bincount(row[:-2][inside] * (WIDTH - EXTRA) + code[inside], minlength=n * (WIDTH - EXTRA))
        out[:, : WIDTH - EXTRA] = np.log1p(counts.reshape(n, -1))
    words = Words(data, offsets)
    _, shingles = words.windows(4)
    first, _ = words.windows(4)
    some, twice = repeated(shingles, words.row[first], n)
    share = twice / np.maximum(some, 1)
    total = np.bincount(words.row, minlength=n)
    nexts = np.bincount(words.row[1:][(words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])], minlength=n) / np.maximum(total, 1)
    upper = np.bincount(row[kind == 1], minlength=n) / np.maximum(np.bincount(row[kind <= 1], minlength=n), 1)
    marks = np.bincount(row[np.isin(kind, (6, 8, 9, 10))], minlength=n) / np.maximum(total, 1)
    length = np.linalg.norm(out, axis=1)
    for i, x in enumerate((share, nexts, upper, marks)):
        out[:, WIDTH - EXTRA + i] = np.minimum(x, 1) * length * 0.7
    return out


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``sample`` different labelled texts of ``docs``, the first by a hash of their id."""
    ids = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = ids.join(docs.select("doc_id"), "doc_id", "left_semi")
    ids = cut(ids.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(sample))
    keyed = docs.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("key"))
    # Rows that repeat, and texts that share an id, are counted before any text is gathered.
    chosen = keyed.join(F.broadcast(ids), "doc_id").select("doc_id", "key", "quality").distinct()
    chosen = cut(chosen.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", "key").limit(sample))
    rows = keyed.join(F.broadcast(chosen.drop("doc_id")), "key").dropDuplicates(["key"]).select("doc_id", "quality", "text")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column("text"))
            found = []
            for _, part, ends in slices(data, offsets):
                for x in features(part, ends):
                    at = np.flatnonzero(x).astype(np.int32)
                    found.append((len(at), pack(at, x[at])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.binary())], names=["doc_id", "quality", "n", "blob"])

    got = rows.mapInArrow(sparse, "doc_id long, quality int, n int, blob binary").collect()
    got.sort(key=lambda r: (r["doc_id"], bytes(r["blob"])))
    x = np.zeros((len(got), WIDTH), np.float32)
    for i, r in enumerate(got):
        at, v = unpack(bytes(r["blob"]), r["n"], "int32", "float32")
        x[i, at] = v
    return x, np.array([float(r["quality"] == 1) for r in got], np.float32)


def scaled(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class Voter:
    """Inverse document frequencies, projection, and the labelled vectors."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rank: int = RANK, seed: int = 5):
        self.y, self.prior = y, float(y.mean()) if len(y) else 0.5
        self.idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
        weighted = scaled(x * self.idf)
        rng = np.random.default_rng(seed)
        base = weighted.T @ rng.standard_normal((len(x), min(rank + 16, max(len(x), 1)))).astype(np.float32)
        for _ in range(3):
            base = np.linalg.qr(weighted.T @ (weighted @ base))[0] if len(x) else base
        if len(x):
            small = np.linalg.svd(weighted @ base, full_matrices=False)[2]
            base = (base @ small.T)[:, :rank]
        self.project = np.ascontiguousarray(base, np.float32)
        self.vectors = np.ascontiguousarray(scaled(weighted @ self.project).T)

    def score(self, x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        out = np.full(len(x), self.prior)
        if not len(self.y):
            return out
        latent = (x * self.idf) @ self.project
        real = np.linalg.norm(latent, axis=1) > 1e-6
        cosines = scaled(latent) @ self.vectors
        k = min(k, len(self.y))
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weight = np.exp(20.0 * (np.take_along_axis(cosines, near, axis=1).astype(np.float64) - 1))
        out[real] = ((weight * self.y[near]).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-300))[real]
        return np.clip(out, 0, 1)


def knn_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id and score (0 to 1) of every row of ``docs``; ``labels``: doc_id, quality."""
    voter = docs.sparkSession.sparkContext.broadcast(Voter(*sampled(docs, labels, sample)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column("text"))
            out = np.zeros(b.num_rows)
            for at, part, ends in slices(data, offsets):
                for i in range(0, len(ends) - 1, BLOCK):
                    some = ends[i : i + BLOCK + 1]
                    out[at + i : at + i + len(some) - 1] = voter.value.score(features(part[some[0] : some[-1]], some - some[0]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out)], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")


def op1_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % 4 == 2
    labels = table(spark, sf_dir, "labels").filter(~fold("doc_id")).select("doc_id", "quality")
    out = knn_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return out.select("doc_id", fold("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
