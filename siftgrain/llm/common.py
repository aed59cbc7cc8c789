"""Shared plumbing: tables, checkpoints, bucket counts and packed blobs."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgrain.session import checkpointed, ensure_checkpoint_dir, stored

__all__ = ["ensure_checkpoint_dir", "stored"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared checkpoint folder and cuts its lineage."""
    return checkpointed(df)


#: Input that one bucket's task is meant for.
BUCKET_BYTES = 256 << 20


def buckets_for(docs: DataFrame, least: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """A number of buckets that grows with the size of ``docs`` (as its plan states it), so that a bucket's does not."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # a plan that doesn't know its size
        return max(least, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2)
    return max(least, -(-size // bucket_bytes))


#: A side of a join is broadcast up to so many rows (of a few numbers each, 8 MB or so), else shuffled.
BROADCAST_ROWS = 500_000


def sized_join(large: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """Joins with a narrow side whose size is counted first: broadcast below the bound, shuffled above it.

    Of the large side only rows that a sketch of the small one's keys lets pass are shuffled (inner and semi
    joins drop the others, anti joins keep them where they are), and none are sorted: the small side is hashed.
    """
    small = cut(small)
    n = small.count()
    if n <= most:
        return large.join(F.broadcast(small), on, how)
    hashed = small.hint("shuffle_hash")
    if how not in ("inner", "left_semi", "left_anti"):
        return large.join(hashed, on, how)
    may = may_hold(small, [on] if isinstance(on, str) else on, n)
    met = large.filter(may).join(hashed, on, how)
    return met if how != "left_anti" else met.unionByName(large.filter(~may).select(*met.columns))


#: Bits of a sketch for each key, and at most (64 MB); beyond that more rows pass, and joins stay exact.
SKETCH_BITS, MOST_BITS = 16, 1 << 29


def may_hold(keys: DataFrame, on: list[str], n: int) -> Column:
    """Whether a row's key can be among ``keys``: one bit for each key's hash, of a table that is sent to all workers."""
    words = 1 << max(10, (min(n * SKETCH_BITS, MOST_BITS) - 1).bit_length() - 6)
    name = F.xxhash64(*on, F.lit(words))
    word, bit = F.pmod(F.shiftright(name, 6), F.lit(words)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(name, F.lit(64)).cast("int"))
    found = keys.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    table_ = np.zeros(words, np.int64)
    table_[found["word"].to_numpy()] = found["bits"].to_numpy(np.int64)
    shared = keys.sparkSession.sparkContext.broadcast(table_)

    @F.arrow_udf("boolean")
    def there(names: pa.Array) -> pa.Array:
        x = names.to_numpy(zero_copy_only=False)
        return pa.array((shared.value[(x >> 6) % words] >> (x % 64)) & 1 == 1)

    return there(name)


#: Texts of one Arrow batch, and the bytes beyond which it ends: what a worker and its JVM hold of the input at a time.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16777216b")}


def map_texts(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over smaller batches than the default ones, which hold 10,000 whole texts, in lean workers; sizes that the session names stay."""
    conf = df.sparkSession.conf
    for name, (default, ours) in BATCH.items():
        if conf.get(name, default) == default:
            conf.set(name, ours)

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        yield from run(batches)

    return df.mapInArrow(lean_run, schema)


#: glibc's name of the size from which memory is mapped, and that size: what is mapped goes back when it is freed.
M_MMAP_THRESHOLD, MAPPED = -3, 1 << 18


def lean() -> None:
    """Has a worker's arrays given back to the system when they are freed, not kept for later stages; elsewhere than on glibc nothing changes."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL("libc.so.6").mallopt(M_MMAP_THRESHOLD, MAPPED)
    except (OSError, AttributeError):
        pass


def row_key(doc_id, text):
    """A key for a row that null or repeated ids cannot confuse: equal only for equal (id, text)."""
    return F.xxhash64(doc_id, F.coalesce(text, F.lit("")))


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shielded(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with its columns called like ``names`` renamed, and what gives them their names back."""
    wanted = {n.lower() for n in names}
    back = {fresh_name(df, f"_{c}"): c for c in df.columns if c.lower() in wanted}
    for new, old in back.items():
        df = df.withColumnRenamed(old, new)

    def restored(out: DataFrame) -> DataFrame:
        return out.withColumnsRenamed(back) if back else out

    return df, restored


def pack(*arrays: np.ndarray) -> bytes:
    """Equal-length arrays as one compressed blob; long runs and sorted ids shrink well."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(blob: bytes, n: int, *dtypes: str) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
    for kind in dtypes:
        size = n * np.dtype(kind).itemsize
        out.append(np.frombuffer(raw, kind, n, at))
        at += size
    return out


def delta(a: np.ndarray) -> np.ndarray:
    """Differences of neighbours, invertible by a running sum; wraps around."""
    out = np.asarray(a, np.int64).copy()
    out[1:] -= np.asarray(a, np.int64)[:-1]
    return out


def slim() -> None:
    """Gives a worker's freed memory back, since workers stay for later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def bucket_runs(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, first, last + 1) of each run of a sorted array."""
    if not len(bucket):
        return []
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    return list(zip(bucket[first].tolist(), first.tolist(), np.r_[first[1:], len(bucket)].tolist(), strict=True))
