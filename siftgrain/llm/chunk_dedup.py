"""Substring dedup by content-defined chunks under a gear rolling hash.

A gear hash over the last 32 bytes rolls along each text. A chunk ends after a
blank whose hash is the least among the blanks within ``REACH`` bytes, so cuts
follow the content alone: an insertion moves no cut further than that away,
and no chunk but a text's last is shorter than ``REACH``. Where no blank is
within ``REACH`` bytes (Chinese, base64), every character's end stands for one.
Chunks are
deduplicated by digest over all texts: the first by (doc_id, offset) stays. A
run of repeated chunks is removed if it spans at least ``LEAST`` bytes, so
that common phrases stay.

A chunk that repeats in a batch is settled there, and only its first (with the
same place of equal rows) meets other batches: a digest that a third of all texts hold reaches its bucket once
a batch.

Edge cases: null and empty texts have no chunks and stay empty; a run of one
character has no least hash and is cut every ``MOST`` bytes; repeated rows with
equal id and text are one row to the digest and are treated alike; null ids
come first; extra columns pass through ``dedup_chunks``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_runs, buckets_for, delta, map_texts, pack, row_key, shielded, slim, table, unpack
from .vec import BYTE, GEAR, SPACE, mix, powers, slices, utf8

U = np.uint64
REACH, MOST, LEAST = 24, 1024, 96
FLUSH = 1_000_000
NULL_ID = -(2**63)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, over the last 32 bytes, by doubling."""
    h = GEAR[data]
    for i in range(5):
        m = 1 << i
        if len(h) > m:
            h[m:] += (h[:-m] << np.uint32(m)).astype(np.uint32)
    return h


def unspaced(data: np.ndarray, offsets: np.ndarray, blanks: np.ndarray) -> np.ndarray:
    """Last bytes of the characters that have no blank of their text within ``REACH`` bytes."""
    # Between two blanks of a text; before its first and after its last.
    wide = np.flatnonzero(np.diff(blanks) > 2 * REACH + 1)
    wide = wide[np.searchsorted(offsets, blanks[wide], "right") == np.searchsorted(offsets, blanks[wide + 1], "right")]
    first, last = np.searchsorted(blanks, offsets[:-1]), np.searchsorted(blanks, offsets[1:])
    some = last > first
    heads, tails = offsets[1:].copy(), offsets[1:].copy()
    heads[some], tails[some] = blanks[first[some]] - REACH, blanks[last[some] - 1] + REACH + 1
    begins, ends = np.r_[blanks[wide] + REACH + 1, offsets[:-1], tails], np.r_[blanks[wide + 1] - REACH, heads, offsets[1:]]
    # The gear hash needs its window.
    begins[len(wide) : len(wide) + len(heads)] += 31
    some = ends > begins
    begins, many = begins[some], (ends - begins)[some]
    spots = np.repeat(begins - (np.cumsum(many) - many), many) + np.arange(many.sum())
    spots = spots[spots + 1 < len(data)]
    return spots[data[spots + 1] & 0xC0 != 0x80]


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end, row) of every chunk of a run of texts, in order."""
    n = len(data)
    row_of = lambda x: np.searchsorted(offsets, x, "right") - 1
    spots = np.flatnonzero(SPACE[data])
    more = unspaced(data, offsets, spots)
    if len(more):
        spots = np.sort(np.concatenate([spots, more]))
    row = row_of(spots)
    go = (spots - offsets[row] >= 31) & (spots + 1 < offsets[row + 1])
    spots, row = spots[go], row[go]
    value = (mix(gear(data)[spots].astype(U)) >> U(8)) if n else np.zeros(0, U)
    keep = np.ones(len(spots), bool)
    for d in range(1, REACH + 1):
        close = (spots[d:] - spots[:-d] <= REACH) & (row[d:] == row[:-d])
        if not close.any():
            break
        keep[:-d] &= ~(close & (value[d:] < value[:-d]))
        keep[d:] &= ~(close & (value[:-d] <= value[d:]))
    last = offsets[1:][np.diff(offsets) > 0]
    ends = np.union1d(spots[keep] + 1, last)
    begins = np.r_[0, ends[:-1]] if len(ends) else ends
    long = np.flatnonzero(ends - begins > MOST)
    if len(long):
        more = [_char_start(data, x) for i in long for x in range(int(begins[i]) + MOST, int(ends[i]), MOST)]
        ends = np.union1d(ends, more).astype(np.int64)
    return ends, row_of(ends - 1)


def _char_start(data: np.ndarray, x: int) -> int:
    while x > 0 and data[x] & 0xC0 == 0x80:
        x -= 1
    return x


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, digest) of every chunk."""
    ends, row = chunk_ends(data, offsets)
    begins = np.r_[0, ends[:-1]] if len(ends) else ends
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE[data] * up[: len(data)], out=sums[1:])
    return begins, ends, row, mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(U))


def later(names: np.ndarray, keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which entries, sorted by name, are not at the first's row and place: equal rows (id and text) hold the first place of a name together."""
    begin = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(names) else np.zeros(0, np.int64)
    begin = np.repeat(begin, np.diff(np.r_[begin, len(names)]))
    return (keys != keys[begin]) | (places != places[begin])


def digest_rows(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Blobs of (digest, doc_id, key, place) for each bucket; a chunk that repeats in a flush goes on as settled, dealt by its row."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        digest, ids, keys, place = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((place, keys, ids, digest))
        digest, ids, keys, place = digest[order], ids[order], keys[order], place[order]
        settled = later(digest, keys, place)
        bucket = np.where(settled, keys.view(U) >> U(20), digest >> U(20)) % U(buckets)
        order = np.lexsort((place, keys, ids, settled, bucket))
        digest, ids, keys, place, settled, bucket = (x[order] for x in (digest, ids, keys, place, settled, bucket))
        out = []
        for b, i, j in bucket_runs(bucket * U(2) + settled):
            blob = pack(delta(keys[i:j]), place[i:j]) if b & 1 else pack(digest[i:j], delta(ids[i:j]), delta(keys[i:j]), place[i:j])
            out.append((b >> 1, bool(b & 1), j - i, blob))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.bool_(), pa.int32(), pa.binary()))], names=["bucket", "settled", "n", "blob"])
        held.clear()

    for b in batches:
        data, offsets = utf8(b.column("text"))
        ids = b.column("doc_id").fill_null(NULL_ID).to_numpy()
        keys = b.column("key").to_numpy()
        for at, part, ends in slices(data, offsets):
            _, _, row, digest = chunks(part, ends)
            first = np.searchsorted(row, np.arange(len(ends) - 1))
            held.append((digest, ids[at + row], keys[at + row], (np.arange(len(row)) - first[row]).astype(np.int32)))
            if sum(len(x[0]) for x in held) >= FLUSH:
                yield from flush()
    yield from flush()
    slim()


def by_key(keys: np.ndarray, *values: np.ndarray) -> pd.DataFrame:
    """A row for each key with its values packed."""
    order = np.lexsort((values[0], keys))
    keys, values = keys[order], [v[order] for v in values]
    runs = bucket_runs(keys)
    return pd.DataFrame({"key": np.array([x[0] for x in runs], np.int64), "n": np.array([j - i for _, i, j in runs], np.int32), "blob": [pack(*[v[i:j] for v in values]) for _, i, j in runs]})


def repeats(blobs: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: by row, the places of chunks that an earlier chunk equals."""
    keys, places, open_ = [], [], []
    for x in blobs.itertuples():
        if x.settled:
            k, p = unpack(x.blob, x.n, "int64", "int32")
            keys.append(np.cumsum(k))
            places.append(p)
        else:
            d, i, k, p = unpack(x.blob, x.n, "uint64", "int64", "int64", "int32")
            open_.append((d, np.cumsum(i), np.cumsum(k), p))
    if open_:
        d, i, k, p = (np.concatenate(x) for x in zip(*open_, strict=True))
        order = np.lexsort((p, k, i, d))
        d, i, k, p = d[order], i[order], k[order], p[order]
        again = later(d, k, p)
        keys.append(k[again])
        places.append(p[again])
    slim()
    return by_key(np.concatenate(keys), np.concatenate(places)) if keys else by_key(np.zeros(0, np.int64), np.zeros(0, np.int32))


def removed_runs(begins: np.ndarray, ends: np.ndarray, again: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each run of repeated chunks of one text that spans ``least`` bytes."""
    edge = np.diff(np.r_[0, again.astype(np.int8), 0])
    i, j = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    a, b = begins[i], ends[j]
    return a[b - a >= least], b[b - a >= least]


def without(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> bytes:
    raw, at, out = data.tobytes(), 0, []
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def dedup_chunks(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` with text deduplicated, and n_bytes, n_chunks, n_removed, n_spans (columns of these names are replaced)."""
    buckets = buckets_for(docs, 16)
    docs, restored = shielded(docs, ("_key", "_n", "_blob"))
    added = ("n_bytes", "n_chunks", "n_removed", "n_spans")
    names = [c for c in docs.columns if c not in added]
    keyed = docs.select(*[F.col(f"`{c}`") for c in names], row_key(F.col("doc_id"), F.col("text")).alias("_key"))
    found = map_texts(keyed.select("doc_id", "text", F.col("_key").alias("key")), lambda x: digest_rows(x, buckets), "bucket int, settled boolean, n int, blob binary")
    found = found.groupBy("bucket").applyInPandas(repeats, "key long, n int, blob binary")
    found = found.groupBy(F.col("key").alias("_key")).agg(F.collect_list("n").alias("_n"), F.collect_list("blob").alias("_blob"))
    # What was found is hashed, so that the texts needn't be sorted.
    joined = keyed.join(found.hint("shuffle_hash"), "_key", "left").drop("_key")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.drop("_key").schema.fields] + ["n_bytes long", "n_chunks long", "n_removed long", "n_spans long"])

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column("text"))
            ns, blobs = b.column("_n"), b.column("_blob")
            for at, part, ends in slices(data, offsets):
                start, stop, row, _ = chunks(part, ends)
                n = len(ends) - 1
                first, last = np.searchsorted(row, np.arange(n)), np.searchsorted(row, np.arange(n), "right")
                texts, removed, spans = [], np.zeros(n, np.int64), np.zeros(n, np.int64)
                for i in range(n):
                    own = part[ends[i] : ends[i + 1]]
                    a = z = np.zeros(0, np.int64)
                    if ns[at + i].is_valid:
                        again = np.zeros(last[i] - first[i], bool)
                        for m, blob in zip(ns[at + i].as_py(), blobs[at + i].as_py(), strict=True):
                            again[unpack(blob, m, "int32")[0]] = True
                        a, z = removed_runs(start[first[i] : last[i]] - ends[i], stop[first[i] : last[i]] - ends[i], again, least)
                    removed[i], spans[i] = (z - a).sum(), len(a)
                    texts.append(without(own, a, z).decode("utf-8", "replace"))
                rest = b.slice(at, n)
                columns = [pa.array(texts, pa.string()) if c == "text" else rest.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(x.astype(np.int64)) for x in (np.diff(ends), last - first, removed, spans)]], names=[*names, "n_bytes", "n_chunks", "n_removed", "n_spans"])

    def slimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from cleaned(batches)
        slim()

    return restored(map_texts(joined, slimmed, schema))


def op7_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_chunks", "n_removed", "n_spans", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))
