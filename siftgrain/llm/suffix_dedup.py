"""Exact substring dedup over blocks of suffixes, with a cover sample.

Every string of ``LENGTH`` bytes that also starts earlier, in the order of
(doc_id, start), is found, and the bytes it covers are removed; strings are
judged on the input and overlaps count.

The cover: of the ``SAMPLE``-byte grams in each string the one with the least
hash, the leftmost of equals, is a sample. Equal strings hold equal samples at
equal places, which is what a difference cover gives suffixes whose places
differ: a comparison moves on to the sample, whose rank (here the hash of its
gram, computed once) decides all that is left of a tie. A residue-class cover
of the same reach would sample a seventh of all places, these a thirty-fifth.

1. Ranks of all samples meet in blocks by rank; ranks seen once are dropped,
   since no string around such a sample repeats.
2. Samples that are left bring the bytes of the strings that chose them (about
   35 starts, 135 bytes) to the block of their rank. One block of suffixes is
   taken at a time: its strings, in the order of (doc_id, start), are named by
   hashes, each is compared byte by byte with the first of its name, and those
   that have one before them are repeats. (Strings are named, not sorted.)
3. Repeats come back to their texts as spans.

A context that repeats in a batch is settled there but for its first (and the same start of equal rows), so that
a passage which a third of all texts hold reaches its block once a batch.

Edge cases: null texts are empty; texts shorter than the length lose nothing;
rows repeated with equal id and text are the same document, and what one loses
the other loses; the strings of different texts under one id are ordered by
start, and by a hash of the text where starts tie; null ids come first; extra
columns pass through ``dedup_substrings``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunk_dedup import NULL_ID, by_key, later, without
from .common import bucket_runs, buckets_for, delta, map_texts, pack, row_key, shielded, table, unpack
from .vec import grams, mix, slices, utf8

U = np.uint64
LENGTH, SAMPLE = 100, 32
FLUSH = 1_000_000
FLUSH_BYTES = 24 << 20
#: Input that a bucket is for, as the plan states it (2 columns of 5 count as two fifths of a file).
BUCKET = 8 << 20
#: Strings of a bucket that meet at a time.
STRINGS = 1 << 20


def sliding_least(a: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, from block-wise running minima."""
    n = len(a) - width + 1
    size = -(-len(a) // width) * width
    padded = np.full(size, np.iinfo(a.dtype).max, a.dtype)
    padded[: len(a)] = a
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def cover(data: np.ndarray, offsets: np.ndarray, length: int, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place of the sample, first start, starts, rank) of each run of neighbouring strings that choose one sample, inside rows."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, np.zeros(0, U)
    rank = mix(grams(data, sample))
    keyed = ((rank >> U(32)) << U(32)) | np.arange(len(rank), dtype=U)
    chosen = (sliding_least(keyed, length - sample + 1) & U(0xFFFFFFFF)).astype(np.int64)
    starts = np.arange(len(chosen))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(chosen)]
    inside = starts + length <= offsets[row + 1]
    starts, chosen, row = starts[inside], chosen[inside], row[inside]
    if not len(starts):
        return none, none, none, np.zeros(0, U)
    first = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])])
    return chosen[first], starts[first], np.diff(np.r_[first, len(starts)]), rank[chosen[first]]


_BLOBS = "bucket int, settled boolean, n int, blob binary, bytes binary"
_BLOBS_ARROW = pa.schema([("bucket", pa.int32()), ("settled", pa.bool_()), ("n", pa.int32()), ("blob", pa.binary()), ("bytes", pa.binary())])


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(_BLOBS_ARROW)], schema=_BLOBS_ARROW)


def rank_rows(batches: Iterator[pa.RecordBatch], buckets: int, length: int, sample: int) -> Iterator[pa.RecordBatch]:
    """Step 1: (rank, key) of every sample by block; ranks that repeat in a flush go on as settled, dealt by row."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        rank, key = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((key, rank))
        rank, key = rank[order], key[order]
        same = rank[1:] == rank[:-1]
        twice, again = np.r_[same, False] | np.r_[False, same], np.r_[False, same]
        # The first of a repeated rank still goes to its block, to meet other batches; it goes on as settled as well.
        rank, key, settled = np.r_[rank[~again], rank[twice]], np.r_[key[~again], key[twice]], np.r_[np.zeros((~again).sum(), bool), np.ones(twice.sum(), bool)]
        bucket = np.where(settled, key.view(U) >> U(20), rank >> U(20)) % U(buckets)
        order = np.lexsort((key, settled, bucket))
        rank, key, settled, bucket = (x[order] for x in (rank, key, settled, bucket))
        yield batch_of([(b >> 1, bool(b & 1), j - i, pack(rank[i:j], delta(key[i:j])), None) for b, i, j in bucket_runs(bucket * U(2) + settled)])
        held.clear()

    for b in batches:
        data, offsets = utf8(b.column("text"))
        keys = b.column("key").to_numpy()
        for at, part, ends in slices(data, offsets):
            place, _, _, rank = cover(part, ends, length, sample)
            held.append((rank, keys[at + np.searchsorted(ends, place, "right") - 1]))
            if sum(len(x[0]) for x in held) >= FLUSH:
                yield from flush()
    yield from flush()


def repeated_ranks(blobs: pd.DataFrame) -> pd.DataFrame:
    """Of one block: by row, the ranks that occur more than once."""
    ranks, keys, open_ = [], [], []
    for x in blobs.itertuples():
        r, k = unpack(x.blob, x.n, "uint64", "int64")
        if x.settled:
            ranks.append(r)
            keys.append(np.cumsum(k))
        else:
            open_.append((r, np.cumsum(k)))
    if open_:
        r, k = (np.concatenate(x) for x in zip(*open_, strict=True))
        order = np.argsort(r, kind="stable")
        r, k = r[order], k[order]
        same = r[1:] == r[:-1]
        twice = np.r_[same, False] | np.r_[False, same]
        ranks.append(r[twice])
        keys.append(k[twice])
    return by_key(np.concatenate(keys), np.concatenate(ranks)) if ranks else by_key(np.zeros(0, np.int64), np.zeros(0, U))


def context_rows(batches: Iterator[pa.RecordBatch], buckets: int, length: int, sample: int) -> Iterator[pa.RecordBatch]:
    """Step 2: the contexts of samples whose rank repeats, by block; a context that repeats in a flush is settled but for its first."""
    held: list[tuple] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        rank, digest, ids, keys, start, runs = (np.concatenate([x[i] for x in held]) for i in range(6))
        raw = b"".join([x[6] for x in held])
        many = runs + (length - 1)
        at = np.cumsum(many) - many
        order = np.lexsort((keys, start, ids, digest[:, 0], digest[:, 1]))
        rank, digest, ids, keys, start, runs, at, many = (x[order] for x in (rank, digest, ids, keys, start, runs, at, many))
        name = np.cumsum(np.r_[False, (digest[1:] != digest[:-1]).any(axis=1)])
        again = later(name, keys, start)
        rows = []
        bucket = (keys.view(U) >> U(20)) % U(buckets)
        late = np.flatnonzero(again)
        late = late[np.argsort(bucket[late], kind="stable")]
        for b, i, j in bucket_runs(bucket[late]):
            x = late[i:j]
            rows.append((b, True, len(x), pack(keys[x], start[x].astype(np.int32), (start[x] + many[x]).astype(np.int32)), None))
        bucket = (rank >> U(20)) % U(buckets)
        early = np.flatnonzero(~again)
        early = early[np.lexsort((keys[early], start[early], ids[early], bucket[early]))]
        for b, i, j in bucket_runs(bucket[early]):
            x = early[i:j]
            body = pack(np.frombuffer(b"".join([raw[a : a + n] for a, n in zip(at[x].tolist(), many[x].tolist(), strict=True)]), np.uint8))
            rows.append((b, False, len(x), pack(delta(ids[x]), delta(keys[x]), start[x].astype(np.int32), runs[x].astype(np.int32)), body))
        yield batch_of(rows)
        held.clear()

    for b in batches:
        data, offsets = utf8(b.column("text"))
        ids, keys = b.column("doc_id").fill_null(NULL_ID).to_numpy(), b.column("key").to_numpy()
        ns, blobs = b.column("ns"), b.column("blobs")
        for at, part, ends in slices(data, offsets):
            place, start, runs, rank = cover(part, ends, length, sample)
            row = np.searchsorted(ends, start, "right") - 1
            first, last = np.searchsorted(row, np.arange(len(ends) - 1)), np.searchsorted(row, np.arange(len(ends) - 1), "right")
            use = np.zeros(len(place), bool)
            for i in range(len(ends) - 1):
                if ns[at + i].is_valid:
                    wanted = np.concatenate([unpack(x, n, "uint64")[0] for n, x in zip(ns[at + i].as_py(), blobs[at + i].as_py(), strict=True)])
                    use[first[i] : last[i]] = np.isin(rank[first[i] : last[i]], wanted)
            if not use.any():
                continue
            place, start, runs, rank, row = place[use], start[use], runs[use], rank[use], row[use]
            raw = part.tobytes()
            body = [raw[s : s + n + length - 1] for s, n in zip(start.tolist(), runs.tolist(), strict=True)]
            digest = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in body]), U).reshape(-1, 2)
            held.append((rank, digest, ids[at + row], keys[at + row], start - ends[row], runs, b"".join(body)))
            size += len(held[-1][6]) + 48 * len(place)
            if size >= FLUSH_BYTES:
                yield from flush()
                size = 0
    yield from flush()


def first_equals(name: np.ndarray) -> np.ndarray:
    """Of each string the first with its name."""
    codes = pd.factorize(name)[0]
    return np.flatnonzero(~pd.Series(name).duplicated().to_numpy())[codes]


def equal_strings(data: np.ndarray, spot: np.ndarray, origin: np.ndarray, length: int, most: int = 1 << 22) -> bool:
    """Whether all strings at ``spot`` equal their origins byte by byte; neighbours are compared in one go."""
    for i in range(0, len(origin), STRINGS):
        hit = i + np.flatnonzero(origin[i : i + STRINGS] != np.arange(i, min(i + STRINGS, len(origin))))
        a, b = spot[hit].astype(np.int64), spot[origin[hit]].astype(np.int64)
        new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1] + 1) | (b[1:] != b[:-1] + 1)]) if len(hit) else hit
        a, b, many = a[new], b[new], np.diff(np.r_[new, len(hit)]) + (length - 1)
        at = 0
        upto = np.cumsum(many)
        while at < len(new):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
            n = many[at:end]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            if (data[np.repeat(a[at:end], n) + inside] != data[np.repeat(b[at:end], n) + inside]).any():
                return False
            at = end
    return True


def string_names(data: np.ndarray, at: np.ndarray, runs: np.ndarray, length: int, most: int = 1 << 22) -> np.ndarray:
    """A hash of each string, of contexts as they lie in ``data`` (string i of a context starts i bytes after it)."""
    out, upto = np.empty(runs.sum(), U), np.r_[0, np.cumsum(runs)]
    c = 0
    while c < len(at):
        end = max(c + 1, int(np.searchsorted(at, at[c] + most)))
        n = runs[c:end]
        hashes = mix(grams(data[at[c] : at[end - 1] + n[-1] + length - 1], length))
        out[upto[c] : upto[end]] = hashes[np.repeat(at[c:end] - at[c] - (upto[c:end] - upto[c]), n) + np.arange(n.sum())]
        c = end
    return out


def origins(name: np.ndarray, ordered: Callable[[np.ndarray], np.ndarray] | None) -> np.ndarray:
    """Of each string the first with its name, ``ordered`` giving places their order; names are dealt into classes, one of which is looked at a time."""
    classes = max(1, -(-len(name) // STRINGS))
    out = np.empty(len(name), np.int64)
    for c in range(classes):
        own = np.flatnonzero(name % U(classes) == U(c))
        own = ordered(own) if ordered else own
        out[own] = own[first_equals(name[own])]
    return out


def repeated_spans(blobs: pd.DataFrame, length: int) -> pd.DataFrame:
    """Step 2, one block: by row, the spans covered by strings that also start earlier."""
    keys, begins, ends, parts, raw = [], [], [], [], []
    for x in blobs.itertuples():
        if x.settled:
            k, a, z = unpack(x.blob, x.n, "int64", "int32", "int32")
            keys.append(k)
            begins.append(a.astype(np.int64))
            ends.append(z.astype(np.int64))
        else:
            i, k, s, r = unpack(x.blob, x.n, "int64", "int64", "int32", "int32")
            parts.append((np.cumsum(i), np.cumsum(k), s.astype(np.int64), r.astype(np.int64)))
            raw.append(unpack(x.bytes, int((r.astype(np.int64) + length - 1).sum()), "uint8")[0])
    if parts:
        ids, key, start, runs = (np.concatenate(x) for x in zip(*parts, strict=True))
        data = np.concatenate(raw)
        raw.clear()
        many = runs + (length - 1)
        at = np.cumsum(many) - many
        name = string_names(data, at, runs, length)
        base = np.cumsum(runs) - runs
        order = np.lexsort((key, start, ids))
        ids, key, start, runs, at = ids[order], key[order], start[order], runs[order], at[order]
        upto = np.cumsum(runs)
        # Strings in the order of their contexts: where each name stands, then where each string's bytes do.
        move = np.repeat(base[order] - (upto - runs), runs)
        move += np.arange(len(move))
        name = name[move]
        spot = np.repeat(at - (upto - runs), runs)
        spot += np.arange(len(spot))
        del move

        def of(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            who = np.searchsorted(upto, strings, "right")
            return key[who], start[who] + strings - (upto - runs)[who]

        def by_place(own: np.ndarray) -> np.ndarray:
            k, place = of(own)
            return own[np.lexsort((k, place, ids[np.searchsorted(upto, own, "right")]))]

        # Texts under one id: contexts overlap, so that their strings are put in order one by one.
        shared = ((ids[1:] == ids[:-1]) & (key[1:] != key[:-1])).any()
        origin = origins(name, by_place if shared else None)
        if not equal_strings(data, spot, origin, length):
            # A hash names two strings: their bytes do.
            name = np.unique(np.array([data[i : i + length].tobytes().hex() for i in spot.tolist()]), return_inverse=True)[1].astype(U)
            origin = origins(name, by_place if shared else None)
        del name, spot, data
        # Runs of strings in one context whose firsts also stand in one.
        hit = origin != np.arange(len(origin))
        head = np.zeros(len(origin), bool)
        head[upto - runs] = True
        new = hit.copy()
        new[1:] &= ~hit[:-1] | (origin[1:] != origin[:-1] + 1) | head[1:] | head[origin[1:]]
        new = np.flatnonzero(new)
        if len(new):
            n = np.add.reduceat(hit, new, dtype=np.int64)
            (k, s), (k0, s0) = of(new), of(origin[new])
            # Rows that are repeated whole are one document: a string's equals with the same key and start don't count.
            use = (k != k0) | (s != s0)
            k, s, z = k[use], s[use], (s + n)[use]
            order = np.lexsort((s, k))
            k, s, z = k[order], s[order], z[order]
            apart = (k[1:] != k[:-1]) | (s[1:] != z[:-1])
            some = min(1, len(k))
            keys.append(k[np.r_[np.full(some, True), apart]])
            begins.append(s[np.r_[np.full(some, True), apart]])
            ends.append(z[np.r_[apart, np.full(some, True)]] + length - 1)
    if not keys:
        return by_key(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))
    return by_key(np.concatenate(keys), np.concatenate(begins).astype(np.int32), np.concatenate(ends).astype(np.int32))


def merged(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans, as spans that neither overlap nor touch."""
    order = np.argsort(begins, kind="stable")
    begins, reach = begins[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.r_[True, begins[1:] > reach[:-1]])
    return begins[new], reach[np.r_[new[1:], len(reach)] - 1]


def dedup_substrings(docs: DataFrame, length: int = LENGTH, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` with n_bytes, n_removed, n_spans, kept (binary, what is left) and kept_sha256."""
    buckets = buckets_for(docs, 48, BUCKET)
    docs, restored = shielded(docs, ("key", "ns", "blobs"))
    added = ("n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")
    names = [c for c in docs.columns if c not in added]
    keyed = docs.select(*[F.col(f"`{c}`") for c in names], row_key(F.col("doc_id"), F.col("text")).alias("key"))
    # What is gathered is hashed, so that joins needn't sort (and spill) the texts.
    gather = lambda df: df.groupBy("key").agg(F.collect_list("n").alias("ns"), F.collect_list("blob").alias("blobs")).hint("shuffle_hash")
    reply = "key long, n int, blob binary"
    ranks = map_texts(keyed.select("text", "key"), lambda x: rank_rows(x, buckets, length, sample), _BLOBS)
    ranks = gather(ranks.groupBy("bucket").applyInPandas(repeated_ranks, reply))
    met = keyed.join(ranks, "key", "left").select("doc_id", "text", "key", "ns", "blobs")
    spans = map_texts(met, lambda x: context_rows(x, buckets, length, sample), _BLOBS)
    spans = gather(spans.groupBy("bucket").applyInPandas(lambda x: repeated_spans(x, length), reply))
    joined = keyed.join(spans, "key", "left").drop("key")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.drop("key").schema.fields]
    schema = ", ".join([*fields, "n_bytes long", "n_removed long", "n_spans long", "kept binary", "kept_sha256 string"])

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column("text"))
            ns, blobs = b.column("ns"), b.column("blobs")
            for at, part, ends in slices(data, offsets):
                n = len(ends) - 1
                removed, spans_, kept = np.zeros(n, np.int64), np.zeros(n, np.int64), []
                for i in range(n):
                    a = z = np.zeros(0, np.int64)
                    if ns[at + i].is_valid:
                        got = [unpack(x, m, "int32", "int32") for m, x in zip(ns[at + i].as_py(), blobs[at + i].as_py(), strict=True)]
                        a, z = merged(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))
                    removed[i], spans_[i] = (z - a).sum(), len(a)
                    kept.append(without(part[ends[i] : ends[i + 1]], a, z))
                rest = b.slice(at, n)
                sha = pa.array([hashlib.sha256(x).hexdigest() for x in kept])
                yield pa.RecordBatch.from_arrays([*[rest.column(c) for c in names], pa.array(np.diff(ends)), pa.array(removed), pa.array(spans_), pa.array(kept, pa.binary()), sha], names=[*names, *added])

    return restored(map_texts(joined, cleaned, schema))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
