"""Language-model scoring by a weighted backoff automaton.

The model is an absolute-discounted bigram model that backs off to add-one
unigrams, all counts taken from every training row. Its states are the root
and one state for each word; a state has an arc for each successor seen
``LEAST`` times and a failure arc, weighted by the mass that its arcs leave, to
the root, whose arcs are the unigrams. One left-to-right traversal carries the
state and adds the arcs' log10 probabilities, so that every state's arcs and
failure arc sum to one over the vocabulary and one unknown word.

All arcs are kept at any size, in two tables: the counts of words and the
counts of bigrams. What every worker holds of them is a cache that follows from
shares: words with at least N / ROOT_ARCS of N training tokens, their failure
arcs, and bigrams with at least N / STATE_ARCS. By the pigeonhole principle
there are at most as many, so the broadcast is bounded. The rest meets the
tables in joins, summed by text: rare words on the word's hash, and the pairs
whose arc no worker can know of on the state's hash. The pairs of a state with
at least N / HOT are dealt by both words, so that no bucket holds them all.

Words are known by 64-bit hashes of their lower-cased (A-Z) bytes. The last
token of a text, its end, is also the state in which each text begins.

Edge cases: a null or empty text is an end alone; without training rows N and
V are 0, and every token scores log10(1 / (N + V + 1)) = 0; a null id counts
as the text ''; rows repeated with one id and text are scored alike; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_runs, buckets_for, delta, map_texts, pack, row_key, slim, stored, table, unpack
from .vec import STEP, Words, mix, slices, utf8

U = np.uint64
ROOT_ARCS = 1 << 20
STATE_ARCS = 1 << 20
HOT = 1 << 10
#: A bigram seen so often is an arc.
LEAST = 2
FLUSH = 1 << 20
COPIES = 1 << 16
DISCOUNT = 0.5
#: Input that a bucket is meant for.
BUCKET = 32 << 20
#: Stands for the end of a text among the words' hashes.
END = 7


def token_runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, token hashes with each row's end, their rows, their lengths in bytes)."""
    data, offsets = utf8(column)
    for at, part, ends in slices(data, offsets):
        n, words = len(ends) - 1, Words(part, ends)
        per = np.bincount(words.row, minlength=n)
        hashes = np.full(len(words.hash) + n, END, np.int64)
        hashes[np.arange(len(words.hash)) + words.row] = words.hash.view(np.int64)
        yield at, n, hashes, np.repeat(np.arange(n), per + 1), per + 1


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(keys, return_counts=True)
    found, back = np.unique(keys, return_inverse=True)
    return found, np.bincount(back, counts, len(found)).astype(np.int64)


class Tally:
    """Counts by key that are merged as they come and given out when many."""

    def __init__(self, most: int = 2_000_000):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.most = 0, most

    def add(self, keys: np.ndarray) -> bool:
        self.parts.append(summed(keys))
        self.size += len(self.parts[-1][0])
        return self.size >= self.most

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = summed(np.concatenate([x[0] for x in self.parts]), np.concatenate([x[1] for x in self.parts])) if self.parts else (np.zeros(0, np.int64),) * 2
        self.parts, self.size = [], 0
        return out


def unigrams(training: DataFrame) -> DataFrame:
    """word (hash) and n (count) over all tokens of ``training``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(x) for x in tally.take()], names=["word", "n"])
        for b in batches:
            for _, _, hashes, _, _ in token_runs(b.column("text")):
                if tally.add(hashes) and len(tally.parts) > 1:
                    yield give()
        yield give()

    return map_texts(training.select("text"), count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One hash of two words in order."""
    return mix(mix(first.view(U)) * STEP[0] + second.view(U) * STEP[1])


def before(hashes: np.ndarray) -> np.ndarray:
    """The token before each; a text's first comes after the end of the one before."""
    return np.r_[np.int64(END), hashes[:-1]]


def planes(a: np.ndarray) -> bytes:
    """An array's bytes, plane by plane, so that high bytes that are all alike pack away."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def from_planes(raw: bytes, n: int, kind: type, at: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, width * n, at).reshape(width, n).T).view(kind).ravel()


def pack_named(lead: np.ndarray | None, *columns: np.ndarray) -> bytes:
    """int64 columns, each as its distinct values and the rows' places among them; ``lead`` is sorted and goes as differences."""
    sizes, parts = [len(columns[0]) if columns else len(lead)], [] if lead is None else [planes(delta(lead))]
    for c in columns:
        names, at = np.unique(c, return_inverse=True)
        sizes.append(len(names))
        parts += [names.tobytes(), planes(at.astype(np.int32))]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.array(sizes, np.int64).tobytes(), *parts]))


def unpack_named(blob: bytes, columns: int, lead: bool = False) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 8 * (columns + 1)
    n, *sizes = np.frombuffer(raw, np.int64, columns + 1).tolist()
    if lead:
        out.append(np.cumsum(from_planes(raw, n, np.int64, at)))
        at += 8 * n
    for size in sizes:
        names = np.frombuffer(raw, np.int64, size, at)
        out.append(names[from_planes(raw, n, np.int32, at + 8 * size)])
        at += 8 * size + 4 * n
    return out


def in_buckets(bucket: np.ndarray, *columns: np.ndarray) -> tuple:
    """The columns in the order of their buckets, otherwise as they came, and the buckets' runs."""
    order = np.argsort(bucket, kind="stable")
    return *[c[order] for c in columns], bucket_runs(bucket[order])


class Automaton:
    """Arcs of the root and the cached arcs of the frequent words' states, as sorted arrays."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order].astype(np.int64)
        self.log_all = float(np.log10(total + distinct + 1)) if total else 0.0
        self.total, self.distinct = total, distinct
        self.root = np.log10(self.counts + 1) - self.log_all
        self.hot = self.counts * HOT >= max(total, 1)
        #: Places by falling count, and each place's rank: codes of pairs of frequent words are small for common pairs.
        self.by_rank = np.argsort(-self.counts, kind="stable")
        self.rank = np.empty(len(self.words), np.int64)
        self.rank[self.by_rank] = np.arange(len(self.words))
        self.arcs, self.arc_logs = np.zeros(0, np.int64), np.zeros(0)
        self.fail = np.zeros(len(self.words))
        #: States all of whose arcs are cached.
        self.whole = np.ones(len(self.words), bool)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each token among the frequent words, or -1."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)

    def codes(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """One number for each pair of places, or -1 where a word is not frequent."""
        both = (first >= 0) & (second >= 0)
        out = np.full(len(first), -1)
        out[both] = self.rank[first[both]] * np.int64(len(self.words)) + self.rank[second[both]]
        return out

    def places(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.by_rank[codes // len(self.words)], self.by_rank[codes % len(self.words)]

    def before(self, numbers: np.ndarray) -> np.ndarray:
        """The place of the token before each; a text's first comes after an end."""
        return np.r_[self.number(np.array([END])), numbers[:-1]]

    def dealt(self, first: np.ndarray, second: np.ndarray, buckets: int) -> np.ndarray:
        """The bucket of each pair: by its state, and by its word too where the state is hot."""
        out = first.view(U) >> U(33)
        if len(self.words):
            state = self.number(first)
            out = out + np.where((state >= 0) & self.hot[state], second.view(U) >> U(33), U(0))
        return (out % U(buckets)).astype(np.int64)

    def with_arcs(self, pairs: np.ndarray, counts: np.ndarray, discount: float = DISCOUNT) -> None:
        order = np.argsort(pairs)
        self.arcs, seen = pairs[order], counts[order]
        src, dst = self.arcs // max(len(self.words), 1), self.arcs % max(len(self.words), 1)
        p = (seen - discount) / self.counts[src]
        self.arc_logs = np.log10(p)
        mass = np.bincount(src, p, len(self.words)) if len(src) else np.zeros(len(self.words))
        below = np.bincount(src, 10 ** self.root[dst], len(self.words)) if len(src) else np.zeros(len(self.words))
        self.fail = np.log10(np.maximum(1 - mass, 1e-12) / np.maximum(1 - below, 1e-12))

    def with_states(self, words: np.ndarray, fail: np.ndarray, whole: np.ndarray) -> None:
        """Failure arcs of states, over all arcs they have in the table."""
        at = self.number(words)
        self.fail[at], self.whole[at] = fail, whole

    def traverse(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(what each token's cached arc or failure arc adds to its root arc, from left to right; number of each token; whether the table may hold an arc for it)."""
        numbers = self.number(hashes)
        prev = self.before(numbers)
        add, open_ = np.zeros(len(hashes)), np.ones(len(hashes), bool)
        stays = prev >= 0
        add[stays] = self.fail[prev[stays]]
        open_[stays] = ~self.whole[prev[stays]]
        if len(self.arcs):
            code = np.where(stays & (numbers >= 0), prev * np.int64(len(self.words)) + numbers, -1)
            at = np.minimum(np.searchsorted(self.arcs, code), len(self.arcs) - 1)
            hit = self.arcs[at] == code
            add[hit] = self.arc_logs[at[hit]] - self.root[numbers[hit]]
            open_[hit] = False
        return add, numbers, open_


def bigrams(training: DataFrame, model: Automaton, buckets: int) -> DataFrame:
    """bucket, first, second (hashes), n, n_first and n_second (-1: unknown) of every pair of neighbouring tokens seen ``LEAST`` times.

    Pairs of frequent words travel as codes, others as hashes. A state's pairs share a
    bucket, so their sum is the state's count, but for hot ones, whose counts every worker holds.
    """
    shared = training.sparkSession.sparkContext.broadcast(model)
    finer = 4 * buckets

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held, size = shared.value, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            second = np.concatenate(held)
            held.clear()
            # The last token of a run is an end, after which the next run's first comes as well.
            to, first = model.number(second), before(second)
            code = model.codes(model.before(to), to)
            rows, named = [], code < 0
            codes, n = np.unique(code[~named], return_counts=True)
            if len(codes):
                at = model.places(codes)
                codes, n, runs = in_buckets(model.dealt(model.words[at[0]], model.words[at[1]], finer), codes, n)
                rows += [(b, True, pack_named(codes[i:j], n[i:j])) for b, i, j in runs]
            first, second = first[named], second[named]
            at, n = np.unique(pair_hash(first, second), return_index=True, return_counts=True)[1:]
            first, second = first[at], second[at]
            first, second, n, runs = in_buckets(model.dealt(first, second, finer), first, second, n)
            rows += [(b, False, pack_named(None, first[i:j], second[i:j], n[i:j])) for b, i, j in runs]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int32(), pa.bool_(), pa.binary()))], names=["bucket", "coded", "blob"])

        for b in batches:
            for _, _, hashes, _, _ in token_runs(b.column("text")):
                held.append(hashes)
                size += len(hashes)
                if size >= 2 * FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()
        slim()

    def total(blobs: pd.DataFrame) -> pd.DataFrame:
        model, out = shared.value, []
        coded = [unpack_named(x, 1, True) for x in blobs.loc[blobs["coded"], "blob"]]
        if coded:
            codes, back = np.unique(np.concatenate([x[0] for x in coded]), return_inverse=True)
            n = np.bincount(back, np.concatenate([x[1] for x in coded]), len(codes)).astype(np.int64)
            codes, n = codes[n >= LEAST], n[n >= LEAST]
            first, second = model.places(codes)
            out.append((model.words[first], model.words[second], n, model.counts[first], model.counts[second]))
        named = [unpack_named(x, 3) for x in blobs.loc[~blobs["coded"], "blob"]]
        if named:
            first, second, n = (np.concatenate(x) for x in zip(*named, strict=True))
            at, back = np.unique(pair_hash(first, second), return_index=True, return_inverse=True)[1:]
            n, first, second = np.bincount(back, n, len(at)).astype(np.int64), first[at], second[at]
            state = np.unique(first, return_inverse=True)[1]
            n_first = np.bincount(state, n).astype(np.int64)[state]
            if len(model.words):
                place = model.number(first)
                n_first = np.where(place >= 0, model.counts[place], n_first)
            use = n >= LEAST
            first, second, n, n_first = first[use], second[use], n[use], n_first[use]
            place = model.number(second)
            out.append((first, second, n, n_first, np.where(place >= 0, model.counts[place], -1) if len(model.words) else np.full(len(n), -1)))
        first, second, n, n_first, n_second = (np.concatenate(x) for x in zip(*out, strict=True))
        out = pd.DataFrame({"bucket": np.full(len(n), blobs["bucket"].iat[0] % buckets, np.int32), "first": first, "second": second, "n": n, "n_first": n_first, "n_second": n_second})
        slim()
        return out

    found = map_texts(training.select("text"), count, "bucket int, coded boolean, blob binary")
    return found.groupBy("bucket").applyInPandas(total, "bucket int, first long, second long, n long, n_first long, n_second long")


def build(training: DataFrame, counts: DataFrame, buckets: int) -> tuple[Automaton, DataFrame]:
    """The part of the automaton that every worker holds; and what buckets hold: bucket, kind (arc, failure arc, rare word), first, second, value."""
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = int(sums["n"]), int(sums["v"])
    often = counts.filter(F.col("n") * ROOT_ARCS >= total).toPandas()
    out = Automaton(often["word"].to_numpy(np.int64), often["n"].to_numpy(np.int64), total, distinct)
    found = bigrams(training, out, buckets)
    # A word of an arc is seen as often as the arc at least.
    named = counts.filter((F.col("n") >= LEAST) & (F.col("n") * ROOT_ARCS < total)).select(F.col("word").alias("second"), F.col("n").alias("n_named"))
    open_ = found.filter("n_second < 0").join(named, "second")
    arcs = stored(found.filter("n_second >= 0").unionByName(open_.select("bucket", "first", "second", "n", "n_first", F.col("n_named").alias("n_second"))))
    p, below = (F.col("n") - DISCOUNT) / F.col("n_first"), (F.col("n_second") + 1) / F.lit(float(total + distinct + 1))
    left = lambda x: F.greatest(1 - F.sum(x), F.lit(1e-12))
    cached = F.col("n") * STATE_ARCS >= total
    states = arcs.groupBy("first").agg(F.first("n_first").alias("n_first"), F.log10(left(p) / left(below)).alias("fail"), F.min(cached).alias("whole"))
    states = stored(states)
    held = arcs.filter(cached).select("first", "second", "n").toPandas()
    code = out.number(held["first"].to_numpy(np.int64)) * np.int64(len(out.words)) + out.number(held["second"].to_numpy(np.int64))
    out.with_arcs(code, held["n"].to_numpy(np.int64))
    frequent = F.col("n_first") * ROOT_ARCS >= total
    held = states.filter(frequent).toPandas()
    out.fail[:] = 0
    out.with_states(held["first"].to_numpy(np.int64), held["fail"].to_numpy(float), held["whole"].to_numpy(bool))
    bucket = lambda c: F.pmod(F.shiftrightunsigned(c, 33), F.lit(buckets)).cast("int").alias("bucket")
    none, kind = F.lit(0).cast("long").alias("second"), lambda k: F.lit(k).cast("byte").alias("kind")
    table_ = arcs.select("bucket", kind(ARC), "first", "second", F.log10(p / below).alias("value"))
    table_ = table_.unionAll(states.filter(~frequent).select(bucket("first"), kind(FAIL), "first", none, F.col("fail").alias("value")))
    rare = counts.filter(F.col("n") * ROOT_ARCS < total)
    return out, table_.unionAll(rare.select(bucket("word"), kind(WORD), F.col("word").alias("first"), none, F.col("n").cast("double").alias("value")))


#: Kinds of rows of the buckets' table.
ARC, FAIL, WORD = 0, 1, 2
_TEXT = ("int64", "int64", "int64", "int64", "float64", "float64", "bool")


def walk(model: Automaton, batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Blobs for the buckets: of each flush its texts with what the held arcs give (texts > 0), and for each bucket what no worker can settle alone.

    The latter: the keys of the texts concerned, then open pairs of frequent words (codes), open pairs with a frequent state
    (hashes), other open pairs (state, hash) and rare words, all with their text's number.
    """
    texts, open_, size, many = [], [], 0, 0

    def flush() -> Iterator[pa.RecordBatch]:
        if not texts:
            return
        ids, keys, n, known, base, weight, valid = (np.concatenate(x) for x in zip(*texts, strict=True))
        rows = [(int(keys[:1].view(U)[0] >> U(33)) % buckets, len(keys), pack(ids, keys, n, known, base, weight, valid))]
        first, second, code, half, text, word, whose = (np.concatenate(x) for x in zip(*open_, strict=True))
        texts.clear()
        open_.clear()
        bucket = model.dealt(first, second, buckets)
        name = np.where(code >= 0, code, pair_hash(first, second).view(np.int64))
        parts: list[dict[int, tuple]] = []
        for k in range(3):
            some = np.flatnonzero((code >= 0) if k == 0 else (code < 0) & (half == (k == 1)))
            some = some[np.argsort(name[some])]
            a, t, f, runs = in_buckets(bucket[some], name[some], text[some], first[some])
            parts.append({b: (a[i:j], t[i:j], f[i:j]) for b, i, j in runs})
        order = np.argsort(word)
        a, t, runs = in_buckets(((word[order].view(U) >> U(33)) % U(buckets)).astype(np.int64), word[order], whose[order])
        parts.append({b: (a[i:j], t[i:j]) for b, i, j in runs})
        for b in sorted(set().union(*parts)):
            held = [p.get(b) for p in parts]
            use = np.zeros(len(keys), bool)
            for x in held:
                if x is not None:
                    use[x[1]] = True
            place = np.cumsum(use) - 1
            raw = [np.array([use.sum(), *[0 if x is None else len(x[0]) for x in held]], np.int64).tobytes(), keys[use].tobytes()]
            for k, x in enumerate(held):
                if x is not None:
                    raw += [planes(delta(x[0])), planes(place[x[1]].astype(np.int32))] + ([x[2].tobytes()] if k == 2 else [])
            rows.append((b, 0, zstandard.ZstdCompressor(level=1).compress(b"".join(raw))))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "texts", "blob"])

    for b in batches:
        ids = b.column("doc_id").cast(pa.int64())
        valid, ids, keys = np.asarray(ids.is_valid()), ids.fill_null(0).to_numpy(), b.column("key").to_numpy()
        for at, n, hashes, row, lengths in token_runs(b.column("text")):
            add, numbers, more = model.traverse(hashes)
            held = numbers >= 0
            base = np.where(held, model.root[numbers] if len(model.words) else 0.0, 0.0)
            known, base, weight = (np.bincount(row, w, n) for w in (held.astype(float), base, base + add))
            own = slice(at, at + n)
            texts.append((ids[own], keys[own], lengths.astype(np.int64), known.astype(np.int64), base, weight, valid[own]))
            state = model.before(numbers)[more]
            open_.append((before(hashes)[more], hashes[more], model.codes(state, numbers[more]), state >= 0, row[more] + many, hashes[~held], row[~held] + many))
            many += n
            size += len(open_[-1][0]) + len(open_[-1][5])
            if size >= FLUSH or many >= FLUSH:
                yield from flush()
                size = many = 0
    yield from flush()
    slim()


def unwalked(blob: bytes) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """(keys of texts, and of each kind: names, texts' numbers and, of pairs with a rare state, the states)."""
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 40, []
    texts, *sizes = np.frombuffer(raw, np.int64, 5).tolist()
    keys = np.frombuffer(raw, np.int64, texts, at)
    at += 8 * texts
    for k, n in enumerate(sizes):
        x = [np.cumsum(from_planes(raw, n, np.int64, at)), from_planes(raw, n, np.int32, at + 8 * n)]
        at += 12 * n
        if k == 2:
            x.append(np.frombuffer(raw, np.int64, n, at))
            at += 8 * n
        out.append(tuple(x))
    return keys, out


def look(names: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each name is there, its value or 0); ``names`` are sorted."""
    if not len(names):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    hit = names[at] == wanted
    return hit, np.where(hit, values[at], 0.0)


_REPLY = "key long, doc_id long, copies long, n long, known long, base double, score double"


def settled(model: Automaton, blobs: pd.DataFrame, table_: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket, by text: what its rare tokens and open pairs add; and the texts' own rows that came along (copies = 1)."""
    kind, first, value = table_["kind"].to_numpy(), table_["first"].to_numpy(np.int64), table_["value"].to_numpy(float)
    arc = kind == ARC
    names = np.where(arc, pair_hash(first, table_["second"].to_numpy(np.int64)).view(np.int64), first)
    if len(model.words):
        # A frequent state's failure arc has been added in the traversal; its arcs take its place.
        state = model.number(first[arc])
        value[arc] -= np.where(state >= 0, model.fail[state], 0.0)
    held = []
    for k in (ARC, FAIL, WORD):
        name, weight = names[kind == k], value[kind == k]
        order = np.argsort(name)
        held.append((name[order], weight[order]))
    arcs, fails, words = held
    out = []
    for texts, blob in zip(blobs["texts"], blobs["blob"], strict=True):
        if texts:
            ids, keys, n, known, base, score_, valid = unpack(blob, texts, *_TEXT)
            out.append((keys, ids, valid, np.ones(texts, np.int64), n, known, base, score_))
            continue
        keys, (coded, half, named, rare) = unwalked(blob)
        add = np.zeros(len(keys))
        if len(coded[0]):
            a, b = model.places(coded[0])
            add += np.bincount(coded[1], look(*arcs, pair_hash(model.words[a], model.words[b]).view(np.int64))[1], len(keys))
        add += np.bincount(half[1], look(*arcs, half[0])[1], len(keys))
        hit, value = look(*arcs, named[0])
        add += np.bincount(named[1], np.where(hit, value, look(*fails, named[2])[1]), len(keys))
        seen = look(*words, rare[0])[1]
        more = np.bincount(rare[1], np.log10(seen + 1) - model.log_all, len(keys))
        none = np.zeros(len(keys), np.int64)
        out.append((keys, none, none.astype(bool), none, none, np.bincount(rare[1], seen > 0, len(keys)).astype(np.int64), more, more + add))
    keys, ids, valid, copies, n, known, base, score_ = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 6 + (np.zeros(0),) * 2
    reply = pd.DataFrame({"key": keys, "doc_id": pd.array(ids, "Int64"), "copies": copies, "n": n, "known": known, "base": base, "score": score_})
    reply.loc[~valid.astype(bool), "doc_id"] = pd.NA
    slim()
    return reply


def score(docs: DataFrame, training: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``; both have doc_id and text.

    Rare words and open pairs meet the counts' and the arcs' tables bucket by
    bucket, and are summed by text. Equal rows share a key: they are summed as
    one, divided by how many they are and given out as often.
    """
    spark = docs.sparkSession
    buckets = buckets_for(docs, 32, BUCKET)
    counts = stored(unigrams(training))
    model, table_ = build(training, counts, buckets)
    shared = spark.sparkContext.broadcast(model)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key(F.col("doc_id"), F.col("text")).alias("key"))
    blobs = map_texts(keyed, lambda x: walk(shared.value, x, buckets), "bucket int, texts int, blob binary")
    found = blobs.groupBy("bucket").cogroup(table_.groupBy("bucket")).applyInPandas(lambda a, b: settled(shared.value, a, b), _REPLY)
    met = found.groupBy("key").agg(F.max("doc_id").alias("doc_id"), *[F.sum(x).alias(x) for x in ("copies", "n", "known", "base", "score")])
    # Equal rows are counted out in runs, so that no array holds a large group.
    met = met.withColumn("from", F.explode(F.expr(f"sequence(1L, copies, {COPIES}L)")))
    met = met.withColumn("copy", F.explode(F.expr(f"sequence(from, least(copies, from + {COPIES - 1}L))")))
    return met.select(
        "doc_id",
        F.expr("n div copies").alias("n_tokens"),
        F.expr("known div copies").alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies")).alias("base_score"),
        (F.col("score") / F.col("copies")).alias("score"),
    )


def op5_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    out = score(docs, docs.filter(~fold))
    return out.select("doc_id", fold.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
