"""Phrase collocation mining: sketch bounds, guarded automata, exact counts.

A count-min sketch of words and pairs of words is built over all texts; its
estimates are upper bounds, so that a pair whose bound stays below ``least``
is in no candidate. Every place of a text where pairs in a row pass is a
fragment: the words from there on, five at most, as far as pairs pass. Equal
fragments of a flush are one with a number; fragments go to the shard of their
first two words, words to the shard of the word.

A shard thus holds every occurrence of its phrases. A sketch of its own, of the
beginnings of its fragments, bounds their counts; those that reach ``least``
compile into a pyahocorasick automaton, guarded by a delimiter before the first
and one behind each word, and all fragments of the shard are scanned. Matches
overlap: a fragment counts for each of its beginnings. Sums are exact, whatever
the bounds; loose ones only cost time. Shards grow in number with the input.

Counts of phrases and of their parts then meet in joins; scores are exact in
decimals of 38 digits.

Edge cases: a null text is empty, a null language ``und``; an empty text, or
one of delimiters, has no piece; a piece has no limit, a word neither; rows that
repeat count again; cuts with equal scores after rounding give the shorter first
part, equal phrases cannot occur twice; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftgrain.session import spread

from .common import buckets_for, cut, delta, map_texts, sized_join, stored, table
from .vec import LOWER, U, Words, mix, slices, utf8

ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
#: Counters of each of a sketch's two rows: one for so many bytes of input, 2**16 to 2**24 (of a byte each while ``least`` is
#: under 256, so that 32 MB are broadcast at most). Beyond, bounds are looser, and more pairs travel than need to.
SKETCH_INPUT = 64
SKETCH_BITS = (16, 24)
SKETCH_BLOCK = 1 << 16
#: Parts of a block of counters that one task sums up.
MERGE = 64
#: Fragments that a flush holds.
FLUSH = 1_000_000
#: Shards of a bucket's bytes of input (256 MB), and shards at least.
BUCKET_SHARDS = 16
LEAST_SHARDS = 24
#: Rows that one task ranks, or so.
ROUND = 50_000
#: A second, independent place in the sketch.
OTHER = U(0xD1B54A32D192ED03)


def language_key(lang: str) -> np.uint64:
    return U(int.from_bytes(blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))


class Sketch:
    """Two rows of counters; estimates are never below the count, but counters stop at ``most``."""

    def __init__(self, bits: int, most: int, rows: np.ndarray | None = None):
        self.bits, self.most, self.added = bits, most, 0
        self.rows = np.zeros((2, 1 << bits), np.int32 if most < 2**30 else np.int64) if rows is None else rows

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shift = U(64 - self.bits)
        return (h >> shift).astype(np.int64), (mix(h ^ OTHER) >> shift).astype(np.int64)

    def add(self, h: np.ndarray, counts: np.ndarray | None = None) -> None:
        n = np.ones(1, self.rows.dtype) if counts is None else np.minimum(counts, self.most).astype(self.rows.dtype)
        self.added += len(h) if counts is None else int(n.sum(dtype=np.int64))
        if self.added >= 2**30:
            self.stop()
            self.added = len(h) * self.most
        for row, at in zip(self.rows, self.places(h), strict=True):
            np.add.at(row, at, n[0] if counts is None else n)

    def stop(self) -> None:
        np.minimum(self.rows, self.most, out=self.rows)

    def passes(self, h: np.ndarray) -> np.ndarray:
        """Whether an estimate reaches ``most``."""
        one, two = self.places(h)
        return (self.rows[0][one] >= self.most) & (self.rows[1][two] >= self.most)


class Pieces:
    """Words of one language's texts: ``meets`` says where the next word lies in the same piece, ``pair`` hashes the two."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, key: np.uint64):
        data = LOWER[data]
        ends = ENDS[data]
        before = np.zeros(len(data) + 1, np.int64)
        np.cumsum(ends, out=before[1:])
        data[ends] = 0x20
        self.words = w = Words(data, offsets, lower=False)
        self.joined = None
        n = len(w.hash)
        self.meets = np.zeros(n, bool)
        if n > 1:
            self.meets[:-1] = (w.row[1:] == w.row[:-1]) & (before[w.start[1:]] == before[w.start[:-1]])
        self.word = mix(w.hash + key)
        self.pair = np.zeros(n, np.uint64)
        if n > 1:
            self.pair[:-1] = mix(self.word[:-1] * U(3) + (self.word[1:] ^ (self.word[1:] >> U(31))))

    def lengths(self, alive: np.ndarray, longest: int) -> np.ndarray:
        """Words of the fragment at each word: pairs in a row that are alive, and one; 1 where none is."""
        out, on = np.ones(len(alive), np.int64), np.ones(len(alive), bool)
        for j in range(longest - 1):
            on[: len(on) - j] &= alive[j:]
            on[max(len(on) - j, 0) :] = False
            out += on
        return out

    def hashes(self, lengths: np.ndarray, longest: int) -> np.ndarray:
        """One for the words of each fragment; only those of equal words are equal, but for collisions of 64 bits."""
        out = mix(self.word + lengths.astype(np.uint64))
        n = len(out)
        for j in range(1, longest):
            more = np.flatnonzero(lengths[: max(n - j, 0)] > j)
            out[more] = mix(out[more] * U(5) + self.word[more + j])
        return out

    def texts(self, first: np.ndarray, lengths: np.ndarray) -> pa.Array:
        """Words of each fragment, a blank between them."""
        if self.joined is None:
            w = self.words
            size = w.end - w.start + 1
            self.ends = np.cumsum(size)
            at = np.repeat(w.start - self.ends + size, size) + np.arange(self.ends[-1] if len(size) else 0)
            self.joined = w.data[np.minimum(at, len(w.data) - 1)]
            self.joined[self.ends - 1] = 0x20
            self.begin = self.ends - size
        return gathered(self.joined, self.begin[first], self.ends[first + lengths - 1] - 1 - self.begin[first])


def gathered(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """Slices of ``data`` as an array of texts."""
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    at = np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))])


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    """Texts of a batch (text, lang) by language."""
    langs = batch.column(1).fill_null("und").dictionary_encode()
    codes = langs.indices.to_numpy(zero_copy_only=False)
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        yield lang, batch.column(0).filter(pa.array(codes == i))


def input_bytes(docs: DataFrame) -> int:
    return int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


SKETCH_SCHEMA = "part int, block int, lang string, n long, counters binary"


def sketch_of(docs: DataFrame, least: int) -> tuple[Sketch, DataFrame]:
    """The sketch of words and pairs, and lang and n, each language's words; docs: text, lang."""
    bits = min(max((input_bytes(docs) // SKETCH_INPUT).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])
    press, open_ = (lambda a: zstandard.ZstdCompressor(level=1).compress(a.tobytes())), (lambda b: zstandard.ZstdDecompressor().decompress(b))
    small = np.uint8 if least < 2**8 else np.uint32 if least < 2**32 else np.uint64

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, words = Sketch(bits, least), {}
        for b in batches:
            for lang, texts in by_language(b):
                key = language_key(lang)
                for _, data, offsets in slices(*utf8(texts)):
                    p = Pieces(data, offsets, key)
                    words[lang] = words.get(lang, 0) + len(p.word)
                    sketch.add(p.word)
                    sketch.add(p.pair[p.meets])
        sketch.stop()
        part = TaskContext.get().partitionId()
        rows = [(part, -1, lang, n, None) for lang, n in words.items()]
        flat = sketch.rows.reshape(-1, SKETCH_BLOCK)
        rows += [(part, i, None, 0, press(flat[i].astype(small))) for i in np.flatnonzero(flat.any(axis=1)).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.binary()), strict=True)] if rows else [pa.array([], t) for t in (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.binary())], ["part", "block", "lang", "n", "counters"])

    def merged(key: tuple, parts: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH_BLOCK, np.int64)
        for blob in parts.column("counters"):
            total += np.frombuffer(open_(blob.as_py()), small).astype(np.int64)
        blob = press(np.minimum(total, least).astype(small))
        return pa.table({"part": pa.array([key[1].as_py()], pa.int32()), "block": pa.array([key[0].as_py()], pa.int32()), "counters": [blob]})

    parts = stored(map_texts(docs, build, SKETCH_SCHEMA))
    words = cut(parts.filter("block = -1").groupBy("lang").agg(F.sum("n").alias("n")))
    blocks, tasks = parts.filter("block >= 0").select("part", "block", "counters"), docs.rdd.getNumPartitions()
    while tasks > 0:  # so that no task meets more than MERGE parts of a block
        tasks = tasks // MERGE
        blocks = blocks.withColumn("part", F.expr(f"cast(part div {MERGE} as int)")).groupBy("block", "part").applyInArrow(merged, "part int, block int, counters binary")
    rows = np.zeros(((2 << bits) // SKETCH_BLOCK, SKETCH_BLOCK), small)
    for r in blocks.collect():
        rows[r.block] = np.frombuffer(open_(r.counters), small)
    return Sketch(bits, least, rows.reshape(2, -1)), words


class Pile:
    """Fragments of one language until a flush: equal ones of a slice, and then of the flush, are one."""

    def __init__(self):
        self.hash, self.first, self.count, self.text, self.n = [], [], [], [], 0

    def add(self, p: Pieces, at: np.ndarray, lengths: np.ndarray, h: np.ndarray, first: np.ndarray) -> None:
        _, index, count = np.unique(h, return_index=True, return_counts=True)
        self.hash.append(h[index])
        self.first.append(first[index])
        self.count.append(count)
        self.text.append(p.texts(at[index], lengths[index]))
        self.n += len(index)

    def shards(self, lang: str, shards: int) -> Iterator[dict]:
        """A row for each shard: fragments in the order of their hashes."""
        h, first, count = (np.concatenate(x) for x in (self.hash, self.first, self.count))
        text = pa.concat_arrays(self.text)
        order = np.argsort(h, kind="stable")
        index = order[np.flatnonzero(np.r_[True, np.diff(h[order]) != 0])]
        total = np.add.reduceat(count[order], np.flatnonzero(np.r_[True, np.diff(h[order]) != 0]))
        shard = (first[index] % U(shards)).astype(np.int64)
        by = np.argsort(shard, kind="stable")
        edge = np.flatnonzero(np.r_[True, np.diff(shard[by]) != 0, True])
        press = zstandard.ZstdCompressor(level=3)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            rows = by[a:b]
            part = text.take(pa.array(index[rows]))
            offsets = np.frombuffer(part.buffers()[1], np.int64, len(part) + 1, part.offset * 8)
            body = part.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else b""
            raw = total[rows].astype(np.int64).tobytes() + delta(offsets - offsets[0]).tobytes() + body
            yield {"shard": int(shard[rows[0]]), "lang": lang, "n": len(rows), "blob": press.compress(raw)}


SHARD_SCHEMA = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("n", pa.int64()), ("blob", pa.binary())])


def opened(parts: list[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers, bytes and offsets of fragments, some at a time."""
    for n, blob in parts:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        count, offsets = np.frombuffer(raw, np.int64, n), np.cumsum(np.frombuffer(raw, np.int64, n + 1, 8 * n))
        for at, data, some in slices(np.frombuffer(raw, np.uint8, int(offsets[-1]), 8 * (2 * n + 1)), offsets):
            yield count[at : at + len(some) - 1], data, some


def fragments(docs: DataFrame, sketch: Sketch, longest: int, shards: int) -> DataFrame:
    """shard, lang, n and blob: fragments of two words or more by their first two, words by themselves; docs: text, lang."""
    sent = docs.sparkSession.sparkContext.broadcast((sketch.bits, sketch.most, sketch.rows))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Sketch(*sent.value)
        piles: dict[str, Pile] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, pile in piles.items():
                if pile.n:
                    yield pa.RecordBatch.from_pylist(list(pile.shards(lang, shards)), SHARD_SCHEMA)
            piles.clear()

        for b in batches:
            for lang, texts in by_language(b):
                key = language_key(lang)
                for _, data, offsets in slices(*utf8(texts)):
                    p = Pieces(data, offsets, key)
                    alive = p.meets.copy()
                    alive[alive] = known.passes(p.pair[alive])
                    lengths = p.lengths(alive, longest)
                    pile = piles.setdefault(lang, Pile())
                    at = np.flatnonzero(lengths > 1)
                    if len(at):
                        pile.add(p, at, lengths[at], p.hashes(lengths, longest)[at], p.pair[at])
                    single = np.flatnonzero(known.passes(p.word))
                    if len(single):
                        pile.add(p, single, np.ones(len(single), np.int64), p.word[single], p.word[single])
            if sum(x.n for x in piles.values()) >= FLUSH:
                yield from flush()
        yield from flush()

    return map_texts(docs, deal, "shard int, lang string, n long, blob binary")


def beginnings(data: np.ndarray, offsets: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each number of words: rows that begin with so many, the hash of these words and the byte behind them. One word counts only where it is all."""
    w = Words(data, offsets, lower=False)
    n_words = np.bincount(w.row, minlength=len(offsets) - 1)
    first = np.cumsum(n_words) - n_words
    h = mix(w.hash[first] + U(1)) if len(first) else w.hash
    for k in range(1, longest + 1):
        rows = np.flatnonzero(n_words == 1 if k == 1 else n_words >= k)
        if k > 1:
            h = h.copy()
            h[rows] = mix(h[rows] * U(5) + w.hash[first[rows] + k - 1])
        yield k, rows, h[rows], w.end[first[rows] + k - 1]


def shard_counts(parts: list[tuple[int, bytes]], least: int, longest: int) -> tuple[list[str], np.ndarray]:
    """Phrases of one language and shard that occur ``least`` times, and how often."""
    total = sum(n for n, _ in parts)
    sketch = Sketch(min(max((2 * total).bit_length(), 10), 22), least)
    for count, data, offsets in opened(parts):
        for _, rows, h, _ in beginnings(data, offsets, longest):
            sketch.add(h, count[rows])
    automaton, phrases = ahocorasick.Automaton(ahocorasick.STORE_INTS), []
    for count, data, offsets in opened(parts):
        raw = data.tobytes()
        for _, rows, h, end in beginnings(data, offsets, longest):
            alive = np.flatnonzero(sketch.passes(h))
            _, index = np.unique(h[alive], return_index=True)
            for i in alive[index].tolist():
                phrase = raw[offsets[rows[i]] : end[i]].decode()
                # A fragment of one word is all of it, so that its guard also ends it.
                guarded = f"\n{phrase} " if " " in phrase else f"\n{phrase} \r"
                if guarded not in automaton:
                    automaton.add_word(guarded, len(phrases))
                    phrases.append(phrase)
    counts = np.zeros(len(phrases), np.int64)
    if not phrases:
        return [], counts
    automaton.make_automaton()
    for count, data, offsets in opened(parts):
        # A line end before each fragment, a blank behind its last word, then its end.
        size = np.diff(offsets) + 3
        edge = np.cumsum(size)
        text = np.zeros(int(edge[-1]), np.uint8)
        text[np.repeat(edge - size + 1 - offsets[:-1], np.diff(offsets)) + np.arange(len(data))] = data
        text[edge - size], text[edge - 2], text[edge - 1] = 0x0A, 0x20, 0x0D
        letters = np.cumsum((text & 0xC0) != 0x80)
        found = np.array(list(automaton.iter(text.tobytes().decode())), np.int64).reshape(-1, 2)
        row = np.searchsorted(letters[edge - 1], found[:, 0], "right")
        np.add.at(counts, found[:, 1], count[row])
    kept = np.flatnonzero(counts >= least)
    return [phrases[i] for i in kept.tolist()], counts[kept]


def phrase_counts(docs: DataFrame, least: int = 100, longest: int = 5, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """lang, phrase (words, a blank between) and f of every word and phrase that occurs ``least`` times; and lang and n, each language's words."""
    docs = spread(docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")))
    sketch, words = sketch_of(docs, least)
    shards = max(LEAST_SHARDS, BUCKET_SHARDS * buckets_for(docs, 1))

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        named = key[1].as_py()
        phrases, f = shard_counts(list(zip(rows.column("n").to_pylist(), rows.column("blob").to_pylist(), strict=True)), least, longest)
        return pa.table({"lang": pa.array([named] * len(phrases), pa.string()), "phrase": pa.array(phrases, pa.string()), "f": pa.array(f, pa.int64())})

    dealt = fragments(docs, sketch, longest, shards)
    return cut(dealt.groupBy("shard", "lang").applyInArrow(count, "lang string, phrase string, f long")), words


def first_words(words: Column, n: Column | int) -> Column:
    return F.array_join(F.slice(words, 1, n), " ")


def collocations(counts: DataFrame, words: DataFrame, longest: int = 5, share: int = 100) -> DataFrame:
    """lang, phrase, a, l, r, n and score of each phrase that no longer one holds ``share`` per cent as often; counts: lang, phrase, f; words: lang, n."""
    parts = counts.withColumn("w", F.split("phrase", " "))
    phrases = parts.filter(F.size("w") > 1)
    sides = phrases.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    sides = sides.withColumns({"left": first_words(F.col("w"), F.col("k")), "right": F.array_join(F.slice("w", F.col("k") + 1, longest), " ")}).drop("w")
    sides = sides.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    sides = sides.join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    sides = sized_join(sides, words, "lang")
    score = F.expr("cast(1000 * cast(cast(a as decimal(19,0)) * cast(n as decimal(19,0)) as decimal(35,0)) as decimal(38,0)) div cast(cast(l as decimal(19,0)) * cast(r as decimal(19,0)) as decimal(38,0))")
    least = sides.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    held = phrases.filter(F.size("w") > 2).select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    scored = least.join(held, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a")))
    return scored.select("lang", "phrase", "a", F.col("s.l").alias("l"), F.col("s.r").alias("r"), "n", F.col("s.score").cast("long").alias("score"))


def best(scored: DataFrame, k: int) -> DataFrame:
    """Each language's first ``k``, with their rank. While many rows are left, they play in rounds of ``ROUND`` dealt by a hash, of which each language's first ``k`` stay."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    rows = cut(scored)
    n = rows.count()
    while n > max(ROUND, 2 * k):
        salt = F.pmod(F.xxhash64("lang", "phrase"), F.lit(math.ceil(n / max(ROUND, 2 * k))))
        place = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
        rows = cut(rows.withColumn("salt", salt).withColumn("rank", place).filter(F.col("rank") <= k).drop("salt", "rank"))
        before, n = n, rows.count()
        if n > before / 2:
            break
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, words = phrase_counts(table(spark, sf_dir, "documents"))
    return best(collocations(counts, words), 2000).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
t AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, array_to_string(ws[i:i+k-1], ' ') AS phrase, k, count(*) AS f
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 6) AS r(k) WHERE len(ws) >= k) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k > 1),
s AS (SELECT c.lang, c.phrase, j, a, x.f AS l, y.f AS r, n, (1000 * a::HUGEINT * n) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN t USING (lang)
  JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:j], ' ') JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[j+1:c.k], ' ')
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, j) = 1),
h AS (SELECT lang, array_to_string(ws[i:i+m-1], ' ') AS phrase, max(a) AS most
  FROM (SELECT lang, ws, a, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::INTEGER AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM s LEFT JOIN h USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * a
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""
