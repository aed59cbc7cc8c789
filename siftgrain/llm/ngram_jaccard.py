"""N-gram Jaccard join with token-combination prefixes.

A text is a set of word shingles. A first pass counts in how many sets of a
flush each token is; tokens that flushes find in at least one of ``SHARE`` of
their sets, and all of them together in one of ``SHARE`` of all sets, are of the
frequent class. They are at most ``SHARE`` times the mean set's size (and
``HEAVY``: a token beyond that counts as rare, which is right as well). In the
one order of all tokens rare ones come before frequent ones, then long shingles
before short ones, then hashes decide.

A set's prefix is extended until its rare tokens, plus its frequent tokens
less one, outnumber the tokens that a partner may lack; rare tokens of the
prefix are indexed singly, frequent ones by pairs. If two sets are similar,
the prefix that ends first shares a rare token or a pair of frequent ones with
the other's. Pairs grow with the square of the prefix, so sets of more than
``PAIRED`` tokens index frequent tokens singly, and sets that could be similar
to one on the other side of that size index both ways.

Equal sets are one node from the start. Nodes that share a signature are
compared by parity bitmaps, whose Hamming distance never exceeds the sets'
difference, so that texts that merely share a passage part here; those left
are linked as stars, the links' components are blocks, and each block's sets
are joined exactly: rarest tokens of the block first, prefix and length
filters, and no check within what is linked already. A block of more than
``BLOCK_SETS`` sets is dealt into chunks, every two of which meet in a task of
their own, so that no task holds a large group of near copies; the components
of what the tasks link are the block's.

Edge cases: null and empty texts, and those without words, have no shingles
and stay alone; fewer words than a shingle's width make one shingle; repeated
rows have equal sets and share a component; rows are told apart by id and text,
so rows that share an id, or have none, are nodes by their own texts; a
component without an id has none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_runs, buckets_for, cut, delta, fresh_name, map_texts, pack, row_key, sized_join, slim, table, unpack
from .components import components
from .vec import Words, mix, slices, utf8

U = np.uint64
WIDTH, PERCENT = 4, 85
SHARE = 4096
HEAVY = 1 << 18
PAIRED = 320
FLUSH = 1_000_000
BLOCK_SETS = 512
PAIR = U(0x9FB21C651E98DF25)


def needed(size: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap that a set of this size has with any similar set."""
    return (size * percent + 99) // 100


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(tokens in the one order, distinct in each row; tokens of each row)."""
    n, words = len(offsets) - 1, Words(data, offsets)
    first, hashes = words.windows(width)
    rows = words.row[first]
    length = np.r_[0, np.cumsum(words.end - words.start)]
    size = length[first + width] - length[first] if len(first) else np.zeros(0, np.int64)
    per = np.bincount(words.row, minlength=n)
    few = np.flatnonzero((per > 0) & (per < width))
    if len(few):
        begin = np.searchsorted(words.row, few)
        more = np.array([hash_of(words.hash[b : b + per[r]]) for r, b in zip(few, begin, strict=True)], U)
        hashes, rows = np.r_[hashes, more], np.r_[rows, few]
        size = np.r_[size, [length[b + per[r]] - length[b] for r, b in zip(few, begin, strict=True)]]
    tokens = ((U(255) - np.minimum(size, 255).astype(U)) << U(56)) | (hashes >> U(8))
    order = np.lexsort((tokens, rows))
    tokens, rows = tokens[order], rows[order]
    fresh = np.r_[True, (tokens[1:] != tokens[:-1]) | (rows[1:] != rows[:-1])] if len(tokens) else np.zeros(0, bool)
    return tokens[fresh], np.bincount(rows[fresh], minlength=n)


def hash_of(words: np.ndarray) -> np.uint64:
    out = np.full(1, len(words), U)
    for w in words:
        out = mix(out * PAIR + w)
    return out[0]


def nodes_of(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A set's node: a hash of its tokens and their number."""
    sums = np.r_[U(0), np.cumsum(mix(tokens ^ PAIR))]
    ends = np.cumsum(sizes)
    return mix((sums[ends] - sums[ends - sizes]) * PAIR + sizes.astype(U)).view(np.int64)


def held_by_many(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(token, sets) of every token that one of ``SHARE`` of a flush's sets has, two at least; and a flush's sets, under no token."""
    held, sets, size, seen = [], 0, 0, np.zeros(0, np.int64)

    def flush() -> Iterator[pa.RecordBatch]:
        tokens, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, U), np.zeros(0, np.int64))
        use = (n >= 2) & (n * SHARE >= sets)
        held.clear()
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(tokens[use].view(np.int64)), pa.nulls(1, pa.int64())]), pa.array(np.r_[n[use], sets].astype(np.int64))], names=["token", "n"])

    for b in batches:
        data, offsets = utf8(b.column("text"))
        for _, part, ends in slices(data, offsets):
            tokens, sizes = shingle_sets(part, ends, width)
            nodes = nodes_of(tokens, sizes)
            fresh = ~pd.Series(nodes).duplicated().to_numpy() & ~np.isin(nodes, seen) & (sizes > 0)
            seen = np.union1d(seen, nodes)
            held.append(tokens[np.repeat(fresh, sizes)])
            sets, size = sets + int(fresh.sum()), size + len(held[-1])
            if size >= 2 * FLUSH:
                yield from flush()
                sets, size, seen = 0, 0, np.zeros(0, np.int64)
    yield from flush()
    slim()


def frequent_tokens(docs: DataFrame, width: int) -> np.ndarray:
    """The sorted tokens of the frequent class; counts are over distinct sets of a flush."""
    found = cut(map_texts(docs.select("text"), lambda x: held_by_many(x, width), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    sets = found.filter("token is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = found.filter("token is not null").filter(F.col("n") * SHARE >= sets).orderBy(F.desc("n"), "token").limit(HEAVY).select("token").toPandas()
    return np.sort(often["token"].to_numpy(np.int64).view(U))


def signatures(tokens: np.ndarray, sizes: np.ndarray, percent: int = PERCENT, heavy: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(signatures, rows, how many are of pairs) of all sets: single rare tokens, pairs of frequent tokens, single frequent tokens of long sets."""
    starts = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    often = np.zeros(len(tokens), bool)
    if heavy is not None and len(heavy) and len(tokens):
        often = heavy[np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)] == tokens
        order = np.argsort(2 * row + often, kind="stable")
        tokens, often = tokens[order], often[order]
    place = np.arange(len(tokens)) - starts[row]
    n_rare = np.bincount(row, ~often, len(sizes)).astype(np.int64)
    lack = sizes - needed(sizes, percent) + 1
    long = sizes >= needed(np.array([PAIRED + 1]), percent)[0]
    single = (~often | long[row]) & (place < lack[row])
    out, rows, pairs = [mix(tokens[single])], [row[single]], 0
    for r in np.flatnonzero((n_rare < lack) & (sizes > 1) & (sizes <= PAIRED)):
        some = mix(tokens[starts[r] + n_rare[r] : starts[r] + lack[r] + 1])
        i, j = np.triu_indices(len(some), 1)
        # A pair has one order in every set.
        a, b = np.minimum(some[i], some[j]), np.maximum(some[i], some[j])
        out.append(mix(a * PAIR + b))
        rows.append(np.full(len(i), r))
        pairs += len(i)
    return np.concatenate(out), np.concatenate(rows), pairs


LEAST_BITS, MOST_BITS = 64, 8192


def bit_class(sizes: np.ndarray) -> np.ndarray:
    """log2 of the bits of a set's bitmap: between half its size and its size."""
    return np.clip(np.ceil(np.log2(np.maximum(sizes, 2) / 2)), np.log2(LEAST_BITS), np.log2(MOST_BITS)).astype(np.int64)


def bitmaps(tokens: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Each set's parity bitmap: bit i is on if an odd number of tokens fall on it. Halves of a bitmap, xored, are the next smaller one."""
    bits = np.int64(1) << bit_class(sizes)
    ends = np.cumsum(bits)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = (ends - bits)[row] + (mix(tokens * PAIR) & (bits[row] - 1).astype(U)).astype(np.int64)
    odd = (np.bincount(at, minlength=ends[-1] if len(ends) else 0) & 1).astype(np.uint8)
    packed = np.packbits(odd, bitorder="little")
    return [packed[(e - n) // 8 : e // 8] for e, n in zip(ends, bits, strict=True)]


_A = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()), ("m", pa.int32()), ("blob", pa.binary()), ("nodes", pa.binary()), ("bitmaps", pa.binary())])
_A_DDL = "doc_id long, key long, n_shingles long, node long, bucket int, n int, m int, blob binary, nodes binary, bitmaps binary"


def signature_rows(batches: Iterator[pa.RecordBatch], buckets: int, width: int, percent: int, heavy: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each text (its set's size and node), under a bucket below zero, and, for each bucket, blobs of signatures with their nodes, sizes and bitmaps; equal sets of a flush sign once.

    Inside a bucket 32 bits name a signature: equal ones stay equal, and what others share by chance the bitmaps part.
    """
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]] = []
    seen = np.zeros(0, np.int64)

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        base = np.cumsum([0, *[len(x[2]) for x in held]])
        sigs, who = np.concatenate([x[0] for x in held]), np.concatenate([x[1] + n for x, n in zip(held, base, strict=False)])
        nodes, sizes = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
        bits = [y for x in held for y in x[4]]
        bucket = ((sigs >> U(20)) % U(buckets)).astype(np.int32)
        order = np.lexsort((who, bucket))
        sigs, who, bucket = sigs[order], who[order], bucket[order]
        runs, out = bucket_runs(bucket), []
        for _, i, j in runs:
            some, local = np.unique(who[i:j], return_inverse=True)
            out.append((len(some), pack(sigs[i:j].astype(np.uint32), delta(local)), pack(nodes[some], sizes[some]), b"".join([bits[k].tobytes() for k in some])))
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [*[pa.nulls(len(runs), pa.int64())] * 4, pa.array([x[0] for x in runs], pa.int32()), pa.array([j - i for _, i, j in runs], pa.int32()), *[pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)]],
            schema=_A,
        )
        held.clear()

    for b in batches:
        data, offsets = utf8(b.column("text"))
        for at, part, ends in slices(data, offsets):
            n = len(ends) - 1
            tokens, sizes = shingle_sets(part, ends, width)
            nodes = nodes_of(tokens, sizes)
            key = b.column("key").slice(at, n)
            deal = pa.array((-1 - key.to_numpy() % buckets).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, n), key, pa.array(sizes.astype(np.int64)), pa.array(nodes, mask=sizes == 0), deal, *[pa.nulls(n, t) for t in _A.types[5:]]], schema=_A)
            fresh = ~pd.Series(nodes).duplicated().to_numpy() & ~np.isin(nodes, seen) & (sizes > 0)
            seen = np.union1d(seen, nodes)
            tokens, sizes = tokens[np.repeat(fresh, sizes)], sizes[fresh]
            held.append((*signatures(tokens, sizes, percent, heavy)[:2], nodes[fresh], sizes.astype(np.int64), bitmaps(tokens, sizes)))
            if sum(len(x[0]) for x in held) >= FLUSH:
                yield from flush()
                seen = np.zeros(0, np.int64)
    yield from flush()
    slim()


class Bitmaps:
    """Bitmaps of many nodes by class, each also folded once, to compare sets whose classes are neighbours."""

    def __init__(self, sizes: np.ndarray, raw: list[bytes], percent: int):
        self.sizes, self.percent, self.kind = sizes, percent, bit_class(sizes)
        self.row = np.zeros(len(sizes), np.int64)
        self.full: dict[int, np.ndarray] = {}
        self.fold: dict[int, np.ndarray] = {}
        data = np.frombuffer(b"".join(raw), U)
        words = np.int64(1) << (self.kind - 6)
        begin = np.cumsum(words) - words
        for k in np.unique(self.kind):
            own = np.flatnonzero(self.kind == k)
            n = 1 << (int(k) - 6)
            self.row[own] = np.arange(len(own))
            self.full[k] = data[begin[own][:, None] + np.arange(n)]
            self.fold[k] = self.full[k][:, : n // 2] ^ self.full[k][:, n // 2 :] if n > 1 else self.full[k]

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether each pair can still be similar."""
        total = self.sizes[i] + self.sizes[j]
        least, most = np.minimum(self.sizes[i], self.sizes[j]), np.maximum(self.sizes[i], self.sizes[j])
        out = np.zeros(len(i), bool)
        low, high = np.where(self.kind[i] <= self.kind[j], i, j), np.where(self.kind[i] <= self.kind[j], j, i)
        go = least * 100 >= most * self.percent
        for k, full in self.full.items():
            for up in (0, 1):
                some = np.flatnonzero(go & (self.kind[low] == k) & (self.kind[high] == k + up))
                if len(some):
                    other = self.fold[k + 1] if up else full
                    for at in range(0, len(some), 65_536):
                        x = some[at : at + 65_536]
                        apart = np.bitwise_count(full[self.row[low[x]]] ^ other[self.row[high[x]]]).sum(axis=1, dtype=np.int64)
                        out[x] = apart * (100 + self.percent) <= (100 - self.percent) * total[x]
        return out


def linked(blobs: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Of one bucket: stars over nodes that share a signature and whose bitmaps are near."""
    sigs, who, nodes, sizes, raw, base = [], [], [], [], [], 0
    for x in blobs.itertuples():
        s, local = unpack(x.blob, x.n, "uint32", "int64")
        a, b = unpack(x.nodes, x.m, "int64", "int64")
        sigs.append(s)
        who.append(np.cumsum(local) + base)
        nodes.append(a)
        sizes.append(b)
        raw.append(x.bitmaps)
        base += x.m
    sigs, who, nodes, sizes = (np.concatenate(x) for x in (sigs, who, nodes, sizes))
    bits = Bitmaps(sizes, raw, percent)
    order = np.lexsort((nodes[who], sigs))
    sigs, who = sigs[order], who[order]
    first = np.flatnonzero(np.r_[True, sigs[1:] != sigs[:-1]])
    many = np.diff(np.r_[first, len(sigs)])
    edges: list[np.ndarray] = []
    small = np.repeat(many <= 32, many)
    for d in range(1, 32):
        i = np.flatnonzero(small[:-d] & (sigs[d:] == sigs[:-d])) if len(sigs) > d else np.zeros(0, np.int64)
        if not len(i):
            break
        a, b = who[i], who[i + d]
        near = bits.near(a, b)
        edges.append(np.stack([nodes[a[near]], nodes[b[near]]]))
    for f, m in zip(first[many > 32], many[many > 32], strict=True):
        todo = who[f : f + m]
        todo = todo[np.unique(nodes[todo], return_index=True)[1]]
        queue: list[int] = []
        while len(todo):
            x = queue.pop() if queue else todo[0]
            todo = todo[todo != x]
            near = bits.near(np.full(len(todo), x), todo)
            if near.any():
                found = todo[near]
                edges.append(np.stack([np.full(len(found), nodes[x]), nodes[found]]))
                queue += found.tolist()
                todo = todo[~near]
    pairs = np.concatenate(edges, axis=1) if edges else np.zeros((2, 0), np.int64)
    out = pd.DataFrame({"a": pairs.max(axis=0), "b": pairs.min(axis=0)}) if pairs.size else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    slim()
    return out[out["a"] != out["b"]].drop_duplicates()


_LINKED = pa.schema([*[_A.field(i) for i in range(4)], ("a", pa.int64()), ("b", pa.int64())])
_LINKED_DDL = "doc_id long, key long, n_shingles long, node long, a long, b long"


def rows_and_links(bucket: int, t: pa.Table, percent: int) -> pa.Table:
    """A bucket's links (a, b); the rows of texts, which stand in buckets below zero, as they are."""
    if bucket < 0:
        columns = [*[t.column(i) for i in range(4)], *[pa.nulls(t.num_rows, pa.int64())] * 2]
    else:
        edges = linked(t.select(["n", "m", "blob", "nodes", "bitmaps"]).to_pandas(), percent)
        columns = [*[pa.nulls(len(edges), pa.int64())] * 4, pa.array(edges["a"].to_numpy(np.int64)), pa.array(edges["b"].to_numpy(np.int64))]
    return pa.table(columns, schema=_LINKED)


def join_block(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """The component of each of a block's distinct sets, by the least index that it reaches."""
    m = len(sets)
    size = np.array([len(x) for x in sets])
    by_size = np.argsort(size, kind="stable")
    tokens, which = np.concatenate([sets[i] for i in by_size]), np.repeat(np.arange(m), size[by_size])
    size = size[by_size]
    _, name, often = np.unique(tokens, return_inverse=True, return_counts=True)
    order = np.lexsort((name, often[name], which))
    name, which = name[order], which[order]
    starts = np.cumsum(size) - size
    place = np.arange(len(name)) - starts[which]
    use = (place < (size - needed(size, percent) + 1)[which]) & (often[name] > 1)
    key, own = name[use], which[use]
    order = np.lexsort((own, key))
    key, own = key[order], own[order]
    group = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    begin = np.repeat(group, np.diff(np.r_[group, len(key)]))
    mine = np.argsort(own, kind="stable")
    ends = np.searchsorted(own[mine], np.arange(m + 1))
    label, members = np.arange(m), [[i] for i in range(m)]
    for x in range(m):
        spots = mine[ends[x] : ends[x + 1]]
        found = [own[begin[s] : s] for s in spots if begin[s] < s]
        if not found:
            continue
        met = np.concatenate(found)
        met = met[(size[met] * 100 >= size[x] * percent) & (label[met] != label[x])]
        if not len(met):
            continue
        met, times = np.unique(met, return_counts=True)
        for y in met[np.argsort(-times, kind="stable")]:
            if label[y] == label[x]:
                continue
            both = len(np.intersect1d(sets[by_size[x]], sets[by_size[y]], assume_unique=True))
            if 100 * both >= percent * (size[x] + size[y] - both):
                a, b = sorted((label[x], label[y]), key=lambda v: len(members[v]))
                label[members[a]] = b
                members[b] += members[a]
                members[a] = []
    out = np.empty(m, np.int64)
    least = np.full(m, m)
    np.minimum.at(least, label, by_size)
    out[by_size] = least[label]
    return out


def similar_sets(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n_shingles and node of every row; node and group of every node that is linked to another). A row's key is a hash of id and text."""
    spark = docs.sparkSession
    buckets = buckets_for(docs, 24)
    heavy = spark.sparkContext.broadcast(frequent_tokens(docs, width))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key(F.col("doc_id"), F.col("text")).alias("key"))
    signed = map_texts(keyed, lambda x: signature_rows(x, buckets, width, percent, heavy.value), _A_DDL)
    # Signatures are shuffled and nothing else: texts' rows go with them, so that they needn't be written to be read twice.
    signed = cut(signed.groupBy("bucket").applyInArrow(lambda key, t: rows_and_links(key[0].as_py(), t, percent), _LINKED_DDL))
    rows = signed.filter("a is null").select("doc_id", "key", "n_shingles", "node")
    blocks = cut(components(signed.filter("a is not null").select("a", "b")))
    chosen = rows.filter("node is not null").groupBy("node").agg(F.min("key").alias("key"))
    chosen = cut(chosen.join(blocks, "node").select("key", "node", F.col("component").alias("block")))
    large = chosen.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("chunks")).filter("chunks > 1")

    def shipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column("text"))
            wanted = b.column("node").to_numpy()
            for at, part, ends in slices(data, offsets):
                tokens, sizes = shingle_sets(part, ends, width)
                stops, nodes = np.cumsum(sizes), nodes_of(tokens, sizes)
                # Texts whose keys collide are told apart by their sets.
                use = np.flatnonzero(nodes == wanted[at : at + len(sizes)])
                blobs = [tokens[stops[i] - sizes[i] : stops[i]].tobytes() for i in use]
                yield pa.RecordBatch.from_arrays([b.column("block").slice(at, len(sizes)).take(pa.array(use)), pa.array(nodes[use]), pa.array(blobs, pa.binary())], names=["block", "node", "tokens"])

    def joined(block: pd.DataFrame) -> pd.DataFrame:
        split = bool(block["i"].iat[0] != block["j"].iat[0])
        block = block.drop_duplicates("node").sort_values("node")
        group = join_block([np.frombuffer(x, U) for x in block["tokens"]], percent)
        node = block["node"].to_numpy()
        return pd.DataFrame({"node": node, "group": node[group], "split": split})

    wanted = sized_join(keyed.select("key", "text"), chosen, "key").select("block", "node", "text")
    sets = map_texts(wanted, shipped, "block long, node long, tokens binary")
    sets = sized_join(sets, large, "block", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    # A chunk meets every other one; the only chunk of a small block meets itself.
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    others = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: k != F.col("chunk")))
    sets = sets.withColumn("chunk", chunk).withColumn("other", F.explode(others)).select("block", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "node", "tokens")
    found = cut(sets.groupBy("block", "i", "j").applyInPandas(joined, "node long, group long, split boolean"))
    links = found.filter("split").select(F.col("node").alias("a"), F.col("group").alias("b"))
    whole = found.filter("not split").select("node", "group")
    if links.isEmpty():
        return rows, whole
    return rows, whole.unionByName(components(links).select("node", F.col("component").alias("group")))


def first_of(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """node and first of its component: no_id, doc_id and key of the component's first row, by id (rows without one last), then key."""
    own = rows.filter("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("own"))
    named = own.join(groups, "node", "left").select("node", "own", F.coalesce("group", "node").alias("group"))
    return named.join(named.groupBy("group").agg(F.min("own").alias("first")), "group").select("node", "first")


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text)."""
    rows, groups = similar_sets(docs, width, percent)
    met = rows.filter("node is not null").join(first_of(rows, groups), "node").select("doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"))
    return met.unionByName(rows.filter("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` but one of each component: its first row stays (all columns pass through).

    First: the smallest id, rows without an id last, then a hash of id and text.
    Of rows that repeat with one id and text any one stays for all. Rows
    without shingles are no one's duplicates and stay.
    """
    rows, groups = similar_sets(docs, width, percent)
    per = rows.filter("node is not null").groupBy("key", "node").agg(F.count("*").alias("n"))
    marked = per.join(first_of(rows, groups), "node").select("key", "n", (F.col("key") == F.col("first.key")).alias("stays"))
    marked = cut(marked.filter("n > 1 or not stays"))
    key = fresh_name(docs, "key")
    keyed = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text")))
    out = sized_join(keyed, marked.select(F.col("key").alias(key)), key, "left_anti")
    again = sized_join(keyed, marked.filter("stays").select(F.col("key").alias(key)), key, "left_semi").dropDuplicates([key])
    return out.unionByName(again).drop(key)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
