"""Bootstraps over whole tables (§2: H1, H2, H15, L5, W19): each row counts a Poisson number of times in each resample.

How often is worked out from the row's key and the number of the resample, so
that no row is drawn, sent or kept: one pass sums up all resamples, and a rerun
gives the same ones. Rows that share a key are drawn together; those without a
key take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftgrain.operators import ranking
from siftgrain.operators.ordered import running
from siftgrain.session import checkpointed, stored

PRIME = 2**31 - 1
#: Places from which on a row counts once, twice, ... (cumulative shares of the Poisson law of mean 1).
STEPS = [math.ceil(x * PRIME) for x in accumulate(math.exp(-1) / math.factorial(k) for k in range(12))]
#: Weights that are held at a time, and resamples of one pass over sorted rows.
CELLS, TOGETHER = 1 << 20, 256
#: Levels that are broadcast at most.
BROADCAST_LEVELS = 100_000


def weights(key: np.ndarray, resamples: np.ndarray, seed: int = 0) -> np.ndarray:
    """How often the row of each key counts in each resample: a line for each key."""
    b = resamples.astype(np.int64)[None, :]
    x = (key.astype(np.int64) % PRIME)[:, None]
    x = (x * 48271 + b * 69621 + (seed % PRIME) * 40692 + 1) % PRIME
    for _ in range(3):
        x = (x * x + 7919 * x + 1299709 + b) % PRIME
    return np.searchsorted(np.array(STEPS), x, "right")


def weights_sql(key: str, resample: str, seed: int = 0) -> str:
    """The same in SQL."""
    x = f"(((({key} % {PRIME}) + {PRIME}) % {PRIME}) * 48271 + {resample} * 69621 + {seed % PRIME * 40692 + 1}) % {PRIME}"
    for _ in range(3):
        x = f"list_transform([{x}], lambda x: (x * x + 7919 * x + 1299709 + {resample}) % {PRIME})[1]"
    return f"list_sum(list_transform([{x}], lambda x: {' + '.join(f'(x >= {s})::BIGINT' for s in STEPS)})[1:1])::BIGINT"


def blocks(n: int, resamples: int) -> Iterator[slice]:
    step = max(1, CELLS // max(1, resamples))
    return (slice(i, min(i + step, n)) for i in range(0, n, step))


def numbers(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which all columns are numbers."""
    for c in columns:
        df = df.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return df


def poisson_means(df: DataFrame, key: str, values: list[str], resamples: int = 1000, seed: int = 0, group: str | None = None) -> DataFrame:
    """(group,) resample, n (rows that count) and mean_<value>, over rows in which all values are numbers; no row for a resample without any."""
    width = len(values) + 1
    numbered = np.arange(resamples)
    rows = numbers(df, *values).select((F.col(group).cast("string") if group else F.lit("")).alias("g"), F.col(key).cast("long").alias("k"), F.array(*[F.col(v).cast("double") for v in values]).alias("v"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([a.ravel().tolist() for a in held.values()], pa.list_(pa.float64()))], ["g", "sums"])
            held.clear()
            return got

        for b in batches:
            g = b.column(0).dictionary_encode(null_encoding="encode")
            code, k = g.indices.to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            v = np.column_stack([np.ones(b.num_rows), b.column(2).flatten().to_numpy().reshape(b.num_rows, width - 1)])
            for i, name in enumerate(g.dictionary.to_pylist()):
                mine = np.flatnonzero(code == i)
                total = held.setdefault(name, np.zeros((resamples, width)))
                for at in blocks(len(mine), resamples):
                    total += weights(k[mine[at]], numbered, seed).T.astype(np.float64) @ v[mine[at]]
                if len(held) * resamples * width > 8 * CELLS:
                    yield out()
        if held:
            yield out()

    each = rows.filter("k is not null").mapInArrow(local, "g string, sums array<double>").select("g", F.posexplode("sums").alias("at", "x"))
    sums = each.groupBy("g", F.expr(f"cast(at div {width} as int)").alias("resample")).agg(*[F.sum(F.when(F.col("at") % width == i, F.col("x"))).alias(f"s{i}") for i in range(width)])
    named = [F.col("g").alias(group)] if group else []
    return sums.filter("s0 > 0").select(*named, "resample", F.col("s0").cast("long").alias("n"), *[(F.col(f"s{i}") / F.col("s0")).alias(f"mean_{v}") for i, v in enumerate(values, 1)])


def interval(resampled: DataFrame, value: str, alternative: str = "greater", confidence: float = 0.95) -> DataFrame:
    """low, high and p of what was resampled: quantiles, and the share on the wrong side of zero."""
    low, high = (1 - confidence) / 2, (1 + confidence) / 2
    wrong = {"greater": F.avg((F.col(value) <= 0).cast("int")), "less": F.avg((F.col(value) >= 0).cast("int"))}
    p = wrong.get(alternative)
    if p is None:
        if alternative != "two-sided":
            raise ValueError(f"unknown alternative: {alternative}")
        p = F.least(2 * F.least(*wrong.values()), F.lit(1.0))
    return resampled.agg(F.percentile(value, F.lit(low)).alias("low"), F.percentile(value, F.lit(high)).alias("high"), p.alias("p"))


def mean_difference(df: DataFrame, key: str, a: str, b: str, resamples: int = 20_000, seed: int = 0, alternative: str = "greater", confidence: float = 0.95) -> DataFrame:
    """§2: H1. One row: difference of the means of a and b, low, high, p and n (rows that have both)."""
    rows = numbers(df, a, b).select(F.col(key).alias("k"), (F.col(a).cast("double") - F.col(b).cast("double")).alias("d")).filter("k is not null")
    seen = rows.agg(F.avg("d").alias("difference"), F.count("*").alias("n"))
    return seen.crossJoin(interval(poisson_means(rows, "k", ["d"], resamples, seed), "mean_d", alternative, confidence)).select("difference", "low", "high", "p", "n")


def mean_deviation(df: DataFrame, key: str, value: str, group: str | None = None, resamples: int = 1000, seed: int = 0) -> DataFrame:
    """§2: H15, W19. (group and) the deviation of a mean over resamples."""
    means = poisson_means(df, key, [value], resamples, seed, group)
    return means.groupBy(*([group] if group else [])).agg(F.stddev_pop(f"mean_{value}").alias("deviation"))


def ranked(df: DataFrame, gold: str) -> tuple[DataFrame, int]:
    """Adds level, the place of a row's gold among the distinct ones, and says how many there are."""
    levels = checkpointed(df.select(F.col(gold).cast("double").alias("_gold")).distinct().withColumn("_one", F.lit(1)))
    n = levels.count()
    placed = checkpointed(running(levels, "_gold", "_one", "level").select("_gold", F.col("level").cast("long").alias("level"))) if n else levels.select("_gold", F.lit(0).cast("long").alias("level"))
    return df.join(F.broadcast(placed) if n <= BROADCAST_LEVELS else placed, F.col(gold).cast("double") == F.col("_gold")).drop("_gold"), n


class Scan:
    """Counts pairs of a sorted part by resample: those whose prediction and bit both grow (won), and all whose bits differ."""

    def __init__(self, resamples: np.ndarray, seed: int, carry: dict | None):
        self.resamples, self.seed = resamples, seed
        zero = np.zeros(len(resamples), np.int64)
        self.won, self.all = zero.astype(np.float64), zero.astype(np.float64)
        # What lies before, in the group: its key, the last prediction, sums of bit 0 and 1, and of bit 0 before the run of that prediction.
        self.group, self.p, self.zero, self.one, self.run = (carry[k] for k in ("group", "p", "zero", "one", "run")) if carry else (None, None, zero, zero, zero)

    def add(self, bit_at: np.ndarray, prefix: np.ndarray, p: np.ndarray, bit: np.ndarray, key: np.ndarray) -> None:
        for at in blocks(len(p), len(self.resamples)):
            self.block(bit_at[at], prefix[at], p[at], bit[at], key[at])

    def block(self, t: np.ndarray, g: np.ndarray, p: np.ndarray, bit: np.ndarray, key: np.ndarray) -> None:
        n = len(p)
        w = weights(key, self.resamples, self.seed)
        w0 = np.where(bit[:, None] == 0, w, 0)
        w1 = w - w0
        c0, c1 = (np.vstack([np.zeros((1, w.shape[1]), np.int64), np.cumsum(x, axis=0)]) for x in (w0, w1))
        new_group = np.r_[self.group != (t[0], g[0]), (t[1:] != t[:-1]) | (g[1:] != g[:-1])]
        new_run = new_group | np.r_[self.p != p[0], p[1:] != p[:-1]]
        place = np.arange(n)
        first, run = np.maximum.accumulate(np.where(new_group, place, -1)), np.maximum.accumulate(np.where(new_run, place, -1))
        # Sums before the block hold for rows whose group, or run, began there.
        old0, old1 = (np.where((first < 0)[:, None], s[None, :], -c[np.maximum(first, 0)]) for s, c in ((self.zero, c0), (self.one, c1)))
        below = np.where((run < 0)[:, None], self.run[None, :], c0[np.maximum(run, 0)] + old0)
        self.won += (w1 * below).sum(axis=0, dtype=np.float64)
        self.all += (w1 * (c0[:-1] + old0)).sum(axis=0, dtype=np.float64) + (w0 * (c1[:-1] + old1)).sum(axis=0, dtype=np.float64)
        self.run, self.zero, self.one = below[-1], c0[n] + old0[-1], c1[n] + old1[-1]
        self.group, self.p = (t[-1], g[-1]), p[-1]


SORTED = "t int, g long, p double, bit int, k long"


def sorted_bits(rows: DataFrame, pred: str, bits: int) -> DataFrame:
    """A row for each bit of a level: rows whose levels agree above the bit form a group; in the order of group, prediction and key."""
    t = F.explode(F.sequence(F.lit(0), F.lit(bits - 1)))
    spread = rows.select(t.alias("t"), F.col("level"), (F.col(pred).cast("double") + 0.0).alias("p"), F.col("k"))
    spread = spread.select(F.col("t").cast("int").alias("t"), F.expr("shiftright(level, t + 1)").alias("g"), "p", F.expr("cast(shiftright(level, t) & 1 as int)").alias("bit"), "k")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(spread.repartitionByRange(parts, "t", "g", "p", "k").sortWithinPartitions("t", "g", "p", "k"))


def columns(b: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in b.columns]


def part_ends(bits: DataFrame, resamples: np.ndarray, seed: int) -> list[dict]:
    """Of each part its last group and prediction, with the sums of the group (bit 0 and 1) and of bit 0 at that prediction."""

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, p, sums = None, None, np.zeros((3, len(resamples)), np.int64)
        for b in batches:
            t, g, q, bit, k = columns(b)
            if not len(t):
                continue
            here = np.flatnonzero((t == t[-1]) & (g == g[-1]))
            if group != (t[-1], g[-1]):
                sums[:] = 0
            elif p != q[-1]:
                sums[2] = 0
            group, p = (t[-1], g[-1]), q[-1]
            for at in blocks(len(here), len(resamples)):
                i = here[at]
                w = weights(k[i], resamples, seed)
                sums += [w[bit[i] == 0].sum(axis=0), w[bit[i] == 1].sum(axis=0), w[(bit[i] == 0) & (q[i] == p)].sum(axis=0)]
        if group:
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip((TaskContext.get().partitionId(), int(group[0]), int(group[1]), float(p), sums.ravel().tolist()), (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.int64())), strict=True)], ["part", "t", "g", "p", "sums"])

    return sorted((r.asDict() for r in bits.mapInArrow(last, "part int, t int, g long, p double, sums array<long>").collect()), key=lambda r: r["part"])


def carries(ends: list[dict], resamples: int) -> dict[int, dict]:
    """What each part finds before it, by the part's number; a row for each part comes in."""
    out, now = {}, None
    for r in ends:
        out[r["part"]] = now
        zero, one, tie = np.array(r["sums"], np.int64).reshape(3, resamples)
        same = now is not None and now["group"] == (r["t"], r["g"])
        before = now["zero"] if same else np.zeros(resamples, np.int64)
        run = now["run"] if same and now["p"] == r["p"] else before + zero - tie
        now = {"group": (r["t"], r["g"]), "p": r["p"], "zero": before + zero, "one": (now["one"] if same else 0) + one, "run": run}
    return out


def pair_counts(bits: DataFrame, resamples: np.ndarray, seed: int) -> DataFrame:
    """resample, won and all."""
    before = bits.sparkSession.sparkContext.broadcast(carries(part_ends(bits, resamples, seed), len(resamples)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scan(resamples, seed, before.value.get(TaskContext.get().partitionId()))
        for b in batches:
            t, g, p, bit, k = columns(b)
            if len(t):
                s.add(t, g, p, bit, k)
        yield pa.RecordBatch.from_arrays([pa.array(resamples, pa.int32()), pa.array(s.won), pa.array(s.all)], ["resample", "won", "all"])

    return bits.mapInArrow(scan, "resample int, won double, all double").groupBy("resample").agg(F.sum("won").alias("won"), F.sum("all").alias("all"))


def resampled_accuracy(df: DataFrame, key: str, gold: str, preds: list[str], resamples: int = 2000, seed: int = 0) -> DataFrame:
    """§2: H2, L5. resample, n_pairs and accuracy_<pred>: the share of pairs of different gold that a prediction orders alike; ties are wrong.

    Over rows in which gold and all predictions are numbers. Levels are read
    bit by bit: a pair differs first at one bit, and is counted where rows that
    agree above it are sorted by prediction, so that a resample costs as much
    as sorting. Parts know what lies before them by a row for each part.
    """
    rows, levels = ranked(numbers(df, gold, *preds).select(F.col(key).cast("long").alias("k"), gold, *preds).filter("k is not null"), gold)
    depth = (levels - 1).bit_length() if levels else 0
    if not depth:
        kinds = ", ".join(f"accuracy_{p} double" for p in preds)
        return df.sparkSession.createDataFrame([], f"resample int, n_pairs double, {kinds}")
    rows, out = checkpointed(rows), None
    for p in preds:
        bits = sorted_bits(rows, p, depth)
        counts = None
        for first in range(0, resamples, TOGETHER):
            some = pair_counts(bits, np.arange(first, min(resamples, first + TOGETHER)), seed)
            counts = some if counts is None else counts.unionByName(some)
        mine = counts.select("resample", F.col("all").alias("n_pairs"), (F.col("won") / F.nullif("all", F.lit(0.0))).alias(f"accuracy_{p}"))
        out = mine if out is None else out.join(mine.drop("n_pairs"), "resample")
    return out


def accuracy_tests(df: DataFrame, key: str, group: str, order: str, gold: str, a: str, b: str, resamples: int = 2000, seed: int = 0) -> DataFrame:
    """§2: L5. Two rows (scope intra and global): difference in pair accuracy of a over b, low, high and p.

    Inside groups it is the mean over groups, which are resampled (H1); over all
    pairs rows are (H2). ``group`` and ``key`` are whole numbers.
    """
    # Pairs inside groups are formed once for both, and their groups read twice.
    mine = stored(ranking.group_accuracies(df, group, order, gold, {"a": a, "b": b}).filter("a is not null and b is not null"))
    intra = mean_difference(mine, group, "a", "b", resamples, seed).drop("n")
    sampled = checkpointed(resampled_accuracy(df, key, gold, [a, b], resamples, seed).withColumn("d", F.col(f"accuracy_{a}") - F.col(f"accuracy_{b}")))
    seen = [ranking.global_accuracy(numbers(df, gold, a, b), gold, p).select(F.col("accuracy").alias(n)) for p, n in ((a, "x"), (b, "y"))]
    overall = seen[0].crossJoin(seen[1]).select((F.col("x") - F.col("y")).alias("difference")).crossJoin(interval(sampled, "d"))
    return intra.select(F.lit("intra").alias("scope"), "*").unionByName(overall.select(F.lit("global").alias("scope"), "*"))
