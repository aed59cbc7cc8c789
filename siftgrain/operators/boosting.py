"""Boosted trees for numbers and for orders (§2: L1-L4, N7): histograms of gradients are summed on the executors.

Features become bins (quantiles, and one for what is missing), rows become
chunks of whole groups, each one row of a written table. Without groups, rows
whose bins and targets are equal get equal gradients, so they are one row with
a weight. A level of a tree is
one pass over the chunks: a task sums whole-number gradients by node, feature
and bin, tasks' sums meet by node and feature, where the best cut is found, and
a row for each of these reaches the driver. Whole numbers make sums, and so
trees, the same however the rows are dealt.

Orders are learnt with pairwise lambdas: of each pair in a group with different
targets, one of them among the first ``TRUNCATION`` by score, the logistic
loss weighted by what swapping them changes in the discounted gain. A group of
more than ``GROUP_ROWS`` rows is dealt into parts that are ordered by themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftgrain.operators.trees import NAN_MISSING, Ensemble, matrix
from siftgrain.session import stored

CHUNK_ROWS = 50_000
GROUP_ROWS = 10_000
TRUNCATION = 30
BINS = 64
#: What gradients are multiplied by before they become whole numbers.
SCALE = 1 << 20
#: Trees after which scores are written again, and tasks whose sums one task adds up.
KEEP, MERGE = 10, 256
#: Pairs of a group that are looked at together.
CELLS = 1 << 20


@dataclass(frozen=True)
class Settings:
    """``objective``: number (squares) or order (lambdas); ``features`` and ``rows`` are shares that a tree sees."""

    objective: str = "number"
    rate: float = 0.1
    depth: int = 4
    least_rows: int = 20
    ridge: float = 1.0
    features: float = 1.0
    rows: float = 1.0
    seed: int = 42


def chunk_rows(b: pa.RecordBatch) -> Iterator[dict]:
    """The chunks of a batch, one at a time: each is a megabyte or more, and a batch may hold all of a task's."""
    for i in range(b.num_rows):
        yield b.slice(i, 1).to_pylist()[0]


def by_size(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the rows of groups of one size, a line for each group, so many that pairs stay few."""
    first = np.cumsum(sizes) - sizes
    for m in np.unique(sizes[sizes > 1]).tolist():
        starts, step = first[sizes == m], max(1, CELLS // (min(m, TRUNCATION) * m))
        for i in range(0, len(starts), step):
            yield starts[i : i + step, None] + np.arange(m)


def gains(y: np.ndarray) -> np.ndarray:
    return np.exp2(np.minimum(y, 50.0)) - 1


def lambdas(score: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the weighted logistic loss of pairs; equal scores stand in the order of the rows."""
    g, h = np.zeros(len(y)), np.zeros(len(y))
    for at in by_size(sizes):
        m = at.shape[1]
        at = np.take_along_axis(at, np.argsort(-score[at], axis=1, kind="stable"), axis=1)
        s, t, top = score[at], y[at], min(m, TRUNCATION)
        discount = 1 / np.log2(np.arange(m) + 2.0)
        best = (np.sort(gains(t), axis=1)[:, ::-1] * discount).sum(axis=1)
        above = np.arange(top)[:, None] < np.arange(m)[None, :]
        worth = np.abs(gains(t)[:, :top, None] - gains(t)[:, None, :]) * np.abs(discount[:top, None] - discount[None, :])
        worth = np.where(above & (t[:, :top, None] != t[:, None, :]), worth / np.maximum(best, 1e-300)[:, None, None], 0)
        sign = np.sign(t[:, :top, None] - t[:, None, :])
        p = 1 / (1 + np.exp(np.clip(sign * (s[:, :top, None] - s[:, None, :]), -500, 500)))
        slope, bend = -sign * p * worth, p * (1 - p) * worth
        g[at[:, :top]] += slope.sum(axis=2)
        h[at[:, :top]] += bend.sum(axis=2)
        g[at] -= slope.sum(axis=1)
        h[at] += bend.sum(axis=1)
    return g, h


def right_pairs(score: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> tuple[int, int]:
    """Pairs in groups with different targets that the scores order rightly, and all; of groups that pairs with the first ``TRUNCATION`` rows."""
    won = n = 0
    for at in by_size(sizes):
        s, t, top = score[at], y[at], min(at.shape[1], TRUNCATION)
        use = (np.arange(top)[:, None] < np.arange(at.shape[1])[None, :]) & (t[:, :top, None] != t[:, None, :])
        won += int((use & ((s[:, :top, None] - s[:, None, :]) * (t[:, :top, None] - t[:, None, :]) > 0)).sum())
        n += int(use.sum())
    return won, n


@dataclass
class Tree:
    """Nodes as in a heap: the children of i are 2i + 1 and 2i + 2; feature -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def walk(self, bins: np.ndarray, levels: int) -> np.ndarray:
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            f = self.feature[at]
            at = np.where(f < 0, at, 2 * at + 1 + (bins[rows, np.maximum(f, 0)] > self.cut[at]))
        return at


def cut_points(rows: DataFrame, features: str, width: int) -> list[np.ndarray]:
    """Of each feature the values at which bins end (quantiles, approximately)."""
    shares = [i / (BINS - 1) for i in range(1, BINS - 1)]
    number = lambda i: F.nanvl(F.get(features, i).cast("double"), F.lit(None).cast("double"))
    if not width:
        return []
    got = rows.agg(*[F.percentile_approx(number(i), shares, 2000).alias(str(i)) for i in range(width)]).first()
    return [np.unique(np.array(got[str(i)] or [], np.float64)) for i in range(width)]


CHUNKS = "chunk long, valid boolean, n int, bins binary, y binary, sizes binary, score binary, weight binary"


def binned(x: pa.Array, edges: list[np.ndarray]) -> np.ndarray:
    """A column of bins for each feature."""
    m = matrix(x, len(edges))
    return np.column_stack([np.where(np.isnan(m[:, f]), BINS - 1, np.searchsorted(e, m[:, f])) for f, e in enumerate(edges)] or [np.zeros((len(m), 0))]).astype(np.uint8)


def chunk(key: tuple, bins: np.ndarray, y: np.ndarray, sizes: np.ndarray, weight: np.ndarray) -> pa.Table:
    parts = {"bins": bins, "y": y, "sizes": sizes.astype(np.int64), "score": np.zeros(len(y)), "weight": weight.astype(np.int64)}
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "valid": [key[1].as_py()], "n": pa.array([len(y)], pa.int32()), **{k: [a.tobytes()] for k, a in parts.items()}})


def weighted_chunks(data: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """Rows of (valid, x, y) without groups: equal ones are counted, what differs is dealt by hashes and packed."""
    width, edges = len(cuts), cuts

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = pa.py_buffer(np.arange(b.num_rows + 1, dtype=np.int32) * np.int32(width))
            bins = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, ends, pa.py_buffer(binned(b.column("x"), edges).tobytes())])
            yield pa.RecordBatch.from_arrays([b.column("valid"), bins, b.column("y")], ["valid", "bins", "y"])

    rows = stored(data.mapInArrow(places, "valid boolean, bins binary, y double").groupBy("valid", "bins", "y").agg(F.count("*").alias("n")))
    deal = max(1, math.ceil(rows.count() / CHUNK_ROWS))

    def packed(key: tuple, t: pa.Table) -> pa.Table:
        bins = np.frombuffer(b"".join(t.column("bins").to_pylist()), np.uint8).reshape(t.num_rows, width)
        y, n = t.column("y").to_numpy(), t.column("n").to_numpy()
        order = np.lexsort((*bins.T[::-1], y))
        return chunk(key, bins[order], y[order], np.ones(0), n[order])

    return stored(rows.withColumn("chunk", F.pmod(F.xxhash64("bins", "y"), F.lit(deal))).groupBy("chunk", "valid").applyInArrow(packed, CHUNKS))


def chunks(rows: DataFrame, features: str, target: str, group: str | None, valid: str | None, cuts: list[np.ndarray]) -> DataFrame:
    """Rows packed by hashes of their groups; the order inside is fixed by group, target and features."""
    width, edges = len(cuts), cuts
    flag = F.coalesce(F.col(valid), F.lit(False)) if valid else F.lit(False)
    own = F.xxhash64(group) if group else F.lit(0)
    data = rows.select(own.alias("g"), flag.alias("valid"), F.col(features).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y")).filter("y is not null and not isnan(y) and x is not null")
    if not group:
        return weighted_chunks(data.drop("g"), cuts)
    large = data.groupBy("g").agg(F.count("*").alias("m")).filter(F.col("m") > GROUP_ROWS)
    parts = F.pmod(F.xxhash64("x", "y"), F.ceil(F.coalesce("m", F.lit(1)) / GROUP_ROWS).cast("long"))
    data = data.join(large, "g", "left").withColumn("g", F.xxhash64("g", parts)).drop("m")
    deal = max(1, math.ceil(data.count() / CHUNK_ROWS))

    def packed(key: tuple, t: pa.Table) -> pa.Table:
        x, y, g = matrix(t.column("x").combine_chunks(), width), t.column("y").to_numpy(), t.column("g").to_numpy()
        order = np.lexsort((*x.T[::-1], y, g))
        y, g = y[order], g[order]
        bins = binned(t.column("x").combine_chunks(), edges)[order]
        sizes = np.diff(np.flatnonzero(np.r_[True, g[1:] != g[:-1], True]))
        return chunk(key, bins, y, sizes, np.ones(0))

    return stored(data.withColumn("chunk", F.pmod("g", F.lit(deal))).groupBy("chunk", "valid").applyInArrow(packed, CHUNKS))


def totals(where: np.ndarray, a: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by place, exact also beyond what a double holds."""
    if not len(a) or int(np.abs(a).max()) * len(a) < 1 << 53:
        return np.rint(np.bincount(where, a, n)).astype(np.int64)
    low = a & ((1 << 26) - 1)
    high, low = (np.rint(np.bincount(where, b, n)).astype(np.int64) for b in (a >> 26, low))
    return (high << 26) + low


class Booster:
    """Trees that grow over written chunks; ``history`` has the measure on rows marked as valid after each number of trees."""

    def __init__(self, rows: DataFrame, features: str = "features", target: str = "y", group: str | None = None, valid: str | None = None, settings: Settings = Settings(), data: tuple | None = None):
        if settings.objective == "order" and group is None:
            raise ValueError("orders need groups")
        self.settings, self.trees, self.written, self.history = settings, [], 0, []
        if data is None:
            width = max(0, rows.filter(F.col(features).isNotNull()).select(F.max(F.size(features))).first()[0] or 0)
            cuts = cut_points(rows.filter(~F.coalesce(F.col(valid), F.lit(False))) if valid else rows, features, width)
            mean = rows.filter(~F.coalesce(F.col(valid), F.lit(False)) if valid else F.lit(True)).agg(F.avg(F.col(target).cast("double")), F.stddev_pop(F.col(target).cast("double"))).first() if settings.objective == "number" else None
            data = cuts, (float(mean[0] or 0), float(mean[1] or 1)) if mean else (0.0, 1.0), chunks(rows, features, target, group, valid, cuts)
        self.data = data
        self.cuts, (self.base, self.spread), self.table = data

    def state(self, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bins, targets, group sizes, scores and weights (ones in groups) of a chunk."""
        n = row["n"]
        bins = np.frombuffer(row["bins"], np.uint8).reshape(n, -1)
        score = np.frombuffer(row["score"], np.float64).copy()
        for t in self.trees[self.written :]:
            score += t.value[t.walk(bins, self.settings.depth)]
        y = (np.frombuffer(row["y"], np.float64) - self.base) / self.spread
        weight = np.frombuffer(row["weight"], np.int64) if row["weight"] else np.ones(n, np.int64)
        return bins, y, np.frombuffer(row["sizes"], np.int64), score, weight

    def sums(self, tree: Tree | None, level: int, used: list[int]) -> dict[tuple[int, int], list[float]]:
        """By (node, feature) the best cut: gain, bin, then sums of gradients, bends and rows on its left and in all; by (-1, -1) the measure."""
        me = self.bare()
        s, width, nodes = self.settings, len(self.cuts), 1 << level
        base = nodes - 1

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, measure = np.zeros((nodes, width, BINS, 3), np.int64), np.zeros(2)
            for b in batches:
                for row in chunk_rows(b):
                    bins, y, sizes, score, weight = me.state(row)
                    if row["valid"]:
                        if level == 0:
                            measure += right_pairs(score, y, sizes) if s.objective == "order" else (float((weight * (score - y) ** 2).sum()), int(weight.sum()))
                        continue
                    if tree is None:
                        continue
                    g, h = lambdas(score, y, sizes) if s.objective == "order" else (score - y, np.ones(len(y)))
                    at = tree.walk(bins, level) - base
                    use = at >= 0
                    if s.rows < 1:
                        rng = np.random.default_rng([s.seed, len(me.trees), row["chunk"]])
                        weight = rng.binomial(weight, s.rows) if row["weight"] else (rng.random(len(y)) < s.rows).astype(np.int64)
                        use &= weight > 0
                    at, bins, weight = at[use], bins[use], weight[use]
                    parts = [np.rint(a[use] * SCALE).astype(np.int64) * weight for a in (g, h)] + [weight]
                    for f in used:
                        where = at * BINS + bins[:, f]
                        for i, a in enumerate(parts):
                            total[:, f, :, i] += totals(where, a, nodes * BINS).reshape(nodes, BINS)
            rows = [(i, f, total[i, f].tobytes()) for i in range(nodes) for f in used if total[i, f].any()]
            if measure[1]:
                rows.append((-1, -1, measure.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["node", "feature", "sums"])

        def added(t: pa.Table, kind: type) -> np.ndarray:
            return sum((np.frombuffer(x.as_py(), kind) for x in t.column("sums")), np.zeros(1, kind))

        def merged(key: tuple, t: pa.Table) -> pa.Table:
            node, feature = key[0].as_py(), key[1].as_py()
            return pa.table({"node": pa.array([node], pa.int32()), "feature": pa.array([feature], pa.int32()), "sums": [added(t, np.float64 if node < 0 else np.int64).tobytes()]})

        def best(key: tuple, t: pa.Table) -> pa.Table:
            node, feature = key[0].as_py(), key[1].as_py()
            if node < 0:
                out = added(t, np.float64).tolist()
            else:
                a = added(t, np.int64).reshape(BINS, 3).astype(np.float64) / [SCALE, SCALE, 1]
                left, every = np.cumsum(a, axis=0)[: BINS - 1], a.sum(axis=0)
                rest = every - left
                worth = lambda x: x[..., 0] ** 2 / (x[..., 1] + s.ridge)
                gain = np.where((left[:, 2] >= s.least_rows) & (rest[:, 2] >= s.least_rows), worth(left) + worth(rest) - worth(every), -1)
                i = int(gain.argmax())
                out = [float(gain[i]), float(i), *left[i].tolist(), *every.tolist()]
            return pa.table({"node": pa.array([node], pa.int32()), "feature": pa.array([feature], pa.int32()), "best": pa.array([out], pa.list_(pa.float64()))})

        got = self.table.mapInArrow(local, "node int, feature int, sums binary")
        if self.table.rdd.getNumPartitions() > MERGE:
            part = F.floor(F.rand(0) * (self.table.rdd.getNumPartitions() // MERGE + 1))
            got = got.withColumn("part", part).groupBy("node", "feature", "part").applyInArrow(lambda key, t: merged(key, t), "node int, feature int, sums binary")
        return {(r.node, r.feature): r.best for r in got.groupBy("node", "feature").applyInArrow(best, "node int, feature int, best array<double>").collect()}

    def bare(self) -> Booster:
        """Without the table, for the executors."""
        out = object.__new__(Booster)
        out.settings, out.trees, out.written, out.base, out.spread = self.settings, self.trees, self.written, self.base, self.spread
        return out

    def note(self, found: dict) -> None:
        if len(self.history) == len(self.trees):
            a, n = found.get((-1, -1), (math.nan, 1))
            self.history.append(a / n if self.settings.objective == "order" else -math.sqrt(a / n) * self.spread)

    def grow(self) -> None:
        """One more tree."""
        s, width = self.settings, len(self.cuts)
        size = (2 << s.depth) - 1
        tree = Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size))
        pick = np.random.default_rng([s.seed, len(self.trees)]).permutation(width)[: max(1, round(s.features * width))] if width else []
        used, open_, sums = sorted(int(f) for f in pick), {0}, {}
        for level in range(s.depth):
            found = self.sums(tree, level, used)
            if level == 0:
                self.note(found)
            following, base = set(), (1 << level) - 1
            for node in sorted(open_):
                cuts = sorted((-found[node - base, f][0], f) for f in used if (node - base, f) in found)
                if level == 0 and cuts:
                    sums[0] = found[0, cuts[0][1]][5:]
                if not cuts or -cuts[0][0] <= 1e-9:
                    continue
                f = cuts[0][1]
                _, cut, *rest = found[node - base, f]
                tree.feature[node], tree.cut[node] = f, int(cut)
                sums[2 * node + 1], sums[2 * node + 2] = rest[:3], [a - b for a, b in zip(rest[3:], rest[:3], strict=True)]
                following |= {2 * node + 1, 2 * node + 2}
            open_ = following
            if not open_:
                break
        for node, (g, h, _) in sums.items():
            tree.value[node] = -s.rate * g / (h + s.ridge)
        self.trees.append(tree)
        if len(self.trees) - self.written >= KEEP:
            self.keep()

    def keep(self) -> None:
        """Writes the chunks again, with their scores."""
        me = self.bare()

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = b.schema.get_field_index("score")
                yield b.set_column(at, b.schema.field(at), pa.array([me.state(r)[3].tobytes() for r in chunk_rows(b)], b.schema.field(at).type))

        self.table, self.written = stored(self.table.mapInArrow(scored, CHUNKS)), len(self.trees)

    def train(self, rounds: int, patience: int | None = None) -> Booster:
        """Up to ``rounds`` trees in all; with ``patience``, until the measure hasn't grown for so many. Trees beyond the best number stay unless ``cut`` goes."""
        while len(self.trees) < rounds:
            self.grow()
            if patience and not all(map(math.isnan, self.history)) and len(self.history) - 1 - int(np.nanargmax(self.history)) >= patience:
                break
        self.note(self.sums(None, 0, []))
        return self

    def best(self) -> int:
        """The number of trees with the best measure; all without valid rows."""
        return int(np.nanargmax(self.history)) if self.history and not all(map(math.isnan, self.history)) else len(self.trees)

    def ensemble(self, trees: int | None = None) -> Ensemble:
        """The first trees (the best number) as a model that scores rows of features."""
        keep = self.trees[: self.best() if trees is None else trees]
        f, t, d, left, right, value, root = [], [], [], [], [], [], []
        for tree in keep:
            place: dict[int, int] = {}
            inner = [i for i in range(len(tree.feature)) if tree.feature[i] >= 0]
            for i in inner:
                place[i] = len(f) + len(place)
            reached = [0, *[c for i in inner for c in (2 * i + 1, 2 * i + 2)]]
            for i in reached:
                if i not in place:
                    place[i] = ~(len(value))
                    value.append(tree.value[i] * self.spread + (self.base if tree is keep[0] else 0))
            root.append(place[0])
            for i in inner:
                f.append(tree.feature[i])
                t.append(self.cuts[tree.feature[i]][tree.cut[i]] if tree.cut[i] < len(self.cuts[tree.feature[i]]) else math.inf)
                d.append(NAN_MISSING << 2)
                left.append(place[2 * i + 1])
                right.append(place[2 * i + 2])
        ints = lambda a: np.array(a, np.int64)
        if not keep:
            value, root = [self.base], [~0]
        return Ensemble(ints(f), np.array(t, np.float64), ints(d), ints(left), ints(right), np.array(value, np.float64), ints(root), len(self.cuts), objective="lambdarank" if self.settings.objective == "order" else "regression")


def halving(rows: DataFrame, trials: list[Settings], features: str = "features", target: str = "y", group: str | None = None, valid: str = "valid", first: int = 5, rounds: int | None = 40, eta: int = 3, patience: int = 10) -> tuple[list[dict], Booster]:
    """§2: L2, N7. Successive halving: all trials get ``first`` trees, the best of each step ``eta`` times as many. Rows of (trial, rounds, measure), and the winner.

    Trials share chunks and bins; one that hasn't improved for ``patience`` trees stops growing. Without ``rounds`` nothing else ends the search.
    """
    if len({t.objective for t in trials}) != 1:
        raise ValueError("trials of one objective can be compared")
    start = Booster(rows, features, target, group, valid, trials[0])
    alive = {i: Booster(rows, features, target, group, valid, t, start.data) for i, t in enumerate(trials)}
    out: dict[int, dict] = {}
    now = first
    while True:
        for i, b in alive.items():
            b.train(now, patience)
            out[i] = {"trial": i, "rounds": b.best(), "trees": len(b.trees), "measure": b.history[b.best()]}
        order = sorted(alive, key=lambda i: (-out[i]["measure"], i))
        if rounds is not None and now >= rounds or len(alive) == 1 and all(len(b.trees) < now for b in alive.values()):
            return [out[i] for i in sorted(out)], alive[order[0]]
        alive = {i: alive[i] for i in order[: max(1, math.ceil(len(order) / eta))]}
        now = now * eta if rounds is None else min(rounds, now * eta)

