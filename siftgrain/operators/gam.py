"""Additive models of smooth terms (§2: H12, H14): Gram sums on the executors, small systems on the driver.

Each feature has cubic B-splines with a penalty on their second differences;
its weight is chosen by generalised cross-validation over a grid, from the same
sums. Effective degrees of freedom come from the trace of the hat matrix, p of
a term from a Wald statistic of its centred coefficients, and p of nested
models from an F-test.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftgrain.operators.stats import incomplete_beta

#: What each row adds to the diagonal: splines of a feature sum to one, as the intercept does, so that the system needs it.
RIDGE = 1e-9
#: Weights of the penalty that are compared.
GRID = tuple(float(x) for x in np.logspace(-3, 3, 13))


def f_sf(x: float, a: float, b: float) -> float:
    """The share of an F law with a and b degrees of freedom above x."""
    return 1.0 if x <= 0 else incomplete_beta(b / 2, a / 2, b / (b + a * x))


def spline_basis(x: np.ndarray, low: float, high: float, n: int = 20) -> np.ndarray:
    """Cubic B-splines over [low, high]."""
    step = (high - low) / (n - 3)
    knots = low + step * np.arange(-3, n + 1)
    x = np.clip(x, low, high - 1e-9 * max(1, abs(high)))[:, None]
    b = ((x >= knots[:-1]) & (x < knots[1:])).astype(float)
    for d in range(1, 4):
        b = (x - knots[: -d - 1]) / (d * step) * b[:, :-1] + (knots[d + 1 :] - x) / (d * step) * b[:, 1:]
    return b


def basis(x: np.ndarray, spans: list[tuple[float, float]], n: int) -> np.ndarray:
    """A column of ones and each feature's splines; x: a column for each feature."""
    return np.concatenate([np.ones((len(x), 1)), *[spline_basis(x[:, i], *s, n) for i, s in enumerate(spans)]], axis=1)


@dataclass
class Sums:
    """What rows leave behind: products of the basis with itself (g) and the target (v), and rows, sum and squares of the target."""

    g: np.ndarray
    v: np.ndarray
    n: float
    y: float
    yy: float
    features: list[str]
    spans: list[tuple[float, float]]
    shown: list[tuple[float, float]]
    n_splines: int

    def of(self, features: list[str]) -> Sums:
        """The sums of some of the features, without another pass."""
        at = [0, *[1 + self.features.index(f) * self.n_splines + i for f in features for i in range(self.n_splines)]]
        pick = [self.features.index(f) for f in features]
        return Sums(self.g[np.ix_(at, at)], self.v[at], self.n, self.y, self.yy, features, [self.spans[i] for i in pick], [self.shown[i] for i in pick], self.n_splines)


def sums(df: DataFrame, features: list[str], target: str, n_splines: int = 20) -> Sums:
    """One pass for the ends (0, 1, 99 and 100 per cent of each feature), one for the sums; a row for each place of the matrix reaches the driver."""
    data = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate([*features, target])])
    for c in data.columns:
        data = data.filter(F.col(c).isNotNull() & ~F.isnan(c))
    k = len(features)
    ends = data.agg(*[f(f"_{i}").alias(f"{n}{i}") for i in range(k) for n, f in (("lo", F.min), ("hi", F.max))], *[F.percentile(f"_{i}", F.array(F.lit(0.01), F.lit(0.99))).alias(f"p{i}") for i in range(k)]).first()
    if ends["lo0"] is None:
        raise ValueError("no rows to fit")
    spans = [(ends[f"lo{i}"], ends[f"hi{i}"] + 1e-9) for i in range(k)]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if len(cols[-1]):
                z, y = basis(np.column_stack(cols[:-1]), spans, n_splines), cols[-1]
                part = np.concatenate([(z.T @ z).ravel(), z.T @ y, [len(y), y.sum(), y @ y]])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

    rows = data.mapInArrow(local, "sums array<double>").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    size = 1 + n_splines * k
    flat = np.zeros(size * size + size + 3)
    for r in rows:
        flat[r["at"]] = r["x"]
    n, y, yy = flat[-3:].tolist()
    return Sums(flat[: size * size].reshape(size, size), flat[size * size : -3], n, y, yy, list(features), spans, [tuple(ends[f"p{i}"]) for i in range(k)], n_splines)


@dataclass
class Fit:
    """A fitted model: ``edf`` by term (after the intercept's) and in all, and p of each term."""

    sums: Sums
    weights: np.ndarray
    penalty: float
    gcv: float
    rss: float
    edf: float
    term_edf: list[float]
    p: list[float]

    @property
    def explained_deviance(self) -> float:
        whole = self.sums.yy - self.sums.y**2 / self.sums.n
        return 1 - self.rss / whole if whole > 0 else 0.0

    def curve(self, feature: str, grid: int = 200) -> dict:
        """§2: H14. The effect of a feature between its 1st and 99th percentile, and where it peaks."""
        i = self.sums.features.index(feature)
        x = np.linspace(*self.sums.shown[i], grid)
        at = 1 + i * self.sums.n_splines
        y = spline_basis(x, *self.sums.spans[i], self.sums.n_splines) @ self.weights[at : at + self.sums.n_splines]
        return {"x": x, "y": y, "peak": float(x[y.argmax()]), "peak_effect": float(y.max())}


def solved(s: Sums, penalty: float) -> Fit:
    size, m = len(s.v), s.n_splines
    bend = np.diff(np.eye(m), 2, axis=0)
    p = np.eye(size) * RIDGE * s.n
    for i in range(len(s.features)):
        at = slice(1 + i * m, 1 + (i + 1) * m)
        p[at, at] += penalty * bend.T @ bend
    inverse = np.linalg.inv(s.g + p)
    hat, w = inverse @ s.g, inverse @ s.v
    rss = max(float(s.yy - 2 * w @ s.v + w @ s.g @ w), 0.0)
    edf = float(np.trace(hat))
    left = max(s.n - edf, 1e-9)
    cov = rss / left * hat @ inverse
    ps, terms = [], []
    for i in range(len(s.features)):
        at = slice(1 + i * m, 1 + (i + 1) * m)
        centre = np.eye(m) - 1 / m
        beta, v = centre @ w[at], centre @ cov[at, at] @ centre
        values, vectors = np.linalg.eigh((v + v.T) / 2)
        use = values > values.max() * 1e-9 if values.max() > 0 else np.zeros(m, bool)
        rank = int(use.sum())
        stat = float((((vectors[:, use].T @ beta) ** 2) / values[use]).sum()) / rank if rank else 0.0
        ps.append(f_sf(stat, rank, left) if rank else 1.0)
        terms.append(float(np.trace(centre @ hat[at, at] @ centre)))
    return Fit(s, w, penalty, s.n * rss / left**2, rss, edf, terms, ps)


def fit(s: Sums, penalty: float | None = None) -> Fit:
    """§2: H12. With the penalty given, or the one of ``GRID`` with the least generalised cross-validation."""
    return solved(s, penalty) if penalty is not None else min((solved(s, x) for x in GRID), key=lambda f: f.gcv)


def compared(small: Fit, large: Fit) -> tuple[float, float]:
    """§2: H12. F and p of what the larger of two nested models explains beyond the smaller."""
    more, left = large.edf - small.edf, large.sums.n - large.edf
    if more <= 0 or left <= 0 or large.rss <= 0:
        return 0.0, 1.0
    f = (small.rss - large.rss) / more / (large.rss / left)
    return f, f_sf(f, more, left)
