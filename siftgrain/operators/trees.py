"""Tree ensembles from model files (§2: P9, S12): LightGBM's text format, as flat arrays that are evaluated over Arrow batches."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siftgrain.operators.predictors import Predictor

# The bits of a node's decision, and what counts as zero.
CATEGORICAL, DEFAULT_LEFT, ZERO_MISSING, NAN_MISSING = 1, 2, 1, 2
ZERO = float(np.float32(1e-35))
#: Bytes of a model file at most: it is read on the driver and sent to all workers.
MOST_BYTES = 256 << 20
#: Rows that walk the trees at a time.
BLOCK = 8192


@dataclass
class Ensemble:
    """Nodes of all trees in one row of arrays. A child below zero is the complement of a place in ``value``."""

    feature: np.ndarray
    threshold: np.ndarray
    decision: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: np.ndarray
    n_features: int
    classes: int = 1
    average: bool = False
    objective: str = "regression"
    #: Of node i, a categorical one: bits ``sets[i]`` say which categories go left.
    sets: dict[int, np.ndarray] = field(default_factory=dict)

    def goes_left(self, node: np.ndarray, v: np.ndarray) -> np.ndarray:
        kind = self.decision[node]
        missing, nan = (kind >> 2) & 3, np.isnan(v)
        x = np.where(nan & (missing != NAN_MISSING), 0.0, v)
        gone = ((missing == ZERO_MISSING) & (np.abs(x) <= ZERO)) | ((missing == NAN_MISSING) & nan)
        out = np.where(gone, (kind & DEFAULT_LEFT) > 0, x <= self.threshold[node])
        for i in np.unique(node[(kind & CATEGORICAL) > 0]).tolist():
            rows, bits = np.flatnonzero(node == i), self.sets[i]
            c = np.where(nan[rows], -1.0, np.trunc(v[rows]))
            known = (c >= 0) & (c < len(bits))
            out[rows] = known & bits[np.where(known, c, 0).astype(np.int64)]
        return out

    def raw(self, x: np.ndarray, trees: int | None = None) -> np.ndarray:
        """Sums of leaves, a column for each class; ``trees``: the first ones only."""
        out = np.zeros((len(x), self.classes))
        roots = self.root[:trees]
        for t, root in enumerate(roots.tolist()):
            at, rows = np.full(len(x), root, np.int64), np.arange(len(x) if root >= 0 else 0)
            while len(rows):
                node = at[rows]
                at[rows] = np.where(self.goes_left(node, x[rows, self.feature[node]]), self.left[node], self.right[node])
                rows = rows[at[rows] >= 0]
            out[:, t % self.classes] += self.value[~at]
        return out / max(1, len(roots) // self.classes) if self.average else out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Raw sums through the objective's link."""
        out, name = self.raw(x), self.objective.split()[0]
        named = dict(p.split(":", 1) for p in self.objective.split()[1:] if ":" in p)
        if name in ("binary", "cross_entropy", "multiclassova"):
            return 1 / (1 + np.exp(-float(named.get("sigmoid", 1)) * out))
        if name == "multiclass":
            e = np.exp(out - out.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)
        if name in ("poisson", "gamma", "tweedie"):
            return np.exp(out)
        return np.sign(out) * out * out if "sqrt" in self.objective.split()[1:] else out


def parsed(text: str) -> Ensemble:
    """A model from the text of its file. Trees with linear leaves raise; what isn't needed to score is ignored."""
    head, *sections = text.replace("\r\n", "\n").split("\nTree=")
    lines = head.split("\n")
    if not lines or lines[0].strip() != "tree":
        raise ValueError("not a tree model")
    keys = dict(x.split("=", 1) for x in lines if "=" in x)
    parts: dict[str, list[np.ndarray]] = {k: [] for k in ("feature", "threshold", "decision", "left", "right", "value")}
    roots, sets, nodes, leaves = [], {}, 0, 0
    for s in sections:
        t = dict(x.split("=", 1) for x in s.split("end of trees")[0].split("\n")[1:] if "=" in x)
        if int(t.get("is_linear", 0)):
            raise ValueError("linear leaves are not supported")
        numbers = lambda k, kind, t=t: np.array(t.get(k, "").split(), kind)
        n = int(t["num_leaves"]) - 1
        value = numbers("leaf_value", np.float64)
        got = {"feature": numbers("split_feature", np.int64), "threshold": numbers("threshold", np.float64), "decision": numbers("decision_type", np.int64), "left": numbers("left_child", np.int64), "right": numbers("right_child", np.int64)}
        if len(value) != n + 1 or any(len(a) != n for a in got.values()):
            raise ValueError("a tree's lists differ in length")
        # A leaf is the complement of its number, here of its place among all trees' leaves.
        for k in ("left", "right"):
            got[k] = np.where(got[k] >= 0, got[k] + nodes, got[k] - leaves)
        if int(t.get("num_cat", 0)):
            edge, words = numbers("cat_boundaries", np.int64), numbers("cat_threshold", np.int64).astype(np.uint32)
            for i in np.flatnonzero(got["decision"] & CATEGORICAL).tolist():
                a, b = edge[int(got["threshold"][i]) : int(got["threshold"][i]) + 2]
                sets[nodes + i] = np.unpackbits(words[a:b].view(np.uint8), bitorder="little").astype(bool)
        roots.append(nodes if n else ~leaves)
        for k, a in {**got, "value": value}.items():
            parts[k].append(a)
        nodes, leaves = nodes + n, leaves + n + 1
    kinds = {"threshold": np.float64, "value": np.float64}
    arrays = {k: np.concatenate(a) if a else np.zeros(0, kinds.get(k, np.int64)) for k, a in parts.items()}
    return Ensemble(
        **arrays, root=np.array(roots, np.int64), n_features=int(keys["max_feature_idx"]) + 1, classes=int(keys.get("num_tree_per_iteration", 1)),
        average="average_output" in lines, objective=keys.get("objective", "regression"), sets=sets,
    )


def written(model: Ensemble) -> str:
    """The model's file, without statistics; ``parsed`` gives the model back. Numerical splits only."""
    if model.sets:
        raise ValueError("categorical splits are not written")
    out = ["tree", "version=v4", f"num_class={model.classes}", f"num_tree_per_iteration={model.classes}", "label_index=0", f"max_feature_idx={model.n_features - 1}", f"objective={model.objective}"]
    out += ["average_output"] * model.average
    out += [f"feature_names={' '.join(f'Column_{i}' for i in range(model.n_features))}", ""]
    row = lambda a: " ".join(repr(x) for x in a.tolist())
    nodes = leaves = 0
    for i, root in enumerate(model.root.tolist()):
        after = [r for r in model.root[i + 1 :].tolist() if r >= 0]
        n = (after[0] if after else len(model.feature)) - nodes if root >= 0 else 0
        at, child = slice(nodes, nodes + n), lambda a, n0=nodes, l0=leaves: row(np.where(a >= 0, a - n0, a + l0))
        out += [f"Tree={i}", f"num_leaves={n + 1}", "num_cat=0"]
        out += [f"split_feature={row(model.feature[at])}", f"threshold={row(model.threshold[at])}", f"decision_type={row(model.decision[at])}", f"left_child={child(model.left[at])}", f"right_child={child(model.right[at])}"] * (n > 0)
        out += [f"leaf_value={row(model.value[leaves : leaves + n + 1])}", "is_linear=0", "shrinkage=1", ""]
        nodes, leaves = nodes + n, leaves + n + 1
    return "\n".join([*out, "end of trees", ""])


def load(spark: SparkSession, path: str, sha256: str | None = None) -> Ensemble:
    """A model file from any store that Spark reads; its digest is checked if one is given."""
    found = spark.read.format("binaryFile").load(path)
    sizes = [r.length for r in found.select("length").limit(2).collect()]
    if len(sizes) != 1 or sizes[0] > MOST_BYTES:
        raise ValueError(f"{path}: one file of at most {MOST_BYTES} bytes is wanted, not {sizes}")
    content = bytes(found.first().content)
    if sha256 and hashlib.sha256(content).hexdigest() != sha256:
        raise ValueError(f"{path}: another sha256")
    return parsed(content.decode())


def save(spark: SparkSession, model: Ensemble, path: str) -> None:
    """One file in a new folder, which ``load`` reads."""
    spark.createDataFrame([(written(model),)], "value string").coalesce(1).write.text(path)


def matrix(features: pa.Array, width: int) -> np.ndarray:
    """Rows of ``width`` numbers from lists: null or missing ones are NaN, those beyond are left out."""
    sizes = features.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = features.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    out = np.full((len(sizes), width), np.nan)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = at < width
    out[row[inside], at[inside]] = flat[inside]
    return out


def predictor(model: Ensemble, features: str = "features", out: str = "score") -> Predictor:
    """Adds ``out`` to rows that carry a feature array: a number, or an array of one for each class; null where the array is null."""
    kind = "double" if model.classes == 1 else "array<double>"

    @F.arrow_udf(kind)
    def score(x: pa.Array) -> pa.Array:
        at = range(0, len(x), BLOCK)
        got = np.concatenate([model.predict(matrix(x[i : i + BLOCK], model.n_features)) for i in at]) if len(x) else np.zeros((0, model.classes))
        if model.classes == 1:
            return pa.array(got[:, 0], mask=x.is_null().to_numpy(zero_copy_only=False))
        return pa.array([None if gone else row for gone, row in zip(x.is_null().to_pylist(), got.tolist(), strict=True)], pa.list_(pa.float64()))

    return lambda rows: rows.withColumn(out, score(F.col(features).cast("array<double>")))
