"""Ranking-quality metrics (§2: M1-M14, J9, W18). Pairs are counted in groups; the global metric never forms them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftgrain.functions.text import fixed
from siftgrain.operators import stats
from siftgrain.operators.ordered import part_of
from siftgrain.session import checkpointed, stored


def finite(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return df


def pairs(df: DataFrame, group: str, order: str, gold: str, pred: str) -> DataFrame:
    """§2: J9, W18. Comparable pairs inside groups: gold_i, gold_j, pred_i, pred_j with gold different."""
    rows = finite(df, gold, pred).select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(gold).alias("y"), F.col(pred).alias("p"))
    a, b = rows.alias("a"), rows.alias("b")
    met = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.o") < F.col("b.o")) & (F.col("a.y") != F.col("b.y")))
    return met.select(F.col("a.g").alias(group), F.col("a.y").alias("gold_i"), F.col("b.y").alias("gold_j"), F.col("a.p").alias("pred_i"), F.col("b.p").alias("pred_j"))


def right() -> Column:
    return ((F.col("pred_i") - F.col("pred_j")) * (F.col("gold_i") - F.col("gold_j")) > 0).cast("int")


def group_accuracy(df: DataFrame, group: str, order: str, gold: str, pred: str) -> DataFrame:
    """§2: M1, M2. Of each group with a comparable pair: accuracy and 2 * accuracy - 1. Ties of predictions are wrong."""
    return pairs(df, group, order, gold, pred).groupBy(group).agg(F.avg(right()).alias("accuracy")).withColumn("scaled", 2 * F.col("accuracy") - 1)


def group_accuracies(df: DataFrame, group: str, order: str, gold: str, preds: dict[str, str]) -> DataFrame:
    """§2: M1. ``group_accuracy`` of several predictions (names: columns) over pairs that are formed once; null where a prediction has no comparable pair."""
    number = lambda p: F.when(~F.isnan(F.col(p).cast("double")), F.col(p))
    rows = finite(df, gold).select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(gold).alias("y"), *[number(p).alias(f"p_{n}") for n, p in preds.items()])
    a, b = rows.alias("a"), rows.alias("b")
    met = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.o") < F.col("b.o")) & (F.col("a.y") != F.col("b.y")))
    won = lambda n: ((F.col(f"a.p_{n}") - F.col(f"b.p_{n}")) * (F.col("a.y") - F.col("b.y")) > 0).cast("int")
    return met.groupBy(F.col("a.g").alias(group)).agg(*[F.avg(won(n)).alias(n) for n in preds])


def intra_summary(df: DataFrame, group: str, order: str, gold: str, pred: str) -> DataFrame:
    """§2: M6, M7, M13. Mean accuracy over groups (-1 without any) and the share of groups that are all right."""
    return group_accuracy(df, group, order, gold, pred).agg(*_summary())


def _summary() -> list[Column]:
    return [F.coalesce(F.avg("accuracy"), F.lit(-1.0)).alias("mean_accuracy"), (F.sum((F.col("accuracy") == 1).cast("int")) / F.nullif(F.count("accuracy"), F.lit(0))).alias("all_right")]


def growing_pairs(y: np.ndarray, p: np.ndarray, n: np.ndarray) -> int:
    """How many pairs of rows (each stands for n) have both y and p smaller in one of them. Levels are read bit by bit: a pair differs first at one."""
    level, place = np.unique(y, return_inverse=True)[1], np.unique(p, return_inverse=True)[1]
    order = np.argsort(place, kind="stable")
    level, place, n = level[order], place[order], n[order].astype(np.int64)
    won = 0
    for bit in range(int(level.max()).bit_length() if len(level) else 0):
        order = np.argsort(level >> (bit + 1), kind="stable")
        group, q, one = level[order] >> (bit + 1), place[order], (level[order] >> bit & 1).astype(bool)
        before = np.r_[0, np.cumsum(np.where(one, 0, n[order]))[:-1]]
        new = np.r_[True, group[1:] != group[:-1]]
        first, run = (np.maximum.accumulate(np.where(x, np.arange(len(q)), 0)) for x in (new, new | np.r_[True, q[1:] != q[:-1]]))
        won += int((n[order] * (before[run] - before[first]))[one].sum())
    return won


def _won(rows: DataFrame, part: str, y: str, p: str) -> DataFrame:
    """won: ``growing_pairs`` of each part, as y, p and n say."""

    def counted(t: pa.Table) -> pa.Table:
        columns = [t.column(c).to_numpy() for c in (y, p, "n")]
        return pa.table({"won": pa.array([growing_pairs(*columns)], pa.int64())})

    return rows.groupBy(part).applyInArrow(counted, "won long")


def _cuts(rows: DataFrame, column: str, parts: int) -> list[float]:
    return sorted(set(rows.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)] or [1.0]).alias("q")).first()["q"] or []))


def global_accuracy(df: DataFrame, gold: str, pred: str, weight: str | None = None) -> DataFrame:
    """§2: M3, N7. Accuracy over all pairs of different gold, by counting.

    Rows are reduced to (level, prediction) counts and dealt by ranges of
    predictions. Pairs inside a range are counted there; of the others only
    the levels and the ranges matter, which are dealt by ranges of levels in
    the same way; pairs that differ in both ranges are counted from a row for
    each pair of ranges. Costs what sorting the counts does.
    ``weight``: a column that says how many rows a row stands for.
    """
    number = lambda c: (F.col(c).cast("double") + 0.0)
    n = F.count("*") if weight is None else F.sum(weight)
    counts = stored(finite(df, gold, pred).groupBy(number(gold).alias("y"), number(pred).alias("p")).agg(n.cast("long").alias("n")))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Predictions that equal a cut are a range of their own, inside which nothing is right: no task meets a frequent one.
    at = part_of(F.col("p"), cuts := _cuts(counts, "p", parts), True)
    placed = counts.withColumn("at", at.cast("long"))
    inside = _won(placed.filter(F.col("at") % 2 == 0) if cuts else placed, "at", "y", "p")
    reduced = stored(placed.groupBy("y", "at").agg(F.sum("n").alias("n")))
    dealt = reduced.withColumn("to", part_of(F.col("y"), cuts := _cuts(reduced, "y", parts), True).cast("long"))
    across = _won(dealt.filter(F.col("to") % 2 == 0) if cuts else dealt, "to", "y", "at")
    # A row for each pair of ranges.
    both = _won(dealt.groupBy("to", "at").agg(F.sum("n").alias("n")).withColumn("all", F.lit(0)), "all", "to", "at")
    won = inside.unionByName(across).unionByName(both).agg(F.sum("won").alias("won"))
    big = lambda c: c.cast("decimal(19,0)")
    levels = reduced.groupBy("y").agg(F.sum("n").alias("n"))
    every = levels.agg(F.sum("n").alias("s"), F.sum(big(F.col("n")) * big(F.col("n"))).alias("q"))
    every = every.select(F.nullif(((big(F.col("s")) * big(F.col("s")) - F.col("q")) / 2).cast("long"), F.lit(0)).alias("all"))
    return won.crossJoin(every).select((F.col("won") / F.col("all")).alias("accuracy"), F.col("all").alias("n_pairs"))


def kendall_tau_b(df: DataFrame, group: str, order: str, gold: str, pred: str, accuracy: bool = False) -> DataFrame:
    """§2: M4. tau-b of each group; null where one side is constant. With ``accuracy`` the group's accuracy too, null without a comparable pair."""
    rows = finite(df, gold, pred).select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(gold).alias("y"), F.col(pred).alias("p"))
    a, b = rows.alias("a"), rows.alias("b")
    met = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.o") < F.col("b.o")))
    s = F.signum(F.col("a.y").cast("double") - F.col("b.y")) * F.signum(F.col("a.p").cast("double") - F.col("b.p"))
    sums = met.groupBy(F.col("a.g").alias(group)).agg(F.sum(s).alias("s"), F.count("*").alias("n0"), F.sum((F.col("a.y") == F.col("b.y")).cast("int")).alias("n1"), F.sum((F.col("a.p") == F.col("b.p")).cast("int")).alias("n2"), F.sum((s > 0).cast("int")).alias("right"))
    below = F.sqrt((F.col("n0") - F.col("n1")).cast("double") * (F.col("n0") - F.col("n2")))
    right_ = [(F.col("right") / F.nullif(F.col("n0") - F.col("n1"), F.lit(0))).alias("accuracy")] if accuracy else []
    return sums.select(group, F.when(below > 0, F.col("s") / below).alias("tau"), *right_)


def kendall_tau_global(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """§2: M4. tau-b over all rows, by counting as ``global_accuracy`` does: tau and n_pairs (of different gold); null where one side is constant."""
    counts = checkpointed(finite(df, gold, pred).groupBy(F.col(gold).alias("y"), F.col(pred).alias("p")).agg(F.count("*").alias("n")))
    two = lambda c: c * (c - 1) / 2
    n = F.col("n").cast("double")
    tied = lambda key, name: counts.groupBy(key).agg(F.sum(n).alias("s")).agg(F.sum(two(F.col("s"))).alias(name))
    sums = counts.agg(two(F.sum(n)).alias("n0"), F.sum(two(n)).alias("n12"))
    met = sums.crossJoin(tied("y", "n1")).crossJoin(tied("p", "n2")).crossJoin(global_accuracy(counts, "y", "p", "n"))
    # Pairs of different gold are right, wrong or tied in their predictions.
    won = F.col("accuracy") * F.col("n_pairs")
    lost = F.col("n_pairs") - won - (F.col("n2") - F.col("n12"))
    below = F.sqrt((F.col("n0") - F.col("n1")) * (F.col("n0") - F.col("n2")))
    return met.select(F.when(below > 0, (won - lost) / below).alias("tau"), "n_pairs")


def level_pairs(df: DataFrame, group: str, order: str, gold: str, pred: str) -> DataFrame:
    """§2: M10. Of each pair of levels i < j, over the pairs inside groups: n, mean predictions, direction, Wilcoxon's z and p that i's are less (exact for few pairs), and whether p < 0.01."""
    met = pairs(df, group, order, gold, pred)
    up = F.col("gold_i") < F.col("gold_j")
    pick = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    rows = met.select(F.least("gold_i", "gold_j").alias("i"), F.greatest("gold_i", "gold_j").alias("j"), pick("pred_i", "pred_j").alias("a"), pick("pred_j", "pred_i").alias("b"))
    means = rows.groupBy("i", "j").agg(F.count("*").alias("n"), F.avg("a").alias("mean_i"), F.avg("b").alias("mean_j"))
    tested = stats.wilcoxon(rows, F.col("a") - F.col("b"), ["i", "j"], "less").select("i", "j", "z", "p")
    out = means.join(tested, ["i", "j"], "left")
    return out.withColumn("direction", F.when(F.col("mean_i") < F.col("mean_j"), "i<j").otherwise("i>j")).withColumn("significant", F.coalesce(F.col("p") < 0.01, F.lit(False)))


def level_means(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """§2: M8, M9. Mean prediction and coverage (share of predictions that are numbers) of each level."""
    real = F.col(pred).isNotNull() & ~F.isnan(F.col(pred).cast("double"))
    return df.groupBy(gold).agg(F.avg(F.when(real, F.col(pred))).alias("mean_pred"), (F.avg(real.cast("int")) * 100).alias("coverage"))


def adapted(kind: str, pred: Column) -> Column:
    """§2: M12. Predictions as they are, or inverted ones (length, depth, distance to the origin)."""
    return -pred if kind in ("inverted", "dist0", "length") else pred


def rounded(c: Column, digits: int = 4) -> Column:
    """§2: M14. Half to even."""
    return F.bround(c, digits)


def evaluation(df: DataFrame, group: str, order: str, gold: str, pred: str) -> DataFrame:
    """§2: M5, M11, L6. One row of metrics."""
    overall = global_accuracy(df, gold, pred).withColumnRenamed("accuracy", "global_accuracy")
    # Pairs are formed once, for tau and for accuracies.
    groups = kendall_tau_b(df, group, order, gold, pred, True)
    tau = groups.agg(F.avg("tau").alias("mean_tau"), *_summary())
    pearson = finite(df, gold, pred).agg(F.corr(F.col(gold).cast("double"), F.col(pred).cast("double")).alias("pearson"))
    return overall.crossJoin(tau).crossJoin(pearson)


def ranking_table(results: DataFrame, name: str, value: str) -> DataFrame:
    """§2: K7, W11, W12. rank, name, value and a mark for best and second, as report lines."""
    rank = F.row_number().over(Window.orderBy(F.desc(value), name))
    out = results.select(rank.alias("rank"), name, value)
    mark = F.when(F.col("rank") == 1, "best").when(F.col("rank") == 2, "second")
    return out.withColumn("mark", mark).withColumn("line", F.concat(F.format_string("%d. %s: ", "rank", name), fixed(F.col(value))))
