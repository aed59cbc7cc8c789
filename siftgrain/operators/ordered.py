"""Running sums and numbers over a whole table without one task that holds it: parts by value or hash, offset by their sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BEFORE = (Window.unboundedPreceding, -1)


def _offset(placed: DataFrame, groups: list[str], value: Column) -> DataFrame:
    """_base: the sum of what lies in the parts before; a row for each part."""
    sums = placed.groupBy(*groups, "_part").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(*_BEFORE)
    return sums.select(*groups, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))


def part_of(value: Column, cuts: list[float], alone: bool = False) -> Column:
    """How many of the sorted cuts lie below a number, by bisection. ``alone``: numbers that equal a cut have parts of their own, at odd places."""
    held = np.array(cuts, np.float64)
    if not len(held):
        return F.lit(0)

    @F.arrow_udf("int")
    def place(x: pa.Array) -> pa.Array:
        x = x.to_numpy(zero_copy_only=False)
        at = np.searchsorted(held, x)
        return pa.array((at + np.searchsorted(held, x, "right") if alone else at).astype(np.int32))

    return place(value.cast("double"))


def running(df: DataFrame, order: str, value: str, out: str, groups: list[str] | None = None) -> DataFrame:
    """Adds the sum of ``value`` over the rows before (of the group), in the order of the numbers ``order``, which differ.

    Cuts between parts are approximate quantiles over all groups, at most one
    for each shuffle partition. ``df`` is read three times: materialise it if
    it is dear.
    """
    groups = groups or []
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / n for i in range(1, n)] or [1.0]
    cuts = sorted(set(df.agg(F.percentile_approx(order, shares).alias("q")).first()["q"] or []))
    placed = df.withColumn("_part", part_of(F.col(order), cuts))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(*groups, "_part").orderBy(order).rowsBetween(*_BEFORE)), F.lit(0))
    met = _null_safe(placed.withColumn("_inside", inside), _offset(placed, groups, F.col(value)), [*groups, "_part"])
    return met.withColumn(out, F.col("_base") + F.col("_inside")).drop("_part", "_base", "_inside")


def numbered(df: DataFrame, order: list[Column], groups: tuple[str, ...] = (), out: str = "number", digits: int = 2) -> DataFrame:
    """Adds a row's place from 1 in its group, in the order of ``order``, whose first column is a hash in hexadecimal digits: its first ones deal the rows."""
    placed = df.withColumn("_part", F.substring(order[0], 1, digits))
    inside = F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(*order))
    met = _null_safe(placed.withColumn("_inside", inside), _offset(placed, list(groups), F.lit(1)), [*groups, "_part"])
    return met.withColumn(out, F.col("_base") + F.col("_inside")).drop("_part", "_base", "_inside")


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    named = right.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], "_base")
    on = [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)]
    met = on[0]
    for c in on[1:]:
        met = met & c
    # A row for each part of each group.
    return left.join(F.broadcast(named) if len(keys) == 1 else named, met).drop(*[f"_r{i}" for i in range(len(keys))])
