"""Preparing graded-answer datasets (§2: G1-G21, J13, J14). Answers sit in one array by level; '' is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftgrain.operators import graph
from siftgrain.operators.ordered import numbered, running
from siftgrain.session import checkpointed


def answers(*columns: str) -> Column:
    """§2: G1. Wide answer columns as one array, null as ''."""
    return F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def given(a: Column) -> Column:
    return F.filter(a, lambda x: x != "")


def per_level(df: DataFrame, a: str = "answers") -> DataFrame:
    """§2: G2. level and count of rows that have an answer there."""
    return df.select(F.posexplode(a).alias("p", "x")).filter("x <> ''").groupBy((F.col("p") + 1).alias("level")).agg(F.count("*").alias("n"))


def last_level(a: Column) -> Column:
    """§2: G3. The level of the last answer, 0 without any."""
    return F.array_max(F.concat(F.array(F.lit(0)), F.transform(a, lambda x, i: F.when(x != "", i + 1).otherwise(0))))


def has_duplicates(a: Column) -> Column:
    """§2: G4, G5."""
    return F.size(given(a)) != F.size(F.array_distinct(given(a)))


def has_gap(a: Column) -> Column:
    """§2: G7. An answer after a missing one."""
    return F.size(given(a)) < last_level(a)


def prepared(df: DataFrame, a: str = "answers", levels: int = 4) -> DataFrame:
    """§2: G5-G8. Rows without duplicates, gaps or answers past the levels; adds num_answers."""
    fine = ~has_duplicates(F.col(a)) & (last_level(F.col(a)) <= levels) & ~has_gap(F.col(a))
    return df.filter(fine).withColumn(a, F.slice(a, 1, levels)).withColumn("num_answers", F.size(given(F.col(a))))


def likert(position: Column, n: Column, levels: int = 4) -> Column:
    """§2: G11. A 0-based position among n on the scale 1..levels; 1 if it is alone."""
    return F.when(n > 1, 1 + position * (levels - 1.0) / (n - 1)).otherwise(F.lit(1.0))


def unpivoted(df: DataFrame, key: str = "id", a: str = "answers") -> DataFrame:
    """§2: G10, J5. key, level, answer and y (by position, gaps ignored)."""
    rows = df.select(key, F.size(given(F.col(a))).alias("n"), F.posexplode(given(F.col(a))).alias("p", "answer"))
    return rows.select(key, (F.col("p") + 1).alias("level"), "answer", likert(F.col("p"), F.col("n")).alias("y"))


def with_features(rows: DataFrame, features: DataFrame, key: str = "id") -> DataFrame:
    """§2: G12, G14. Features by (key, level), never by a formatted number."""
    return rows.join(features, [key, "level"])


def runs(df: DataFrame, order: list[str], key: str) -> DataFrame:
    """§2: G15. Lengths of runs of equal neighbours: run (from 0), key and size, in one order inside each partition of ``order[:-1]``."""
    part, last = order[:-1], order[-1]
    w = Window.partitionBy(*part).orderBy(last)
    new = F.when(F.lag(key).over(w).eqNullSafe(F.col(key)), 0).otherwise(1)
    marked = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return marked.groupBy(*part, "run", key).agg(F.count("*").alias("size"))


def rank_labels(df: DataFrame, group: str, y: str, tie: str) -> DataFrame:
    """§2: G16. Integer labels inside a group: the smallest gets the greatest."""
    w = Window.partitionBy(group)
    return df.withColumn("label", F.count("*").over(w) - F.row_number().over(w.orderBy(y, tie)))


def multi_level(df: DataFrame, answer: Column, level: str) -> DataFrame:
    """§2: G17. Answers that occur at more than one level."""
    return df.groupBy(answer.alias("answer")).agg(F.sort_array(F.collect_set(level)).alias("levels")).filter(F.size("levels") > 1)


def pivot_counts(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """§2: G18. Counts by two keys with a TOTAL row; missing combinations are 0."""
    both = df.select(row, column).unionByName(df.select(F.lit("TOTAL").alias(row), column))
    return both.groupBy(row).pivot(column, values).count().na.fill(0)


def counts_with_total(df: DataFrame, row: str, column: str) -> DataFrame:
    """§2: G18. The same in long form, for any number of columns: row, column and n for each combination of keys that occur, and for TOTAL."""
    seen = df.groupBy(row, column).agg(F.count("*").alias("n"))
    total = seen.groupBy(column).agg(F.sum("n").alias("n")).select(F.lit("TOTAL").alias(row), column, "n")
    # As many rows as the result has.
    every = seen.select(row).distinct().crossJoin(seen.select(column).distinct()).select(row, column, F.lit(0).cast("long").alias("n"))
    return seen.unionByName(total).unionByName(every).groupBy(row, column).agg(F.sum("n").alias("n"))


def level_spread(df: DataFrame, key: str, level: str) -> DataFrame:
    """§2: G19, G20. Count, mean and population variance of levels for each key, and its share of all rows."""
    total = df.select(F.count("*").alias("_all"))
    out = df.groupBy(key).agg(F.count("*").alias("n"), F.avg(level).alias("mean_level"), F.var_pop(level).alias("var_level"))
    return out.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def first_seen(a: Column) -> Column:
    """§2: J14. Items of an array whose trimmed lower-case form is new, trimmed, in order."""
    items = F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x != "")
    keys = F.transform(items, F.lower)
    return F.filter(F.transform(items, lambda x, i: F.when(F.array_position(keys, F.lower(x)) == i + 1, x)), lambda x: x.isNotNull())


def components(edges: DataFrame) -> DataFrame:
    """§2: G9. id and component (its least id) of ids that answers link; edges: id, answer. Each id is linked to the least one of its answer."""
    edges = edges.select("id", "answer")
    least = edges.filter("answer is not null").groupBy("answer").agg(F.min("id").alias("b"))
    found = graph.components(edges.join(least, "answer").select(F.col("id").alias("a"), "b"))
    ids = edges.select("id").filter("id is not null").distinct()
    return ids.join(found, ids["id"] == found["node"], "left").select("id", F.coalesce("component", "id").alias("component"))


def packed(sizes: DataFrame, shares: dict[str, float], key: str = "component", size: str = "n", seed: int = 42) -> DataFrame:
    """§2: G9. Adds split: sizes laid end to end, largest first and equal ones in the order of a hash, go where their middle falls.

    A split's end is missed by less than half of the size that lies across it;
    one that is larger than all shares after it leaves these empty. Places are
    sums by size, and by parts of equal sizes, so that no task orders all.
    """
    by_size = checkpointed(sizes.groupBy(size).agg(F.sum(size).alias("_rows")).withColumn("_order", -F.col(size)))
    before = running(by_size, "_order", "_rows", "_before").select(F.col(size).alias("_size"), "_before")
    order = [F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), F.col(key).cast("string")]
    placed = numbered(sizes, order, (size,), "_place").join(before, F.col(size) == F.col("_size"))
    middle = F.col("_before") + (F.col("_place") - 1) * F.col(size) + F.col(size) / 2
    total, end, split = sizes.agg(F.sum(size).alias("_all")), 0.0, None
    for name, share in list(shares.items())[:-1]:
        end += share
        here = middle < F.lit(round(end, 12)) * F.col("_all")
        split = F.when(here, name) if split is None else split.when(here, name)
    last = list(shares)[-1]
    out = placed.crossJoin(F.broadcast(total)).withColumn("split", split.otherwise(last) if split is not None else F.lit(last))
    return out.select(*sizes.columns, "split")


def leakage_free_split(edges: DataFrame, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """§2: G9, J13. id, component and split; ids that share an answer never part, and splits hold the shares of ids up to a component."""
    found = checkpointed(components(edges))
    sizes = checkpointed(found.groupBy("component").agg(F.count("*").alias("n")))
    return found.join(packed(sizes, {"train": train, "val": val, "test": 1 - train - val}, seed=seed).select("component", "split"), "component").select("id", "component", "split")


def shared_answers(rows: DataFrame) -> DataFrame:
    """§2: J13. One row: answers, and shared, those in more than one split; rows: split, answer."""
    each = rows.filter("answer is not null").groupBy("answer").agg(F.min("split").alias("a"), F.max("split").alias("b"))
    return each.agg(F.count("*").alias("answers"), F.count_if(F.col("a") != F.col("b")).alias("shared"))


def disjoint(rows: DataFrame) -> bool:
    """§2: J13. Whether no answer is in two splits; rows: split, answer."""
    return shared_answers(rows).first()["shared"] == 0
