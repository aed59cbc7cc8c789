"""Pooling of unit scores to scopes and texts (§2: A1-A14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgrain.functions.text import clean
from siftgrain.session import stored

from .percentile import bucket, percentile_rank
from .split import scopes, split_scopes, unit_rows, units

# Fixed value: the score of a scope without units.
NO_FACT = 5.0
POOLS = ("sum", "min", "max", "mean", "lower_quantile_mean", "weighted_mean")


def validate(pool: str, scope_pool: str, tail: float, scope_tail: float) -> None:
    """§2: A11. Fails early, on the driver."""
    for name in (pool, scope_pool):
        if name not in POOLS:
            raise ValueError(f"unknown pooling: {name}")
    if pool == "weighted_mean":
        raise ValueError("weighted_mean pools scopes, not units")
    for name, q in ((pool, tail), (scope_pool, scope_tail)):
        if name == "lower_quantile_mean" and not 0 < q <= 1:
            raise ValueError("a tail share lies in (0, 1]")


def lower_mean(scores: Column, q: float) -> Column:
    """§2: A4. The mean of the lowest share of an array, at least of one score."""
    k = F.greatest(F.lit(1), F.ceil(F.size(scores) * F.lit(float(q)))).cast("int")
    return F.aggregate(F.slice(F.sort_array(scores), 1, k), F.lit(0.0), lambda a, x: a + x) / k


def pooled(pool: str, score: str, tail: float, weight: str | None = None) -> Column:
    """§2: A1-A5. The aggregate of a pool over a group of scores."""
    s = F.col(score)
    if pool == "lower_quantile_mean":
        return lower_mean(F.collect_list(s), tail)
    if pool == "weighted_mean":
        return F.sum(s * F.col(weight)) / F.sum(weight)
    return {"sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg}[pool](s)


def array_pool(scores: Column, pool: str, tail: float = 0.5) -> Column:
    """§2: A1-A4 over an array of scores: stateless, so it also runs on streams."""
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    value = {"sum": total, "min": F.array_min(scores), "max": F.array_max(scores), "mean": total / F.size(scores)}.get(pool)
    return F.when(F.size(scores) > 0, lower_mean(scores, tail) if value is None else value).otherwise(F.lit(NO_FACT))


def by_row(predictor):
    """The expression that a predictor is, if it is no more."""
    return getattr(predictor, "by_row", None)


def score_units(rows: DataFrame, predictor) -> DataFrame:
    """Scores each distinct unit once and joins back (§2: A8); by expression, if that is all a predictor is."""
    if by_row(predictor):
        return predictor(rows)
    distinct = rows.filter("unit is not null").select("unit").distinct()
    return rows.join(predictor(distinct), "unit", "left")


def split_rows(docs: DataFrame, key: str = "doc_id", scope: str = "sentence", scope_text: bool = False) -> DataFrame:
    """A row for each unit, with a number of its text (``text_row``), written once: the distinct units and the scores read it.

    ``scope_text`` stands in a scope's first row alone, if it is asked for.
    """
    rows = docs.select(key, "text", F.monotonically_increasing_id().alias("text_row"))
    rows = unit_rows(split_scopes(rows, scope).drop("text"))
    first = [F.when(F.coalesce("unit_pos", F.lit(0)) == 0, F.col("scope_text")).alias("scope_text")] if scope_text else []
    return stored(rows.select(key, "text_row", "scope_index", *first, "unit"))


def score_texts(
    docs: DataFrame,
    predictor,
    reference: DataFrame | None = None,
    *,
    key: str = "doc_id",
    scope: str = "sentence",
    pool: str = "mean",
    scope_pool: str = "lower_quantile_mean",
    tail: float = 0.5,
    scope_tail: float = 0.8,
    before_pooling: bool = True,
    details: bool = False,
) -> DataFrame:
    """§2: A6-A10. key, score, percentile and bucket of every text; rows are texts of their own, whether or not they share a key.

    predictor: a function that adds ``score`` to a table of ``unit``. With a
    reference (score), percentiles are taken of units before pooling or of the
    texts' scores after it; without one, percentile and bucket are null.
    """
    validate(pool, scope_pool, tail, scope_tail)
    if by_row(predictor) and reference is None:
        return unranked(score_arrays(docs, by_row(predictor), key, scope, pool, scope_pool, tail, scope_tail, details))
    return score_rows(split_rows(docs, key, scope, details), predictor, reference, key=key, pool=pool, scope_pool=scope_pool, tail=tail, scope_tail=scope_tail, before_pooling=before_pooling, details=details)


def unranked(out: DataFrame) -> DataFrame:
    return out.withColumn("percentile", F.lit(None).cast("double")).withColumn("bucket", F.lit(None).cast("string"))


def score_arrays(docs: DataFrame, score, key: str, scope: str, pool: str, scope_pool: str, tail: float, scope_tail: float, details: bool) -> DataFrame:
    """``score_rows`` for a predictor by expression and without a reference: a text stays one row, and nothing is shuffled or written."""
    known = lambda u: F.struct(u.alias("unit"), F.coalesce(score(u), F.lit(NO_FACT)).alias("score"))
    parts = F.transform(scopes(clean(F.coalesce(F.col("text"), F.lit(""))), scope), lambda s: F.struct(s.alias("t"), F.transform(units(s), known).alias("u")))
    rows = _barrier(docs.select(key, "text"), "z", parts)
    scores = lambda s: F.when(F.size(s["u"]) > 0, s["u"]["score"]).otherwise(F.array(F.lit(NO_FACT)))
    rows = _barrier(rows, "v", F.transform("z", lambda s: F.struct(scores(s).alias("s"))))
    rows = _barrier(rows, "p", F.transform("v", lambda x: F.struct(array_pool(x["s"], pool, tail).alias("v"), F.size(x["s"]).cast("double").alias("w"))))
    if scope_pool == "weighted_mean":
        total = lambda f: F.aggregate("p", F.lit(0.0), lambda a, x: a + f(x))
        value = total(lambda x: x["v"] * x["w"]) / total(lambda x: x["w"])
    else:
        value = array_pool(F.col("p")["v"], scope_pool, scope_tail)
    pairs = lambda s: F.map_from_entries(F.array_sort(F.array_distinct(s["u"])))
    listed = lambda s, i: F.struct(i.alias("scope_index"), s["t"].alias("scope_text"), F.get("p", i)["v"].alias("scope_score"), pairs(s).alias("unit_scores"))
    return rows.select(key, value.alias("score"), *([F.transform("z", listed).alias("scopes")] if details else []))


def score_rows(
    units: DataFrame,
    predictor,
    reference: DataFrame | None = None,
    *,
    key: str = "doc_id",
    pool: str = "mean",
    scope_pool: str = "lower_quantile_mean",
    tail: float = 0.5,
    scope_tail: float = 0.8,
    before_pooling: bool = True,
    details: bool = False,
) -> DataFrame:
    """``score_texts`` from a table of ``split_rows``."""
    validate(pool, scope_pool, tail, scope_tail)
    rows = score_units(units, predictor)
    rows = rows.withColumn("score", F.coalesce("score", F.lit(NO_FACT)))
    early = reference is not None and before_pooling
    if early:
        rows = percentile_rank(rows, reference).withColumn("raw", F.col("score")).withColumn("score", F.col("percentile")).drop("percentile")
    extra = []
    if details:
        pairs = F.filter(F.collect_list(F.struct("unit", "score")), lambda x: x["unit"].isNotNull())
        extra = [F.max("scope_text").alias("scope_text"), F.map_from_entries(F.array_sort(F.array_distinct(pairs))).alias("unit_scores")]
    by_scope = rows.groupBy("text_row", key, "scope_index").agg(pooled(pool, "score", tail).alias("scope_score"), F.count("*").alias("weight"), *extra)
    if details:
        extra = [F.collect_list(F.struct("scope_index", "scope_text", "scope_score", "unit_scores")).alias("scopes")]
    out = by_scope.groupBy("text_row", key).agg(pooled(scope_pool, "scope_score", scope_tail, "weight").alias("score"), *extra).drop("text_row")
    if reference is None:
        return unranked(out)
    out = out.withColumn("percentile", F.col("score")) if early else percentile_rank(out, reference)
    return out.withColumn("bucket", bucket(F.col("percentile")))


def score_unsplit(docs: DataFrame, predictor, key: str = "doc_id", reference: DataFrame | None = None) -> DataFrame:
    """§2: A10. Texts scored as they are, as one unit: key and score; with a reference also percentile and bucket."""
    out = score_units(docs.select(key, F.col("text").alias("unit")), predictor).select(key, "score")
    return out if reference is None else percentile_rank(out, reference).withColumn("bucket", bucket(F.col("percentile")))


def sweep_names() -> list[tuple[str, str, float, str, float]]:
    """§2: A14. (scope, pool, tail, scope pool, scope tail) of the 63 configurations."""
    inner = [("sum", 0.5), ("min", 0.5), ("max", 0.5), ("mean", 0.5), *[("lower_quantile_mean", q) for q in (0.1, 0.5, 0.8)]]
    outer = [*inner, ("weighted_mean", 0.5)]
    return [("sentence", *i, *o) for o in outer for i in inner] + [("document", *i, "mean", 0.5) for i in inner]


def sweep(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """§2: A14. All configurations from one table of scored units (key, scope_index, score): a pass to scopes, a pass to texts.

    key, config (its number in ``sweep_names``) and value.
    """
    configs = sweep_names()
    inner = list(dict.fromkeys((p, q) for _, p, q, _, _ in configs))
    # Each group's scores are gathered and sorted once; every pool reads the sorted array.
    ordered = scored.groupBy(key, "scope_index").agg(F.sort_array(F.collect_list("score")).alias("s"))
    scopes = ordered.select(key, F.struct(F.size("s").cast("double").alias("w"), "s", *[sorted_pool(F.col("s"), p, q).alias(f"i{n}") for n, (p, q) in enumerate(inner)]).alias("z"))
    whole = _barrier(scopes.groupBy(key).agg(F.collect_list("z").alias("z")), "d", F.sort_array(F.flatten(F.transform("z", lambda x: x["s"]))))
    for n in range(len(inner)):
        whole = _barrier(whole, f"i{n}", F.sort_array(F.transform("z", _field(f"i{n}"))))

    def value(scope: str, p: str, q: float, o: str, oq: float) -> Column:
        n = inner.index((p, q))
        if scope == "document":
            return sorted_pool(F.col("d"), p, q)
        if o == "weighted_mean":
            total = lambda f: F.aggregate("z", F.lit(0.0), lambda a, x: a + f(x))
            return total(lambda x: x[f"i{n}"] * x["w"]) / total(lambda x: x["w"])
        return sorted_pool(F.col(f"i{n}"), o, oq)

    values = [F.struct(F.lit(n).alias("config"), value(*c).alias("value")) for n, c in enumerate(configs)]
    return whole.select(key, F.explode(F.array(*values)).alias("v")).select(key, "v.config", "v.value")


def _field(name: str):
    return lambda x: x[name]


def _barrier(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column behind a generator of one row, so that what reads it doesn't work it out again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def sorted_pool(scores: Column, pool: str, tail: float) -> Column:
    """§2: A1-A4 over a sorted array that isn't empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    if pool == "lower_quantile_mean":
        k = F.greatest(F.lit(1), F.ceil(F.size(scores) * F.lit(float(tail)))).cast("int")
        return total(F.slice(scores, 1, k)) / k
    return {"sum": lambda: total(scores), "min": lambda: scores[0], "max": lambda: F.element_at(scores, -1), "mean": lambda: total(scores) / F.size(scores)}[pool]()
