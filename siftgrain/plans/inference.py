"""Queries for model files, boosted orders, bootstraps, capacity splits and exact tests, over whole tables, and their DuckDB twins."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftgrain.operators import boosting, gam, qa, resampling, stats, trees
from siftgrain.operators import dataset as ds
from siftgrain.plans.catalogue import normal_sf_sql, query, r6, table
from siftgrain.plans.single import folder
from siftgrain.sources import files

#: A model made by hand: two trees with both kinds of missing values, one that splits by categories, and one leaf.
MODEL = """tree
version=v4
num_class=1
num_tree_per_iteration=1
label_index=0
max_feature_idx=65
objective=regression
feature_names=none

Tree=0
num_leaves=4
num_cat=0
split_feature=0 1 64
threshold=0.05 -0.1 3.5
decision_type=2 8 10
left_child=1 -1 -3
right_child=2 -2 -4
leaf_value=0.25 -0.5 1.5 2.25
is_linear=0
shrinkage=1


Tree=1
num_leaves=3
num_cat=1
split_feature=64 63
threshold=0 0.015625
decision_type=1 0
left_child=1 -2
right_child=-1 -3
leaf_value=-0.75 0.125 0.0625
cat_boundaries=0 2
cat_threshold=42 1
is_linear=0
shrinkage=0.1


Tree=2
num_leaves=1
num_cat=0
split_feature=
threshold=
decision_type=
left_child=
right_child=
leaf_value=10
is_linear=0
shrinkage=1


Tree=3
num_leaves=3
num_cat=0
split_feature=65 2
threshold=1 0
decision_type=6 4
left_child=-1 -2
right_child=1 -3
leaf_value=0.001 0.002 0.004
is_linear=0
shrinkage=1


end of trees

parameters:
end of parameters
"""


@query("""WITH f AS (SELECT vec_id, embedding::DOUBLE[] AS e, CASE WHEN vec_id % 7 <> 0 THEN label::DOUBLE END AS c, (vec_id % 3)::DOUBLE AS z FROM embeddings)
SELECT vec_id, round(CASE WHEN e[1] <= 0.05 THEN (CASE WHEN e[2] <= -0.1 THEN 0.25 ELSE -0.5 END) ELSE (CASE WHEN c IS NULL OR c <= 3.5 THEN 1.5 ELSE 2.25 END) END
  + CASE WHEN c IN (1, 3, 5, 32) THEN (CASE WHEN e[64] <= 0.015625 THEN 0.125 ELSE 0.0625 END) ELSE -0.75 END + 10
  + CASE WHEN z = 0 OR z <= 1 THEN 0.001 WHEN e[3] <> 0 AND e[3] <= 0 THEN 0.002 ELSE 0.004 END, 6) AS score FROM f""")
def tree_file_scores(spark: SparkSession, sf: str) -> DataFrame:
    """§2: P9, S12, S14: a model file is written, found behind one that differs, read through Spark, and scores every vector."""
    root = folder(spark)
    for place, text in (("cache", MODEL.replace("0.25", "0.26")), ("bundled", MODEL)):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{root}/{place}/model")
    # Spark's writer ends the text with one more line end.
    path = files.resolved(spark, "model", [f"{root}/none", f"{root}/cache", f"{root}/bundled"], hashlib.sha256(f"{MODEL}\n".encode()).hexdigest())
    more = F.array(F.when(F.col("vec_id") % 7 != 0, F.col("label").cast("double")), (F.col("vec_id") % 3).cast("double"))
    rows = table(spark, sf, "embeddings").select("vec_id", F.concat(F.col("embedding").cast("array<double>"), more).alias("features"))
    return trees.predictor(trees.load(spark, path))(rows).select("vec_id", r6(F.col("score"), "score"))


def drawn(rows: str, resamples: int) -> str:
    """Rows of a twin's table, with k, once for each resample b in which they count, and how often (w)."""
    return f"(SELECT * FROM (SELECT *, {resampling.weights_sql('k', 'b')} AS w FROM {rows}, range({resamples}) AS r(b)) WHERE w > 0)"


_LINES = "(SELECT l_orderkey * 8 + l_linenumber AS k, * FROM lineitem)"


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").withColumn("k", F.col("l_orderkey").cast("long") * 8 + F.col("l_linenumber"))


@query(f"SELECT b::INTEGER AS resample, sum(w)::BIGINT AS n, round(sum(w * l_quantity::DOUBLE) / sum(w), 6) AS mean_l_quantity, round(sum(w * l_discount::DOUBLE) / sum(w), 6) AS mean_l_discount FROM {drawn(_LINES, 25)} GROUP BY b")
def resampled_means(spark: SparkSession, sf: str) -> DataFrame:
    """§2: H15: means of all lines in each of 25 resamples."""
    out = resampling.poisson_means(lines(spark, sf), "k", ["l_quantity", "l_discount"], 25)
    return out.select("resample", "n", r6(F.col("mean_l_quantity"), "mean_l_quantity"), r6(F.col("mean_l_discount"), "mean_l_discount"))


_GAP = "(SELECT l_orderkey * 8 + l_linenumber AS k, l_quantity / 50::DOUBLE - l_extendedprice::DOUBLE / 100000 AS d FROM lineitem)"


@query(f"""WITH m AS (SELECT b, sum(w * d) / sum(w) AS m FROM {drawn(_GAP, 40)} GROUP BY b)
SELECT (SELECT round(avg(d), 6) FROM {_GAP}) AS difference, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(avg((m <= 0)::INT), 6) AS p, (SELECT count(*) FROM lineitem) AS n FROM m""")
def mean_difference_test(spark: SparkSession, sf: str) -> DataFrame:
    """§2: H1."""
    rows = lines(spark, sf).select("k", (F.col("l_quantity") / 50).alias("a"), (F.col("l_extendedprice") / 100000).alias("b"))
    out = resampling.mean_difference(rows, "k", "a", "b", 40)
    return out.select(*[r6(F.col(c), c) for c in ("difference", "low", "high", "p")], "n")


@query(f"""WITH e AS (SELECT event_id AS k, event_type, value::DOUBLE AS value FROM events WHERE value IS NOT NULL), m AS (SELECT event_type, b, sum(w * value) / sum(w) AS m FROM {drawn("e", 30)} GROUP BY ALL)
SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, count(value) AS n, any_value(deviation) AS deviation
FROM events JOIN (SELECT event_type, round(stddev_pop(m), 6) AS deviation FROM m GROUP BY 1) USING (event_type) GROUP BY event_type""")
def events_level_deviation(spark: SparkSession, sf: str) -> DataFrame:
    """§2: W19, H15: statistics of each level, and the deviation of its mean over resamples."""
    out = qa.described(table(spark, sf, "events"), "value", "event_type", key="event_id", resamples=30)
    return out.select("event_type", *[r6(F.col(c), c) for c in ("mean", "std", "min", "max")], "n", r6(F.col("deviation"), "deviation"))


def _accuracy_sql(pred: str, rows: str = "d") -> str:
    sums = ", ".join(f"coalesce(sum(w) FILTER (y = {i}), 0) AS s{i}" for i in range(1, 6))
    before = " + ".join(f"s{i} * coalesce(sum({' + '.join(f's{j}' for j in range(1, i))}) OVER x, 0)" for i in range(2, 6))
    return f"(SELECT b, sum(won) AS won FROM (SELECT b, {before} AS won FROM (SELECT b, {pred} AS p, {sums} FROM {rows} GROUP BY ALL) WINDOW x AS (PARTITION BY b ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) GROUP BY b)"


@query(f"""WITH g AS (SELECT *, ceil(l_quantity / 10)::INTEGER AS y FROM {_LINES}), d AS MATERIALIZED {drawn("g", 12)},
n AS (SELECT b, (sum(s) ** 2 - sum(s ** 2)) / 2 AS n FROM (SELECT b, y, sum(w)::DOUBLE AS s FROM d GROUP BY ALL) GROUP BY b)
SELECT n.b::INTEGER AS resample, n AS n_pairs, round(p.won / n, 6) AS accuracy_l_extendedprice, round(q.won / n, 6) AS accuracy_l_discount FROM n JOIN {_accuracy_sql("l_extendedprice")} p USING (b) JOIN {_accuracy_sql("l_discount")} q USING (b)""")
def bootstrap_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """§2: H2, L5: pair accuracy of two predictors of a line's size over all pairs of lines, in each of 12 resamples."""
    rows = lines(spark, sf).withColumn("y", F.ceil(F.col("l_quantity") / 10))
    preds = ["l_extendedprice", "l_discount"]
    out = resampling.resampled_accuracy(rows, "k", "y", preds, 12)
    return out.select("resample", "n_pairs", *[r6(F.col(f"accuracy_{p}"), f"accuracy_{p}") for p in preds])


@query(f"""WITH g AS (SELECT *, ceil(l_quantity / 10)::INTEGER AS y FROM {_LINES}), d AS MATERIALIZED {drawn("g", 40)},
n AS (SELECT b, (sum(s) ** 2 - sum(s ** 2)) / 2 AS n FROM (SELECT b, y, sum(w)::DOUBLE AS s FROM d GROUP BY ALL) GROUP BY b),
r AS (SELECT (p.won - q.won) / n AS m FROM n JOIN {_accuracy_sql("l_extendedprice")} p USING (b) JOIN {_accuracy_sql("l_tax")} q USING (b)),
x AS (SELECT 0 AS b, 1 AS w, * FROM g),
o AS (SELECT (p.won - q.won) / (SELECT (sum(s) ** 2 - sum(s ** 2)) / 2 FROM (SELECT count(*)::DOUBLE AS s FROM g GROUP BY y)) AS difference FROM {_accuracy_sql("l_extendedprice", "x")} p, {_accuracy_sql("l_tax", "x")} q),
e AS (SELECT a.l_orderkey AS k, avg(((a.l_extendedprice - b.l_extendedprice) * (a.y - b.y) > 0)::INT) - avg(((a.l_tax - b.l_tax) * (a.y - b.y) > 0)::INT) AS d
  FROM g a JOIN g b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.y <> b.y GROUP BY 1),
i AS (SELECT sum(w * d) / sum(w) AS m FROM {drawn("e", 40)} GROUP BY b),
t AS (SELECT 'global' AS scope, (SELECT difference FROM o) AS difference, * FROM (SELECT quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high, avg((m <= 0)::INT) AS p FROM r)
  UNION ALL SELECT 'intra', (SELECT avg(d) FROM e), * FROM (SELECT quantile_cont(m, 0.025), quantile_cont(m, 0.975), avg((m <= 0)::INT) FROM i))
SELECT scope, round(difference, 6) AS difference, round(low, 6) AS low, round(high, 6) AS high, round(p, 6) AS p FROM t""")
def accuracy_tests(spark: SparkSession, sf: str) -> DataFrame:
    """§2: L5, H1, H2: differences inside orders and over all pairs, with intervals and p."""
    rows = lines(spark, sf).withColumn("y", F.ceil(F.col("l_quantity") / 10))
    out = resampling.accuracy_tests(rows, "k", "l_orderkey", "l_linenumber", "y", "l_extendedprice", "l_tax", 40)
    return out.select("scope", *[r6(F.col(c), c) for c in ("difference", "low", "high", "p")])


_SPLIT = """c AS (SELECT o_custkey, min(o_orderkey) AS component, count(*) AS n FROM orders GROUP BY 1),
o AS (SELECT *, sum(n) OVER (ORDER BY n DESC, md5(component || '|42'), component::VARCHAR ROWS UNBOUNDED PRECEDING) - n / 2.0 AS middle, sum(n) OVER () AS total FROM c),
s AS (SELECT *, CASE WHEN middle < 0.8 * total THEN 'train' WHEN middle < 0.9 * total THEN 'val' ELSE 'test' END AS split FROM o)"""


def customers_split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders by customer, and the split in which no customer is torn."""
    edges = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("answer"))
    return edges, ds.leakage_free_split(edges)


@query(f"WITH {_SPLIT} SELECT o_orderkey AS id, component, split FROM orders JOIN s USING (o_custkey)")
def capacity_split(spark: SparkSession, sf: str) -> DataFrame:
    """§2: G9: orders of one customer never part, and splits are full to a customer's orders."""
    return customers_split(spark, sf)[1]


@query("SELECT count(DISTINCT o_custkey) AS answers, 0::BIGINT AS shared FROM orders")
def split_disjoint(spark: SparkSession, sf: str) -> DataFrame:
    """§2: J13: answers of the split, and those that lie in more than one part of it."""
    edges, split = customers_split(spark, sf)
    return ds.shared_answers(edges.join(split, "id"))


_RANKS = """v AS (SELECT l_orderkey, d, abs(d) AS a FROM (SELECT l_orderkey, l_quantity::DOUBLE - 24.5 AS d FROM lineitem)),
k AS (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY a) + (count(*) OVER (PARTITION BY l_orderkey, a) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY l_orderkey, a) AS c FROM v),
s AS (SELECT l_orderkey, count(*) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END)::DOUBLE AS w, sum(c ** 2 - 1)::DOUBLE AS t FROM k GROUP BY 1)"""


@query(f"""WITH RECURSIVE {_RANKS}, law AS (SELECT 0 AS m, [1] || list_transform(range(210), lambda x: 0) AS ways UNION ALL
  SELECT m + 1, list_transform(range(1, 212), lambda i: ways[i] + CASE WHEN i > m + 1 THEN ways[i - m - 1] ELSE 0 END) FROM law WHERE m < 20),
z AS (SELECT *, (w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - t / 48) AS z FROM s)
SELECT l_orderkey, n, w AS w_plus, round(CASE WHEN t = 0 THEN list_sum(ways[1:w::INTEGER + 1]) / 2.0 ** n ELSE 1 - {normal_sf_sql("z")} END, 6) AS p FROM z JOIN law ON m = n""")
def signed_rank_orders(spark: SparkSession, sf: str) -> DataFrame:
    """§2: H3, M10: of each order, whether its quantities lie below 24.5; exact but where ranks tie."""
    out = stats.wilcoxon(table(spark, sf, "lineitem"), F.col("l_quantity") - 24.5, ["l_orderkey"], "less")
    return out.select("l_orderkey", "n", "w_plus", r6(F.col("p"), "p"))


@query("""WITH v AS (SELECT n_regionkey = 1 AS flag, avg(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_regionkey), k AS (SELECT flag, rank() OVER (ORDER BY v) AS rk FROM v),
s AS (SELECT count(*) FILTER (flag) AS n1, count(*) FILTER (NOT flag) AS n0, sum(rk) FILTER (flag) AS r FROM k),
r AS (SELECT unnest(range(1, 26)) AS i), five AS (SELECT a.i + b.i + c.i + d.i + e.i AS t FROM r a JOIN r b ON a.i < b.i JOIN r c ON b.i < c.i JOIN r d ON c.i < d.i JOIN r e ON d.i < e.i)
SELECT n1, n0, (r - 15)::DOUBLE AS u1, round(least(1.0, 2 * least((SELECT avg((t <= r)::INT) FROM five), (SELECT avg((t >= r)::INT) FROM five))), 6) AS p FROM s""")
def rank_sum_exact(spark: SparkSession, sf: str) -> DataFrame:
    """§2: H6: whether customers of one region's nations have other mean balances, by the exact law."""
    means = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey", "n_regionkey").agg(F.avg("c_acctbal").alias("v"))
    out = stats.mann_whitney(means.select((F.col("n_regionkey") == 1).cast("int").alias("flag"), "v"), "flag", "v")
    return out.select("n1", "n0", "u1", r6(F.col("p"), "p"))


def orders_to_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with features and a target that no line through them gives: how far a quantity lies from the middle. A fifth of the orders is held out."""
    far = F.floor(F.abs(F.col("l_quantity") - 25) / 7)
    x = F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])
    return lines(spark, sf).select(F.col("l_orderkey").alias("id"), "l_linenumber", x.alias("features"), far.cast("double").alias("y"), (F.col("l_orderkey") % 5 == 0).alias("valid"))


@query(None)
def lambda_ranker(spark: SparkSession, sf: str) -> DataFrame:
    """§2: L3. Rows only: scores of held-out orders by trees that were boosted with pairwise lambdas on the others."""
    rows = orders_to_rank(spark, sf)
    model = boosting.Booster(rows, group="id", valid="valid", settings=boosting.Settings("order", rate=0.3, depth=3)).train(8).ensemble()
    held = trees.predictor(model)(rows.filter("valid"))
    return held.select("id", "l_linenumber", "y", r6(F.col("score"), "score"))


@query(None)
def tree_search(spark: SparkSession, sf: str) -> DataFrame:
    """§2: L2, N7. Rows only: successive halving over four settings, trees until the measure on held-out orders stops growing."""
    trials = [boosting.Settings("number", rate=r, depth=d) for r, d in ((0.05, 2), (0.3, 2), (0.1, 3), (0.5, 3))]
    found, _ = boosting.halving(orders_to_rank(spark, sf), trials, first=3, rounds=None, patience=3)
    best = Window.orderBy(F.desc("measure"), "trial")
    return spark.createDataFrame(found, "trial int, rounds int, trees int, measure double").withColumn("place", F.row_number().over(best))


@query(None)
def gam_inference(spark: SparkSession, sf: str) -> DataFrame:
    """§2: H12, H14. Rows only: price by quantity alone, and by quantity and discount: deviance, degrees of freedom, p of each term and of the larger model."""
    data = table(spark, sf, "lineitem").select("l_quantity", "l_discount", (F.col("l_extendedprice") / 1000).alias("price"))
    sums = gam.sums(data, ["l_quantity", "l_discount"], "price", 12)
    small, large = gam.fit(sums.of(["l_quantity"])), gam.fit(sums)
    _, p = gam.compared(small, large)
    rows = [(n, f, m.explained_deviance, m.term_edf[i], m.p[i], m.curve(f)["peak"], None if m is small else p) for n, m in (("small", small), ("large", large)) for i, f in enumerate(m.sums.features)]
    out = spark.createDataFrame(rows, "model string, feature string, explained_deviance double, edf double, p double, peak double, p_model double")
    return out.select("model", "feature", *[r6(F.col(c), c) for c in ("explained_deviance", "edf", "p", "peak", "p_model")])
