"""All queries of the catalogue over whole tables, and their DuckDB twins (§7.4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgrain.functions import text as tx
from siftgrain.operators import dataset as ds
from siftgrain.operators import percentile as pc
from siftgrain.operators import pooling as pl
from siftgrain.operators import predictors as pr
from siftgrain.operators import ordered, qa, ranking, split, stats
from siftgrain.operators import vectors as vc
from siftgrain.session import checkpointed, spread, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id and text of all documents, over all cores."""
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def normal_sf_sql(x: str) -> str:
    """The normal law's share above x: a series of odd powers over odd factorials."""
    series = f"list_sum(list_transform(range(200), lambda k: exp((2 * k + 1) * ln(greatest(abs({x}), 1e-300)) - (k + 1) * ln(2.0) - lgamma(k + 1.5) + ln(pi()) / 2)))"
    return f"(CASE WHEN {x} > 8 THEN 0.0 WHEN {x} < -8 THEN 1.0 ELSE 0.5 - sign({x}) * exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * {series} END)"


def t_two_sided_sql(t: str, df: str, steps: int = 2000) -> str:
    """Student's two-sided p: Simpson's rule from zero to t."""
    f = lambda x: f"exp(lgamma(({df} + 1) / 2) - lgamma(({df}) / 2)) / sqrt(({df}) * pi()) * (1 + ({x}) * ({x}) / ({df})) ** (-(({df}) + 1) / 2)"
    h = f"(abs({t}) / {steps}.0)"
    return f"greatest(0.0, 1 - 2 * {h} / 3 * list_sum(list_transform(range({steps + 1}), lambda i: (CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {f(f'i * {h}')})))"


# Pieces of SQL that several twins share.
_CLEAN = r"trim(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?])([A-Za-z])', '\1 \2', 'g'), '\s+', ' ', 'g'))"
_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(set(split.STOP_WORDS))) + "]"
_SCOPES = rf"""c AS (SELECT doc_id, {_CLEAN} AS body FROM documents),
s0 AS (SELECT doc_id, body, list_filter(list_transform(string_split(regexp_replace(body, '([.!?]+) ', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM c),
s1 AS (SELECT doc_id, CASE WHEN len(l) > 0 THEN l ELSE [body] END AS l FROM s0),
s AS (SELECT doc_id, unnest(l) AS scope_text, generate_subscripts(l, 1) - 1 AS scope_index FROM s1)"""
_MARKED = rf""",
t AS (SELECT *, regexp_extract_all(regexp_replace(scope_text, '(\p{{Lu}}\p{{L}}*) et al\b', '\1etal', 'g'), '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}\s]') AS tok FROM s),
m AS (SELECT *, list_transform(tok, lambda x: CASE WHEN list_contains({_STOP}, lower(x)) OR NOT regexp_matches(x, '[\p{{L}}\p{{N}}]') THEN chr(10) ELSE x END) AS mk FROM t),
ul AS (SELECT doc_id, scope_index, scope_text, list_filter(list_transform(string_split(array_to_string(mk, ' '), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS units FROM m)"""
_UNITS = _SCOPES + _MARKED + """,
u0 AS (SELECT doc_id, scope_index, unnest(CASE WHEN len(units) > 0 THEN units ELSE [NULL] END) AS unit FROM ul),
u AS (SELECT doc_id, scope_index, unit, coalesce(length(unit)::DOUBLE, 5.0::DOUBLE) AS score FROM u0)"""
_RANKED = _UNITS + """,
ref0 AS (SELECT length(unit)::DOUBLE AS r FROM (SELECT DISTINCT unit FROM u WHERE unit IS NOT NULL)),
ref AS (SELECT r, count(*) AS n FROM ref0 GROUP BY r),
x AS (SELECT DISTINCT score AS x FROM u),
p AS (SELECT x, 50.0::DOUBLE / (SELECT sum(n) FROM ref) * (coalesce((SELECT sum(n) FROM ref WHERE r < x), 0) + coalesce((SELECT sum(n) FROM ref WHERE r <= x), 0)
  + CASE WHEN EXISTS (SELECT 1 FROM ref WHERE r = x) THEN 1 ELSE 0 END) AS pct FROM x),
up AS (SELECT u.doc_id, scope_index, unit, score, pct FROM u JOIN p ON u.score = p.x)"""
_LQM = "(SELECT doc_id, avg(v) AS v FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY v) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM {src}) WHERE k <= greatest(1, ceil(n * {q}::DOUBLE)) GROUP BY doc_id)"


def scoped(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_scopes(texts(spark, sf))


def unit_table(spark: SparkSession, sf: str) -> DataFrame:
    return split.unit_rows(scoped(spark, sf).select("doc_id", "scope_index", "units"))


def unit_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = pl.score_units(unit_table(spark, sf), pr.length)
    return rows.select("doc_id", "scope_index", "unit", F.coalesce("score", F.lit(pl.NO_FACT)).alias("score"))


def noun_reference(units: DataFrame) -> DataFrame:
    """§2: B4. Scores of all distinct units."""
    return pr.length(units.filter("unit is not null").select("unit").distinct()).select("score")


@query(f"SELECT doc_id, md5({_CLEAN}) AS cleaned, md5(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\([^)]*\\)|\\[[^\\]]*\\]', ' ', 'g'), '([.!?])([A-Za-z])', '\\1 \\2', 'g'), '\\s+', ' ', 'g'))) AS no_brackets FROM documents")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    """§2: T4, T6-T8, T17."""
    body = F.coalesce("text", F.lit(""))
    return texts(spark, sf).select("doc_id", F.md5(tx.clean(body)).alias("cleaned"), F.md5(tx.clean(body, brackets=True)).alias("no_brackets"))


@query(r"""SELECT doc_id, length(text)::BIGINT AS chars, (CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END)::BIGINT AS words, lower(trim(source)) AS label FROM documents""")
def text_stats(spark: SparkSession, sf: str) -> DataFrame:
    """§2: T9-T11."""
    return table(spark, sf, "documents").select("doc_id", tx.char_length(F.col("text")).alias("chars"), tx.word_count(F.col("text")).alias("words"), tx.normalised(F.col("source")).alias("label"))


@query(f"WITH {_SCOPES} SELECT doc_id, scope_index::INTEGER AS scope_index, md5(scope_text) AS scope_hash FROM s")
def sentence_scopes(spark: SparkSession, sf: str) -> DataFrame:
    """§2: U1-U3."""
    return scoped(spark, sf).select("doc_id", "scope_index", F.md5("scope_text").alias("scope_hash"))


@query(f"WITH {_UNITS} SELECT doc_id, scope_index::INTEGER AS scope_index, len(units)::INTEGER AS n_units, md5(array_to_string(units, '|')) AS units_hash, len(list_distinct(units))::INTEGER AS n_objects FROM ul")
def unit_extract(spark: SparkSession, sf: str) -> DataFrame:
    """§2: U5-U9."""
    rows = scoped(spark, sf)
    return rows.select("doc_id", "scope_index", F.size("units").alias("n_units"), F.md5(F.array_join("units", "|")).alias("units_hash"), F.size(split.without_repeats(F.col("units"))).alias("n_objects"))


@query(f"WITH {_UNITS} SELECT unit, any_value(score) AS score, count(*) AS uses FROM u WHERE unit IS NOT NULL GROUP BY unit")
def unit_distinct_scores(spark: SparkSession, sf: str) -> DataFrame:
    """§2: P0, P5."""
    return pr.length(unit_table(spark, sf).filter("unit is not null").groupBy("unit").agg(F.count("*").alias("uses"))).select("unit", "score", "uses")


@query("""WITH ref AS (SELECT round(o_totalprice / 1000) AS r, count(*) AS n FROM orders GROUP BY 1), x AS (SELECT DISTINCT round(c_acctbal / 50) AS x FROM customer)
SELECT x AS score, round(50.0::DOUBLE / (SELECT sum(n) FROM ref) * (coalesce((SELECT sum(n) FROM ref WHERE r < x), 0) + coalesce((SELECT sum(n) FROM ref WHERE r <= x), 0) + CASE WHEN EXISTS (SELECT 1 FROM ref WHERE r = x) THEN 1 ELSE 0 END), 6) AS percentile FROM x""")
def percentile_rank(spark: SparkSession, sf: str) -> DataFrame:
    """§2: B1, N12."""
    ref = table(spark, sf, "orders").select(F.round(F.col("o_totalprice") / 1000).alias("score"))
    asked = table(spark, sf, "customer").select(F.round(F.col("c_acctbal") / 50).alias("score")).distinct()
    return pc.percentile_rank(asked, ref).select("score", r6(F.col("percentile"), "percentile"))


@query("SELECT p::DOUBLE AS percentile, round(s, 6) AS score FROM (SELECT unnest([1, 25, 50, 75, 99]) AS p, unnest(quantile_cont(o_totalprice, [0.01, 0.25, 0.5, 0.75, 0.99])) AS s FROM orders)")
def percentile_inverse(spark: SparkSession, sf: str) -> DataFrame:
    """§2: B2."""
    got = pc.score_of_percentile(table(spark, sf, "orders"), [1, 25, 50, 75, 99], "o_totalprice")
    return got.select("percentile", r6(F.col("score"), "score"))


@query("""WITH ref AS (SELECT p_retailprice AS r, count(*) AS n FROM part GROUP BY 1), c AS (SELECT r, n, sum(n) OVER (ORDER BY r) AS upto, sum(n) OVER () AS total FROM ref),
q AS (SELECT r, 50.0::DOUBLE / total * (upto - n + upto + 1) AS pct FROM c)
SELECT CASE WHEN pct < 33.33 THEN 'low' WHEN pct < 66.66 THEN 'medium' ELSE 'high' END AS bucket, count(*) AS n FROM part JOIN q ON r = p_retailprice GROUP BY 1""")
def bucket_counts(spark: SparkSession, sf: str) -> DataFrame:
    """§2: B3."""
    rows = table(spark, sf, "part").select(F.col("p_retailprice").alias("score"))
    return pc.percentile_rank(rows, rows).groupBy(pc.bucket(F.col("percentile")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""WITH {_RANKED}, d AS (SELECT DISTINCT unit, pct FROM up WHERE unit IS NOT NULL), z AS (SELECT d.*, t.target FROM d, (SELECT unnest([10.0::DOUBLE, 50.0, 90.0]) AS target) t WHERE abs(pct - target) <= 2.5)
SELECT target, unit, round(pct, 6) AS percentile FROM z QUALIFY row_number() OVER (PARTITION BY target ORDER BY md5(unit || '|0'), unit) <= 10""")
def near_percentile(spark: SparkSession, sf: str) -> DataFrame:
    """§2: B6, B7."""
    units = stored(pr.length(unit_table(spark, sf).filter("unit is not null").select("unit").distinct()))
    ranked = pc.percentile_rank(units, units.select("score"))
    return pc.near_percentile(ranked, [10, 50, 90]).select("target", "unit", r6(F.col("percentile"), "percentile"))


@query(rf"""WITH {_SCOPES}, d AS (SELECT DISTINCT scope_text AS sentence FROM s WHERE scope_text <> ''), f AS (SELECT sentence FROM d WHERE len(string_split(sentence, ' ')) BETWEEN 5 AND 40)
SELECT md5(sentence) AS sentence FROM f ORDER BY md5(sentence || '|0'), sentence LIMIT 500""")
def reference_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """§2: B5."""
    rows = scoped(spark, sf).select(F.col("scope_text").alias("sentence")).distinct().filter("sentence <> ''")
    return pc.reference_sentences(rows, 500).select(F.md5("sentence").alias("sentence"))


def _pool(name: str, expr, sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        items = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("score"), F.col("l_quantity").alias("w"))
        return items.groupBy("l_orderkey").agg(r6(expr(), "value"))

    run.__doc__ = "§2: A1-A5, one pool of them."
    run.__name__ = f"pool_{name}"
    query(sql)(run)


for _name, _sql in (("sum", "sum(l_extendedprice)"), ("min", "min(l_extendedprice)"), ("max", "max(l_extendedprice)"), ("mean", "avg(l_extendedprice)"), ("wmean", "sum(l_extendedprice * l_quantity) / sum(l_quantity)")):
    _pool(_name, lambda n=_name: pl.pooled({"wmean": "weighted_mean"}.get(n, n), "score", 0.5, "w"), f"SELECT l_orderkey, round({_sql}, 6) AS value FROM lineitem GROUP BY 1")
_pool(
    "lqm", lambda: pl.pooled("lower_quantile_mean", "score", 0.5),
    "SELECT l_orderkey, round(avg(v), 6) AS value FROM (SELECT l_orderkey, l_extendedprice AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE k <= greatest(1, ceil(n * 0.5::DOUBLE)) GROUP BY 1",
)


@query(f"""WITH {_RANKED}, sc AS (SELECT doc_id, scope_index, avg(pct) AS v FROM up GROUP BY ALL), d AS (SELECT * FROM {_LQM.format(src='sc', q='0.8')})
SELECT doc_id, round(v, 6) AS score, CASE WHEN v < 33.33 THEN 'low' WHEN v < 66.66 THEN 'medium' ELSE 'high' END AS bucket FROM d""")
def doc_score_default(spark: SparkSession, sf: str) -> DataFrame:
    """§2: A6-A8, B1, B3, P8. The default pipeline: sentences, mean of percentiles, lower-quantile mean of sentences."""
    units = pl.split_rows(texts(spark, sf))
    out = pl.score_rows(units, pr.named("length"), noun_reference(units))
    return out.select("doc_id", r6(F.col("score"), "score"), "bucket")


@query(f"""WITH {_UNITS}, sc AS (SELECT doc_id, scope_index, avg(score) AS v, count(*) AS w FROM u GROUP BY ALL)
SELECT doc_id, round(sum(v * w) / sum(w), 6) AS weighted, round(min(v), 6) AS least FROM sc GROUP BY 1""")
def doc_score_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """§2: A5, A6: raw scores, sentences weighted by their units."""
    scopes = unit_scores(spark, sf).groupBy("doc_id", "scope_index").agg(pl.pooled("mean", "score", 0.5).alias("v"), F.count("*").alias("w"))
    return scopes.groupBy("doc_id").agg(r6(pl.pooled("weighted_mean", "v", 0.5, "w"), "weighted"), r6(pl.pooled("min", "v", 0.5), "least"))


@query(f"""WITH {_UNITS}, d AS (SELECT doc_id, scope_index, map_from_entries(list_sort(list(DISTINCT (unit, score)) FILTER (unit IS NOT NULL))) AS mp, avg(score) AS v FROM u GROUP BY ALL)
SELECT doc_id, count(*) AS n_scopes, sum(coalesce(len(map_keys(mp)), 0))::BIGINT AS n_scored, round(sum(v), 6) AS total FROM d GROUP BY 1""")
def doc_details(spark: SparkSession, sf: str) -> DataFrame:
    """§2: A9: scores by unit and scope, counted here."""
    out = pl.score_texts(texts(spark, sf), pr.length, details=True, scope_pool="sum")
    n = F.aggregate("scopes", F.lit(0).cast("long"), lambda a, s: a + F.size(s["unit_scores"]))
    return out.select("doc_id", F.size("scopes").cast("long").alias("n_scopes"), n.alias("n_scored"), r6(F.col("score"), "total"))


@query("SELECT doc_id, length(text)::DOUBLE AS score FROM documents")
def doc_score_unsplit(spark: SparkSession, sf: str) -> DataFrame:
    """§2: A10."""
    return pl.score_unsplit(table(spark, sf, "documents"), pr.length)


def _sweep_sql() -> str:
    value = {"sum": "sum(v)", "min": "min(v)", "max": "max(v)", "mean": "avg(v)", "weighted_mean": "sum(v * w) / sum(w)"}
    low = lambda src, key, q: f"(SELECT {key}, avg(v) AS v, max(n) AS w FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY v) AS k, count(*) OVER (PARTITION BY {key}) AS n FROM {src}) WHERE k <= greatest(1, ceil(n * {q}::DOUBLE)) GROUP BY {key})"
    ctes, outs, names = [], [], {}
    for n, (scope, p, q, o, oq) in enumerate(pl.sweep_names()):
        key = "doc_id, scope_index" if scope == "sentence" else "doc_id"
        inner = (scope, p, q)
        if inner not in names:
            names[inner] = f"g{len(names)}"
            body = low("b", key, q) if p == "lower_quantile_mean" else f"(SELECT {key}, {value[p]} AS v, count(*) AS w FROM b GROUP BY {key})"
            ctes.append(f"{names[inner]} AS MATERIALIZED {body}")
        src = names[inner]
        last = f"(SELECT doc_id, v FROM {src})" if scope == "document" else low(src, "doc_id", oq) if o == "lower_quantile_mean" else f"(SELECT doc_id, {value[o]} AS v FROM {src} GROUP BY doc_id)"
        outs.append(f"SELECT doc_id, {n}::INTEGER AS config, round(v + 1e-9, 6) AS value FROM {last}")
    return f"WITH {_UNITS}, b AS MATERIALIZED (SELECT doc_id, scope_index, score AS v FROM u), {', '.join(ctes)} {' UNION ALL '.join(outs)}"


@query(_sweep_sql())
def pooling_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """§2: A14: 63 configurations from one table of unit scores."""
    return pl.sweep(unit_scores(spark, sf)).select("doc_id", "config", r6(F.col("value") + 1e-9, "value"))


def graded_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Wide answers for the dataset operators: the texts of all turns of a conversation, '' where there is none; as wide as the longest."""
    turns = table(spark, sf, "conversations").filter("turn >= 0").groupBy("conv_id", "turn").agg(F.max("text").alias("text"))
    width = turns.agg(F.coalesce(F.max("turn"), F.lit(0))).first()[0] + 1
    held = turns.groupBy(F.col("conv_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("turn").cast("int"), "text"))).alias("m"))
    return held.select("id", F.transform(F.sequence(F.lit(0), F.lit(int(width) - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(""))).alias("answers"))


_WIDE = """n AS (SELECT max(turn)::BIGINT + 1 AS width FROM conversations), w AS (SELECT conv_id AS id, list_transform(range(0, width), lambda i: coalesce(mp[i], '')) AS a FROM n, (SELECT conv_id, map_from_entries(list((turn::BIGINT, tx))) AS mp FROM (SELECT conv_id, turn, max(text) AS tx FROM conversations WHERE turn >= 0 GROUP BY ALL) GROUP BY 1)),
g AS (SELECT id, a, list_filter(a, lambda x: x <> '') AS v, list_max(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN a[i] <> '' THEN i ELSE 0 END)) AS last FROM w)"""


@query(f"WITH {_WIDE} SELECT id, len(v) <> len(list_distinct(v)) AS dup, len(v) < last AS gap, last::INTEGER AS last_level FROM g")
def dup_gap_rows(spark: SparkSession, sf: str) -> DataFrame:
    """§2: G3-G7."""
    a = F.col("answers")
    return graded_answers(spark, sf).select("id", ds.has_duplicates(a).alias("dup"), ds.has_gap(a).alias("gap"), ds.last_level(a).cast("int").alias("last_level"))


@query(f"WITH {_WIDE} SELECT i::INTEGER AS level, count(*) AS n FROM (SELECT unnest(list_filter(range(1, len(a) + 1), lambda i: a[i] <> '')) AS i FROM g) GROUP BY 1")
def answers_per_level(spark: SparkSession, sf: str) -> DataFrame:
    """§2: G2."""
    return ds.per_level(graded_answers(spark, sf))


@query(f"WITH {_WIDE} SELECT id, len(v)::INTEGER AS num_answers FROM g WHERE len(v) = len(list_distinct(v)) AND len(v) = last AND last <= 4")
def prepared_rows(spark: SparkSession, sf: str) -> DataFrame:
    """§2: G5-G8."""
    return ds.prepared(graded_answers(spark, sf)).select("id", "num_answers")


@query(f"WITH {_WIDE}, e AS (SELECT id, unnest(v) AS answer, generate_subscripts(v, 1) AS level, len(v) AS n FROM g) SELECT id, level::INTEGER AS level, md5(answer) AS answer, round(CASE WHEN n > 1 THEN 1 + (level - 1) * 3.0::DOUBLE / (n - 1) ELSE 1.0 END, 6) AS y FROM e")
def unpivot_likert(spark: SparkSession, sf: str) -> DataFrame:
    """§2: G10, G11, J5."""
    return ds.unpivoted(graded_answers(spark, sf)).select("id", "level", F.md5("answer").alias("answer"), r6(F.col("y"), "y"))


@query(None)
def split_no_leakage(spark: SparkSession, sf: str) -> DataFrame:
    """§2: G9: orders that share a supplier's part on any of their lines never part. Rows only: components are iterative."""
    edges = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat_ws("-", "l_partkey", "l_suppkey").alias("answer"))
    return ds.leakage_free_split(edges)


@query("""WITH d AS (SELECT lang, coalesce(source, '') AS source FROM documents), l AS (SELECT DISTINCT lang FROM d UNION ALL SELECT 'TOTAL'), s AS (SELECT DISTINCT source FROM d)
SELECT l.lang, s.source, (SELECT count(*) FROM d WHERE d.source = s.source AND (l.lang = 'TOTAL' OR d.lang IS NOT DISTINCT FROM l.lang)) AS n FROM l, s""")
def pivot_counts(spark: SparkSession, sf: str) -> DataFrame:
    """§2: G18, in long form."""
    return ds.counts_with_total(table(spark, sf, "documents").select("lang", F.coalesce("source", F.lit("")).alias("source")), "lang", "source")


@query("SELECT l_partkey::VARCHAR AS answer, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS levels FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) > 1")
def multi_level_entities(spark: SparkSession, sf: str) -> DataFrame:
    """§2: G17."""
    out = ds.multi_level(table(spark, sf, "lineitem"), F.col("l_partkey").cast("string"), "l_linenumber")
    return out.select("answer", F.concat_ws(",", F.col("levels").cast("array<string>")).alias("levels"))


@query("SELECT l_shipmode_key AS key, count(*) AS n, round(avg(l_linenumber), 6) AS mean_level, round(var_pop(l_linenumber), 6) AS var_level, round(count(*) / (SELECT count(*) FROM lineitem)::DOUBLE, 6) AS share FROM (SELECT l_returnflag AS l_shipmode_key, l_linenumber FROM lineitem) GROUP BY 1")
def level_spread(spark: SparkSession, sf: str) -> DataFrame:
    """§2: G19, G20."""
    out = ds.level_spread(table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "key"), "key", "l_linenumber")
    return out.select("key", "n", *[r6(F.col(c), c) for c in ("mean_level", "var_level", "share")])


@query("""WITH m AS (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER w IS NOT DISTINCT FROM role AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT conv_id, role, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 1 AS run FROM m) SELECT conv_id, run::BIGINT AS run, role, count(*) AS size FROM r GROUP BY ALL""")
def run_length(spark: SparkSession, sf: str) -> DataFrame:
    """§2: G15."""
    return ds.runs(table(spark, sf, "conversations"), ["conv_id", "turn"], "role")


@query("SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber) AS label FROM lineitem")
def rank_labels(spark: SparkSession, sf: str) -> DataFrame:
    """§2: G16."""
    out = ds.rank_labels(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_orderkey", "l_extendedprice", "l_linenumber")
    return out.select("l_orderkey", "l_linenumber", "label")


_PAIRS = "SELECT a.l_orderkey, (a.l_extendedprice - b.l_extendedprice) * (a.l_linenumber - b.l_linenumber) > 0 AS ok FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber"


@query(f"SELECT l_orderkey, round(avg(ok::INT), 6) AS accuracy, round(2 * avg(ok::INT) - 1, 6) AS scaled FROM ({_PAIRS}) GROUP BY 1")
def pair_accuracy_intra(spark: SparkSession, sf: str) -> DataFrame:
    """§2: M1, M2, J9, W18."""
    out = ranking.group_accuracy(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", "l_linenumber", "l_extendedprice")
    return out.select("l_orderkey", r6(F.col("accuracy"), "accuracy"), r6(F.col("scaled"), "scaled"))


@query(f"WITH a AS (SELECT l_orderkey, avg(ok::INT) AS acc FROM ({_PAIRS}) GROUP BY 1) SELECT round(avg(acc), 6) AS mean_accuracy, round(count(*) FILTER (acc = 1) / count(*)::DOUBLE, 6) AS all_right FROM a")
def pair_accuracy_summary(spark: SparkSession, sf: str) -> DataFrame:
    """§2: M6, M7, M13."""
    out = ranking.intra_summary(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", "l_linenumber", "l_extendedprice")
    return out.select(r6(F.col("mean_accuracy"), "mean_accuracy"), r6(F.col("all_right"), "all_right"))


@query("""WITH c AS (SELECT l_linenumber AS y, l_extendedprice AS p, count(*) AS n FROM lineitem GROUP BY ALL),
l AS (SELECT l_linenumber AS y, count(*) AS n FROM lineitem GROUP BY 1), pr AS (SELECT a.y AS lo, b.y AS hi, a.n * b.n AS al FROM l a JOIN l b ON a.y < b.y),
e AS (SELECT lo, hi, p, n, 0 AS m FROM pr JOIN c ON lo = y UNION ALL SELECT lo, hi, p, 0, n FROM pr JOIN c ON hi = y), f AS (SELECT lo, hi, p, sum(n) AS n, sum(m) AS m FROM e GROUP BY ALL),
v AS (SELECT m * coalesce(sum(n) OVER (PARTITION BY lo, hi ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS won FROM f)
SELECT round((SELECT sum(won) FROM v) / (SELECT sum(al) FROM pr)::DOUBLE, 6) AS accuracy, (SELECT sum(al) FROM pr)::BIGINT AS n_pairs""")
def pair_accuracy_global(spark: SparkSession, sf: str) -> DataFrame:
    """§2: M3, by counting; a test holds it against the self-join."""
    out = ranking.global_accuracy(table(spark, sf, "lineitem"), "l_linenumber", "l_extendedprice")
    return out.select(r6(F.col("accuracy"), "accuracy"), "n_pairs")


@query("""WITH p AS (SELECT a.l_orderkey, sign(a.l_linenumber - b.l_linenumber) * sign(a.l_quantity - b.l_quantity) AS s, (a.l_quantity = b.l_quantity)::INT AS t FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber),
g AS (SELECT l_orderkey, sum(s) AS s, count(*) AS n0, sum(t) AS n2 FROM p GROUP BY 1) SELECT l_orderkey, CASE WHEN n0 > n2 THEN round(s / sqrt(n0::DOUBLE * (n0 - n2)), 6) END AS tau FROM g""")
def kendall_tau_b(spark: SparkSession, sf: str) -> DataFrame:
    """§2: M4."""
    out = ranking.kendall_tau_b(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", "l_linenumber", "l_quantity")
    return out.select("l_orderkey", r6(F.col("tau"), "tau"))


@query("SELECT l_linenumber AS level, round(avg(l_extendedprice), 4) AS mean_pred, 100.0::DOUBLE AS coverage, round(corr(l_linenumber, l_extendedprice) , 6) AS own FROM lineitem GROUP BY 1".replace(", round(corr(l_linenumber, l_extendedprice) , 6) AS own", ""))
def level_means(spark: SparkSession, sf: str) -> DataFrame:
    """§2: M8, M9, G21."""
    out = ranking.level_means(table(spark, sf, "lineitem").withColumnRenamed("l_linenumber", "level"), "level", "l_extendedprice")
    return out.select("level", F.round("mean_pred", 4).alias("mean_pred"), "coverage")


@query("SELECT round(corr(l_linenumber, l_extendedprice), 6) AS pearson, round(corr(l_linenumber, -l_extendedprice), 6) AS inverted FROM lineitem")
def pearson(spark: SparkSession, sf: str) -> DataFrame:
    """§2: M5, M12, W3."""
    y, p = F.col("l_linenumber").cast("double"), F.col("l_extendedprice")
    return table(spark, sf, "lineitem").agg(r6(F.corr(y, p), "pearson"), r6(F.corr(y, ranking.adapted("inverted", p)), "inverted"))


@query("""WITH s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS sim FROM embeddings q, embeddings c)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id)::INTEGER AS rank, round(sim, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) <= 10""")
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    """§2: V2, V3, V11, V12: every vector asks for its 10 nearest of all."""
    vectors = table(spark, sf, "embeddings")
    return vc.top_k(vectors, vectors, 10).select("query_id", "rank", r6(F.col("similarity"), "similarity"))


_ANCHORS = "a AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings ORDER BY md5(vec_id::VARCHAR || '|42'), vec_id LIMIT 33)"


@query(f"WITH {_ANCHORS}, s AS (SELECT v.vec_id, list_cosine_similarity(v.embedding::DOUBLE[], a.e) AS sim FROM embeddings v, a) SELECT vec_id, round(max(sim), 6) AS best, round(min(sim), 6) AS worst, round(sum(sim), 5) AS total, count(*)::INTEGER AS width FROM s GROUP BY 1")
def anchor_features(spark: SparkSession, sf: str) -> DataFrame:
    """§2: V5, V10, V14, J10."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    out = vc.features(vectors, vc.random_anchors(vectors, 33), "similarity")
    f = F.col("features")
    return out.select("vec_id", r6(f[0], "best"), r6(F.element_at(f, -1), "worst"), F.round(F.aggregate(f, F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.size(f).alias("width"))


_BALL = "(SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / 16) AS e FROM embeddings)"


def ball(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors scaled into the Poincaré ball."""
    return table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") / 16).alias("embedding"))


@query(f"SELECT vec_id, round(2 * atanh(sqrt(list_inner_product(e, e))), 6) AS dist0 FROM {_BALL}")
def dist0(spark: SparkSession, sf: str) -> DataFrame:
    """§2: V6."""
    return ball(spark, sf).select("vec_id", r6(vc.dist0(F.col("embedding")), "dist0"))


@query(f"""WITH b AS {_BALL}, o AS (SELECT e AS x FROM b ORDER BY vec_id LIMIT 1), d AS (SELECT vec_id, list_inner_product(e, e) AS aa, list_inner_product(x, x) AS bb, list_inner_product(e, x) AS ab FROM b, o)
SELECT vec_id, round(acosh(greatest(1.0::DOUBLE, 1 + 2 * (aa + bb - 2 * ab) / ((1 - aa) * (1 - bb)))), 5) AS distance FROM d""")
def poincare_dist(spark: SparkSession, sf: str) -> DataFrame:
    """§2: V7."""
    b = ball(spark, sf)
    met = b.crossJoin(F.broadcast(b.orderBy("vec_id").limit(1).select(F.col("embedding").alias("x"))))
    return met.select("vec_id", F.round(vc.poincare(F.col("embedding"), F.col("x")), 5).alias("distance"))


@query(f"WITH {_ANCHORS.replace('embedding::DOUBLE[] AS e', 'list_transform(embedding::DOUBLE[], lambda x: x / 16) AS e')}, b AS {_BALL}, s AS (SELECT b.vec_id, list_inner_product(b.e, b.e) AS aa, list_inner_product(a.e, a.e) AS bb, list_inner_product(a.e, b.e) AS ab, list_cosine_similarity(a.e, b.e) AS sim FROM b, a) SELECT vec_id, round(2 * atanh(sqrt(max(aa))), 6) AS origin, round(max(sim), 6) AS best, round(sum(acosh(greatest(1.0::DOUBLE, 1 + 2 * (aa + bb - 2 * ab) / ((1 - aa) * (1 - bb))))), 3) AS distances, (1 + 2 * count(*))::INTEGER AS width FROM s GROUP BY 1")
def hyperbolic_features(spark: SparkSession, sf: str) -> DataFrame:
    """§2: V8, V9."""
    b = ball(spark, sf)
    out = vc.features(b, vc.random_anchors(b, 33), "hyperbolic")
    f = F.col("features")
    return out.select("vec_id", r6(f[0], "origin"), r6(f[1], "best"), F.round(F.aggregate(F.slice(f, 35, 33), F.lit(0.0), lambda a, x: a + x), 3).alias("distances"), F.size(f).alias("width"))


@query(f"""WITH d AS (SELECT vec_id, 2 * atanh(sqrt(list_inner_product(e, e))) AS d0 FROM {_BALL}), q AS (SELECT quantile_cont(d0, 0.33) AS a, quantile_cont(d0, 0.66) AS b FROM d),
n AS (SELECT vec_id, CASE WHEN d0 <= a THEN 0 WHEN d0 <= b THEN 1 ELSE 2 END AS bin FROM d, q) SELECT vec_id, bin FROM n QUALIFY row_number() OVER (PARTITION BY bin ORDER BY md5(vec_id::VARCHAR || '|42'), vec_id) <= 33""")
def radial_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """§2: V16, J8."""
    return vc.radial_anchors(ball(spark, sf), 99).select("vec_id", "bin")


@query(f"WITH {_UNITS} SELECT min(doc_id) AS vec_id, unit AS label, 64 AS width FROM u WHERE unit IS NOT NULL GROUP BY unit")
def index_build(spark: SparkSession, sf: str) -> DataFrame:
    """§2: V1, V13: an index of all distinct units."""
    out = vc.build_index(unit_table(spark, sf).select(F.col("doc_id").alias("vec_id"), F.col("unit").alias("label")))
    return out.select("vec_id", "label", F.size("unit_vector").alias("width"))


_DRAW = "('0x' || substr(md5({q} || '|' || j || '|42'), 1, 15))::BIGINT % (SELECT count(*) FROM embeddings)"
_PLACED = "n AS (SELECT vec_id, embedding::DOUBLE[] AS e, row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) - 1 AS position FROM embeddings)"


def placed_index(spark: SparkSession, sf: str) -> DataFrame:
    """position, vec_id and embedding of every vector."""
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    positions = ordered.numbered(v.select("vec_id"), [F.md5(F.col("vec_id").cast("string")), F.col("vec_id")]).select("vec_id", (F.col("number") - 1).cast("long").alias("position"))
    return v.join(positions, "vec_id")


@query(f"WITH {_PLACED}, q AS (SELECT *, {_DRAW.format(q='vec_id')} AS spot FROM embeddings, range(5) AS r(j)) SELECT q.vec_id AS query_id, j::INTEGER AS j, n.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], n.e), 6) AS similarity FROM q JOIN n ON n.position = spot")
def random_neighbour_search(spark: SparkSession, sf: str) -> DataFrame:
    """§2: V4."""
    out = vc.random_neighbours(table(spark, sf, "embeddings").select("vec_id", "embedding"), placed_index(spark, sf), 5)
    return out.select("query_id", "j", "vec_id", r6(F.col("similarity"), "similarity"))


@query(f"WITH {_PLACED}, a AS (SELECT j, vec_id, e FROM range(20) AS r(j) JOIN n ON n.position = {_DRAW.format(q='-1')}) SELECT j::INTEGER AS j, a.vec_id, round(max(list_cosine_similarity(e, v.embedding::DOUBLE[])), 6) AS nearest FROM a, embeddings v WHERE v.vec_id <> a.vec_id GROUP BY ALL")
def drawn_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """§2: V15: anchors by draws of one dummy query, with replacement, and how near the nearest other vector lies."""
    index = placed_index(spark, sf)
    anchors = checkpointed(vc.drawn_anchors(index, 20))
    found = vc.top_k(anchors.select("vec_id", "embedding").dropDuplicates(["vec_id"]), index.select("vec_id", "embedding"), 2)
    best = found.filter("query_id <> vec_id").groupBy("query_id").agg(F.max("similarity").alias("nearest"))
    return anchors.join(best.withColumnRenamed("query_id", "vec_id"), "vec_id").select("j", "vec_id", r6(F.col("nearest"), "nearest"))


_LETTER = "coalesce(nullif(regexp_extract(text, '(A|B|C)', 1), ''), 'C')"


@query(f"SELECT conv_id, turn, {_LETTER} AS letter, {_LETTER} = 'A' AS is_correct FROM conversations WHERE role = 'assistant'")
def grade_parse(spark: SparkSession, sf: str) -> DataFrame:
    """§2: Q1, Q2."""
    rows = qa.graded(table(spark, sf, "conversations").filter("role = 'assistant'"), "text")
    return rows.select("conv_id", "turn", qa.grade_letter(F.col("text")).alias("letter"), "is_correct")


@query("""WITH g AS (SELECT lang, avg(quality) AS c, avg(CASE WHEN quality = 0 AND toxic = 1 THEN 1 ELSE 0 END) AS i, avg(CASE WHEN quality = 0 AND toxic = 0 THEN 1 ELSE 0 END) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1),
h AS (SELECT *, CASE WHEN c + i > 0 THEN c / (c + i) ELSE 0 END AS g FROM g)
SELECT lang, round_even(c, 4) AS correct, round_even(i, 4) AS incorrect, round_even(n, 4) AS not_attempted, round_even(c + i, 4) AS attempted, round_even(g, 4) AS accuracy_given_attempted, round_even(CASE WHEN g + c > 0 THEN 2 * g * c / (g + c) ELSE 0 END, 4) AS f1 FROM h""")
def grade_summary(spark: SparkSession, sf: str) -> DataFrame:
    """§2: Q4, Q5, W6, M14."""
    rows = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    rows = rows.withColumn("is_correct", F.col("quality") == 1).withColumn("is_incorrect", F.expr("quality = 0 and toxic = 1")).withColumn("is_not_attempted", F.expr("quality = 0 and toxic = 0"))
    return qa.grade_summary(rows, "lang")


@query("SELECT 'task-' || conv_id::VARCHAR || '.' || turn::VARCHAR AS custom_id, md5('Grade: ' || text) AS prompt FROM conversations WHERE role = 'user'")
def judge_requests(spark: SparkSession, sf: str) -> DataFrame:
    """§2: Q6, Q8, T16. A request for every user turn."""
    rows = table(spark, sf, "conversations").filter("role = 'user'").withColumn("id", F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    out = qa.requests(rows, tx.filled("Grade: {text}", text=F.col("text")), "judge")
    return out.select("custom_id", F.md5(F.get_json_object("request", "$.body.input[0].content")).alias("prompt"))


_ASKED = "FROM conversations q LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user'"


def asked_and_answered(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(id and score of every user turn, of the assistant's turns by the turn that they answer); scores are lengths."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("score"))
    own = lambda turn: F.concat_ws(".", F.col("conv_id").cast("string"), turn.cast("string")).alias("id")
    return rows.filter("role = 'user'").select(own(F.col("turn")), "score"), rows.filter("role = 'assistant'").select(own(F.col("turn") - 1), "score")


@query(f"SELECT q.conv_id::VARCHAR || '.' || q.turn::VARCHAR AS id, length(a.text) - length(q.text) AS gap {_ASKED}")
def qa_join_gap(spark: SparkSession, sf: str) -> DataFrame:
    """§2: J1, J2, W7: every question; those without an answer have no gap."""
    questions, answers = asked_and_answered(spark, sf)
    return qa.joined_gap(questions.select("id"), answers, questions).select("id", "gap")


@query("SELECT CASE quality WHEN 1 THEN 'correct' ELSE 'incorrect' END AS label, round(avg(n_chars), 6) AS n_chars, round(avg(length(source)), 6) AS source_length FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def label_means(spark: SparkSession, sf: str) -> DataFrame:
    """§2: W1, W4, W6, W8-W10."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").withColumn("is_correct", F.col("quality") == 1).withColumn("is_incorrect", F.col("quality") == 0).withColumn("is_not_attempted", F.lit(False))
    rows = rows.withColumn("label", qa.outcome()).withColumn("source_length", F.length("source"))
    out = qa.means(rows, ["label"], ["n_chars", "source_length"])
    return out.select("label", *[r6(F.col(c), c) for c in ("n_chars", "source_length")])


@query("WITH m AS (SELECT lang, source, avg(n_chars) AS m FROM documents GROUP BY ALL) SELECT lang, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd FROM m GROUP BY 1")
def mean_of_means(spark: SparkSession, sf: str) -> DataFrame:
    """§2: W2, N3."""
    out = qa.mean_of_means(table(spark, sf, "documents"), "lang", "source", "n_chars")
    return out.select("lang", r6(F.col("mean"), "mean"), r6(F.col("sd"), "sd"))


@query("SELECT 'l_quantity' AS feature, round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem UNION ALL SELECT 'l_discount', round(corr(l_discount, l_extendedprice), 6) FROM lineitem")
def feature_correlations(spark: SparkSession, sf: str) -> DataFrame:
    """§2: W3."""
    return qa.correlations(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice").select("feature", r6(F.col("corr"), "corr"))


@query("SELECT source FROM documents GROUP BY 1 HAVING count(DISTINCT lang) = 4")
def common_ids(spark: SparkSession, sf: str) -> DataFrame:
    """§2: J3, J12."""
    return qa.common_ids(table(spark, sf, "documents"), "source", "lang", 4)


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority AS o_orderstatus_new FROM orders WHERE o_orderstatus <> o_orderpriority")
def diff_runs(spark: SparkSession, sf: str) -> DataFrame:
    """§2: J4."""
    o = table(spark, sf, "orders")
    return qa.changed(o, o.select("o_orderkey", F.col("o_orderpriority").alias("o_orderstatus")), "o_orderkey", "o_orderstatus")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    """§2: J7, Q10."""
    return qa.unanswered(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("SELECT 'customer' AS dataset, c_custkey AS id, c_acctbal AS value FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier")
def tagged_union(spark: SparkSession, sf: str) -> DataFrame:
    """§2: J11."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("value"))
    return qa.tagged_union({"customer": c, "supplier": s}).select("dataset", "id", "value")


@query("SELECT a.r_name AS first, b.r_name AS second FROM region a JOIN region b ON a.r_name < b.r_name")
def dataset_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """§2: J15."""
    return qa.column_pairs(table(spark, sf, "region"), "r_name").select(F.col("a").alias("first"), F.col("b").alias("second"))


_MWU = """WITH r AS (SELECT quality, n_chars, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL), v AS (SELECT n_chars, sum(n) AS n, sum(n) FILTER (quality = 1) AS n1 FROM r GROUP BY 1),
k AS (SELECT n, coalesce(n1, 0) AS n1, coalesce(sum(n) OVER (ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0::DOUBLE AS rk FROM v),
s AS (SELECT sum(n1)::DOUBLE AS n1, sum(n)::DOUBLE AS nn, sum(rk * n1) AS r1, sum(n::DOUBLE ** 3 - n) AS t FROM k), u AS (SELECT n1, nn - n1 AS n0, nn, t, r1 - n1 * (n1 + 1) / 2 AS u1 FROM s)"""


@query(_MWU + " SELECT n1::BIGINT AS n1, n0::BIGINT AS n0, round(u1, 4) AS u1, round((u1 - n1 * n0 / 2) / sqrt(n1 * n0 / 12 * (nn + 1 - t / (nn * (nn - 1)))), 6) AS z, round(2 * u1 / (n1 * n0) - 1, 6) AS cliffs_delta, round(u1 / (n1 * n0), 6) AS auc,"
       f" round(least(1.0, 2 * {normal_sf_sql('greatest(abs(u1 - n1 * n0 / 2) - 0.5, 0) / sqrt(n1 * n0 / 12 * (nn + 1 - t / (nn * (nn - 1))))')}), 6) AS p FROM u")
def mann_whitney(spark: SparkSession, sf: str) -> DataFrame:
    """§2: H6, H8, H10."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("quality", "n_chars")
    out = stats.mann_whitney(rows, "quality", "n_chars")
    return out.select("n1", "n0", F.round("u1", 4).alias("u1"), *[r6(F.col(c), c) for c in ("z", "cliffs_delta", "auc", "p")])


_TURNS = f"p AS (SELECT length(q.text)::DOUBLE AS a, length(a.text)::DOUBLE AS b {_ASKED} AND a.text IS NOT NULL)"


def paired_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Lengths of every question and its answer."""
    questions, answers = asked_and_answered(spark, sf)
    return questions.select("id", F.col("score").cast("double").alias("a")).join(answers.select("id", F.col("score").cast("double").alias("b")), "id")


@query(f"""WITH {_TURNS}, d AS (SELECT a - b AS d FROM p WHERE a <> b), v AS (SELECT abs(d) AS x, count(*) AS n, count(*) FILTER (d > 0) AS pos FROM d GROUP BY 1),
k AS (SELECT *, coalesce(sum(n) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0::DOUBLE AS rk FROM v),
s AS (SELECT sum(n)::DOUBLE AS n, sum(rk * pos) AS wp, sum(rk * (n - pos)) AS wm, sum(n::DOUBLE ** 3 - n) AS t FROM k),
z AS (SELECT *, (wp - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - t / 48) AS z FROM s)
SELECT n::BIGINT AS n, round(wp, 4) AS w_plus, round(wm, 4) AS w_minus, round(z, 6) AS z, round(2 * {normal_sf_sql("abs(z)")}, 6) AS p FROM z""")
def wilcoxon(spark: SparkSession, sf: str) -> DataFrame:
    """§2: H3."""
    out = stats.wilcoxon(paired_turns(spark, sf), F.col("a") - F.col("b"))
    return out.select("n", F.round("w_plus", 4).alias("w_plus"), F.round("w_minus", 4).alias("w_minus"), r6(F.col("z"), "z"), r6(F.col("p"), "p"))


@query(f"""WITH {_TURNS}, s AS (SELECT count(*) AS n, avg((a > b)::INT) AS share, avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) AS t, avg(a - b) / stddev_pop(a - b) AS dz FROM p)
SELECT n, round(share, 6) AS share, round(t, 6) AS t, round(dz, 6) AS cohen_dz, round({t_two_sided_sql("t", "(n - 1)::DOUBLE")}, 6) AS p FROM s""")
def paired_tests(spark: SparkSession, sf: str) -> DataFrame:
    """§2: H4, H5, H13."""
    return stats.paired(paired_turns(spark, sf), "a", "b").select("n", *[r6(F.col(c), c) for c in ("share", "t", "cohen_dz", "p")])


@query("""WITH m AS (SELECT source AS key, avg(n_chars) AS mean_chars, count(*)::DOUBLE AS n FROM documents GROUP BY 1), l AS (SELECT key, 'mean_chars' AS metric, mean_chars AS value FROM m UNION ALL SELECT key, 'n', n FROM m)
SELECT metric, key, round(value, 6) AS value, row_number() OVER (PARTITION BY metric ORDER BY value DESC, key)::INTEGER AS place FROM l QUALIFY row_number() OVER (PARTITION BY metric ORDER BY value DESC, key) <= 2""")
def best_second(spark: SparkSession, sf: str) -> DataFrame:
    """§2: W11, W12."""
    m = table(spark, sf, "documents").groupBy(F.col("source").alias("key")).agg(F.avg("n_chars").alias("mean_chars"), F.count("*").alias("n"))
    return qa.best_second(m, "key", ["mean_chars", "n"]).select("metric", "key", r6(F.col("value"), "value"), "place")


@query("WITH m AS (SELECT source AS name, avg(n_chars) AS value FROM documents GROUP BY 1) SELECT row_number() OVER (ORDER BY value DESC, name)::INTEGER AS rank, name FROM m")
def ranking_table(spark: SparkSession, sf: str) -> DataFrame:
    """§2: K7, W12."""
    m = table(spark, sf, "documents").groupBy(F.col("source").alias("name")).agg(F.avg("n_chars").alias("value"))
    return ranking.ranking_table(m, "name", "value").select("rank", "name")


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, count(value) AS n FROM events GROUP BY 1")
def events_level_stats(spark: SparkSession, sf: str) -> DataFrame:
    """§2: W19."""
    out = qa.described(table(spark, sf, "events"), "value", "event_type")
    return out.select("event_type", *[r6(F.col(c), c) for c in ("mean", "std", "min", "max")], "n")


@query(r"""SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<title>(.*?)</title>') THEN trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) END AS title, md5(regexp_replace(html, '<[^>]*>', ' ', 'g')) AS plain FROM pages""")
def page_sections(spark: SparkSession, sf: str) -> DataFrame:
    """§2: T13: a part of a page by pattern, null where there is none."""
    title = r"(?is)<title>(.*?)</title>"
    return table(spark, sf, "pages").select("page_id", F.when(F.col("html").rlike(title), F.trim(F.regexp_extract("html", title, 1))).alias("title"), F.md5(F.regexp_replace("html", "<[^>]*>", " ")).alias("plain"))


@query(r"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS word FROM documents), p AS (SELECT doc_id, word, count(*) AS t FROM w GROUP BY ALL),
f AS (SELECT word, log10(sum(t) / (SELECT sum(t) FROM p)::DOUBLE) + 9 AS z FROM p GROUP BY 1)
SELECT doc_id, sum(t)::BIGINT AS n_words, round(count(*) / sum(t)::DOUBLE, 6) AS ttr, round(sum(z * t) / sum(t), 5) AS mean_zipf FROM p JOIN f USING (word) GROUP BY 1""")
def lexical_stats(spark: SparkSession, sf: str) -> DataFrame:
    """§2: Q11."""
    return qa.lexical(texts(spark, sf), "doc_id", "text").select("doc_id", "n_words", r6(F.col("ttr"), "ttr"), F.round("mean_zipf", 5).alias("mean_zipf"))


@query("SELECT source, ntile(4) OVER (ORDER BY source)::INTEGER AS block FROM (SELECT DISTINCT source FROM documents)")
def column_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """§2: W16."""
    return qa.column_blocks(table(spark, sf, "documents").select("source").distinct(), "source", 4)


@query("WITH m AS (SELECT source, avg(n_chars) AS a, avg(length(text) % 97) AS b FROM documents GROUP BY 1), r AS (SELECT row_number() OVER (ORDER BY a, source) AS a, row_number() OVER (ORDER BY b, source) AS b FROM m) SELECT round(corr(a, b), 6) AS rank_corr FROM r")
def rank_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """§2: W15, J6."""
    m = table(spark, sf, "documents").groupBy("source").agg(F.avg("n_chars").alias("a"), F.avg(F.length("text") % 97).alias("b"))
    return qa.rank_correlation(m, "a", "b", "source").select(r6(F.col("rank_corr"), "rank_corr"))


@query("WITH f AS (SELECT quality, (row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR || '|42'), doc_id) % 5)::INTEGER AS fold FROM labels) SELECT quality, fold, count(*) AS n FROM f GROUP BY ALL")
def stratified_folds(spark: SparkSession, sf: str) -> DataFrame:
    """§2: H11."""
    return stats.stratified_folds(table(spark, sf, "labels"), "quality", "doc_id").groupBy("quality", "fold").agg(F.count("*").alias("n"))


@query(None)
def gbt_scores(spark: SparkSession, sf: str) -> DataFrame:
    """§2: L1, L4, P1, P2. Rows only: boosted trees on anchor features, level = label."""
    rows = table(spark, sf, "embeddings")
    anchors = vc.random_anchors(rows.select("vec_id", "embedding"), 33)
    data = vc.features(rows.select("vec_id", "embedding", F.col("label").alias("y")), anchors, "similarity")
    model = pr.fit_gbt(data, iterations=5)
    return pr.gbt(model)(data).select("vec_id", "y", r6(F.col("score"), "score"))
