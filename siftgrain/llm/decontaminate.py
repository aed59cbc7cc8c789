"""Benchmark decontamination by winnowing, in DataFrame expressions only.

A window is ``length`` words in a row of a benchmark item; an item of fewer
words is one window. Each sliding window of a text keeps the least hash of its
word grams; windows in a row that keep the same one are one fingerprint, a run.
Two equal windows keep equal hashes, so that joining the fingerprints of texts
and items finds every shared span of ``length`` words. A hit is then extended:
the words of its run's windows are compared with those of the benchmark's, and
windows that match and overlap make up a span.

Fingerprints travel without texts; the texts of hits alone are read again, one
for each distinct text, told apart by two 64-bit hashes. Windows that the same
items share form one class, so that a copied passage meets its items once.

Edge cases: a null or empty text or item has no words, no window and no hit;
rows that repeat, and repeated texts under several ids, are judged alike; items
that share an id count once in a list; the windows of an item without an id
hit words, but add no item; empty tables give no rows or no hits; extra columns
pass through, and columns that the operator adds replace those of their name.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgrain.session import spread

from .common import cut, shielded, sized_join, table

#: What parts the words of a text without A-Z, and of one that may have them.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BREAKS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A side of a join with a window's words, or a digest, in each row is broadcast up to so many rows (10 MB or so).
BROADCAST_TEXTS = 100_000
KEYS = ["_a", "_b"]
INTERNAL = ("_a", "_b", "_w", "_h", "_g", "_m", "_f")


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column behind a generator of one row: what stands above reads it, and never works it out again by element."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase), BREAKS), "")


def keyed(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds what tells texts apart."""
    body = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns({"_a": F.xxhash64(body), "_b": F.xxhash64(F.lit(1), body)})


def fingerprints(df: DataFrame, keep: list[str], length: int, gram: int) -> DataFrame:
    """``keep`` with length, hash, first and after of each run of windows of ``length`` words that keep one hash; df: _w, the words."""
    gram = min(gram, length)
    width = length - gram + 1
    n = F.size("_w")
    near = lambda name, i, m: [F.get(name, i + j) for j in range(1, m)]
    out = held(df.filter(n >= length), "_h", F.transform("_w", lambda w: F.xxhash64(w)))
    out = held(out, "_g", F.slice(F.transform("_h", lambda x, i: F.xxhash64(x, *near("_h", i, gram))), 1, F.size("_h") - (gram - 1)))
    least = F.transform("_g", lambda x, i: F.least(x, *near("_g", i, width))) if width > 1 else F.col("_g")
    out = held(out, "_m", F.slice(least, 1, F.size("_g") - (width - 1)))
    begins = F.filter(F.sequence(F.lit(0), F.size("_m") - 1), lambda i: (i == 0) | (F.get("_m", i) != F.get("_m", i - 1)))
    out = held(out, "_f", begins)
    runs = F.transform("_f", lambda i, j: F.struct(F.get("_m", i).alias("hash"), i.alias("first"), F.coalesce(F.get("_f", j + 1), F.size("_m")).alias("after")))
    return out.select(*keep, F.lit(length).alias("length"), F.inline(runs).alias("hash", "first", "after"))


def spans_of(places: Column) -> Column:
    """Disjoint spans (first and after, in words) that sorted intervals cover together."""
    span = lambda first, after: F.struct(first.cast("int").alias("first"), after.cast("int").alias("after"))
    none = F.lit(-1)
    start = F.struct(F.expr("cast(array() as array<struct<first: int, after: int>>)").alias("done"), span(none, none).alias("open"))
    closed = lambda a: F.when(a["open"]["first"] < 0, a["done"]).otherwise(F.concat(a["done"], F.array(a["open"])))

    def step(a: Column, x: Column) -> Column:
        meets = x["first"] <= a["open"]["after"]
        joined = F.struct(a["done"].alias("done"), span(a["open"]["first"], F.greatest(a["open"]["after"], x["after"])).alias("open"))
        return F.when(meets, joined).otherwise(F.struct(closed(a).alias("done"), span(x["first"], x["after"]).alias("open")))

    return F.aggregate(places, start, step, closed)


def benchmark_windows(items: DataFrame, length: int, item_id: str, text: str) -> DataFrame:
    """item, length and window (its words) of every window of the benchmark; length is that of the item where it has fewer words."""
    words = held(items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("_t")), "_w", words_of(F.col("_t"))).filter(F.size("_w") > 0)
    size = F.least(F.size("_w"), F.lit(length))
    cuts = F.transform(F.sequence(F.lit(1), F.size("_w") - size + 1), lambda i: F.array_join(F.slice("_w", i, size), " "))
    return words.select("item", size.alias("length"), F.explode(cuts).alias("window"))


def text_hits(docs: DataFrame, items: DataFrame, length: int = 10, gram: int = 5, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """_a, _b (a text), spans (array of first and after, in words) and items (sorted ids) of every distinct text with a hit."""
    windows = cut(benchmark_windows(items, length, item_id, item_text).distinct())
    # Lengths lie between 1 and ``length``.
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())
    texts = spread(keyed(docs.select(F.col(text).alias("_t")), "_t"))
    cut_up = held(texts, "_w", words_of(F.col("_t"))).drop("_t")
    known = windows.withColumn("_w", F.split("window", " "))
    runs = None
    for n in lengths:
        marks = fingerprints(known.filter(F.col("length") == n).select("_w"), [], n, gram).select("hash").distinct()
        found = sized_join(fingerprints(cut_up, KEYS, n, gram), marks, "hash", "left_semi").drop("hash")
        runs = found if runs is None else runs.unionByName(found)
    if runs is None:
        return keyed(docs.select(F.col(text).alias("_t")), "_t").filter(F.lit(False)).select(*KEYS, F.expr("cast(array() as array<struct<first: int, after: int>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    hits = cut(runs.groupBy(*KEYS).agg(F.collect_set(F.struct("length", "first", "after")).alias("runs")))
    # One row for each text with a hit, with its words.
    again = sized_join(keyed(docs.select(F.col(text).alias("_t")), "_t"), hits.select(*KEYS), KEYS, "left_semi").dropDuplicates(KEYS)
    again = held(again.join(hits, KEYS), "_w", words_of(F.col("_t")))
    window = lambda r, i: F.struct(i.alias("first"), (i + r["length"]).alias("after"), F.array_join(F.slice("_w", i + 1, r["length"]), " ").alias("window"))
    each = F.flatten(F.transform("runs", lambda r: F.transform(F.sequence(r["first"], r["after"] - 1), lambda i: window(r, i))))
    placed = again.select(*KEYS, F.inline(each).alias("first", "after", "window"))
    held_by = windows.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    classes = cut(held_by.groupBy("items").agg(F.min("window").alias("class"), F.collect_list("window").alias("windows")))
    met = sized_join(placed, classes.select("class", F.explode("windows").alias("window")), "window", most=BROADCAST_TEXTS).drop("window")
    met = cut(met)
    spans = met.groupBy(*KEYS).agg(F.array_sort(F.collect_set(F.struct("first", "after"))).alias("places"))
    spans = held(spans, "_f", F.col("places")).select(*KEYS, spans_of(F.col("_f")).alias("spans"))
    listed = sized_join(met.select(*KEYS, "class").distinct(), classes.select("class", F.explode("items").alias("item")), "class", most=BROADCAST_TEXTS)
    listed = listed.groupBy(*KEYS).agg(F.array_sort(F.collect_set("item")).alias("items"))
    return spans.join(listed, KEYS, "left").withColumn("items", F.coalesce("items", F.expr("cast(array() as array<string>)")))


def contamination(docs: DataFrame, items: DataFrame, length: int = 10, gram: int = 5, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Adds n_words, spans (array of first and after, in words), items (sorted ids) and contaminated to every row of ``docs``."""
    docs, restored = shielded(docs, INTERNAL)
    docs = docs.drop("n_words", "spans", "items", "contaminated")
    hits = text_hits(docs, items, length, gram, text, item_id, item_text)
    out = keyed(docs, text).withColumn("n_words", n_words(text)).join(hits, KEYS, "left").drop(*KEYS)
    none = F.expr("cast(array() as array<struct<first: int, after: int>>)")
    out = out.withColumns({"spans": F.coalesce("spans", none), "items": F.coalesce("items", F.expr("cast(array() as array<string>)"))})
    return restored(out.withColumn("contaminated", F.size("spans") > 0))


def n_words(text: str) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), BREAKS_ANY_CASE), "")).cast("long")


def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = text_hits(docs, table(spark, sf_dir, "benchmark"))
    covered = F.aggregate("spans", F.lit(0), lambda n, x: n + x["after"] - x["first"])
    digests = hits.select(*KEYS, covered.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    out = sized_join(keyed(docs).select("doc_id", *KEYS, n_words("text").alias("n_words")), digests, KEYS, "left", most=BROADCAST_TEXTS)
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
i AS (SELECT item_id, ws, least(10, len(ws)) AS m FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, m, array_to_string(ws[p:p+m-1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - m + 2)) AS p FROM i)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT r, m, p, array_to_string(ws[p:p+m-1], ' ') AS g FROM (SELECT r, ws, m, unnest(range(1, len(ws) - m + 2)) AS p FROM d, ms WHERE len(ws) >= m)),
hit AS (SELECT DISTINCT r, dw.m, p, g FROM dw SEMI JOIN bw USING (m, g)),
cov AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + m)) AS q FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, bw.item_id::VARCHAR AS item FROM hit JOIN bw USING (m, g) WHERE bw.item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(cov.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
  sha256(coalesce(its.ids, '')) AS items_sha256, cov.n IS NOT NULL AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)"""
