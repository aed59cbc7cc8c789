"""Grading of question answering (§2: Q1-Q11, J1-J4, J7, J11, J12, J15, W1-W19, N1-N9)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftgrain.functions.text import fixed
from siftgrain.operators import resampling
from siftgrain.session import stored

#: Words at most that are sent to all workers with their frequencies.
BROADCAST_WORDS = 200_000

Responder = Callable[[DataFrame], DataFrame]
"""§2: Q9, N6, N9. A plug that adds ``reply`` to a table of prompts; none ships, since it needs a service."""


def grade_letter(reply: Column, strict: bool = False) -> Column:
    """§2: Q1. The first A, B or C anywhere, C without one; ``strict`` reads a leading letter only (spelled grades fool the first form)."""
    return F.coalesce(F.nullif(F.regexp_extract(reply, r"^\s*([ABC])\b" if strict else "(A|B|C)", 1), F.lit("")), F.lit("C"))


def graded(df: DataFrame, reply: str = "reply", strict: bool = False) -> DataFrame:
    """§2: Q2."""
    letter = grade_letter(F.col(reply), strict)
    return df.withColumn("is_correct", letter == "A").withColumn("is_incorrect", letter == "B").withColumn("is_not_attempted", letter == "C").withColumn("score", F.col("is_correct"))


def batch_replies(df: DataFrame, custom_id: str = "custom_id", response: str = "response") -> DataFrame:
    """§2: Q3. id (the id's last part) and reply (the last content of the last output) of a judge's batch lines."""
    schema = "body struct<output array<struct<content array<struct<text string>>>>>"
    output = F.from_json(response, schema)["body"]["output"]
    last = lambda a: F.element_at(a, -1)
    return df.select(F.substring_index(custom_id, "-", -1).alias("id"), last(last(output)["content"])["text"].alias("reply"))


def grade_summary(df: DataFrame, *keys: str) -> DataFrame:
    """§2: Q4, Q5, N2. Rates, accuracy given an attempt and F1 for each key, to four decimals."""
    rate = lambda c: F.avg(F.col(c).cast("int"))
    s = df.groupBy(*keys).agg(rate("is_correct").alias("c"), rate("is_incorrect").alias("i"), rate("is_not_attempted").alias("n"))
    tried = F.col("c") + F.col("i")
    given = F.when(tried > 0, F.col("c") / tried).otherwise(0.0)
    f1 = F.when(given + F.col("c") > 0, 2 * given * F.col("c") / (given + F.col("c"))).otherwise(0.0)
    r = lambda c, name: F.bround(c, 4).alias(name)
    return s.select(*keys, r(F.col("c"), "correct"), r(F.col("i"), "incorrect"), r(F.col("n"), "not_attempted"), r(tried, "attempted"), r(given, "accuracy_given_attempted"), r(f1, "f1"))


def requests(df: DataFrame, prompt: Column, model: str, prefix: str = "task") -> DataFrame:
    """§2: Q6, Q8, T16. A judge's batch lines: custom_id and the request as JSON."""
    message = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.lit(0).alias("temperature"), F.array(message).alias("input"))
    custom = F.concat_ws("-", F.lit(prefix), F.col("id").cast("string"))
    line = F.to_json(F.struct(custom.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/responses").alias("url"), body.alias("body")))
    return df.select(custom.alias("custom_id"), line.alias("request"))


def within_length(answer_words: Column, reasoning_words: Column, limit: int) -> Column:
    """§2: Q7. An answer there is, and both parts fit; a missing part counts -1."""
    a, r = F.coalesce(answer_words, F.lit(-1)), F.coalesce(reasoning_words, F.lit(-1))
    return (a != -1) & (a + r <= limit)


def unanswered(asked: DataFrame, answered: DataFrame, key: str = "id") -> DataFrame:
    """§2: J7, Q10. What is left to ask on resuming."""
    return asked.join(answered.select(key), key, "left_anti")


def joined_gap(grades: DataFrame, output: DataFrame, gold: DataFrame, key: str = "id") -> DataFrame:
    """§2: J1, J2, W7. Every graded row with the scores of its answer and of the gold answer, null where there is none; gap = answer - gold."""
    a, b = output.select(key, F.col("score").alias("score_output")), gold.select(key, F.col("score").alias("score_gold"))
    return grades.join(a, key, "left").join(b, key, "left").withColumn("gap", F.col("score_output") - F.col("score_gold"))


def common_ids(df: DataFrame, key: str, member: str, wanted: int) -> DataFrame:
    """§2: J3, J12. Keys that all ``wanted`` members have."""
    return df.groupBy(key).agg(F.count_distinct(member).alias("n")).filter(F.col("n") == wanted).select(key)


def changed(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """§2: J4. Rows of two runs whose values differ."""
    new = b.select(key, F.col(value).alias(f"{value}_new"))
    return a.select(key, value).join(new, key).filter(F.col(value) != F.col(f"{value}_new"))


def tagged_union(frames: dict[str, DataFrame], tag: str = "dataset") -> DataFrame:
    """§2: J11."""
    out = None
    for name, df in frames.items():
        one = df.withColumn(tag, F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def outcome() -> Column:
    """§2: W6."""
    return F.when(F.col("is_correct"), "correct").when(F.col("is_incorrect"), "incorrect").when(F.col("is_not_attempted"), "not_attempted").otherwise("unknown")


def means(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """§2: W1, W4, W8-W10, N3. Means by key; blanks were left null, so they don't count."""
    return df.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics])


def mean_of_means(df: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """§2: W2. Mean and sample deviation over ``inner`` of its means."""
    return df.groupBy(outer, inner).agg(F.avg(value).alias("m")).groupBy(outer).agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"))


def correlations(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """§2: W3. feature and its correlation with the target."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])
    return df.select(F.explode(pairs).alias("p"), F.col(target).cast("double").alias("y")).groupBy(F.col("p.feature").alias("feature")).agg(F.corr("p.x", "y").alias("corr"))


def weighted_mean(df: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """§2: W14."""
    return df.groupBy(key).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))


def rank_correlation(df: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """§2: W15, J6. Pearson on row numbers; for tables of results, which are small."""
    r = lambda c: F.row_number().over(Window.orderBy(c, key))
    return df.select(r(a).alias("a"), r(b).alias("b")).agg(F.corr("a", "b").alias("rank_corr"))


def best_second(df: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """§2: W11, W12. metric, key, value and its place for the two best of each metric."""
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("z")).select(key, "z.metric", "z.value")
    return long.withColumn("place", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("value"), key))).filter("place <= 2")


def distinct_ordered(df: DataFrame, *columns: str) -> DataFrame:
    """§2: W5. Distinct values of the columns, in their order."""
    return df.select(*columns).distinct().orderBy(*columns)


def in_order(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """§2: W13. A report's rows by a list of keys, with their place; keys that the table lacks raise, rows that the list lacks are left out."""
    wanted = df.sparkSession.createDataFrame(list(enumerate(order, 1)), f"place int, `{key}` string")
    found = df.withColumn(key, F.col(key).cast("string")).join(F.broadcast(wanted), key)
    missing = wanted.join(found.select(key).distinct(), key, "left_anti").limit(5).collect()
    if missing:
        raise KeyError([r[key] for r in missing])
    return found.orderBy("place")


def column_blocks(df: DataFrame, order: str, blocks: int) -> DataFrame:
    """§2: W16. Deals a table of results into blocks of near-equal length."""
    return df.withColumn("block", F.ntile(blocks).over(Window.orderBy(order)))


def described(df: DataFrame, value: str, group: str, key: str | None = None, resamples: int = 1000) -> DataFrame:
    """§2: W19. Statistics of each group; with a key, also the deviation of its mean over resamples of rows by key."""
    v = F.col(value)
    out = df.groupBy(group).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"))
    if key is None:
        return out
    deviation = resampling.mean_deviation(df, key, value, group, resamples).withColumnRenamed(group, "_group")
    return out.join(deviation, F.col(group).cast("string").eqNullSafe(F.col("_group")), "left").drop("_group")


def lexical(df: DataFrame, key: str, text: str, rare: float = 3.0) -> DataFrame:
    """§2: Q11. n_words, type-token ratio, mean Zipf frequency (log10 of occurrences a billion words, from the table itself) and rare share.

    The most frequent words, up to ``BROADCAST_WORDS``, are sent to the texts, which stay where they are; occurrences of
    the others are counted by text and meet their frequencies in a join. Rows of one key count as one text.
    """
    each = df.select(F.col(key).alias("key"), F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("words"))
    counts = stored(each.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    # Words by classes of their number, eight for each doubling: as many whole classes are sent as fit.
    size = F.floor(F.log2("n") * 8)
    sent, least, total = 0, None, 0
    for r in sorted(counts.groupBy(size.alias("size")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect(), reverse=True):
        total, sent = total + r.n, sent + r.words
        if sent <= BROADCAST_WORDS:
            least = r.size
    zipf = counts.select("word", size.alias("size"), (F.log10(F.col("n") / F.lit(total)) + 9).alias("zipf"))
    often, seldom = (zipf.filter(c).drop("size") for c in (size >= least, size < least)) if least is not None else (zipf.limit(0).drop("size"), zipf.drop("size"))
    first = lambda c: F.sum(F.when(F.col("pos") == 0, c).otherwise(0))
    low = F.when(F.col("zipf") < rare, F.col("times")).otherwise(0)
    found = each.select("key", "words", F.size(F.array_distinct("words")).alias("own")).select("key", "own", F.posexplode("words").alias("pos", "word")).withColumn("times", F.lit(1))
    found = found.join(F.broadcast(often), "word", "left").withColumn("word", F.when(F.col("zipf").isNull(), F.col("word")))
    found = found.groupBy("key", "word").agg(F.count("*").alias("times"), F.sum("zipf").alias("z"), F.sum(low).alias("low"), first(F.lit(1)).alias("rows"), first(F.col("own")).alias("own"))
    if sent > BROADCAST_WORDS:
        found = stored(found)
        others = found.filter("word is not null").join(seldom, "word").select("key", "times", (F.col("zipf") * F.col("times")).alias("z"), low.alias("low"), "rows", "own")
        found = found.filter("word is null").drop("word").unionByName(others)
    done = stored(found.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("times", "z", "low", "rows", "own")]))
    again = done.filter("rows > 1").select(F.col("key").alias("again"))
    if not again.isEmpty():
        texts = each.join(again, F.col("key").eqNullSafe(F.col("again")), "left_semi")
        types = texts.select(F.col("key").alias("again"), F.explode(F.array_distinct("words")).alias("word")).distinct().groupBy("again").agg(F.count("*").alias("types"))
        done = done.join(types, F.col("key").eqNullSafe(F.col("again")), "left").withColumn("own", F.coalesce("types", "own"))
    share = lambda c: F.col(c) / F.col("times")
    return done.select(F.col("key").alias(key), F.col("times").alias("n_words"), share("own").alias("ttr"), share("z").alias("mean_zipf"), share("low").alias("rare_share"))


def gold_granularity(df: DataFrame, score: Callable[[DataFrame], DataFrame], key: str = "id", answers: str = "answers", question: str = "question") -> DataFrame:
    """§2: N1, W8, W10. key, answer_granularity (mean over its answers, blank ones left out) and question_granularity.

    score: takes doc_id and text, gives doc_id and score, a row for each row.
    """
    long = df.select(key, F.explode(F.concat(F.transform(answers, lambda a: F.struct(F.lit("a").alias("part"), a.alias("text"))), F.array(F.struct(F.lit("q").alias("part"), F.col(question).alias("text"))))).alias("z"))
    long = long.filter("trim(coalesce(z.text, '')) <> ''").select(F.concat_ws("\0", F.col(key).cast("string"), "z.part").alias("doc_id"), "z.text")
    done = score(long).groupBy("doc_id").agg(F.avg("score").alias("score"))
    done = done.select(F.substring_index("doc_id", "\0", 1).alias(key), F.substring_index("doc_id", "\0", -1).alias("part"), "score")
    return done.groupBy(key).pivot("part", ["a", "q"]).agg(F.first("score")).withColumnRenamed("a", "answer_granularity").withColumnRenamed("q", "question_granularity")


def overview_line(df: DataFrame, dataset: str) -> DataFrame:
    """§2: N2. The line of a report: dataset and mean granularities to four decimals, N/A where there is none."""
    return df.agg(*_means()).select(means_line(F.lit(dataset)).alias("line"))


def _means() -> list[Column]:
    return [F.avg(f"{c}_granularity").alias(c) for c in ("answer", "question")]


def means_line(dataset: Column) -> Column:
    """The line of one dataset, from its means."""
    shown = lambda c: F.coalesce(fixed(F.col(c)), F.lit("N/A"))
    return F.concat(dataset, F.lit(": Answer "), shown("answer"), F.lit(" - Question "), shown("question"))


def overview_lines(df: DataFrame, dataset: str) -> DataFrame:
    """§2: N2, N3. A line for each dataset (and model) in one pass, in place of a loop; dataset, line."""
    return df.groupBy(dataset).agg(*_means()).select(dataset, means_line(F.col(dataset)).alias("line"))


def rated(df: DataFrame, score: Callable[[DataFrame], DataFrame], key: str, text: str, rating: str, invert: bool = False) -> DataFrame:
    """§2: N5. key, score and rating of rated sentences; ``invert`` turns a rating's sign, for scales that run the other way."""
    done = score(df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))).select(F.col("doc_id").alias(key), "score")
    value = F.col(rating).cast("double")
    return df.select(key, (-value if invert else value).alias("rating")).join(done, key).select(key, "score", "rating")


def column_pairs(df: DataFrame, name: str) -> DataFrame:
    """§2: J15. a and b: each pair of distinct names, a before b."""
    names = df.select(name).filter(F.col(name).isNotNull()).distinct()
    return names.select(F.col(name).alias("a")).join(names.select(F.col(name).alias("b")), F.col("a") < F.col("b"))


def sections_scored(df: DataFrame, key: str, sections: list[str], score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """§2: N4. The same scoring over several text columns: long, scored once, wide again."""
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.col(s).alias("text")) for s in sections])).alias("z")).select(F.concat_ws("\0", F.col(key).cast("string"), "z.section").alias("doc_id"), "z.text")
    done = score(long).select(F.substring_index("doc_id", "\0", 1).alias(key), F.substring_index("doc_id", "\0", -1).alias("section"), "score")
    return done.groupBy(key).pivot("section", sections).agg(F.first("score"))
