"""Mixing sources to target weights by blocks of tokens.

Each source's texts form one stream of words, cut into blocks of a fixed
length. Every output shard draws its source counts from what the targets
still leave (a multinomial without replacement, so that the sums over shards
are the targets), and the slots of a source go through a pseudorandom
permutation of its block indices, epoch after epoch; slots meet blocks by a
join on the index.

Edge cases: a null text has no words and is never taken; a null source is a
source of its own, last in order; a corpus without words takes nothing; rows
repeated with the same id and text are rows of their own in the stream, and keep
what else they hold; extra columns pass through ``mix`` untouched. Sources are metadata: their totals are
read on the driver, at most ``MOST_SOURCES`` of them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shielded, table

WEIGHTS = (5, 2, 1)
MOST_SOURCES = 100_000
MOST_EPOCHS = 3
RUN_SLOTS = 16_384
TASK_SLOTS = 200_000


def targets(sizes: list[int], weights: list[float], total: float, most: float = MOST_EPOCHS) -> list[float]:
    """Shares by weight, none above ``most`` times its size; the excess goes to the others by weight."""
    out, free = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = total
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in over]
    return out


def permuted(index: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A permutation of 0..size-1 for each (size, seed): four Feistel rounds, walked until inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        x, h, m, s = out[todo], half[todo], mask[todo], seed[todo].astype(np.uint64)
        left, right = x >> h, x & m
        for i in range(4):
            f = (right + s + np.uint64(i + 1)) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def whole_row(docs: DataFrame) -> Column:
    """A hash of all columns, null or not: rows of one hash may stand for each other."""
    plain = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
    return F.xxhash64(*[x for f in docs.schema.fields for x in (plain(f), F.col(f"`{f.name}`").isNull())])


def streams(docs: DataFrame, cell_rows: int = 2_000, row: Column | None = None) -> DataFrame:
    """Adds size, source_key, from_word: each row's place in its source's stream, and number, by which equal rows differ.

    ``row`` tells rows apart, by doc_id and text unless it is given.

    Offsets inside cells of a bounded number of rows are added to the cells'
    own offsets, so that no task holds a whole source.
    """
    size = F.size(F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    row = F.xxhash64("doc_id", "text") if row is None else row
    narrow = docs.select("doc_id", row.alias("row"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t")).alias("source_key"), size.alias("size"))
    narrow = cut(narrow)
    cells = max(1, math.ceil(narrow.count() / cell_rows))
    narrow = narrow.withColumn("cell", F.pmod(F.xxhash64("row", F.lit(8)), F.lit(cells)))
    before = Window.partitionBy("source_key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = narrow.groupBy("source_key", "cell").agg(F.sum("size").alias("words"))
    sums = sums.select("source_key", "cell", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    ordered = Window.partitionBy("source_key", "cell").orderBy("doc_id", "row")
    inside = ordered.rowsBetween(Window.unboundedPreceding, 0)
    placed = narrow.select("*", F.sum("size").over(inside).alias("inside"), F.row_number().over(ordered).alias("number")).join(sums, ["source_key", "cell"])
    return placed.select("doc_id", "row", "number", "source_key", "size", (F.col("base") + F.col("inside") - F.col("size")).alias("from_word"))


def draw(wanted: list[int], shards: int, seed: int) -> np.ndarray:
    """Slots of every source in each shard: each shard draws from what is left, so that columns sum to ``wanted``."""
    rng, left = np.random.default_rng(seed), np.array(wanted, np.int64)
    out = np.zeros((shards, len(wanted)), np.int64)
    for i in range(shards):
        room = int(left.sum()) // (shards - i)
        if not room:
            continue
        drawn = np.minimum(rng.multinomial(room, left / left.sum()), left)
        while short := room - int(drawn.sum()):
            spare = left - drawn
            drawn += np.minimum(rng.multinomial(short, spare / spare.sum()), spare)
        out[i] = drawn
        left -= drawn
    out[-1] += left
    return out


def mix_plan(docs: DataFrame, block: int = 64, shards: int = 64, seed: int = 20, row: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their source's size and target, slots, block members).

    slots: shard, source_key, slot (of its source), epoch, block_index.
    members: source_key, block_index, row, number, from_word, n_words (of the row in the block).
    """
    spark = docs.sparkSession
    placed = cut(streams(docs, row=row))
    per = sorted(placed.groupBy("source_key").agg(F.sum("size").alias("words")).limit(MOST_SOURCES + 1).collect(), key=lambda r: r["source_key"])
    if len(per) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sizes = [int(r["words"]) for r in per]
    want = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(per))], float(sum(sizes)))
    blocks = [math.ceil(s / block) for s in sizes]
    wanted = [min(MOST_EPOCHS * b, round(w / (s / b) if s else 0)) for w, s, b in zip(want, sizes, blocks, strict=True)]
    schema = "source_key string, source_size long, target double, blocks long, source_seed long"
    sources = spark.createDataFrame([(r["source_key"], s, w, b, seed * 1_000_003 + i) for i, (r, s, w, b) in enumerate(zip(per, sizes, want, blocks, strict=True))], schema)
    counts = draw(wanted, shards, seed)
    first = np.cumsum(counts, axis=0) - counts
    drawn = [(i, r["source_key"], int(first[i, j]), int(counts[i, j])) for i in range(shards) for j, r in enumerate(per) if counts[i, j]]
    drawn = spark.createDataFrame(drawn, "shard int, source_key string, first long, n long")
    # Runs of a bounded number of slots are dealt before they are counted out, so that no array or task holds a source's whole share.
    runs = drawn.withColumn("begin", F.explode(F.expr(f"sequence(first, first + n - 1, {RUN_SLOTS}L)")))
    runs = runs.repartition(max(1, math.ceil(int(counts.sum()) / TASK_SLOTS)), "source_key", "begin")
    slots = runs.withColumn("slot", F.explode(F.expr(f"sequence(begin, least(begin + {RUN_SLOTS - 1}L, first + n - 1))"))).drop("first", "n", "begin")
    slots = slots.join(F.broadcast(sources), "source_key")
    slots = slots.withColumn("epoch", F.floor(F.col("slot") / F.col("blocks")).cast("int"))

    @F.pandas_udf("long")
    def place(index: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(permuted(index.to_numpy(), size.to_numpy(), key.to_numpy()))

    slots = slots.withColumn("block_index", place(F.pmod("slot", "blocks"), F.col("blocks"), F.col("source_seed") * 31 + F.col("epoch")))
    slots = slots.select("shard", "source_key", "slot", "epoch", "block_index")
    documents = placed.join(F.broadcast(sources.select("source_key", "source_size", "target")), "source_key")
    index = F.explode(F.expr(f"sequence(from_word div {block}, (from_word + size - 1) div {block})"))
    members = placed.filter("size > 0").select("source_key", "row", "number", "size", "from_word", index.alias("block_index"))
    begin = F.greatest(F.col("from_word"), F.col("block_index") * block)
    end = F.least(F.col("from_word") + F.col("size"), (F.col("block_index") + 1) * block)
    members = members.select("source_key", "block_index", "row", "number", (begin - F.col("from_word")).alias("from_word"), (end - begin).alias("n_words"))
    return documents, slots, members


def taken_blocks(slots: DataFrame, members: DataFrame) -> DataFrame:
    """Row, number, shard, slot, epoch, from_word and n_words of every piece that the mix takes."""
    return slots.join(members, ["source_key", "block_index"])


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: one row for a run of consecutive words taken from a row in one epoch, with the row's other columns.

    text is the run's words, joined by single blanks unless the run is the
    whole text, which is kept as it is; n_chars, where there is such a column,
    is counted anew; epoch is not among the columns.
    """
    docs, restored = shielded(docs, ("_row", "run", "_words"))
    columns = docs.columns
    _, slots, members = mix_plan(docs, row=whole_row(docs), **how)
    pieces = taken_blocks(slots, members).select("source_key", "row", "number", "epoch", "from_word", "n_words")
    runs = pieces.groupBy("source_key", "row", "number", "epoch").agg(F.array_sort(F.collect_list(F.struct("from_word", "n_words"))).alias("pieces"))
    start = F.struct(F.expr("cast(array() as array<struct<a: bigint, b: bigint>>)").alias("done"), F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"))

    def step(acc, x):
        joins = x["from_word"] == acc["b"]
        closed = F.when(acc["a"] < 0, acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["a"].alias("a"), acc["b"].alias("b")))))
        return F.struct(
            F.when(joins, acc["done"]).otherwise(closed).alias("done"),
            F.when(joins, acc["a"]).otherwise(x["from_word"]).alias("a"),
            (x["from_word"] + x["n_words"]).alias("b"),
        )

    done = F.aggregate("pieces", start, step, lambda acc: F.concat(acc["done"], F.array(F.struct(acc["a"].alias("a"), acc["b"].alias("b")))))
    runs = runs.select("row", F.explode(done).alias("run"))
    keyed = docs.select(*[F.col(f"`{c}`") for c in columns], whole_row(docs).alias("_row")).dropDuplicates(["_row"])
    joined = keyed.join(runs.withColumnRenamed("row", "_row"), "_row")
    joined = joined.select("*", F.explode(F.array(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))).alias("_words"))
    whole = (F.col("run.a") == 0) & (F.col("run.b") == F.size("_words"))
    text = F.when(whole, F.col("text")).otherwise(F.array_join(F.slice("_words", (F.col("run.a") + 1).cast("int"), (F.col("run.b") - F.col("run.a")).cast("int")), " "))
    out = joined.withColumn("text", text)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return restored(out.select(*[F.col(f"`{c}`") for c in columns]))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, slots, members = mix_plan(table(spark, sf_dir, "documents"))
    taken = taken_blocks(slots, members).groupBy("source_key", "row", "number").agg(F.sum("n_words").alias("taken"))
    out = documents.join(taken, ["source_key", "row", "number"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
