"""K-d tree partitioning into shards of near-equal bytes, in DataFrame operations only.

Law: ``bytes``. Every node splits its shards in two halves at the weighted
median (weight: bytes) of its widest metadata dimension until a node is one
shard of the target bytes. Dimensions: log of the size, language and source;
widths are relative to the dimension's range over all rows, and a dimension
with one value over all rows is the last to be cut. A hash below the scale's
step spreads rows of equal value, so that a source with a third of all rows can
be cut anywhere; below that, a hash of the row's place in the input spreads
rows repeated with equal id and text, so that they can be cut as well. Medians
come from histograms of 4,096 bins that are summed on the executors and refined
inside the crossed bin until it holds a thousandth of a shard at most; the
driver sees at most shards x bins sums, however many rows there are. What it
knows of the nodes goes into the plan as arrays of a row for each shard at most.

Edge cases: a null text is empty (16 bytes, crc 0); null language or source is
a value of its own; repeated rows are rows of their own and part like others;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import stored, table

OVERHEAD = 16
STEPS = 64
DIMENSIONS = ("k_size", "k_lang", "k_source")


def unit(*columns: Column) -> Column:
    """A hash in 0..1 with 31 bits."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 33).cast("double") / float(1 << 31)


def coordinates(docs: DataFrame, steps: int = STEPS) -> DataFrame:
    """doc_id, size, text_crc32, tie (a number of its own for each row) and the coordinates; the text goes no further."""
    body = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).cast("long").alias("text_crc32"),
        F.coalesce(F.col("lang"), F.lit("\0")).alias("_lang"),
        F.coalesce(F.col("source"), F.lit("\0")).alias("_source"),
        F.monotonically_increasing_id().alias("tie"),
    )
    narrow = narrow.withColumn("_tie", unit(F.lit(5), F.col("tie")) / float(1 << 31))
    spread = lambda salt: (unit(F.lit(salt), F.col("doc_id"), F.col("text_crc32")) + F.col("_tie")) / steps
    step = lambda name: F.floor(unit(F.col(name)) * (steps - 1)) / steps
    return narrow.select(
        "doc_id",
        "size",
        "text_crc32",
        "tie",
        (F.floor(F.least(F.log2(F.col("size") / OVERHEAD) / 31, F.lit(0.999)) * (steps * 16)) / (steps * 16) + spread(1) / 16).alias("k_size"),
        (step("_lang") + spread(2)).alias("k_lang"),
        (step("_source") + spread(3)).alias("k_source"),
    )


def known(values: list, kind: str) -> Column:
    """What the driver knows of each node, by the row's node: an array of a row for each shard at most, whatever the input's size."""
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("node"))


def along(dims: list[int | None]) -> Column:
    """The coordinate along its node's dimension; null where the node has none."""
    return F.get(F.array(*DIMENSIONS), known(dims, "int"))


def crossings(rows: DataFrame, nodes: dict[int, tuple[int, float, float, float]], n: int, bins: int, fine: float, rounds: int = 6) -> dict[int, float]:
    """Of each node the coordinate below which the wanted bytes lie, by histograms until the bin crossed holds ``fine`` bytes at most; nodes: dimension, low, high, bytes wanted."""
    at, out = {k: list(v) for k, v in nodes.items()}, {}
    for _ in range(rounds):
        if not at:
            break
        each = lambda i: [at[k][i] if k in at else None for k in range(n)]
        held = rows.select("node", "size", along(each(0)).alias("x"), known(each(1), "double").alias("lo"), known(each(2), "double").alias("hi"))
        # No filter: pushed down, it would repeat the nodes' expressions of all levels.
        place = F.when((F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi")), F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
        sums: dict[int, list[tuple[int, int]]] = {}
        for r in held.groupBy("node", place.alias("bin")).agg(F.sum("size").alias("bytes")).collect():
            if r["bin"] is None:
                continue
            sums.setdefault(r["node"], []).append((r["bin"], r["bytes"]))
        for k, found in sums.items():
            _, lo, hi, want = at[k]
            below = 0.0
            for b, size in sorted(found):
                if below + size >= want:
                    at[k][1:] = [lo + (hi - lo) * b / bins, lo + (hi - lo) * (b + 1) / bins, want - below]
                    out[k] = at[k][1] if 2 * at[k][3] < size else at[k][2]
                    if size <= fine or not at[k][1] < at[k][2]:
                        del at[k]
                    break
                below += size
        at = {k: v for k, v in at.items() if k in sums}
    return out


def kd_shards(docs: DataFrame, shards: int = 40, bins: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    rows = stored(coordinates(docs)).withColumn("node", F.lit(0))
    nodes = [(0, shards)]  # first shard and number of shards of each node
    ends = [f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]
    whole = None
    while any(n > 1 for _, n in nodes):
        stats = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("size").alias("bytes"), *ends).collect()}
        if not stats:
            break
        if whole is None:
            root = stats[0]
            whole = [root[f"hi_{d}"] - root[f"lo_{d}"] for d in DIMENSIONS]
            fine = root["bytes"] / shards / 1000
        wanted = {}
        for k, (_, n) in enumerate(nodes):
            if n > 1 and (r := stats.get(k)):
                widths = [r[f"hi_{d}"] - r[f"lo_{d}"] for d in DIMENSIONS]
                # A dimension whose range is within a step has one value: its rows differ by hash alone.
                widths = [w / x if x > 1 / STEPS else w / STEPS for w, x in zip(widths, whole, strict=True)]
                d = max(range(len(DIMENSIONS)), key=lambda i: (widths[i], -i))
                wanted[k] = (d, r[f"lo_{DIMENSIONS[d]}"], math.nextafter(r[f"hi_{DIMENSIONS[d]}"], math.inf), r["bytes"] * (n // 2) / n)
        cuts = crossings(rows, wanted, len(nodes), bins, fine)
        each, base, halves = [], [], []
        for k, (first, n) in enumerate(nodes):
            base.append(len(halves))
            each.append((wanted[k][0], cuts[k]) if k in cuts else (None, None))
            halves += [(first, n // 2), (first + n // 2, n - n // 2)] if n > 1 else [(first, n)]
        beyond = F.coalesce((along([x[0] for x in each]) >= known([x[1] for x in each], "double")).cast("int"), F.lit(0))
        # Written, so that no level works out those before it again.
        rows, nodes = stored(rows.withColumn("node", known(base, "int") + beyond)), halves
    return slotted(rows.withColumn("shard", known([first for first, _ in nodes], "int")), shards)


def slotted(rows: DataFrame, shards: int, cell_rows: int = 50_000) -> DataFrame:
    """Adds slot, gapless from 0 in each shard: rows are numbered inside cells of a bounded size, cells are offset by their counts."""
    cells = max(1, math.ceil(rows.count() / (shards * cell_rows)))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("tie", F.lit(7)), F.lit(cells)).cast("int"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "tie"))
    numbered = rows.withColumn("inside", inside).join(offsets, ["shard", "cell"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("inside") - 1).cast("long").alias("slot"))


def op4_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
