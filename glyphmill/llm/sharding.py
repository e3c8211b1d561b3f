"""Sharding by longest processing time: the largest group goes to the least-loaded shard.

Documents with equal texts form a group and stay together. Groups are taken by
size, largest first, and a heap gives the least-loaded shard each time. Equal
groups are interchangeable, so the heap runs over the histogram of group sizes,
not over the groups: sizes under 65,536 bytes are classes of their own, larger
ones share a class with those within 1/4096 of them, which bounds the histogram
to some 260,000 rows at any input size. For a class the heap yields how many of
its groups each shard takes; a group's rank in its class then decides its shard.

Ranks (of groups in a class, of documents in a shard) are taken in two levels:
row numbers within hash blocks, plus the sizes of the blocks before. So a class
or shard with most rows is spread over all blocks, and texts are read once and
never shuffled, only their sizes, checksums and 128-bit hashes.

Defined cases: a null text counts as an empty one; repeated rows are separate
rows of one group; an empty table gives an empty result; one group that outweighs
all others still stays whole, since the law of this method is equal bytes under
that condition.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, blocks

#: Bytes that a document takes besides its text.
ROW_BYTES = 8
#: Group sizes below this are classes of their own.
EXACT_BELOW = 1 << 16
#: Bits of precision of the classes above.
CLASS_BITS = 12


def lpt_quotas(classes: Iterable[tuple[float, int]], shards: int) -> list[np.ndarray]:
    """How many groups of each class every shard takes.

    ``classes``: (size of a group, number of groups), largest size first. The same
    result as pushing the groups through the heap one by one, but a class of many
    groups is first levelled in one step.
    """
    load = [(0.0, s) for s in range(shards)]
    out = []
    for size, n in classes:
        quota = np.zeros(shards, np.int64)
        if n > 2 * shards:
            levels, left = np.array([x for x, _ in sorted(load, key=lambda x: x[1])]), n
            order = np.sort(levels)
            for m in range(shards, 0, -1):  # the shards that the level reaches
                level = (order[:m].sum() + n * size) / m
                if level >= order[m - 1]:
                    break
            quota = np.maximum(0, np.floor((level - levels) / size)).astype(np.int64)
            left = n - int(quota.sum())
            if left < 0:  # rounding of the level
                quota[np.argmax(quota)] += left
                left = 0
            load = [(float(levels[s] + quota[s] * size), s) for s in range(shards)]
            heapq.heapify(load)
        else:
            left = n
        for _ in range(left):
            at, shard = load[0]
            heapq.heapreplace(load, (at + size, shard))
            quota[shard] += 1
        out.append(quota)
    return out


def assign_shards(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, size, text_crc32, shard and slot."""
    spark = docs.sparkSession
    scratch, n_blocks = Scratch(spark, "sharding"), blocks(spark)
    whole = F.coalesce(text, F.lit(""))
    rows = scratch.keep(
        docs.select(
            F.col(key).alias("_key"), (F.octet_length(whole) + ROW_BYTES).cast("long").alias("size"), F.crc32(whole).alias("text_crc32"),
            F.xxhash64(whole).alias("_h1"), F.xxhash64(F.lit("text"), whole).alias("_h2"),
        ),
        "rows",
    )
    weight = F.col("_weight")
    step = F.when(weight < EXACT_BELOW, F.lit(1.0)).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(weight.cast("double"))) - CLASS_BITS)).cast("long")
    groups = scratch.keep(
        rows.groupBy("_h1", "_h2", "size").agg((F.count(F.lit(1)) * F.first("size")).alias("_weight"))
        .withColumn("_class", F.floor(weight / step) * step)
        .withColumn("_block", F.pmod("_h1", F.lit(n_blocks)).cast("int")),
        "groups",
    )

    histogram = groups.groupBy("_class").agg(F.count(F.lit(1)).alias("n"), F.sum("_weight").alias("bytes")).toPandas()
    histogram["mean"] = histogram["bytes"] / histogram["n"]
    histogram = histogram.sort_values(["mean", "_class"], ascending=False)
    quotas = lpt_quotas(zip(histogram["mean"].tolist(), histogram["n"].tolist(), strict=True), shards)
    plan = pd.DataFrame({"_class": histogram["_class"].to_numpy("int64"), "_ends": [np.cumsum(q).tolist() for q in quotas]})
    plan_table = scratch.keep(spark.createDataFrame(plan, "_class bigint, _ends array<bigint>"), "plan")

    in_block = groups.groupBy("_class", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_class").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = in_block.select("_class", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")).join(plan_table, "_class")
    local = Window.partitionBy("_class", "_block").orderBy("_h1", "_h2", "size")
    ranked = groups.withColumn("_rank", F.row_number().over(local) - 1).join(offsets, ["_class", "_block"])
    placed = ranked.select("_h1", "_h2", "size", F.size(F.filter("_ends", lambda end: end <= F.col("_rank") + F.col("_offset"))).alias("shard"))

    sharded = scratch.keep(rows.join(placed, ["_h1", "_h2", "size"]).withColumn("_block", F.pmod(F.xxhash64("_key", "_h1"), F.lit(n_blocks)).cast("int")), "sharded")
    in_shard = sharded.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = in_shard.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = Window.partitionBy("shard", "_block").orderBy("_key", "_h1", "_h2")
    out = sharded.withColumn("_rank", F.row_number().over(local) - 1).join(starts, ["shard", "_block"])
    return out.select(F.col("_key").alias(key), "size", "text_crc32", "shard", (F.col("_rank") + F.col("_start")).cast("long").alias("slot"))
