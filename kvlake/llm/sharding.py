"""Sharding by the longest-processing-time rule: whole groups of equal texts, largest first, to the least-loaded shard.

The heap runs on the driver over *size classes*, not over groups.  A group is alone in its class when it is heavy (at
least 1/64 of an even shard, so at most 64 x shards such groups exist); every other group belongs to the class of its
size cut to nine significant bits, of which fewer than 256 x 64 exist.  The groups of a class differ by less than 0.4 %
and are dealt in one go as if they had the mean of their class: for groups of equal size that is what the heap would do
one by one, else every light group stands within 0.4 % of its own place.  Which group of a class goes where follows from
a distributed rank, so neither driver nor any task holds the groups.

Null and empty texts count as equal and have 16 bytes.  Whole texts are measured, however long.  Ties between groups go
by a hash of the text, ties between shards to the lowest.  Repeated rows are separate documents of one group.  An empty
table gives an empty result.  Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.llm.common import materialize, rank_in_groups

#: A group is heavy from this part of an even shard on.
HEAVY_PARTS = 64
#: Bytes that a document takes besides its text.
OVERHEAD = 16


def lpt(classes: list[tuple[int, int, float]], shards: int) -> dict[int, list[int]]:
    """classes: (class, number of groups, mean size).  Returns how many groups of each class every shard gets.

    Equal to placing the groups one at a time, largest first, on the least-loaded shard; a class with many groups is
    first filled up to a common level, the rest of it goes through the heap.
    """
    loads = [0.0] * shards
    given: dict[int, list[int]] = {}
    for name, count, mean in sorted(classes, key=lambda c: (-c[2], c[0])):
        parts = [0] * shards
        if count >= 4 * shards:
            low, high = min(loads), max(loads) + mean * (count / shards + 1)
            for _ in range(100):
                level = (low + high) / 2
                if sum(max(0, int((level - x) / mean)) for x in loads) <= count:
                    low = level
                else:
                    high = level
            parts = [max(0, int((low - x) / mean)) for x in loads]
            loads = [x + n * mean for x, n in zip(loads, parts, strict=True)]
        heap = [(x, s) for s, x in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(count - sum(parts)):
            load, s = heap[0]
            parts[s] += 1
            heapq.heapreplace(heap, (load + mean, s))
        for load, s in heap:
            loads[s] = load
        given[name] = parts
    return given


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal the documents to ``shards`` shards of nearly equal bytes, equal texts together.

    Returns id_col, size, text_crc32, group_bytes, shard and slot (gapless from 0 inside the shard).
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(
        docs.select(
            F.col(id_col).alias("_id"),
            (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("_k"),
        ),
        "shard-docs",
    )
    key = ["_k", "text_crc32", "size"]
    groups = rows.groupBy(*key).agg((F.count(F.lit(1)) * F.col("size")).alias("group_bytes"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    heavy = max(total // (shards * HEAVY_PARTS), 1 << 9)
    cut = F.greatest(F.length(F.bin("group_bytes")) - 9, F.lit(0))
    rough = F.expr("shiftleft(shiftright(group_bytes, _cut), _cut)")
    groups = groups.withColumn("_cut", cut).withColumn("_class", F.when(F.col("group_bytes") >= heavy, -F.col("group_bytes")).otherwise(rough)).drop("_cut")
    groups = materialize(groups, "shard-groups")

    classes = [(r[0], r[1], r[2] / r[1]) for r in groups.groupBy("_class").agg(F.count(F.lit(1)), F.sum("group_bytes")).collect()]
    bounds = []
    for name, parts in lpt(classes, shards).items():
        upto, ends = 0, []
        for n in parts:
            upto += n
            ends.append(upto)
        bounds.append((name, ends))
    plan = spark.createDataFrame(bounds, "_class2 long, _ends array<long>")

    ranked = rank_in_groups(groups, ["_class"], [F.col(c) for c in key], "_rank", F.xxhash64(*key, F.lit(1)), 64)
    # The plan has at most 64 x shards + 16,384 rows of one number a shard.
    placed = ranked.join(F.broadcast(plan), F.col("_class") == F.col("_class2")).select(*key, "group_bytes", F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))).alias("shard"))
    # Many copies of one text make a hot key; adaptive execution splits it, as neither side needs its rows together.
    dealt = materialize(rows.join(placed, key).select("_id", "size", "text_crc32", "group_bytes", "shard"), "shard-dealt")
    out = rank_in_groups(dealt, ["shard"], [F.col("_id"), F.col("text_crc32"), F.col("size")], "slot", F.xxhash64("_id", "text_crc32", "size"), 256)
    return out.withColumnRenamed("_id", id_col)


def op1_sharding(spark, sf_dir: str, shards: int = 40) -> DataFrame:
    from kvlake.llm.common import table

    out = shard_by_bytes(table(spark, sf_dir, "documents"), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_bytes")
