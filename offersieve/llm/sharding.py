"""Sharding by longest-processing-time scheduling.

Documents with equal texts form a group that stays together.  Groups, largest
first, go to the least-loaded shard through a heap.  Groups of one size are
interchangeable, so the heap takes each distinct size once with its count: the
driver sees at most sqrt(2 x total bytes) sizes, never the groups themselves.

Null texts count as empty.  Repeated rows are rows of one group.  An empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offersieve.llm.common import stored

#: Groups of one size that are numbered together at least; with more of a size than the square of that, the
#: root of their number, so that neither a block nor the list of blocks outgrows a task.
_RANK_BLOCK = 64
#: Blocks of a shard that are numbered by themselves.
_SLOT_BLOCKS = 512


def deal(loads: list[int], size: int, count: int) -> list[int]:
    """How many of count groups of one size the heap gives each shard; loads are updated.

    The heap takes the count least values of {load + i * size}, ties to the lower shard.
    All values up to a level are taken at once; what is left goes through the heap.
    """

    def taken(level: int) -> list[int]:
        return [max(0, (level - x) // size + 1) if level >= x else 0 for x in loads]

    low, high = min(loads) - 1, max(loads) + size * (count + 1)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if sum(taken(middle)) <= count else (low, middle - 1)
    out = taken(low)
    heap = [(x + size * k, j) for j, (x, k) in enumerate(zip(loads, out, strict=True))]
    heapq.heapify(heap)
    for _ in range(count - sum(out)):
        load, j = heap[0]
        out[j] += 1
        heapq.heapreplace(heap, (load + size, j))
    for j, k in enumerate(out):
        loads[j] += size * k
    return out


def schedule(sizes: list[tuple[int, int]], n_shards: int) -> list[tuple[int, int, list[int]]]:
    """(size, count) pairs -> (size, blocks, running totals of each shard's share of that size)."""
    loads, out = [0] * n_shards, []
    for size, count in sorted(sizes, reverse=True):
        total, ends = 0, []
        for k in deal(loads, size, count):
            total += k
            ends.append(total)
        out.append((size, -(-count // max(_RANK_BLOCK, math.isqrt(count))), ends))
    return out


def shards(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs."""
    spark = docs.sparkSession
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = stored(
        docs.select(
            "doc_id",
            (F.octet_length(data).cast("long") + 1).alias("size"),
            F.crc32(data).alias("text_crc32"),
            F.unhex(F.sha2(data, 256)).alias("text_key"),
        ),
        "rows",
    )
    groups = stored(rows.groupBy("text_key").agg(F.sum("size").alias("group_size")), "groups")
    sizes = [(r[0], r[1]) for r in groups.groupBy("group_size").count().collect()]
    plan = spark.createDataFrame(schedule(sizes, n_shards), "group_size long, blocks long, ends array<long>")
    blocked = stored(
        groups.join(plan, "group_size").withColumn("block", F.pmod(F.xxhash64("text_key"), "blocks")),
        "blocked",
    )
    # A block's number of groups, and how many stand in the blocks before it.
    before = (
        blocked.groupBy("group_size", "block").count()
        .withColumn("before", F.sum("count").over(Window.partitionBy("group_size").orderBy("block")) - F.col("count"))
        .drop("count")
    )
    ranked = blocked.withColumn("rank", F.row_number().over(Window.partitionBy("group_size", "block").orderBy("text_key")) - 1)
    placed = stored(
        ranked.join(before, ["group_size", "block"]).select(
            "text_key",
            F.size(F.filter("ends", lambda e: e <= F.col("rank") + F.col("before"))).alias("shard"),
        ),
        "placed",
    )
    out = stored(
        rows.join(placed, "text_key").withColumn("block", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(_SLOT_BLOCKS))),
        "sharded",
    )
    # At most n_shards x _SLOT_BLOCKS rows.
    totals, starts, at = sorted(map(tuple, out.groupBy("shard", "block").count().collect())), [], {}
    for shard, block, count in totals:
        starts.append((shard, block, at.get(shard, 0)))
        at[shard] = at.get(shard, 0) + count
    starts = spark.createDataFrame(starts, "shard int, block long, start long")
    number = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_key"))
    return (
        out.withColumn("number", number)
        .join(F.broadcast(starts), ["shard", "block"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("start") + F.col("number") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
