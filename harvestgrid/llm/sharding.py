"""Shards of near equal size by longest-processing-time scheduling.

Groups of equal texts stay together. Sorted by size, each goes to the least loaded shard, found with a heap. Groups above
a share of the total, of which there can be only so many, are scheduled one by one; all others are dealt by
hash into a fixed number of parcels first, and the parcels are scheduled. So the list that the driver
schedules has a fixed bound, whatever the number of documents.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harvestgrid.llm.tables import cut

# A group above total / (shards * LARGE) bytes is scheduled by itself: at most shards * LARGE of them.
LARGE = 2_048
PARCELS = 16_384


def schedule(sizes: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """Shard of each name: largest first (equal ones by name), each to the least loaded shard (equal ones: the lowest)."""
    heap = [(0, shard) for shard in range(shards)]
    out = {}
    for name, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8) -> DataFrame:
    """Put every row into a shard: (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    The law is ``bytes``: sums of ``size`` (UTF-8 bytes of the text, none for null, plus 1) are near equal, and rows of
    equal text share a shard. Null texts are not equal to anything. ``slot`` counts a shard's rows from 0 without
    gaps, by id, then checksum; equal rows in any order. ``grown_shard`` is null under this law. Repeated rows and
    null ids are rows like any other. Other columns are not read.
    """
    text = F.col(text_col)
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.md5(text.cast("binary")).alias("grp"),
            F.monotonically_increasing_id().alias("place"),
        ).withColumn("grp", F.coalesce("grp", F.concat(F.lit("null "), F.col("place").cast("string"))))
    )
    groups = cut(rows.groupBy("grp").agg(F.sum("size").alias("size")))
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    large = F.col("size") > total / (shards * LARGE)
    parcel = F.concat(F.lit("parcel "), F.pmod(F.xxhash64("grp"), F.lit(PARCELS)))
    # At most shards * LARGE + PARCELS rows come back.
    units = (
        groups.select(F.when(large, F.col("grp")).otherwise(parcel).alias("unit"), "size")
        .groupBy("unit")
        .agg(F.sum("size").alias("size"))
        .collect()
    )
    plan = schedule([(u["unit"], u["size"]) for u in units], shards)
    named = docs.sparkSession.createDataFrame(list(plan.items()), "unit string, shard int")
    placed = (
        rows.join(groups.where(large).select("grp", F.lit(True).alias("alone")).hint("broadcast"), "grp", "left")
        .withColumn("unit", F.when(F.col("alone"), F.col("grp")).otherwise(parcel))
        .join(F.broadcast(named), "unit")
        .select("doc_id", "size", "text_crc32", "shard", "place")
    )
    ordered = cut(
        # The place in the input parts rows that are equal, so that a range of them is no bigger than others.
        placed.repartitionByRange("shard", "doc_id", "text_crc32", "place")
        .sortWithinPartitions("shard", "doc_id", "text_crc32", "place")
        .withColumn("part", F.spark_partition_id())
        .withColumn("row", F.monotonically_increasing_id())
    )
    # One row per partition and shard in it.
    runs = ordered.groupBy("shard", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return ordered.join(F.broadcast(runs), ["shard", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.col("row") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
