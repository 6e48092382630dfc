"""Conflict-constrained best-fit packing.

Documents go into bins of a fixed capacity, the longest first. A bin remembers the sources and the duplicate clusters of what
it holds as bitmaps; two documents of one source or one cluster never share a bin. Bins are kept
in the order of the room they have left: the search starts at the tightest bin that has room and goes on to its
successors until a compatible one is found.

Windows of some thousand documents, dealt by hash so that a hot source is spread evenly, are packed by
themselves; no task sees more than one window at a time.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 16_384
WINDOW = 4_096
# Bits of a bitmap. Keys that share a bit count as in conflict, which costs room but never lets a conflict through.
SOURCE_BITS, CLUSTER_BITS = 1_024, 4_096


class Bins:
    """Open bins ordered by residual room."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []  # residual, bin
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def put(self, length: int, source: int, cluster: int) -> int:
        """Place a piece with its two bits (0: in conflict with nothing); returns the bin."""
        at = bisect_left(self.order, (length, -1))
        while at < len(self.order):
            residual, number = self.order[at]
            if not (self.sources[number] & source or self.clusters[number] & cluster):
                del self.order[at]
                break
            at += 1
        else:
            residual, number = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[number] |= source
        self.clusters[number] |= cluster
        if residual > length:
            insort(self.order, (residual - length, number))
        return number


def _bit(key: str | None, bits: int) -> int:
    return 0 if key is None else 1 << crc32(key.encode()) % bits


def _pack(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["length", "id_text", "piece", "source", "cluster"]).to_pylist()
        order = sorted(range(len(rows)), key=lambda k: (-rows[k]["length"], rows[k]["id_text"] or "", rows[k]["piece"]))
        bins, used = Bins(capacity), {}
        number, offset = [0] * len(rows), [0] * len(rows)
        for k in order:
            row = rows[k]
            n = bins.put(row["length"], _bit(row["source"], SOURCE_BITS), _bit(row["cluster"], CLUSTER_BITS))
            number[k], offset[k] = n, used.get(n, 0)
            used[n] = offset[k] + row["length"]
        window = table.column("window")
        names = [f"{w.as_py()}-{n}" for w, n in zip(window, number, strict=True)]
        kept = table.select(["id", "piece", "start", "length"])
        out = [pa.array(names, pa.string()), *kept.columns, pa.array(offset, pa.int64())]
        return pa.table(out, names=["bin", "id", "piece", "start", "length", "at"])

    return run


def pack_best_fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster_col: str | None = None,
    capacity: int = CAPACITY,
    window: int = WINDOW,
) -> DataFrame:
    """Pack documents into bins: one row per piece, (bin, doc_id, piece, start, length, at).

    Lengths are UTF-8 bytes, the tokens of a byte-level model. A document longer than ``capacity`` is cut into
    pieces at ``start``, without loss; ``at`` is the piece's place in its bin. The duplicate cluster is
    ``cluster_col``, by default the text without regard to case and white space. No bin holds two
    pieces of one source or one cluster. A null source or cluster, and a text that is null or blank, are in
    conflict with nothing; null and empty texts have one piece of length 0. Pieces of equal length go in the order of
    their ids, as text. Repeated rows are documents of one cluster; null ids are packed like any other. Other
    columns are not read.
    """
    plain = F.trim(F.regexp_replace(F.lower(F.col(text_col)), r"\s+", " "))
    cluster = F.when(plain != "", F.md5(plain)) if cluster_col is None else F.col(cluster_col).cast("string")
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    pieces = F.greatest(F.lit(1), F.ceil(size / F.lit(capacity))).cast("int")
    total = docs.agg(F.coalesce(F.sum(pieces), F.lit(0))).first()[0]
    windows = max(1, total // window)
    rows = (
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            cluster.alias("cluster"),
            size.alias("size"),
            pieces.alias("pieces"),
            F.monotonically_increasing_id().alias("place"),
        )
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .withColumn("start", F.col("piece") * F.lit(capacity).cast("long"))
        .select(
            "id",
            F.col("id").cast("string").alias("id_text"),
            "source",
            "cluster",
            "piece",
            "start",
            F.least(F.lit(capacity), F.col("size") - F.col("start")).cast("long").alias("length"),
            # The place in the input deals repeated rows over all windows.
            F.pmod(F.xxhash64("id", "cluster", "piece", "place"), F.lit(windows)).alias("window"),
        )
    )
    kind = dict(rows.dtypes)["id"]
    packed = rows.groupBy("window").applyInArrow(
        _pack(capacity), f"bin string, id {kind}, piece int, start long, length long, at long"
    )
    return packed.withColumnRenamed("id", "doc_id")
