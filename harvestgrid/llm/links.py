"""Links between rows: comparison in bounded blocks, and connected components.

A group of rows is compared as pairs of blocks, never whole in one task: a group of n rows is cut by hash
into n / ``block`` blocks, and each task holds two of them. A task gives back, for all links it finds, how many
each row has and a spanning forest of them, so the output does not grow with the square of a group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestgrid.llm.tables import cut

FOUND = "item long, other long, links long"


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric matrix of links."""
    left = np.ones(len(linked), bool)
    edges = []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            new = np.flatnonzero(linked[at] & left)
            left[new] = False
            edges.extend((at, int(k)) for k in new)
            queue.extend(new.tolist())
    return edges


def compare_blocks(
    members: DataFrame, linked: Callable[[list[bytes], list[bytes]], np.ndarray], rows: int, block: int
) -> DataFrame:
    """Compare all rows of each group with each other.

    ``members`` has ``grp`` long, ``n`` long (items of the group), ``item`` long (a repeated one counts once),
    ``weight`` long and ``payload`` binary; ``rows`` is about their number. ``linked(a, b)`` says for two lists of payloads which of a link with which of
    b. Gives rows (item, other, null) for a spanning forest of the links that each task found, and rows
    (item, null, links) with the summed weights of the rows that an item links with, in each task.
    """
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    bundles = max(1, rows // (2 * block))
    own = F.pmod(F.xxhash64("item"), F.col("_of")).cast("int")
    dealt = (
        members.withColumn("_of", blocks)
        .withColumn("_own", own)
        .withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
        .select(
            "grp",
            "item",
            "weight",
            "payload",
            F.col("_own").alias("own"),
            F.least("_own", "_with").alias("i"),
            F.greatest("_own", "_with").alias("j"),
            F.when(F.col("_of") == 1, F.pmod(F.xxhash64("grp"), F.lit(bundles)))
            .otherwise(F.xxhash64("grp", F.least("_own", "_with"), F.greatest("_own", "_with")))
            .alias("job"),
        )
    )

    def job(table: pa.Table) -> pa.Table:
        unit = np.stack([table.column(c).to_numpy() for c in ("grp", "i", "j")], axis=1)
        order = np.lexsort(unit.T[::-1])
        unit = unit[order]
        cuts = np.flatnonzero((unit[1:] != unit[:-1]).any(axis=1)) + 1
        items, weights = table.column("item").to_numpy(), table.column("weight").to_numpy()
        owns, payloads = table.column("own").to_numpy(), table.column("payload")
        found: list[tuple] = []
        for rows in np.split(order, cuts):
            if len(rows) < 2:
                continue
            rows = rows[np.unique(items[rows], return_index=True)[1]]
            _, i, j = (table.column(c)[int(rows[0])].as_py() for c in ("grp", "i", "j"))
            sides = [rows[owns[rows] == i], rows[owns[rows] == j]]
            loads = [[payloads[int(k)].as_py() for k in side] for side in sides[: 1 + (i != j)]]
            if not len(sides[0]) or not len(sides[1]):
                continue
            match = linked(loads[0], loads[-1])
            if i == j:
                np.fill_diagonal(match, False)
                whole, at = match, sides[0]
            else:
                a, b = match.shape
                whole = np.zeros((a + b, a + b), bool)
                whole[:a, a:], whole[a:, :a] = match, match.T
                at = np.concatenate(sides)
            if not whole.any():
                continue
            found.extend((int(items[at[x]]), int(items[at[y]]), None) for x, y in _forest(whole))
            sums = whole @ weights[at]
            found.extend((int(items[at[k]]), None, int(sums[k])) for k in np.flatnonzero(sums))
        columns = list(zip(*found, strict=True)) if found else [[], [], []]
        kinds = [pa.int64()] * 3
        return pa.table(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["item", "other", "links"]
        )

    return dealt.groupBy("job").applyInArrow(job, FOUND)


# A node with more edges than this, and than a part in SHARE of all, is heavy; so there are at most 2 * SHARE heavy nodes.
HEAVY, SHARE = 64, 5000
# Up to so many edges the least neighbours of all nodes, 16 bytes a node, are looked up by broadcast and no edge is dealt by its node.
FEW_EDGES = 200_000


def _with_least(rows: DataFrame, least: DataFrame, bound: int) -> DataFrame:
    """The rows (u, v) with ``m`` of their node u from ``least`` (u, m, n); no task holds one heavy node's rows.

    Nodes with more than ``bound`` rows are looked up by broadcast and their rows dealt by v; the others meet by u.
    """
    heavy = F.broadcast(least.where(F.col("n") > bound).select("u", F.col("m").alias("_m")))
    light = least.where(F.col("n") <= bound).select(F.col("u").alias("_u"), F.lit(True).alias("_by_u"), "m")
    dealt = rows.join(heavy, "u", "left").withColumn("_by_u", F.col("_m").isNull())
    dealt = dealt.withColumn("_u", F.when(F.col("_by_u"), F.col("u")).otherwise(F.xxhash64("v")))
    return dealt.join(light, ["_u", "_by_u"], "left").select("u", "v", F.coalesce("_m", "m").alias("m"))


def _few_step(both: DataFrame) -> DataFrame:
    """A large-star and a small-star step on few edges, both ways round: three exchanges, none of them by a node's rows."""
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    large = both.where("v > u").join(F.broadcast(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    return large.join(F.broadcast(low), "u").select(
        F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")
    )


def _step(both: DataFrame, bound: int) -> DataFrame:
    """The same step on any number of edges; the centre of a star with more than ``bound`` of them is heavy."""
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
    large = _with_least(both.where("v > u"), least, bound).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return _with_least(large, low, bound).select(
        F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")
    )


def components(edges: DataFrame) -> DataFrame:
    """The smallest node that each node of ``edges`` (a long, b long, a <> b) reaches: (node, root).

    Alternates large-star and small-star steps until the edges no longer change; each step is joins and
    aggregates, and its edges go to the shared folder. The centre of a large star is one of at most 2 * SHARE heavy nodes,
    whose edges are spread over the tasks; up to ``FEW_EDGES`` edges stay where they are. Nodes without an edge are not in the result.
    """
    pairs = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    both_ways = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")
    seen = None
    while True:
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = state
        both = pairs.select(both_ways).select("e.u", "e.v")
        pairs = cut((_few_step(both) if state[0] <= FEW_EDGES else _step(both, max(HEAVY, state[0] // SHARE))).distinct())
