"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

Documents are sets of five-word shingles. Equal sets are one class, so copies never meet each other. Each
class gets a signature of minhash values; every tree of the forest orders the signatures by values of its
own, and a node of a tree is a prefix that several classes share. Matching begins at the deepest prefixes and
shortens them step by step. Classes that share a long prefix are joined at once, by an edge to the node's least
class. A node of the shortest prefix is closed as soon as the classes below it are all in one cluster; only
classes in open nodes go on to shorter prefixes. The shortest is the longest at which a pair at the
threshold meets in some tree with the target probability. In nodes still open there, signatures are compared in blocks, and only
across clusters; only clearly dissimilar pairs are put aside. Inside the clusters that come of it, all pairs are
verified on the full shingle sets, again in blocks.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestgrid.llm.links import compare_blocks, components
from harvestgrid.llm.tables import BROADCAST_IDS, cut
from harvestgrid.llm.words import gram_hashes, mix, word_hashes
from harvestgrid.operators.sizes import broadcast_if_small

POOL = 128
TREES = 48
DEEPEST = 16
SEED = 20240229
# A pair at the threshold whose signatures agree less than threshold - SLACK is over five deviations off.
SLACK = 0.2
# Rows of a block: signatures take 512 bytes each, sets 8 bytes a word of the text.
SIGNATURE_BLOCK, SET_BLOCK = 1024, 256
MEMBERS = "grp long, n long, item long, weight long, payload binary"
_MEMBERS = pa.schema([*((c, pa.int64()) for c in ("grp", "n", "item", "weight")), ("payload", pa.binary())])
# Columns of an incidence matrix that are held at a time.
COLUMNS = 4096


def forest_recall(depth: int, threshold: float, trees: int = TREES, pool: int = POOL) -> float:
    """The probability that two sets at the threshold share a prefix of ``depth`` values in some tree.

    Each tree orders ``depth`` of ``pool`` minhash values, so it depends on how many of the pool agree.
    """
    total = 0.0
    for same in range(pool + 1):
        chance = comb(pool, same) * threshold**same * (1 - threshold) ** (pool - same)
        total += chance * (1 - (1 - comb(same, depth) / comb(pool, depth)) ** trees)
    return total


def prefix_depth(threshold: float, recall: float, trees: int = TREES, pool: int = POOL) -> int:
    """The longest prefix that reaches the target recall; found by shortening from the deepest."""
    for depth in range(DEEPEST, 0, -1):
        if forest_recall(depth, threshold, trees, pool) >= recall:
            return depth
    return 1


def prefix_depths(threshold: float, recall: float) -> list[int]:
    """The depths at which classes are matched, longest first; the last one reaches the target recall."""
    last = prefix_depth(threshold, recall)
    return sorted({DEEPEST, (DEEPEST + last) // 2, last}, reverse=True)


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(SEED)
    odd = random.integers(0, 1 << 32, POOL, dtype=np.uint32) | np.uint32(1)
    return odd, random.integers(0, 1 << 32, POOL, dtype=np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minhash values of a set of 64-bit shingle hashes; the set must not be empty."""
    times, plus = _multipliers()
    out = np.full(POOL, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 1024):
        part = shingles[at : at + 1024]
        low, high = part.astype(np.uint32), (part >> np.uint64(32)).astype(np.uint32)
        values = times[:, None] * high[None, :]
        values += plus[:, None]
        values ^= low[None, :]
        np.minimum(out, values.min(axis=1), out=out)
    return out


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the runs of n words; a text of fewer words is one run."""
    return np.unique(gram_hashes(word_hashes(text), n))


def _print(grams: np.ndarray) -> str | None:
    """A 128-bit print of a set and its size; equal sets, and no others, have equal prints."""
    if not len(grams):
        return None
    one = int(grams.sum(dtype=np.uint64))
    two = int(mix(grams ^ np.uint64(SEED)).sum(dtype=np.uint64))
    return f"{one:016x}{two:016x}{len(grams):x}"


def _prints(n: int):
    def run(batches):
        for batch in batches:
            sets = [shingle_set(text.as_py(), n) for text in batch.column("text")]
            signatures = [signature(x).tobytes() if len(x) else None for x in sets]
            yield pa.record_batch(
                [
                    batch.column("id"),
                    batch.column("mark"),
                    pa.array([_print(x) for x in sets], pa.string()),
                    pa.array(signatures, pa.binary()),
                ],
                names=["id", "mark", "print", "signature"],
            )

    return run


def _at(depth: int) -> str:
    return f"at{depth}"


def _prefixes(depths: list[int]):
    """For each class and tree the class's prefix at each of the depths, as a hash (``at6`` and so on)."""

    def run(batches):
        random = np.random.default_rng(SEED + 1)
        picks = [random.permutation(POOL)[: max(depths)] for _ in range(TREES)]
        for batch in batches:
            reps = batch.column("rep").to_numpy()
            if not len(reps):
                continue
            values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, POOL)
            keys: dict[int, list[np.ndarray]] = {depth: [] for depth in depths}
            for tree, pick in enumerate(picks):
                key = np.full(len(reps), tree + 1, np.uint64)
                for depth, k in enumerate(pick, 1):
                    key = mix(key ^ values[:, k].astype(np.uint64)) + key
                    if depth in keys:
                        keys[depth].append(key.view(np.int64))
            yield pa.record_batch(
                [pa.array(np.tile(reps, TREES)), *(pa.array(np.concatenate(keys[d])) for d in depths)],
                names=["rep", *map(_at, depths)],
            )

    return run


def match_prefixes(signed: DataFrame, depths: list[int]) -> tuple[DataFrame, DataFrame]:
    """Match classes (``rep`` long, ``signature`` binary) by prefixes of the given depths, longest first.

    Gives the classes in nodes that stay open at the last depth (prefix long, rep long, cluster long), and the
    edges (a long, b long) found by longer prefixes. Classes that share a prefix of the last depth in some tree are either in one
    cluster of the edges or together in an open node. Classes that meet nobody are in neither.
    """
    last = _at(depths[-1])
    columns = ", ".join(f"{_at(d)} long" for d in depths)
    prefixes = signed.mapInArrow(_prefixes(depths), f"rep long, {columns}")
    nodes = (
        prefixes.groupBy(last)
        .agg(F.count("*").alias("n"), F.min("rep").alias("first"), F.bit_xor(F.xxhash64("rep")).alias("whole"))
        .where("n > 1")
        # Trees in which the same classes meet are taken once.
        .groupBy("n", "first", "whole")
        .agg(F.min(last).alias(last))
        .select(last)
    )
    members = cut(prefixes.join(nodes, last).withColumn("cluster", F.col("rep")))
    edges = members.sparkSession.createDataFrame([], "a long, b long")
    for depth in depths[:-1]:
        least = (
            members.groupBy(_at(depth))
            .agg(F.min("cluster").alias("least"), F.max("cluster").alias("most"))
            .where("least < most")
            .select(_at(depth), "least")
        )
        found = members.join(least, _at(depth)).where("cluster > least").select("cluster", "least")
        roots = components(found.toDF("a", "b"))
        roots = roots.where("node <> root").select(F.col("node").alias("cluster"), "root")
        edges = edges.union(roots)
        members = members.join(roots, "cluster", "left").withColumn("cluster", F.coalesce("root", "cluster")).drop("root")
        open_nodes = (
            members.groupBy(last)
            .agg(F.min("cluster").alias("least"), F.max("cluster").alias("most"))
            .where("least < most")
            .select(last)
        )
        members = cut(members.join(open_nodes, last, "left_semi").drop(_at(depth)))
    return members.withColumnRenamed(last, "prefix"), edges


def _alike(least: float):
    """Which signatures of a and b agree enough; payloads begin with the cluster, and one cluster's are passed over."""

    def split(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        values = np.frombuffer(b"".join(payloads), np.uint32).reshape(-1, POOL + 2)
        return values[:, :2].copy().view(np.uint64)[:, 0], values[:, 2:]

    def linked(a: list[bytes], b: list[bytes]) -> np.ndarray:
        (clusters, left), (others, right) = split(a), split(b)
        out = np.zeros((len(left), len(right)), bool)
        for k, row in enumerate(left):
            apart = np.flatnonzero(others != clusters[k])
            out[k, apart] = (right[apart] == row).sum(axis=1) >= least * POOL
        return out

    return linked


def jaccard_at_least(threshold: float):
    """Which sets (sorted 64-bit values, as bytes) of a and b have at least this Jaccard similarity.

    What a list compared with itself has on its diagonal says nothing.
    """

    def linked(a: list[bytes], b: list[bytes]) -> np.ndarray:
        sets = [np.frombuffer(x, np.uint64) for x in (a if a is b else [*a, *b])]
        sizes = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times[column] > 1
        owner, column = owner[shared], column[shared]
        renumber = np.cumsum(times > 1) - 1
        column = renumber[column]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        height = len(a)
        both = np.zeros((height, len(b)))
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            span = slice(*np.searchsorted(column, [low, low + COLUMNS]))
            held = np.zeros((len(sets), COLUMNS), np.float32)
            held[owner[span], column[span] - low] = 1
            both += held[:height] @ (held if a is b else held[height:]).T
        first = sizes[:height]
        second = first if a is b else sizes[height:]
        return both / (first[:, None] + second[None, :] - both) >= threshold

    return linked


def _sets(n: int):
    def run(batches):
        for batch in batches:
            rows, sets = [], []
            for k, (text, wanted) in enumerate(zip(batch.column("text"), batch.column("print"), strict=True)):
                grams = shingle_set(text.as_py(), n)
                if _print(grams) == wanted.as_py():
                    rows.append(k)
                    sets.append(grams.tobytes())
            kept = batch.select(["grp", "n", "item", "weight"]).take(pa.array(rows, pa.int64()))
            yield pa.record_batch([*kept.columns, pa.array(sets, pa.binary())], schema=_MEMBERS)

    return run


def _same_id(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) between the classes of texts that stand under one id."""
    several = texts.groupBy("id").count().where("count > 1").select("id")
    nodes = texts.join(several, "id").join(classes.select("print", "node"), "print").select("id", "node")
    first = nodes.groupBy("id").agg(F.min("node").alias("first"))
    return nodes.join(first, "id").where("node > first").select(F.col("node").alias("a"), F.col("first").alias("b"))


def ngram_jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    threshold: float = 0.8,
    recall: float = 0.9999,
) -> DataFrame:
    """Near-duplicate classes of documents: one row per document id with its class and its links.

    Result: ``doc_id`` long, ``class_id`` long (the smallest id that links of at least ``threshold`` reach, its own
    included) and ``n_links`` long (other documents linked directly, copies included). A text without a
    word (null, empty, only marks) has no links. Rows that repeat an id and a set of shingles are one document. Different texts under one
    id are all compared: the id has the links of each of them, summed, and they belong to one class. A null id has one row with a null
    class and no links. Ties do not arise: every pair at or above the threshold is a link. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    prints = cut(rows.mapInArrow(_prints(n), "id long, mark long, print string, signature binary"))
    named = F.when(F.col("id").isNotNull(), F.col("print"))
    ids = cut(prints.groupBy("id", named.alias("print")).agg(F.min("mark").alias("mark")))
    texts = ids.where("print IS NOT NULL")
    classes = cut(
        texts.groupBy("print")
        .agg(F.min(F.struct("id", "mark")).alias("least"), F.count("*").alias("weight"))
        .select("print", "least.*", "weight", F.monotonically_increasing_id().alias("node"))
    )
    signed = cut(prints.join(classes, ["id", "mark", "print"]).select(F.col("node").alias("rep"), "signature"))
    met, edges = match_prefixes(signed, prefix_depths(threshold, recall))
    alike = (
        met.join(met.groupBy("prefix").agg(F.count("*").alias("n")), "prefix")
        .join(signed, "rep")
        .select(
            F.col("prefix").alias("grp"),
            "n",
            F.col("rep").alias("item"),
            F.lit(1).cast("long").alias("weight"),
            F.concat(F.unhex(F.lpad(F.hex("cluster"), 16, "0")), "signature").alias("payload"),
        )
    )
    maybe = compare_blocks(alike, _alike(threshold - SLACK), met.count(), SIGNATURE_BLOCK).where("other IS NOT NULL")
    clusters = components(edges.union(maybe.select("item", "other")))
    found = cut(
        clusters.join(clusters.groupBy("root").agg(F.count("*").alias("n")), "root")
        .join(classes, "node")
        .select(F.col("root").alias("grp"), "n", F.col("node").alias("item"), "weight", "print", "id", "mark")
    )
    sets = rows.join(broadcast_if_small(found, BROADCAST_IDS), ["id", "mark"]).mapInArrow(_sets(n), MEMBERS)
    links = cut(compare_blocks(sets, jaccard_at_least(threshold), found.count(), SET_BLOCK))
    linked = links.where("other IS NOT NULL").select(F.col("item").alias("a"), F.col("other").alias("b"))
    joined = components(linked.union(_same_id(texts, classes))).join(classes.select("node", "id"), "node")
    least = joined.groupBy("root").agg(F.min("id").alias("class_id"))
    others = links.where("other IS NULL").groupBy("item").agg(F.sum("links").alias("others"))
    by_print = (
        classes.join(others.withColumnRenamed("item", "node"), "node", "left")
        .join(joined.join(least, "root").select("node", "class_id"), "node", "left")
        .select(
            "print",
            F.coalesce("class_id", "id").alias("class_id"),
            (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        )
    )
    return (
        ids.join(by_print, "print", "left")
        .groupBy(F.col("id").alias("doc_id"))
        .agg(
            F.coalesce(F.min("class_id"), F.col("doc_id")).alias("class_id"),
            F.coalesce(F.sum("n_links"), F.lit(0)).cast("long").alias("n_links"),
        )
    )
