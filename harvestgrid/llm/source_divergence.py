"""Source divergence audit: how far the word use of each source lies from that of the others of its language.

Words are counted per (lang, source). For the sums over all kept terms, the cube (source, source, term) of a language is cut into
cells of (source block, source block, term block). The counts of a source block are sent to every cell that it is a side
of; a cell holds two such slices, works out the partial divergences of all its pairs of sources, and the partial sums are
reduced along the term axis. A cell's size is bounded by its blocks, whatever the number of sources, terms or rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestgrid.llm.byte_words import LETTERS, word_pieces
from harvestgrid.llm.tables import cut

# Shares are whole parts of this.
PARTS = 1_000_000_000
GROUP_BLOCK = 64
TERM_BLOCK = 4_096
# Entries that a task counts up before it hands them on.
HELD = 400_000


def _count(batches):
    """Uses per language, source and term, and the texts that hold the term."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows():
        langs, sources, terms, uses, texts = [], [], [], [], []
        for (lang, source), (total, holding) in held.items():
            langs.extend([lang] * len(total))
            sources.extend([source] * len(total))
            terms.extend(total)
            uses.extend(total.values())
            texts.extend(holding[term] for term in total)
        kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        columns = (langs, sources, terms, uses, texts)
        held.clear()
        return pa.record_batch(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "source", "term", "n", "docs"]
        )

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text")), strict=True):
            total, holding = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            distinct: set[bytes] = set()
            for words in word_pieces(text.as_py(), LETTERS):
                total.update(words)
                distinct.update(words)
            holding.update(distinct)
        if sum(len(total) for total, _ in held.values()) + len(held) > HELD:
            yield rows()
    if held:
        yield rows()


def _share(count: str, total: str, size: str) -> Column:
    """``1 + floor(PARTS * (count + 1) / (total + size))``, exactly; null for an empty vocabulary."""
    over = f"CAST(NULLIF({size}, 0) + {total} AS DECIMAL(20, 0))"
    return F.expr(f"1 + (CAST({count} + 1 AS DECIMAL(20, 0)) * {PARTS}) div {over}")


def _partial(table: pa.Table) -> pa.Table:
    """Partial divergences of a cell, for each of its ordered pairs of different sources.

    Rows without a term give a source's share of a term that it lacks (``p``) and the vocabulary's size. ``seen``
    counts the terms that any source of the cell has; each of the others adds ``lacking``.
    """
    first, second = (table.column(c)[0].as_py() for c in ("a", "b"))
    term = table.column("term")
    marks = table.filter(pc.is_null(term))
    names = marks.column("source").to_pylist()
    place = {name: k for k, name in enumerate(names)}
    blocks = marks.column("block").to_numpy()
    base = marks.column("p").to_numpy()
    size = marks.column("size")[0].as_py()
    held = table.filter(pc.is_valid(term))
    coded = held.column("term").combine_chunks().dictionary_encode() if held.num_rows else None
    seen = len(coded.dictionary) if held.num_rows else 0
    shares = np.repeat(base[:, None], max(seen, 1), axis=1)[:, :seen]
    if held.num_rows:
        owner = held.column("source").combine_chunks().dictionary_encode()
        owners = np.array([place[s] for s in owner.dictionary.to_pylist()])[owner.indices.to_numpy()]
        shares[owners, coded.indices.to_numpy()] = held.column("p").to_numpy()
    out: list[list] = [[], [], [], [], []]
    left, right = np.flatnonzero(blocks == first), np.flatnonzero(blocks == second)
    for k, x in enumerate(left):
        others = right[k + 1 :] if first == second else right
        gap = shares[x] - shares[others]
        gap *= gap
        there = (gap // shares[others]).sum(1)
        back = (gap // shares[x]).sum(1)
        apart = (base[x] - base[others]) ** 2
        for one, other, partial, lacking in (
            (np.full(len(others), x), others, there, apart // base[others]),
            (others, np.full(len(others), x), back, apart // base[x]),
        ):
            out[0].extend(names[j] for j in one)
            out[1].extend(names[j] for j in other)
            out[2].extend(partial.tolist())
            out[3].extend([seen] * len(others))
            out[4].extend(lacking.tolist())
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    lang = pa.array([table.column("lang")[0].as_py()] * len(out[0]), pa.string())
    return pa.table(
        [lang, *(pa.array(c, k) for c, k in zip(out, kinds, strict=True)), pa.array([size] * len(out[0]), pa.int64())],
        names=["lang", "source", "item", "partial", "seen", "lacking", "size"],
    )


def _pairs(kept: DataFrame, groups: DataFrame, group_block: int, term_block: int) -> DataFrame:
    """Divergence of each source from each other one of its language: (lang, source, item, value)."""
    group_blocks = F.ceil(F.col("sources") / F.lit(group_block)).cast("int")
    term_blocks = F.greatest(F.ceil(F.col("size") / F.lit(term_block)), F.lit(1)).cast("int")
    sized = groups.select(
        "lang", "source", "total", "size", group_blocks.alias("group_blocks"), term_blocks.alias("term_blocks")
    ).withColumn("block", F.pmod(F.xxhash64("source"), F.col("group_blocks")).cast("int"))
    slices = kept.drop("uses", "first").join(sized, ["lang", "source"]).select(
        "lang",
        "source",
        "term",
        _share("n", "total", "size").alias("p"),
        "size",
        "block",
        "group_blocks",
        F.pmod(F.xxhash64("term"), F.col("term_blocks")).cast("int").alias("terms"),
    )
    marks = sized.select(
        "lang",
        "source",
        F.lit(None).cast("binary").alias("term"),
        F.coalesce(_share("0L", "total", "size"), F.lit(1)).alias("p"),
        "size",
        "block",
        "group_blocks",
        F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)).alias("terms"),
    )
    cells = (
        slices.unionByName(marks)
        .withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("group_blocks") - 1)))
        .select(
            "lang",
            "source",
            "term",
            "p",
            "size",
            "block",
            F.least("block", "_with").alias("a"),
            F.greatest("block", "_with").alias("b"),
            "terms",
        )
    )
    partial = cells.groupBy("lang", "a", "b", "terms").applyInArrow(
        _partial, "lang string, source string, item string, partial long, seen long, lacking long, size long"
    )
    summed = partial.groupBy("lang", "source", "item").agg(
        F.sum("partial").alias("partial"),
        F.sum("seen").alias("seen"),
        F.max("lacking").alias("lacking"),
        F.max("size").alias("size"),
    )
    return summed.select(
        "lang", "source", "item", (F.col("partial") + (F.col("size") - F.col("seen")) * F.col("lacking")).alias("value")
    )


def source_divergence(
    docs: DataFrame,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    least_docs: int = 3,
    top: int = 200,
    group_block: int = GROUP_BLOCK,
    term_block: int = TERM_BLOCK,
) -> DataFrame:
    """Divergences of sources and of their terms: (lang, source, part, item, value, rank).

    Null language, source and text count as empty. A language keeps the terms that stand in at least ``least_docs`` of its rows. A group's
    share of a term is ``1 + floor(PARTS * (count + 1) / (N + V))``, with N its uses of kept terms and V their number;
    the divergence of share p from q is ``floor((p - q)^2 / q)``. Part ``pair`` has a row for each other source of the
    language, summed over all kept terms (0 if there are none). Part ``term`` has the ``top`` kept terms that the source uses more
    than its language does. ``rank`` goes from 1 by value, greatest first, then item in byte order. All arithmetic is exact.

    Every row counts, repeated ones too, and ids are not read. A source without a kept term still has its pairs; a
    language with one source has none. An empty table gives an empty one. Other columns are not read.
    """
    rows = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.col(text_col).cast("binary").alias("text"),
    )
    by_term = Window.partitionBy("lang", "term")
    first = F.row_number().over(by_term.orderBy("source")) == 1
    kept = cut(
        rows.mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .withColumns({"uses": F.sum("n").over(by_term), "docs": F.sum("docs").over(by_term), "first": first})
        .where(F.col("docs") >= least_docs)
        .drop("docs")
    )
    # A row per group, and per language.
    named = rows.select("lang", "source").distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("first").alias("size"))
    counted = named.join(totals, ["lang", "source"], "left").na.fill(0, ["total", "size"])
    per_lang = counted.groupBy("lang").agg(
        F.count("*").alias("sources"), F.sum("size").alias("size"), F.sum("total").alias("lang_total")
    )
    groups = cut(counted.drop("size").join(per_lang, "lang"))
    pairs = _pairs(kept, groups, group_block, term_block)
    by_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by_group)).withColumn("part", F.lit("pair"))
    uncommon = (
        kept.join(groups, ["lang", "source"])
        .select("lang", "source", "term", _share("n", "total", "size").alias("p"), _share("uses", "lang_total", "size").alias("q"))
        .where("p > q")
        .select("lang", "source", F.col("term").cast("string").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))
        .withColumn("rank", F.row_number().over(by_group))
        .where(F.col("rank") <= top)
        .withColumn("part", F.lit("term"))
    )
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(uncommon.select(*columns))
