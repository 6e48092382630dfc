"""Importance resampling towards a target's word distribution, with hashed n-gram features.

Each document's words are joined by one space and scanned once for running CRCs: one after each word, one after the
space behind it. The CRC of any n-gram follows from two of them. CRC is linear over GF(2): the prefix before the
n-gram is carried over the n-gram's length by a shift (a 32 x 32 bit matrix as byte tables) and cancelled by XOR. So no
n-gram is cut out or read again, however many orders there are.
"""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestgrid.llm.byte_words import LETTERS_AND_DIGITS, word_pieces
from harvestgrid.llm.tables import cut

BUCKETS = 10_000
POLYNOMIAL = 0xEDB88320
# Lengths up to this have a table of their own; longer ones are put together from powers of two.
SHORT = 256
LENGTH_BITS = 40


def _byte_tables(columns: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by its 32 columns, as four tables of 256 entries."""
    tables = np.zeros((4, 256), np.uint32)
    values = np.arange(256)
    for part in range(4):
        for bit in range(8):
            tables[part][(values >> bit & 1) == 1] ^= columns[8 * part + bit]
    return tables


def apply_shift(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """Values under the map of ``tables``."""
    out = np.zeros(len(crc), np.uint32)
    for part in range(4):
        out ^= tables[part][crc >> np.uint32(8 * part) & np.uint32(255)]
    return out


def shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """Maps that carry a CRC over zero bytes: over 0 to ``SHORT`` of them, and over 2^k of them."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    columns = bits
    for _ in range(8):
        columns = np.where(columns & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0)) ^ columns >> np.uint32(1)
    one = _byte_tables(columns)
    short = [_byte_tables(bits)]
    for _ in range(SHORT):
        columns = apply_shift(one, apply_shift(short[-1], bits))
        short.append(_byte_tables(columns))
    powers = [one]
    for _ in range(LENGTH_BITS - 1):
        powers.append(_byte_tables(apply_shift(powers[-1], apply_shift(powers[-1], bits))))
    return np.stack(short), np.stack(powers)


_shifts: list[tuple[np.ndarray, np.ndarray]] = []


def carry(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each CRC carried over as many bytes as ``length`` says."""
    if not _shifts:
        _shifts.append(shift_tables())
    short, powers = _shifts[0]
    near = length <= SHORT
    out = np.zeros(len(crc), np.uint32)
    flat = short.reshape(len(short), -1)
    for part in range(4):
        index = (crc[near] >> np.uint32(8 * part) & np.uint32(255)).astype(np.int64) + 256 * part
        out[near] ^= flat[length[near], index]
    far = np.flatnonzero(~near)
    if len(far):
        value, left = crc[far], length[far]
        for k in range(LENGTH_BITS):
            has = left >> k & 1 == 1
            if has.any():
                value[has] = apply_shift(powers[k], value[has])
        out[far] = value
    return out


class RunningCrc:
    """Running CRCs of one document's joined words; word lists may come in pieces."""

    def __init__(self, longest: int):
        self.longest = longest
        # The CRC and length before each of the last words, so that n-grams over two pieces are whole.
        self.starts = np.zeros(0, np.uint32)
        self.offsets = np.zeros(0, np.int64)
        self.crc, self.size, self.words = 0, 0, 0

    def grams(self, words: list[bytes]) -> list[np.ndarray]:
        """CRCs of the n-grams that end in this piece, an array per order."""
        if not words:
            return [np.zeros(0, np.uint32)] * self.longest
        space, crc32 = (b" " if self.words else b""), zlib.crc32
        self.words += len(words)
        start = crc32(space, self.crc)
        first = crc32(words[0], start)
        scan = accumulate(words[1:], lambda crc, word: crc32(word, crc32(b" ", crc)), initial=first)
        runs = np.fromiter(scan, np.uint32, len(words))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = self.size + len(space) + np.cumsum(lengths + 1) - 1
        begins = ends - lengths
        # What each word starts from: the run before it, and its space.
        spaced = np.concatenate([np.array([start], np.uint32), _after_space(runs[:-1])])
        self.crc, self.size = int(runs[-1]), int(ends[-1])
        starts, offsets = np.concatenate([self.starts, spaced]), np.concatenate([self.offsets, begins])
        old = len(self.starts)
        out = []
        for n in range(1, self.longest + 1):
            # The n-gram that ends with word k starts at word k - n + 1.
            first = max(0, n - 1 - old)
            at = np.arange(first, len(words)) + old - n + 1
            out.append(runs[first:] ^ carry(starts[at], ends[first:] - offsets[at]))
        keep = min(self.longest - 1, len(starts))
        self.starts, self.offsets = starts[len(starts) - keep :], offsets[len(offsets) - keep :]
        return out


def _after_space(crc: np.ndarray) -> np.ndarray:
    """CRCs after one more space, from those before it."""
    return carry(crc, np.ones(len(crc), np.int64)) ^ np.uint32(zlib.crc32(b" "))


def _buckets(text: bytes | None, longest: int, buckets: int):
    """Words and hash buckets of the n-grams of each piece of a text."""
    scan = RunningCrc(longest)
    for words in word_pieces(text, LETTERS_AND_DIGITS):
        grams = scan.grams(words)
        yield len(words), (np.concatenate(grams) if longest > 1 else grams[0]).astype(np.int64) % buckets


def bucket_counts(rows: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How many n-grams of the column ``text`` (binary) fall into each bucket; at most one row per bucket comes back."""

    def count(batches):
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                for _, found in _buckets(text.as_py(), longest, buckets):
                    held += np.bincount(found, minlength=buckets)
        full = np.flatnonzero(held)
        yield pa.record_batch([pa.array(full), pa.array(held[full])], names=["bucket", "n"])

    out = np.zeros(buckets, np.float64)
    for row in rows.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of the target's smoothed share of each bucket to the corpus's."""
    size = len(corpus)
    ratio = (target + 1) * (corpus.sum() + size) / ((corpus + 1) * (target.sum() + size))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _gumbel(id_col: Column, seed: int) -> Column:
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((drawn + 0.5) / F.lit(4294967296.0))))


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    longest: int = 1,
    buckets: int = BUCKETS,
    least_words: int = 20,
    percent: int = 10,
    seed: int = 2024,
) -> DataFrame:
    """Draw ``percent`` of the rows with ``least_words`` words or more, as the target's words would have them.

    Gives (doc_id, n_features, weight, score, rank) for every row. Features are all runs of 1 to ``longest`` words, hashed into ``buckets``;
    a bucket's gain is 1000 times the log ratio of its smoothed shares in target and corpus, rounded down. ``weight``
    is the mean gain of a row's features, rounded down (none: 0), ``score`` adds Gumbel noise that follows from seed and id, and ``rank``
    (1, 2, 3 ...) goes by score, then smaller id, null ids last; rows not drawn have none.

    Null and empty texts have no features. A null id draws its noise as an empty id. Repeated rows are rows like any
    other: they share their score, and ranks among rows that are equal throughout come in any order. Both tables may be empty. Other
    columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    aims = target.select(F.col(target_col).cast("binary").alias("text"))
    gain = gains(bucket_counts(rows.select("text"), longest, buckets), bucket_counts(aims, longest, buckets))
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches):
        gain = shared.value
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for text in batch.column("text"):
                words = features = total = 0
                for size, found in _buckets(text.as_py(), longest, buckets):
                    words, features, total = words + size, features + len(found), total + int(gain[found].sum())
                out.append((words, features, total // features if features else 0))
            columns = zip(*out, strict=True) if out else ([], [], [])
            yield pa.record_batch(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)],
                names=["doc_id", "words", "n_features", "weight"],
            )

    kind = dict(rows.dtypes)["doc_id"]
    scored = cut(
        rows.mapInArrow(weigh, f"doc_id {kind}, words long, n_features long, weight long")
        .withColumn("score", F.col("weight") + _gumbel(F.col("doc_id"), seed))
        .withColumn("place", F.monotonically_increasing_id())
    )
    return _ranked(scored, F.col("words") >= least_words, percent).select("doc_id", "n_features", "weight", "score", "rank")


def _ranked(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """The rows with the rank of those drawn. No task sees more than its range of the order, however many rows tie.

    Scores are whole thousandths of bounded logarithms, so their counts are at most some hundred thousand rows.
    """
    counts = scored.where(eligible).groupBy("score").count().orderBy(F.desc("score")).collect()
    drawn = percent * sum(c["count"] for c in counts) // 100
    above, edge = 0, None
    for c in counts:
        if above >= drawn:
            break
        above, edge = above + c["count"], c["score"]
    none = F.lit(None).cast("long")
    if edge is None:
        return scored.withColumn("rank", none)
    inside = eligible & (F.col("score") >= edge)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("place")]
    ordered = cut(
        scored.where(inside)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("row", F.monotonically_increasing_id())
    )
    # A row per partition.
    runs = ordered.groupBy("part").agg(F.min("row").alias("first"), F.count("*").alias("n")).orderBy("part").collect()
    shifts, before = [], 0
    for run in runs:
        shifts.append((run["part"], before - run["first"] + 1))
        before += run["n"]
    shift = scored.sparkSession.createDataFrame(shifts, "part int, shift long")
    rank = F.col("row") + F.col("shift")
    ranked = ordered.join(F.broadcast(shift), "part").withColumn("rank", F.when(rank <= drawn, rank))
    return ranked.select(*scored.columns, "rank").unionByName(scored.where(~inside).withColumn("rank", none))
