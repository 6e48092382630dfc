"""Benchmark decontamination: rare seeds, a count of seeds on one band, then Smith-Waterman alignment of words.

Seeds are pairs of neighbouring words of a test item; a document has them as neighbours or with one word between. Any alignment
that reaches the least score has a number of seeds of the item that follows from the item's length, all within a band of
diagonals (``seeds_needed``, ``drift``). So the seeds that most items share may be passed over in the first look:
one of the others must be there. Items seen in that look are counted with all their seeds, and where a band has enough
of them, its stretch of the document is aligned with the whole item. No step loses a place that scores enough.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestgrid.llm.words import gram_hashes, word_hashes

# Characters of items that one pass over the documents looks for; more items take more passes.
ITEM_CHARS = 8_000_000
# Items of fewer words have to be matched better, and those of fewer than the second number are no evidence inside other text.
FULL_SIZE, EVIDENT_SIZE = 8, 4
# Bits of the table that documents are searched with first.
FILTER_BITS = 20
# Places of seeds that are held at a time.
PLACES = 1 << 20
MATCH, MISMATCH, GAP = 2, -1, -1


def align(item: np.ndarray, part: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two sequences of word hashes, and the end of its place in ``part``."""
    steps = np.arange(len(part) + 1) * -GAP
    row = np.zeros(len(part) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(part == word, MATCH, MISMATCH), row[1:] + GAP)
        np.maximum(new, 0, out=new)
        # Gaps along the part: the best cell to the left, less its distance.
        row = np.maximum(new, np.maximum.accumulate(new + steps) - steps)
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def place(item: np.ndarray, part: np.ndarray, least: float = 0.0) -> tuple[float, int, int]:
    """Score from 0 to 1 (1: the whole item, word by word), start and end of the best place in ``part``.

    A score under ``least`` comes without a place.
    """
    best, end = align(item, part)
    score = best / (MATCH * len(item))
    if best == 0 or score < least:
        return score, 0, 0
    _, back = align(item[::-1], part[:end][::-1])
    return score, end - back, end


def seeds_needed(size: int, least: float) -> int:
    """Pairs of an item of ``size`` words that every alignment of at least ``least`` has, as neighbours or one word apart.

    With m words matched, 2 * (m - least * size) unit penalties may stand between them. Of the m - 1 gaps, ``a`` lose a pair to a
    changed or left-out word (one penalty and one of the size - m words not matched), ``b`` to two or more words put in (two
    penalties); the least of m - 1 - a - b over all of them is at m = size * (1 + 2 * least) / 3, a = size - m, b = 0.
    """
    return ceil(size * (4 * least - 1) / 3 - 1 - 1e-9)


def least_score(size: int, least: float) -> float:
    """The least score of an item of ``size`` words: ``least`` from ``FULL_SIZE`` words on, then more, 1 from half of that down."""
    return max(least, min(1.0, least * FULL_SIZE / max(1, size)))


def drift(size: int, least: float) -> int:
    """More than the distance of any two diagonals of one alignment: each step aside costs one, and at most size words match."""
    return floor(2 * size * (1 - least) + 1e-9) + 1


def _pairs(words: np.ndarray, step: int) -> np.ndarray:
    """A hash of each word with the one ``step`` further on."""
    if len(words) <= step:
        return words[:0]
    if step == 1:
        return gram_hashes(words, 2)
    both = np.empty(2 * (len(words) - step), np.uint64)
    both[::2], both[1::2] = words[:-step], words[step:]
    return gram_hashes(both, 2)[::2]


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count - first, count)


@dataclass
class Seeds:
    """Items and their seeds. ``first`` tells where an item's seeds begin in ``key`` (place in ``keys``) and ``at`` (word)."""

    least: np.ndarray
    ids: pa.Array
    words: list[np.ndarray]
    singles: bool
    need: np.ndarray
    width: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    key: np.ndarray
    at: np.ndarray
    table: np.ndarray
    look_first: np.ndarray | None = None
    look_item: np.ndarray | None = None

    @staticmethod
    def of(ids: pa.Array, texts, least: float) -> Seeds:
        words = [word_hashes(t) for t in texts]
        kept = [k for k, w in enumerate(words) if len(w)]
        ids, words = ids.take(pa.array(kept, pa.int64())), [words[k] for k in kept]
        leasts = np.array([least_score(len(w), least) for w in words], np.float64)
        need = np.array([seeds_needed(len(w), x) for w, x in zip(words, leasts, strict=True)], np.int64)
        # Where no pair is sure to be there, single words are the seeds: as many match as the score asks for at least.
        single = need < 1
        need = np.where(single, [max(1, ceil(x * len(w) - 1e-9)) for w, x in zip(words, leasts, strict=True)], need).astype(np.int64)
        grams = [w if s else _pairs(w, 1) for w, s in zip(words, single, strict=True)]
        sizes = np.array([len(g) for g in grams], np.int64)
        keys, key = np.unique(np.concatenate([*grams, np.empty(0, np.uint64)]), return_inverse=True)
        table = np.zeros(1 << FILTER_BITS, bool)
        table[keys >> np.uint64(64 - FILTER_BITS)] = True
        first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        width = np.array([drift(len(w), x) for w, x in zip(words, leasts, strict=True)], np.int64)
        return Seeds(leasts, ids, words, bool(single.any()), need, width, keys, first, key, _ranges(sizes * 0, sizes), table)

    def rank(self) -> None:
        """Choose the seeds of the first look: all of an item but the (need - 1) that most items have.

        The count is over all items here. It decides how many items a document is looked at for, not the result.
        """
        frequency = np.bincount(self.key, minlength=len(self.keys))
        sizes = np.diff(self.first)
        item = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((frequency[self.key], item))
        looked = order[self.at < np.repeat(sizes - self.need + 1, sizes)]
        looked = looked[np.argsort(self.key[looked], kind="stable")]
        self.look_item = item[looked]
        self.look_first = np.searchsorted(self.key[looked], np.arange(len(self.keys) + 1))

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Seeds of any item in a document: their places in ``keys`` and in the document."""
        grams = [_pairs(words, 1), _pairs(words, 2)] + [words] * self.singles
        where = np.concatenate([np.arange(len(g)) for g in grams])
        grams = np.concatenate(grams)
        maybe = np.flatnonzero(self.table[grams >> np.uint64(64 - FILTER_BITS)])
        if not len(maybe):
            return maybe, maybe
        grams, where = grams[maybe], where[maybe]
        key = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        same = self.keys[key] == grams
        return key[same], where[same]

    def stretches(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, low, high): the stretches of a document that may hold an item."""
        key, where = self.hits(words)
        if not len(key):
            return []
        seen = np.unique(key)
        count = self.look_first[seen + 1] - self.look_first[seen]
        items = np.unique(self.look_item[_ranges(self.look_first[seen], count)])
        order = np.argsort(key, kind="stable")
        key, where = key[order], where[order]
        sizes = self.first[items + 1] - self.first[items]
        entry, owner = _ranges(self.first[items], sizes), np.repeat(items, sizes)
        low = np.searchsorted(key, self.key[entry])
        count = np.searchsorted(key, self.key[entry], "right") - low
        entry, owner, low, count = (x[count > 0] for x in (entry, owner, low, count))
        # Items with fewer different seeds than needed in the whole document are out before places are looked at.
        enough = np.bincount(owner, minlength=len(self.need))[owner] >= self.need[owner]
        entry, owner, low, count = (x[enough] for x in (entry, owner, low, count))
        # Bands are numbered from below: an item's first word may lie before the document.
        below = int((np.diff(self.first) // self.width).max()) + 2
        bands = len(words) // int(self.width.min()) + below + 2
        names, totals = [], []
        ends = np.cumsum(count)
        at = 0
        while at < len(entry):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PLACES, "right")))
            part = slice(at, to)
            at = to
            own = np.repeat(owner[part], count[part])
            seed = np.repeat(entry[part], count[part])
            band = (where[_ranges(low[part], count[part])] - self.at[seed]) // self.width[own]
            # A band is two widths wide, so whatever lies within one width lies in some band.
            name = np.concatenate([own * bands + band, own * bands + band - 1]) + below
            pairs = np.stack([name, np.concatenate([seed, seed])])
            pairs = pairs[:, np.lexsort(pairs[::-1])]
            fresh = np.ones(pairs.shape[1], bool)
            fresh[1:] = (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)
            name, total = np.unique(pairs[0, fresh], return_counts=True)
            names.append(name)
            totals.append(total)
        if not names:
            return []
        name, place_of = np.unique(np.concatenate(names), return_inverse=True)
        total = np.bincount(place_of, np.concatenate(totals))
        item = name // bands
        band = name - item * bands - below
        keep = total >= self.need[item]
        out: list[tuple[int, int, int]] = []
        for i, b in zip(item[keep].tolist(), band[keep].tolist(), strict=True):
            width, size = int(self.width[i]), len(self.words[i])
            from_, end = max(0, b * width), max(0, min(len(words), (b + 2) * width + size))
            if out and out[-1][0] == i and out[-1][2] >= from_:
                out[-1] = (i, out[-1][1], end)
            elif end > from_:
                out.append((i, from_, end))
        return out

    def places(self, words: np.ndarray):
        """(item, score, start, end) of the items in a document that score enough."""
        for i, low, high in self.stretches(words):
            item, part, least = self.words[i], words[low:high], float(self.least[i])
            if len(item) < EVIDENT_SIZE and len(words) != len(item):
                continue
            if np.isin(item, part).sum() < least * len(item) - 1e-9:
                continue
            score, start, end = place(item, part, least)
            if score >= least - 1e-12 and end:
                yield i, score, low + start, low + end


def _aligned(shared):
    def run(batches):
        seeds: Seeds = shared.value
        for batch in batches:
            rows, found = [], []
            for k, text in enumerate(batch.column("text")):
                for one in seeds.places(word_hashes(text.as_py())):
                    rows.append(k)
                    found.append(one)
            item, score, start, end = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.record_batch(
                [
                    batch.column("id").take(pa.array(rows, pa.int64())),
                    seeds.ids.take(pa.array(item, pa.int64())),
                    pa.array(score, pa.float64()),
                    pa.array(start, pa.int64()),
                    pa.array(end, pa.int64()),
                ],
                names=["doc_id", "item_id", "score", "start", "end"],
            )

    return run


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least: float = 0.5,
) -> DataFrame:
    """Documents that hold a test item, copied, edited or reworded.

    One row per document and item with a score of at least ``least`` (more for items under ``FULL_SIZE`` words, see
    ``least_score``): (doc_id, item_id, score, start, end). ``score`` is the
    alignment's share of what the whole item would score; ``start`` and ``end`` are its words in the document.
    Of several places the best counts, of equal ones the first. Null and empty texts and items hold nothing. An item of fewer
    than ``EVIDENT_SIZE`` words is no evidence inside other text and is reported only where it is all of a document's words. Rows that repeat an id are looked at in turn and
    give the best of them; a null document or item id is not reported. Other columns are not read.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    tests = (
        items.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull())
        .select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
        .distinct()
    )
    kinds = dict(rows.dtypes) | dict(tests.dtypes)
    chars = tests.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    passes = max(1, ceil(chars / ITEM_CHARS))
    found = None
    for k in range(passes):
        part = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).toArrow()
        ids = part.column("item_id").combine_chunks()
        seeds = Seeds.of(ids, part.column("text").to_pylist(), least)
        seeds.rank()
        one = rows.mapInArrow(
            _aligned(context.broadcast(seeds)), f"doc_id {kinds['id']}, item_id {kinds['item_id']}, score double, start long, end long"
        )
        found = one if found is None else found.union(one)
    best = found.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("score", (-F.col("start")).alias("_s"), (-F.col("end")).alias("_e"))).alias("b")
    )
    return best.select(
        "doc_id", "item_id", "b.score", (-F.col("b._s")).alias("start"), (-F.col("b._e")).alias("end")
    )
