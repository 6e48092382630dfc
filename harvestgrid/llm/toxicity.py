"""Toxicity from a weighted lexicon.

Texts are folded first: compatibility forms and lookalike letters of other scripts become plain letters, and digits and signs that
stand for letters inside a word become those letters. One Aho-Corasick pass finds all entries, which are words or
beginnings of words, and all exception phrases, inside which entries do not count. The weights found are summed and
normalised by the text's length.

Entries, weights, learned exceptions and the final scale are estimated from labelled rows: document counts per class for
every beginning of a word, kept where the classes differ beyond chance; then, with each word taken by its longest entry alone, the
weights anew; then a logistic scale of the sums.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestgrid.llm.tables import cut, plain_name

# Labelled rows per class that the lexicon is learned from, at most; distinct ones, the lowest by hash.
TRAINING_ROWS = 10_000
# Entries and learned exceptions kept, at most: those that tell the classes apart most surely.
ENTRIES, EXCEPTIONS = 20_000, 5_000
# An entry stands in as many toxic texts, and differs between the classes by this (G statistic, log odds).
LEAST_TEXTS, LEAST_G, LEAST_ODDS = 3, 18.0, 1.2
SHORTEST, LONGEST = 3, 12
# Letters of a text that are folded at a time.
PIECE = 1 << 20

# Cyrillic and Greek letters that look like Latin ones, and what digits and signs stand for.
LOOKALIKES = str.maketrans("аеорсухіјѕԁһԛԝвкмнтαεικνορτυχ", "aeopcyxijsdhqwbkmhtaeikvoptux")
SUBSTITUTES = str.maketrans("013457@$!|", "oieastasil")
_TOKEN = re.compile(r"[^\W_](?:[\w@$!|]*[^\W_])?|[@$][^\W_]+")
_LATIN = re.compile(r"[a-z]")


def fold_words(text: str) -> list[str]:
    """The words of a text as they are looked up.

    Letters of other scripts are read as Latin ones in words that hold a Latin letter too, so that words of those scripts
    keep their letters; digits and signs are read as letters beside a letter.
    """
    text = text.lower()
    plain = text.isascii()
    if not plain:
        text = unicodedata.normalize("NFKC", text)
    words = _TOKEN.findall(text)
    for k, word in enumerate(words):
        if not word.isalpha() and any(c.isalpha() for c in word):
            word = words[k] = word.translate(SUBSTITUTES)
        if not plain and not word.isascii() and _LATIN.search(word):
            words[k] = word.translate(LOOKALIKES)
    return words


def folded_pieces(text: str | None) -> Iterator[list[str]]:
    """The folded words of a whole text, in lists from bounded pieces; a piece ends at white space."""
    at, text = 0, text or ""
    while at < len(text):
        end = at + PIECE
        while end < len(text) and not text[end].isspace():
            end += 1
        yield fold_words(text[at:end])
        at = end


def beginnings(word: str) -> Iterator[str]:
    """Entries that a word could belong to: its beginnings, behind a space, and the whole word between spaces."""
    for size in range(SHORTEST, min(LONGEST, len(word)) + 1):
        yield f" {word[:size]}"
    yield f" {word} "


@dataclass(frozen=True)
class Lexicon:
    """Entries with their weights, exception phrases, and the scale from sums to scores."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    scale: tuple[float, ...] = (-4.0, 0.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), entry, weight))
        for phrase in self.exceptions:
            folded = " ".join(fold_words(phrase))
            if folded:
                found.add_word(f" {folded} ", (len(folded), None, 0.0))
        if len(found):
            found.make_automaton()
        return found


def _matches(automaton: ahocorasick.Automaton, words: list[str]) -> list[tuple[int, str, float]]:
    """The longest entry of each word that has one outside exceptions: (its place in the joined words, entry, weight)."""
    if not len(automaton):
        return []
    best: dict[int, tuple[int, str, float]] = {}
    spared: list[tuple[int, int]] = []
    joined = f" {' '.join(words)} "
    for end, (size, entry, weight) in automaton.iter(joined):
        if entry is None:
            spared.append((end - size - 1, end))
        elif best.get(end - size + 1, (0,))[0] < size:
            best[end - size + 1] = (size, entry, weight)
    if spared:
        covered = np.zeros(len(joined) + 1, np.int64)
        for start, end in spared:
            covered[max(0, start)] += 1
            covered[end] -= 1
        inside = np.cumsum(covered) > 0
        best = {at: hit for at, hit in best.items() if not inside[at]}
    return [(at, entry, weight) for at, (_, entry, weight) in sorted(best.items())]


def measures(total: float, strongest: float, words: int) -> tuple[float, float, float, float]:
    """What the scale sees of a text: the constant, the sum against its length, against its root, and the strongest entry."""
    return 1.0, np.log1p(100 * total / max(1, words)), np.log1p(total / max(1, words) ** 0.5), strongest


def text_measures(text: str | None, automaton: ahocorasick.Automaton) -> tuple[float, float, float, float]:
    total = strongest = 0.0
    count = 0
    for words in folded_pieces(text):
        count += len(words)
        for _, _, weight in _matches(automaton, words):
            total, strongest = total + weight, max(strongest, weight)
    return measures(total, strongest, count)


def score_of(seen: Iterable[float], scale: Iterable[float]) -> float:
    z = float(sum(s * x for s, x in zip(scale, seen, strict=True)))
    return float(1 / (1 + np.exp(-min(50.0, max(-50.0, z)))))


def log_odds(toxic: np.ndarray, clean: np.ndarray, sizes: tuple[int, int]) -> np.ndarray:
    return np.log((toxic + 0.5) / (sizes[0] + 1)) - np.log((clean + 0.5) / (sizes[1] + 1))


def _sample(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, trains: Column, bound: int
) -> tuple[DataFrame, tuple[int, int], tuple[float, float]]:
    """Distinct labelled rows (text, toxic), at most ``bound`` of a class; how many (toxic, clean), and how many each stands for.

    Labels meet prints of the rows, not texts. Of several labels of an id the greatest counts.
    """
    marks = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic"))
        .where(F.col("_id").isNotNull() & F.col("toxic").isin(0, 1))
        .groupBy("_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    rows = docs.where(trains).select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("print")
    )
    prints = cut(rows.select("_id", "print").distinct().join(marks, "_id").select("toxic", "print"))
    every = {r["toxic"]: r["count"] for r in prints.groupBy("toxic").count().collect()}
    chosen, sizes, stands = F.lit(False), [], []
    for label in (1, 0):
        taken = min(every.get(label, 0), bound)
        mine = F.col("toxic") == label
        if taken < every.get(label, 0):
            # The prints up to the bound: at most ``bound`` numbers.
            edge = prints.where(mine).select("print").orderBy("print").limit(taken).agg(F.max("print")).first()[0]
            mine = mine & (F.col("print") <= edge)
        chosen = chosen | mine
        sizes.append(taken)
        stands.append(every.get(label, 0) / taken if taken else 0.0)
    # At most ``bound`` prints of a class are broadcast, and as many texts are kept.
    drawn = rows.join(F.broadcast(prints.where(chosen)), "print").groupBy("print", "toxic").agg(F.min("text").alias("text"))
    return cut(drawn.select("text", "toxic")), (sizes[0], sizes[1]), (stands[0], stands[1])


def _entries(sample: DataFrame, sizes: tuple[int, int]) -> dict[str, float]:
    """Beginnings of words and whole words that stand in more toxic texts than chance has it, with their log odds."""

    def count(batches):
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def rows():
            grams = list(held[0].keys() | held[1].keys())
            columns = [pa.array(grams, pa.string()), *(pa.array([side[g] for g in grams], pa.int64()) for side in held)]
            for side in held:
                side.clear()
            return pa.record_batch(columns, names=["entry", "clean", "toxic"])

        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                distinct = {word for words in folded_pieces(text.as_py()) for word in words}
                held[toxic].update({entry for word in distinct for entry in beginnings(word)})
                if len(held[0]) + len(held[1]) > 1_000_000:
                    yield rows()
        yield rows()

    total, all_toxic = float(sum(sizes)), float(sizes[0])
    counted = (
        sample.mapInArrow(count, "entry string, clean long, toxic long")
        .groupBy("entry")
        .agg(F.sum("toxic").cast("double").alias("toxic"), F.sum("clean").cast("double").alias("clean"))
        .where(F.col("toxic") >= LEAST_TEXTS)
    )
    expected = (F.col("toxic") + F.col("clean")) * (all_toxic / max(1.0, total))
    others = (F.col("toxic") + F.col("clean")) - expected

    def part(seen: Column, due: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / due)).otherwise(0.0)

    surely = 2 * (part(F.col("toxic"), expected) + part(F.col("clean"), others))
    odds = F.log((F.col("toxic") + 0.5) / (sizes[0] + 1)) - F.log((F.col("clean") + 0.5) / (sizes[1] + 1))
    found = (
        counted.select("entry", odds.alias("odds"), surely.alias("surely"))
        .where((F.col("odds") >= LEAST_ODDS) & (F.col("surely") >= LEAST_G))
        .orderBy(F.desc("surely"), "entry")
        .limit(ENTRIES)
        .collect()
    )
    return {row["entry"]: row["odds"] for row in found}


def _used(sample: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Per entry, and per phrase of an entry's word and a neighbour: the texts of each class that it stands in."""
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)

    def count(batches):
        automaton = shared.value.automaton()
        held: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                seen = set()
                for words in folded_pieces(text.as_py()):
                    starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
                    for at, entry, _ in _matches(automaton, words):
                        k = int(np.searchsorted(starts, at))
                        seen.add((entry, False))
                        seen.update((f"{words[j]} {words[j + 1]}", True) for j in (k - 1, k) if 0 <= j < len(words) - 1)
                held[toxic].update(seen)
        found = list(held[0].keys() | held[1].keys())
        yield pa.record_batch(
            [
                pa.array([f for f, _ in found], pa.string()),
                pa.array([p for _, p in found], pa.bool_()),
                *(pa.array([side[f] for f in found], pa.int64()) for side in held),
            ],
            names=["entry", "phrase", "clean", "toxic"],
        )

    return (
        sample.mapInArrow(count, "entry string, phrase boolean, clean long, toxic long")
        .groupBy("entry", "phrase")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )


def _seen(sample: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Measures and labels of the sample's rows, in an order that does not depend on how they arrive."""
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)

    def measure(batches):
        automaton = shared.value.automaton()
        for batch in batches:
            rows = [text_measures(text.as_py(), automaton) for text in batch.column("text")]
            columns = [pa.array([r[k] for r in rows], pa.float64()) for k in range(1, 4)]
            yield pa.record_batch([batch.column("toxic"), *columns], names=["toxic", "a", "b", "c"])

    found = sample.mapInArrow(measure, "toxic int, a double, b double, c double").toPandas().sort_values(["toxic", "a", "b", "c"])
    seen = np.column_stack([np.ones(len(found)), found[["a", "b", "c"]].to_numpy(float)])
    return seen, found["toxic"].to_numpy(float)


def fit_scale(seen: np.ndarray, labels: np.ndarray, weights: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton steps; all but the constant are drawn to zero."""
    scale = np.zeros(seen.shape[1])
    pull = np.full(seen.shape[1], penalty)
    pull[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(seen @ scale, -30, 30)))
        slope = seen.T @ (weights * (p - labels)) + pull * scale
        bend = (seen * (weights * p * (1 - p))[:, None]).T @ seen + np.diag(pull)
        step = np.linalg.solve(bend, slope)
        scale -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return scale


def learn_lexicon(
    docs: DataFrame,
    labels: DataFrame,
    trains: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    exceptions: tuple[str, ...] = (),
    training_rows: int = TRAINING_ROWS,
) -> Lexicon:
    """A lexicon from the labelled rows for which ``trains`` holds, at most ``training_rows`` distinct ones of a class.

    ``exceptions`` are phrases inside which no entry counts; more are learned: pairs of words around an entry that stand in clean
    texts at least as often as in toxic ones. Without toxic or without clean rows the lexicon is empty.
    """
    sample, sizes, stands = _sample(docs, labels, id_col, text_col, label_col, trains, training_rows)
    start = np.log((sizes[0] * stands[0] + 0.5) / (sizes[1] * stands[1] + 0.5)) if sum(sizes) else -50.0
    if not all(sizes):
        return Lexicon({}, exceptions, (float(start), 0.0, 0.0, 0.0))
    first = Lexicon(_entries(sample, sizes), exceptions)
    used = _used(sample, first).where("toxic >= 1 OR clean >= 3")
    spared = (
        used.where(F.col("phrase") & (F.col("clean") >= LEAST_TEXTS))
        .where(F.col("clean") * sizes[0] >= F.col("toxic") * sizes[1])
        .orderBy(F.desc("clean"), "entry")
        .limit(EXCEPTIONS)
        .collect()
    )
    # At most a row per entry.
    kept = used.where(~F.col("phrase") & (F.col("toxic") >= 2)).collect()
    odds = log_odds(np.array([r["toxic"] for r in kept], float), np.array([r["clean"] for r in kept], float), sizes)
    weights = {r["entry"]: float(w) for r, w in sorted(zip(kept, odds, strict=True), key=lambda x: x[0]["entry"]) if w > 0}
    lexicon = Lexicon(weights, (*exceptions, *(r["entry"] for r in spared)))
    seen, marks = _seen(sample, lexicon)
    scale = fit_scale(seen, marks, np.where(marks == 1, stands[0], stands[1]))
    return Lexicon(lexicon.weights, lexicon.exceptions, tuple(scale.tolist()))


def score_toxicity(
    docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3
) -> DataFrame:
    """Score every whole text: all columns of ``docs``, then ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Null, empty and wordless texts hold no entry and get the score of such texts. Rows with null or repeated ids are rows like any
    other, and equal texts get equal scores. An empty table gives an empty one. Columns of ``docs`` named
    like the new ones keep their names; the new ones get an underscore in front then.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    score, predicted = plain_name(docs, "score"), plain_name(docs, "predicted")

    def judge(batches):
        lexicon = shared.value
        automaton = lexicon.automaton()
        for batch in batches:
            scores = [score_of(text_measures(text.as_py(), automaton), lexicon.scale) for text in batch.column(text_col)]
            yield pa.record_batch(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())],
                names=[*batch.schema.names, score, predicted],
            )

    schema = ", ".join([f"`{name}` {kind}" for name, kind in docs.dtypes] + [f"`{score}` double", f"`{predicted}` int"])
    return docs.mapInArrow(judge, schema)
