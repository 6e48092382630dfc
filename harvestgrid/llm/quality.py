"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or nothing on each document. Expectation-maximisation estimates from the
counts of all vote patterns how reliable each heuristic is, and so how likely a document with a pattern is good.
These posterior labels train a linear scorer on hashed features, whose verdict decides.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestgrid.llm.words import code_points, mix

# Documents whose features train the scorer: a bounded sample by hash, half from either side of the posterior.
TRAINING_DOCUMENTS = 8_000
BITS = 16
EPOCHS, RATE, PENALTY = 150, 0.5, 1e-5
GOOD, BAD, NONE = 1, 0, 2
# Kinds of characters: classes, then single marks.
KINDS = ("lower", "upper", "letter", "digit", "space", "mark", *"\n.,;:!?'\"-()|#$%&*@/=+_<>[]")
LOWER, UPPER, OTHER, DIGIT, SPACE, OTHER_MARK = range(6)
# A text of fewer words gives the heuristics no ground for a vote against it.
FEW_WORDS = 8
# Marks that junk attaches to words, and frequent words of four languages.
_MARKED = re.compile(r"[#$%&*@^~|<>{}\\=+]{2,}")
_STOPS = frozenset(
    """the of and to in is it that for with as on be at by this are was from or an der die das und von zu den mit
    ist im nicht ein eine auf dem des sich als le la les de des et un une en du que qui dans pour pas sur au avec
    el los las que del se con por una su para es al""".split()
)


def _between(value: float, good: float, bad: float, low_is_good: bool = True) -> int:
    if low_is_good:
        return GOOD if value <= good else BAD if value >= bad else NONE
    return GOOD if value >= good else BAD if value <= bad else NONE


def measures(text: str, kinds: np.ndarray) -> dict[str, float]:
    """What the heuristics look at, as shares (``length``: words); ``kinds`` are the text's character kinds."""
    lower = text.lower().split()
    count = max(1, len(lower))
    of = np.bincount(kinds, minlength=len(KINDS))
    letters = of[LOWER] + of[UPPER] + of[OTHER]
    return {
        "length": len(lower),
        "marked": len(_MARKED.findall(text)) / count,
        "bars": lower.count("|") / count,
        "shouted": of[UPPER] / max(1, letters),
        "exclaimed": text.count("!") / count,
        "repeated": sum(map(eq, lower, lower[1:])) / count,
        "distinct": len(set(lower)) / count,
        "stops": sum(map(_STOPS.__contains__, lower)) / count,
        "letters": (letters + of[DIGIT]) / max(1, len(text)),
    }


# Each heuristic gets the measures of a text and votes.
LABELLERS: dict[str, Callable[[dict[str, float]], int]] = {
    "marked": lambda m: _between(m["marked"], 0.02, 0.25),
    "bars": lambda m: _between(m["bars"], 0.01, 0.2),
    "shouted": lambda m: _between(m["shouted"], 0.1, 0.4),
    "exclaimed": lambda m: _between(m["exclaimed"], 0.02, 0.3),
    "repeated": lambda m: _between(m["repeated"], 0.05, 0.3),
    "distinct": lambda m: _between(m["distinct"], 0.2, 0.08, False),
    "stops": lambda m: _between(m["stops"], 0.12, 0.03, False),
    "letters": lambda m: _between(m["letters"], 0.7, 0.6, False),
}


def votes(m: dict[str, float]) -> list[int]:
    """The vote of each labeller; none against a very short text."""
    out = [vote(m) for vote in LABELLERS.values()]
    return [NONE if v == BAD else v for v in out] if m["length"] < FEW_WORDS else out


def pattern_of(m: dict[str, float]) -> int:
    code = 0
    for vote in votes(m):
        code = code * 3 + vote
    return code


def describe(text: str | None) -> tuple[int, np.ndarray]:
    """Vote pattern and features of a text; null and blank ones have no votes and no features."""
    if not text or text.isspace():
        return ABSENT, np.empty(0, np.int64)
    kinds = character_kinds(text)
    m = measures(text, kinds)
    return pattern_of(m), features(kinds, m)


def fit_accuracies(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of good documents, each labeller's vote probabilities (class x labeller x vote), and the posteriors.

    A labeller that does not vote says nothing about the document.

    EM over distinct vote patterns with their counts. It starts from the majority of the votes; so
    the good class stays the one that the labellers speak for.
    """
    good, bad = (patterns == GOOD).sum(1), (patterns == BAD).sum(1)
    # One vote against outweighs several for: most heuristics see one kind of fault only.
    post = np.where(bad > 0, 0.2 ** bad, 0.5 + 0.49 * good / np.maximum(1, good + bad))
    rates = np.empty((2, patterns.shape[1], 2))
    share = 0.9
    for _ in range(rounds):
        for side, weight in enumerate(((1 - post) * counts, post * counts)):
            for vote in (BAD, GOOD):
                rates[side, :, vote] = ((patterns == vote) * weight[:, None]).sum(0) + 0.5
        rates /= rates.sum(2, keepdims=True)
        share = float(np.clip((post @ counts + 1) / (counts.sum() + 2), 0.01, 0.99))
        gain = np.log(rates[1]) - np.log(rates[0])
        said = np.where(patterns == GOOD, gain[:, GOOD], np.where(patterns == BAD, gain[:, BAD], 0.0))
        new = 1 / (1 + np.exp(-np.clip(said.sum(1) + np.log(share) - np.log(1 - share), -50, 50)))
        if len(counts) and np.abs(new - post).max() < 1e-6:
            return share, rates, new
        post = new
    return share, rates, post


def features(kinds: np.ndarray, m: dict[str, float]) -> np.ndarray:
    """Hashed features, sorted and distinct: runs of two and three character kinds, and steps of the measures.

    Words are left out: what they say is the topic or the language, not the quality.
    """
    wide = kinds.astype(np.int32)
    seen = np.zeros(len(KINDS) ** 2 + len(KINDS) ** 3, bool)
    seen[wide[:-1] * len(KINDS) + wide[1:]] = True
    seen[len(KINDS) ** 2 + (wide[:-2] * len(KINDS) + wide[1:-1]) * len(KINDS) + wide[2:]] = True
    steps = [(k << 20) + round(20 * v) + (1 << 50) for k, (name, v) in enumerate(m.items()) if name != "length"]
    every = mix(np.concatenate([np.flatnonzero(seen).astype(np.uint64), np.array(steps, np.uint64)]))
    return np.unique(every >> np.uint64(64 - BITS)).astype(np.int64)


_table: list[np.ndarray] = []


def character_kinds(text: str) -> np.ndarray:
    """An index of KINDS for each character."""
    if not _table:
        table = np.full(0x110000, OTHER_MARK, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            table[i] = (
                LOWER if c.islower() else UPPER if c.isupper() else OTHER if c.isalpha() else DIGIT if c.isdigit()
                else SPACE if c.isspace() else OTHER_MARK
            )
        for k, c in enumerate(KINDS):
            if len(c) == 1:
                table[ord(c)] = k
        _table.append(table)
    return _table[0][code_points(text)]


def train_scorer(rows: list[np.ndarray], targets: np.ndarray) -> np.ndarray:
    """Weights of a logistic scorer over hashed features (the last one is the bias), by full-batch Adagrad."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate(rows) if rows else np.empty(0, np.int64)
    scale = 1 / np.sqrt(np.maximum(1, [len(r) for r in rows]))
    weights, seen = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-8)
    for _ in range(EPOCHS if len(rows) else 0):
        z = np.bincount(owner, weights[column], len(rows)) * scale + weights[-1]
        off = 1 / (1 + np.exp(-z)) - targets
        step = np.bincount(column, (off * scale)[owner], (1 << BITS) + 1) / len(rows)
        step[-1] = off.mean()
        step += PENALTY * weights
        seen += step * step
        weights -= RATE * step / np.sqrt(seen)
    return weights


def _voted(batches):
    for batch in batches:
        codes = []
        for text in batch.column("text"):
            text = text.as_py()
            blank = not text or text.isspace()
            codes.append(ABSENT if blank else pattern_of(measures(text, character_kinds(text))))
        yield pa.record_batch([pa.array(codes, pa.int32())], names=["pattern"])


ABSENT = 3 ** len(LABELLERS) - 1  # the pattern in which nobody votes


def decode(pattern: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        pattern, vote = divmod(pattern, 3)
        out.append(vote)
    return out[::-1]


def classify_quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = 0.35, carry: bool = False
) -> DataFrame:
    """Judge every row: (id, pattern, posterior, score, keep), and with ``carry`` the whole row as a struct ``row``.

    ``pattern`` codes the votes in base 3, ``posterior`` is the label model's probability that the document is good,
    ``score`` the scorer's, and ``keep`` is true from a score of ``keep`` on. Null and blank texts have no content:
    score 0, not kept. Repeated rows get the same result; null ids have rows like any other. An empty table
    gives an empty one. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    judged, kinds = rows, f"id {kind}"
    if carry:
        judged = docs.select(
            F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*(docs[c] for c in docs.columns)).alias("row")
        )
        kinds += f", row {dict(judged.dtypes)['row']}"
    # At most 3 ** labellers rows.
    patterns = rows.select("text").mapInArrow(_voted, "pattern int").groupBy("pattern").count().orderBy("pattern").collect()
    codes = [p["pattern"] for p in patterns]
    votes_of = np.array([decode(c) for c in codes], np.int64).reshape(-1, len(LABELLERS))
    counts = np.array([p["count"] for p in patterns], np.float64)
    _, _, posterior = fit_accuracies(votes_of, counts)
    label = dict(zip(codes, posterior.tolist(), strict=True))
    weights = _fit(rows, label, counts, posterior)
    shared = docs.sparkSession.sparkContext.broadcast((label, weights))

    def score(batches):
        label, weights = shared.value
        for batch in batches:
            pattern, post, scores, kept = [], [], [], []
            for text in batch.column("text"):
                code, row = describe(text.as_py())
                z = weights[row].sum() / np.sqrt(max(1, len(row))) + weights[-1]
                value = float(1 / (1 + np.exp(-z))) if len(row) else 0.0
                pattern.append(code)
                post.append(label[code])
                scores.append(value)
                kept.append(value >= keep and value > 0.0)
            yield pa.record_batch(
                [
                    *(batch.column(c) for c in carried),
                    pa.array(pattern, pa.int32()),
                    pa.array(post, pa.float64()),
                    pa.array(scores, pa.float64()),
                    pa.array(kept, pa.bool_()),
                ],
                names=[*carried, "pattern", "posterior", "score", "keep"],
            )

    carried = ["id", "row"] if carry else ["id"]
    return judged.mapInArrow(score, f"{kinds}, pattern int, posterior double, score double, keep boolean")


def _fit(rows: DataFrame, label: dict[int, float], counts: np.ndarray, posterior: np.ndarray) -> np.ndarray:
    """Train the scorer on a hashed sample of either side, on average at most half of ``TRAINING_DOCUMENTS`` each."""
    low = posterior < 0.5
    bad = {c for c, p in label.items() if p < 0.5}
    shares = [min(1.0, TRAINING_DOCUMENTS / 2 / max(1.0, counts[side].sum())) for side in (low, ~low)]
    chance = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / (1 << 30)

    def featured(batches):
        for batch in batches:
            found = []
            for chance, text in zip(batch.column("chance").to_pylist(), batch.column("text"), strict=True):
                code, row = describe(text.as_py())
                if len(row) and chance < shares[code not in bad]:
                    found.append((code, row))
            yield pa.record_batch(
                [
                    pa.array([c for c, _ in found], pa.int32()),
                    pa.array([r.tolist() for _, r in found], pa.list_(pa.int64())),
                ],
                names=["pattern", "features"],
            )

    drawn = rows.select("text", chance.alias("chance")).where(F.col("chance") < max(shares))
    sample = drawn.mapInArrow(featured, "pattern int, features array<long>").toArrow()
    # The order of arrival must not matter for the sums.
    drawn = sorted(
        (label[p], tuple(f)) for p, f in zip(sample["pattern"].to_pylist(), sample["features"].to_pylist(), strict=True)
    )
    targets = np.array([p for p, _ in drawn])
    weights = train_scorer([np.array(f, np.int64) for _, f in drawn], targets)
    if drawn:  # the sample holds more bad documents than the corpus does
        weights[-1] += _odds(posterior @ counts, counts.sum()) - _odds(targets.sum(), len(targets))
    return weights


def _odds(part: float, whole: float) -> float:
    return float(np.log((part + 1) / (whole - part + 1)))
