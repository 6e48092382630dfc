"""Language identification with interpolated Kneser-Ney character models.

Character four-grams of all training texts are counted per language; the smoothed models follow from the counts by
aggregates and joins. Every gram is kept by its whole 64-bit key. A model that is measured and small is broadcast as sorted
arrays of keys, one per order, with a column of log probabilities per language; a larger one stays in Spark, where it is
joined with the documents' grams. A text gets the language of lowest cross-entropy per character; a text whose
cross-entropy lies far above what training texts of that language and length have is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestgrid.llm.tables import cut
from harvestgrid.llm.words import code_points

ORDER = 4
# A model of at most so many rows (a language's grams of all orders), and so many bytes as arrays, goes through the driver.
MODEL_ROWS, MODEL_BYTES = 2_000_000, 128 << 20
# A text is rejected beyond the 99 % quantile of its language and length, plus so many times the distance
# from the median to it, plus so many nats per character.
REJECT_SPREAD, REJECT_NATS = 2.0, 1.0
BATCH_CHARS = 1 << 20
UNDETERMINED = "und"

_letters: list[np.ndarray] = []


def _is_letter(points: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0][points]


def four_grams(text: str | None) -> np.ndarray:
    """Packed four-grams (16 bits a character) of the lower-cased letters of a text.

    Each run of other characters counts as one space, at both ends too. No letter, no grams. Letters beyond U+FFFF
    share the keys of U+8000 to U+FFFF with others.
    """
    if not text:
        return np.empty(0, np.uint64)
    points = code_points(text.lower())
    letter = _is_letter(points)
    if not letter.any():
        return np.empty(0, np.uint64)
    points = np.where(letter, points, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    folded = points[keep].astype(np.uint64)
    folded = np.where(folded > 0xFFFF, (folded & np.uint64(0x7FFF)) | np.uint64(0x8000), folded)
    lead = np.full(ORDER - 1, 32, np.uint64)
    tail = lead[:0] if folded[-1] == 32 else lead[:1]
    if folded[0] == 32:
        folded = folded[1:]
    s = np.concatenate([lead, folded, tail])
    return s[:-3] << np.uint64(48) | s[1:-2] << np.uint64(32) | s[2:-1] << np.uint64(16) | s[3:]


def _count_grams(batches):
    """Distinct four-grams of each language with their counts, merged over the partition."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    waiting: dict[str, list[np.ndarray]] = {}
    sizes: dict[str, int] = {}

    def merge(lang: str) -> None:
        fresh = np.unique(np.concatenate(waiting.pop(lang)), return_counts=True)
        sizes[lang] = 0
        held.setdefault(lang, []).append(fresh)
        if len(held[lang]) > 8:
            held[lang] = [_summed(held[lang])]

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            grams = four_grams(text.as_py())
            if len(grams):
                waiting.setdefault(lang, []).append(grams)
                sizes[lang] = sizes.get(lang, 0) + len(grams)
                if sizes[lang] > BATCH_CHARS:
                    merge(lang)
    for lang in list(waiting):
        merge(lang)
    for lang, parts in held.items():
        grams, counts = _summed(parts)
        for at in range(0, len(grams), 50_000):
            part = slice(at, at + 50_000)
            yield pa.record_batch(
                [
                    pa.array([lang] * len(grams[part]), pa.string()),
                    pa.array(grams[part].view(np.int64)),
                    pa.array(counts[part].astype(np.int64)),
                ],
                names=["lang", "gram", "n"],
            )


def _summed(parts):
    grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(at, np.concatenate([c for _, c in parts])).astype(np.int64)


def _order_tables(counts: DataFrame) -> DataFrame:
    """Kneser-Ney tables from (lang, gram, n) of the highest order.

    Rows (lang, kind, ord, gram, value): kind ``p`` has the interpolated log probability of a gram's last character,
    kind ``b`` the log weight that its context leaves to the next lower order.
    """
    width = lambda order: (1 << (16 * order)) - 1
    grams = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        above = grams[order + 1]
        grams[order] = above.groupBy(
            "lang", F.col("gram").bitwiseAND(F.lit(width(order))).alias("gram")
        ).agg(F.count("*").alias("n"))
    found = None
    lower = None
    for order in range(1, ORDER + 1):
        table = grams[order]
        context = F.shiftrightunsigned("gram", 16)
        ones, twos = (F.sum((F.col("n") == k).cast("long")) for k in (1, 2))
        discount = table.groupBy("lang").agg(
            F.greatest(F.lit(0.1), F.least(F.lit(0.9), F.try_divide(ones, ones + 2 * twos))).alias("d")
        )
        discount = discount.withColumn("d", F.coalesce("d", F.lit(0.5)))
        totals = (
            table.groupBy("lang", context.alias("context"))
            .agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
            .join(F.broadcast(discount), "lang")
            .withColumn("gamma", F.col("d") * F.col("kinds") / F.col("all"))
        )
        rows = table.withColumn("context", context).join(totals, ["lang", "context"])
        own = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("all")
        if order == 1:
            # The last order falls back on an even share among the characters seen and one unseen.
            p = rows.withColumn("p", own + F.col("gamma") / (F.col("kinds") + 1))
        else:
            p = rows.withColumn("shorter", F.col("gram").bitwiseAND(F.lit(width(order - 1)))).join(
                lower.select("lang", F.col("gram").alias("shorter"), F.col("p").alias("below")), ["lang", "shorter"]
            )
            p = p.withColumn("p", own + F.col("gamma") * F.col("below"))
        lower = cut(p.select("lang", "gram", "p"))
        unseen = F.col("gamma") / (F.col("kinds") + 1) if order == 1 else F.col("gamma")
        part = lower.select("lang", F.lit("p").alias("kind"), F.lit(order).alias("ord"), "gram", F.ln("p").alias("value"))
        part = part.union(totals.select("lang", F.lit("b"), F.lit(order - 1), "context", F.ln(unseen)))
        found = part if found is None else found.union(part)
    return found


@dataclass
class Model:
    """Sorted grams and, for each, log probabilities (``p``) or back-off weights (``b``) of all languages."""

    languages: list[str]
    tables: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]

    def look_up(self, kind: str, order: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = self.tables[kind, order]
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        return keys[at] == grams, values[at]

    def log_probabilities(self, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log probability of each gram's last character after the others, a column per language."""
        if order == 0:
            known, value = self.look_up("b", 0, np.zeros(len(grams), np.uint64))
            return np.where(known[:, None], value, 0.0)
        known, out = self.look_up("p", order, grams)
        if not known.all():
            out = out.copy()
            rest = ~known
            out[rest] = self._below(grams[rest], order)
        return out

    def _below(self, grams: np.ndarray, order: int) -> np.ndarray:
        shorter = grams & np.uint64((1 << (16 * (order - 1))) - 1)
        below = self.log_probabilities(shorter, order - 1)
        if order == 1:
            return below
        known, weight = self.look_up("b", order - 1, grams >> np.uint64(16))
        return below + np.where(known[:, None], weight, 0.0)


def build_model(rows: pa.Table) -> Model:
    """A model from (lang, kind, ord, gram, value); where a language lacks a gram, its back-off value is filled in."""
    languages = sorted(set(rows.column("lang").to_pylist()))
    model = Model(languages, {})
    if not languages:
        return model
    column = np.array([languages.index(x) for x in rows.column("lang").to_pylist()])
    kind = np.array(rows.column("kind").to_pylist())
    order = rows.column("ord").to_numpy()
    grams = rows.column("gram").to_numpy().view(np.uint64)
    values = rows.column("value").to_numpy()
    for k in range(ORDER):
        own = (kind == "b") & (order == k)
        keys, at = np.unique(grams[own], return_inverse=True)
        weight = np.zeros((len(keys), len(languages)), np.float32)
        weight[at, column[own]] = values[own]
        model.tables["b", k] = keys, weight
    for k in range(1, ORDER + 1):
        own = (kind == "p") & (order == k)
        keys, at = np.unique(grams[own], return_inverse=True)
        p = model._below(keys, k).astype(np.float32)
        p[at, column[own]] = values[own]
        model.tables["p", k] = keys, p
    return model


SCORES = "best string, entropy double, score double, size long"


def _verdict(languages: list[str], total: np.ndarray, size: int) -> tuple[str, float, float]:
    """Best language, its cross-entropy and its share, from the log probability of a text of ``size`` grams in each language."""
    h = -total / size
    k = int(h.argmin())
    gaps = np.exp(-np.minimum((np.delete(h, k) - h[k]) * np.sqrt(size), 700.0))
    return languages[k], float(h[k]), float(1 / (1 + gaps.sum()))


def _scored_batch(batch, verdicts, sizes):
    best, entropy, score = zip(*verdicts, strict=True) if verdicts else ((), (), ())
    kept = [batch.column(c) for c in ("id", "trains", "lang", "row_hash")]
    return pa.record_batch(
        [
            *kept,
            pa.array(best, pa.string()),
            pa.array(entropy, pa.float64()),
            pa.array(score, pa.float64()),
            pa.array(sizes, pa.int64()),
        ],
        names=["id", "trains", "lang", "row_hash", "best", "entropy", "score", "size"],
    )


def _scores(shared):
    def run(batches):
        model: Model = shared.value
        for batch in batches:
            verdicts, sizes = [], []
            for text in batch.column("text"):
                grams = four_grams(text.as_py())
                sizes.append(len(grams))
                if not len(grams) or not model.languages:
                    verdicts.append((None, None, None))
                    continue
                grams, counts = _runs(np.sort(grams))
                verdicts.append(_verdict(model.languages, counts @ model.log_probabilities(grams), int(counts.sum())))
            yield _scored_batch(batch, verdicts, sizes)

    return run


def _row_grams(batches):
    """Distinct four-grams of each row with their counts."""
    for batch in batches:
        for row, text in zip(batch.column("row").to_pylist(), batch.column("text"), strict=True):
            grams = four_grams(text.as_py())
            if len(grams):
                grams, counts = _runs(np.sort(grams))
                yield pa.record_batch(
                    [pa.array(np.full(len(grams), row)), pa.array(grams.view(np.int64)), pa.array(counts.astype(np.int64))],
                    names=["row", "gram", "n"],
                )


def _verdicts(languages: list[str]):
    def run(batches):
        for batch in batches:
            sizes = batch.column("size").to_pylist()
            totals = batch.column("totals").to_pylist()
            verdicts = [_verdict(languages, np.array(t), n) if n else (None, None, None) for t, n in zip(totals, sizes, strict=True)]
            yield _scored_batch(batch, verdicts, sizes)

    return run


def _joined_scores(rows: DataFrame, tables: DataFrame, languages: list[str]) -> DataFrame:
    """What ``_scores`` gives, with the model as joined tables: no part of it is held by one process.

    Values are single precision and sums of a text double, as in the arrays, so both ways give the same.
    """
    held = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    grams = cut(held.mapInArrow(_row_grams, "row long, gram long, n long"))
    # One row for each gram, with what each language that has it says.
    by_language = tables.groupBy("kind", "ord", "gram").agg(
        F.map_from_entries(F.collect_list(F.struct("lang", F.col("value").cast("float").alias("value")))).alias("says")
    )
    by_language = cut(by_language)
    priced = grams.select("gram").distinct()
    for kind, order, shift in [*(("p", k, 0) for k in range(ORDER, 0, -1)), *(("b", k, 16) for k in range(ORDER - 1, -1, -1))]:
        part = by_language.where((F.col("kind") == kind) & (F.col("ord") == order)).select(
            F.col("gram").alias("_key"), F.col("says").alias(f"{kind}{order}")
        )
        # Single characters and the empty context have at most 2 ** 16 rows.
        part = F.broadcast(part) if order < 2 else part
        mask = (1 << (16 * order)) - 1
        key = F.shiftrightunsigned("gram", shift) if shift else F.col("gram")
        key = key if order == ORDER else key.bitwiseAND(F.lit(mask))
        priced = priced.withColumn("_at", key).join(part, F.col("_at") == F.col("_key"), "left").drop("_at", "_key")
    says = lambda name, lang: F.try_element_at(F.col(name), F.lit(lang))
    priced = priced.select("gram", *[_backed_off(says, lang).alias(f"_{k}") for k, lang in enumerate(languages)])
    totals = (
        grams.join(priced, "gram")
        .groupBy("row")
        .agg(F.sum("n").alias("size"), F.array(*[F.sum(F.col("n") * F.col(f"_{k}")) for k in range(len(languages))]).alias("totals"))
    )
    kind = dict(rows.dtypes)["id"]
    return (
        held.drop("text")
        .join(totals, "row", "left")
        .withColumn("size", F.coalesce("size", F.lit(0)).cast("long"))
        .mapInArrow(_verdicts(languages), f"id {kind}, trains boolean, lang string, row_hash long, {SCORES}")
    )


def _backed_off(says, lang: str):
    """Log probability of a gram: that of the longest ending the language knows, with the weights of the contexts above it."""
    none = F.lit(0.0).cast("float")
    value = F.coalesce(says("b0", lang), none)
    for order in range(1, ORDER + 1):
        weight = F.coalesce(says(f"b{order - 1}", lang), none) if order > 1 else none
        value = F.coalesce(says(f"p{order}", lang), value + weight)
    return value.cast("double")


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[starts], np.diff(np.append(starts, len(ordered)))


def _tables(training: DataFrame) -> DataFrame:
    """The rows of ``_order_tables`` from (lang, text); rows with a null language or text say nothing."""
    counts = cut(
        training.where("lang IS NOT NULL AND text IS NOT NULL")
        .select("lang", "text")
        .mapInArrow(_count_grams, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    return cut(_order_tables(counts))


def train_model(training: DataFrame) -> Model:
    """Models of all languages from (lang, text), on the driver; ``identify_languages`` measures the tables before."""
    return build_model(_tables(training).toArrow())


def row_hash(identity, text):
    """What names a row whose id may be null or repeated; rows with equal ids and texts have equal verdicts."""
    return F.xxhash64(identity, text, F.length(text))


def identify_languages(
    docs: DataFrame,
    trains,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """Predict the language of every row: (id, trains, lang_pred, score, rejected, entropy, row_hash).

    ``trains`` is a condition on the rows of ``docs``; texts and languages are learned from these alone. ``lang_pred`` is a learned
    language, or ``und`` with score 0 if the text is null or has no letter, or nothing was learned.
    ``score`` (0 to 1) is the language's share among all, each weighed by its cross-entropy and the square root of
    the text's length. ``rejected`` is true beyond the calibrated bound, and for ``und``. Of equal
    cross-entropies the language that sorts first wins. Repeated rows and null ids have rows like any other;
    ``trains`` that is null counts as false. ``row_hash`` is ``row_hash(id, text)``, by which rows can be found again.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(trains, F.lit(False)).alias("trains"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).alias("text"),
        row_hash(F.col(id_col), F.col(text_col)).alias("row_hash"),
    )
    tables = _tables(rows.where("trains"))
    languages = sorted(r["lang"] for r in tables.select("lang").distinct().collect())
    # A gram takes a row of the arrays for each order and kind, with a value for each language.
    many = tables.count()
    if many <= MODEL_ROWS and many * (8 + 4 * len(languages)) <= MODEL_BYTES:
        shared = docs.sparkSession.sparkContext.broadcast(build_model(tables.toArrow()))
        kind = dict(rows.dtypes)["id"]
        found = rows.mapInArrow(_scores(shared), f"id {kind}, trains boolean, lang string, row_hash long, {SCORES}")
    else:
        found = _joined_scores(rows, tables, languages)
    scored = cut(found.withColumn("scale", F.floor(F.log2(F.greatest("size", F.lit(1)))).cast("int")))
    bound = (
        scored.where("trains AND lang = best")
        .groupBy("best", "scale")
        .agg(F.percentile_approx("entropy", [0.5, 0.99], 1000).alias("q"))
        .select(
            "best",
            "scale",
            (F.col("q")[1] + REJECT_SPREAD * (F.col("q")[1] - F.col("q")[0]) + REJECT_NATS).alias("bound"),
        )
    )
    # A length that training lacks takes the language's widest bound.
    widest = bound.groupBy("best").agg(F.max("bound").alias("widest"))
    # One row per language and power of two of the length.
    judged = scored.join(F.broadcast(bound), ["best", "scale"], "left").join(F.broadcast(widest), "best", "left")
    far = F.col("entropy") > F.coalesce("bound", "widest", F.lit(float("inf")))
    return judged.select(
        "id",
        "trains",
        F.coalesce("best", F.lit(UNDETERMINED)).alias("lang_pred"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        (F.col("best").isNull() | far).alias("rejected"),
        "entropy",
        "row_hash",
    )
