"""Near-duplicate embeddings by product quantisation.

Vectors of one label are searched in inverted lists over subspaces. Two unit vectors within the threshold's distance
r of each other are within r / sqrt(m) in at least one of m subspaces. A list belongs to one subspace and to a pair of coarse
centres, one for each half of it. A vector is stored in its own list of each subspace and visits each further list that a
neighbour can be in: such a neighbour lies behind the plane half-way between two centres of a half, so the distances to the planes
of both halves bound the search, and these probes are sufficient. The lists grow with the rows of a label, so
that a list's rows do not, until the sample has no more centres to give.

What travels to the lists are codes: the residual of each half against its centre, as a codeword. In a
list the distance of a vector's subspace to the coded ones is looked up in tables; what is left is held against the decoded whole vectors. A
code is passed over only if its distance, less the codes' own errors, is too large. Whole vectors are then fetched only for entries
with something left in their list, and exact cosine in double precision decides. A pair counts in the first subspace in which it is
close enough to meet.

The index (centres and codewords) is fitted on a bounded sample; every vector is indexed.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestgrid.llm.links import compare_blocks, components
from harvestgrid.llm.tables import cut

SAMPLE = 20_000
CODEWORDS = 64
ROUNDS = 8
# Rows that a list should have, and sample rows that a centre of a half should have.
LIST_ROWS, CENTRE_ROWS = 256, 8
# Rows of a block: two blocks of vectors take some megabytes, a table of their distances 32 MB.
BLOCK = 2_048
SEED = 20240301
# Added to the search radius, so that rounding can't lose a pair; the cosine decides in the end.
MARGIN = 1e-6


@dataclass
class Index:
    """Of one vector size: an order of the components, the cuts of the halves, and each half's centres and codewords."""

    order: np.ndarray
    cuts: list[int]
    centres: list[np.ndarray]
    words: list[np.ndarray]

    @property
    def subspaces(self) -> int:
        return len(self.centres) // 2

    def half(self, x: np.ndarray, h: int) -> np.ndarray:
        return x[:, self.order[self.cuts[h] : self.cuts[h + 1]]]

    def subspace(self, x: np.ndarray, s: int) -> np.ndarray:
        return x[:, self.order[self.cuts[2 * s] : self.cuts[2 * s + 2]]]

    def code_type(self) -> np.dtype:
        """What an entry of a list is made of; a subspace shorter than the widest is filled with zeros."""
        widest = max(self.cuts[2 * s + 2] - self.cuts[2 * s] for s in range(self.subspaces))
        halves = len(self.centres)
        return np.dtype(
            [("own", "u1"), ("subspace", "u1"), ("size", "<u4"), ("centre", "<u2", (halves,)), ("word", "u1", (halves,)),
             ("error", "<f4"), ("part_error", "<f4"), ("part", "<f4", (widest,))]
        )

    def decode(self, h: int, centre: np.ndarray, word: np.ndarray) -> np.ndarray:
        return self.centres[h][centre] + self.words[h][word]


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def _k_means(x: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    centres = x[random.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        nearest = _squared(x, centres).argmin(1)
        rows = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        for column in range(x.shape[1]):
            sums[:, column] = np.bincount(nearest, x[:, column], len(centres))
        centres[rows > 0] = sums[rows > 0] / rows[rows > 0, None]
    return centres


def fit_index(sample: np.ndarray, lists: float, subspaces: int) -> Index:
    """Centres of all halves, ``lists`` pairs of them a subspace, and residual codewords, of a sample of unit vectors."""
    random = np.random.default_rng(SEED)
    size = sample.shape[1]
    halves = 2 * max(1, min(subspaces, size // 2))
    index = Index(random.permutation(size), [round(size * k / halves) for k in range(halves + 1)], [], [])
    for h in range(halves):
        part = index.half(sample, h)
        centres = _k_means(part, max(1, round(lists**0.5)), random)
        index.centres.append(centres)
        index.words.append(_k_means(part - centres[_squared(part, centres).argmin(1)], CODEWORDS, random))
    return index


def encode(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centre and codeword of each half, and each half's squared distance from what they stand for."""
    centres, words, errors = [], [], []
    for h, own in enumerate(index.centres):
        part = index.half(x, h)
        centres.append(_squared(part, own).argmin(1))
        words.append(_squared(part - own[centres[-1]], index.words[h]).argmin(1))
        errors.append(((part - index.decode(h, centres[-1], words[-1])) ** 2).sum(1))
    return np.stack(centres, 1), np.stack(words, 1), np.stack(errors, 1)


def _planes(centres: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre, and the least distance of a point of each centre's region."""
    d = _squared(part, centres)
    home = d.argmin(1)
    apart = np.sqrt(_squared(centres, centres))
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (d - d[np.arange(len(part)), home][:, None]) / (2 * apart[home])
    plane[np.arange(len(part)), home] = 0
    return home, np.nan_to_num(plane, nan=0.0, posinf=0.0)


def probes(index: Index, x: np.ndarray, s: int, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home list of each vector in a subspace; and (vector, list) for each later list in which one within the radius can be at home."""
    first, second = index.centres[2 * s], index.centres[2 * s + 1]
    home_a, a = _planes(first, index.half(x, 2 * s))
    home_b, b = _planes(second, index.half(x, 2 * s + 1))
    home = home_a * len(second) + home_b
    reach = radius + MARGIN
    row_a, at_a = np.nonzero(a <= reach)
    row_b, at_b = np.nonzero(b <= reach)
    of_row = np.bincount(row_b, minlength=len(x))
    times = of_row[row_a]
    left = np.repeat(np.arange(len(row_a)), times)
    right = (np.cumsum(of_row) - of_row)[row_a[left]] + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
    row, cell = row_a[left], at_a[left] * len(second) + at_b[right]
    near = a[row, at_a[left]] ** 2 + b[row, at_b[right]] ** 2 <= reach**2
    near &= cell > home[row]
    return home, row[near], cell[near]


def unit_rows(vectors: list[bytes], kind: type) -> np.ndarray:
    """Vectors of one size, as they are stored, made unit vectors in double precision."""
    x = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64) + 0.0
    # The largest component first, so that neither tiny nor huge vectors lose their length.
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x


def _units(kind: type):
    """Each vector in its own precision (``raw``), which is what travels, and a print of its direction and label."""

    def run(batches):
        for batch in batches:
            raws, prints = [], []
            for label, vector in zip(batch.column("label").to_pylist(), batch.column("vector"), strict=True):
                raw = np.array(vector.as_py(), kind).tobytes()
                raws.append(raw)
                prints.append(md5(label.encode() + b"\0" + unit_rows([raw], kind).tobytes()).hexdigest())
            yield pa.record_batch(
                [batch.column("id"), batch.column("label"), pa.array(prints, pa.string()), pa.array(raws, pa.binary())],
                names=["id", "label", "print", "raw"],
            )

    return run


def _dealt(fitted, radius: float, kind: type):
    width = np.dtype(kind).itemsize
    names = ["rep", "label", "size", "subspace", "cell", "code"]

    def entries(index: Index, reps: np.ndarray, labels: pa.Array, x: np.ndarray):
        centre, word, errors = encode(index, x)
        for s in range(index.subspaces):
            home, row, cell = probes(index, x, s, radius / np.sqrt(index.subspaces))
            rows, cells = np.concatenate([np.arange(len(x)), row]), np.concatenate([home, cell])
            codes = np.zeros(len(rows), index.code_type())
            codes["own"][: len(x)] = 1
            codes["subspace"], codes["size"] = s, x.shape[1]
            codes["centre"], codes["word"] = centre[rows], word[rows]
            codes["error"] = np.sqrt(errors.sum(1))[rows]
            codes["part_error"] = np.sqrt(errors[:, 2 * s : 2 * s + 2].sum(1))[rows]
            part = index.subspace(x, s)
            codes["part"][:, : part.shape[1]] = part[rows]
            data = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(codes.itemsize), len(codes), [None, pa.py_buffer(codes.tobytes())]
            )
            yield pa.record_batch(
                [
                    pa.array(reps[rows]),
                    labels.take(pa.array(rows)),
                    pa.array(np.full(len(rows), x.shape[1], np.int32)),
                    pa.array(np.full(len(rows), s, np.int32)),
                    pa.array(cells.astype(np.int32)),
                    data.cast(pa.binary()),
                ],
                names=names,
            )

    def run(batches):
        for batch in batches:
            raws = batch.column("raw").to_pylist()
            sizes = np.array([len(r) for r in raws])
            for size, index in fitted.value.items():
                rows = np.flatnonzero(sizes == width * size)
                if len(rows):
                    some = batch.take(pa.array(rows))
                    x = unit_rows([raws[k] for k in rows], kind)
                    yield from entries(index, some.column("rep").to_numpy(), some.column("label"), x)

    return run


def _about(fitted, radius: float):
    """Entries of a list that their codes do not keep apart; visitors never meet each other."""

    def linked(a: list[bytes], b: list[bytes]) -> np.ndarray:
        index = fitted.value[int.from_bytes(a[0][2:6], "little")]
        queries, stored = (np.frombuffer(b"".join(side), index.code_type()) for side in (a, b))
        out = np.zeros((len(a), len(b)), bool)
        s = int(queries["subspace"][0])
        near = radius / np.sqrt(index.subspaces) + MARGIN
        for one, two, turned in ((queries, stored, False), (stored, queries, True))[: 1 if a is b else 2]:
            own = np.flatnonzero(two["own"])
            if not len(own):
                continue
            kept = two[own]
            about = np.zeros((len(one), len(own)), np.float32)
            at = 0
            for h in (2 * s, 2 * s + 1):
                # Codes that occur among the stored ones, and the distance of each vector's half to them.
                pairs, code = np.unique(kept["centre"][:, h].astype(np.int64) * 256 + kept["word"][:, h], return_inverse=True)
                points = index.decode(h, pairs // 256, pairs % 256)
                half = one["part"][:, at : at + points.shape[1]].astype(np.float64)
                about += _squared(half, points).astype(np.float32)[:, code]
                at += points.shape[1]
            row, column = np.nonzero(about <= (near + kept["part_error"]) ** 2)
            if not len(row):
                continue
            whole = np.zeros(len(row))
            for h in range(len(index.centres)):
                x = index.decode(h, one["centre"][:, h], one["word"][:, h])
                y = index.decode(h, kept["centre"][:, h], kept["word"][:, h])
                whole += ((x[row] - y[column]) ** 2).sum(1)
            close = np.sqrt(whole) <= radius + one["error"][row].astype(np.float64) + kept["error"][column] + MARGIN
            row, column = row[close], own[column[close]]
            out[(column, row) if turned else (row, column)] = True
        return out | out.T if a is b else out

    return linked


def _close(fitted, radius: float, threshold: float, kind: type):
    """Links by exact cosine of a list's stored vectors with each other and with visitors, in their first subspace alone."""
    item = np.dtype(kind).itemsize

    def linked(a: list[bytes], b: list[bytes]) -> np.ndarray:
        index = fitted.value[(len(a[0]) - 2) // item]
        (x, x_own), (y, y_own) = (
            (unit_rows([p[2:] for p in side], kind), np.array([p[0] for p in side], bool)) for side in (a, b)
        )
        row, column = np.nonzero((x @ y.T >= threshold - MARGIN) & (x_own[:, None] | y_own[None, :]))
        out = np.zeros((len(a), len(b)), bool)
        least = radius**2 / index.subspaces * (1 + 1e-9) + 1e-12
        for at in range(0, len(row), BLOCK * 8):
            r, c = row[at : at + BLOCK * 8], column[at : at + BLOCK * 8]
            left, right = x[r], y[c]
            exact = np.einsum("ij,ij->i", left, right) >= threshold
            apart = (left - right) ** 2
            meets = np.stack([index.subspace(apart, s).sum(1) <= least for s in range(index.subspaces)], 1)
            exact &= meets.argmax(1) == a[0][1]
            out[r[exact], c[exact]] = True
        return out

    return linked


def embedding_near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
    sample: int = SAMPLE,
    subspaces: int = 8,
) -> DataFrame:
    """Links between vectors of one label whose cosine is at least ``threshold``.

    Result, one row per id: ``vec_id``, ``n_links`` long (other ids linked directly), ``component_id`` long
    (smallest id reachable by links, itself included), ``kept`` boolean (it is its component's smallest).
    Vectors that are null, empty, zero or hold a null or non-finite component, and rows with a null label, link with
    nothing; so do vectors of different sizes. Rows that repeat an id count once (the one whose label, then
    print, sorts first). A null id has one row, with a null component and ``kept`` null. Other columns are not read.
    """
    single_precision = dict(vectors.dtypes)[vector_col] == "array<float>"
    kind = np.float32 if single_precision else np.float64
    width = np.dtype(kind).itemsize
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<float>" if single_precision else "array<double>").alias("vector"),
    )
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & whole).where(
        F.exists("vector", lambda x: x != 0.0)
    )
    units = valid.mapInArrow(_units(kind), "id long, label string, print string, raw binary")
    one = F.min(F.struct("label", "print", "raw")).alias("_one")
    units = cut(units.groupBy("id").agg(one).select("id", "_one.*"))
    classes = units.groupBy("print").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    single = cut(
        units.withColumnRenamed("id", "rep").join(classes.select("rep", "weight"), "rep").drop("print")
    )
    # Rows of the largest label: lists are kept apart by label, so that one decides how many there should be.
    largest = single.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    some = single.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("raw").toArrow().column("raw").to_pylist()
    fitted: dict[int, Index] = {}
    for size in sorted({len(u) for u in some}):
        x = unit_rows([u for u in some if len(u) == size], kind)
        lists = min(largest / LIST_ROWS, (len(x) / CENTRE_ROWS) ** 2)
        fitted[size // width] = fit_index(x, lists, subspaces)
    for (size,) in single.select(F.length("raw").alias("size")).distinct().collect():
        if size // width not in fitted:  # a size that the sample missed: one list, coded without a fit
            fitted[size // width] = fit_index(np.zeros((1, size // width)), 1.0, subspaces)
    shared = single.sparkSession.sparkContext.broadcast(fitted)
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    named = "rep long, label string, size int, subspace int, cell int, code binary"
    dealt = cut(
        single.mapInArrow(_dealt(shared, radius, kind), named).select(
            F.monotonically_increasing_id().alias("entry"),
            F.xxhash64("label", "size", "subspace", "cell").alias("grp"),
            "rep",
            "code",
        )
    )
    sizes = dealt.groupBy("grp").agg(F.count("*").alias("n"), F.max(F.substring("code", 1, 1) == F.lit(b"\x01")).alias("held"))
    members = dealt.join(sizes.where("n > 1 AND held").select("grp", "n"), "grp").select(
        "grp",
        "n",
        F.col("entry").alias("item"),
        F.lit(1).cast("long").alias("weight"),
        F.col("code").alias("payload"),
    )
    maybe = compare_blocks(members, _about(shared, radius), dealt.count(), BLOCK).where("other IS NULL")
    left = maybe.select(F.col("item").alias("entry")).distinct()
    fetched = cut(
        dealt.join(left, "entry")
        .select("grp", "rep", F.substring("code", 1, 2).alias("head"))
        .join(single.select("rep", "weight", "raw"), "rep")
        .select("grp", F.col("rep").alias("item"), "weight", F.concat("head", "raw").alias("payload"))
    )
    members = fetched.join(fetched.groupBy("grp").agg(F.count("*").alias("n")), "grp")
    links = cut(compare_blocks(members, _close(shared, radius, threshold, kind), fetched.count(), BLOCK))
    joined = components(links.where("other IS NOT NULL").select(F.col("item").alias("a"), F.col("other").alias("b")))
    others = links.where("other IS NULL").groupBy("item").agg(F.sum("links").alias("others"))
    by_class = (
        classes.withColumnRenamed("rep", "item")
        .join(others, "item", "left")
        .join(joined.select(F.col("node").alias("item"), "root"), "item", "left")
        .select(
            "print",
            F.coalesce("root", "item").alias("component"),
            (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("links"),
        )
    )
    named = units.select("id", "print").join(by_class, "print")
    return (
        rows.select("id")
        .distinct()
        .join(named, "id", "left")
        .select(
            F.col("id").alias("vec_id"),
            F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
            (F.col("id") == F.coalesce("component", "id")).alias("kept"),
        )
    )
