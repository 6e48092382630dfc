"""Token ids packed into rows of a fixed width by best-fit decreasing.

Documents are encoded with a public tokenizer, cut where they are longer than a row, and packed into rows. The
search for the fullest row that still has room goes down a segment tree over the room that rows have left.
Each task packs windows of its own documents, so nothing is shuffled and memory stays bounded.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 2_048
# Tokens that a task packs together; it holds about twice as many.
WINDOW_TOKENS = 4_000_000
# Words whose ids a task remembers.
REMEMBERED = 300_000
# The split pattern of the byte-level vocabularies, and their free id, which ends a document.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_RUN = re.compile(r"\s\s")
END = 50_256
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SCHEMA = (
    "pack_id long, n_tokens int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, "
    "doc_ids array<long>, doc_offsets array<long>"
)


class Encoder:
    """Byte-level BPE through tiktoken, with the ids of words kept: the pattern never joins across a single space."""

    def __init__(self, vocabulary: bytes) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.bpe = tiktoken.Encoding("packs", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        """Ids as 16-bit values, little end first."""
        if _RUN.search(text):  # runs of white space are split by the pattern in their own way
            return self._encode(text)
        first, *rest = text.split(" ")
        known, out = self.known, [self._encode(first)]
        for word in rest:
            got = known.get(word)
            if got is None:
                got = self._encode(f" {word}")
                if len(known) >= REMEMBERED:
                    known.clear()
                known[word] = got
            out.append(got)
        return b"".join(out)

    def _encode(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), "<u2").tobytes()


class RoomTree:
    """Rows by the room they have left: a segment tree that counts rows, searched for the least room of at least n."""

    def __init__(self, width: int) -> None:
        self.size = 1 << width.bit_length()
        self.counts = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def add(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        self._count(room, 1)

    def _count(self, room: int, by: int) -> None:
        k = room + self.size
        while k:
            self.counts[k] += by
            k >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and give (room, row) of the tightest row with that much room."""
        k = least + self.size
        while not self.counts[k]:
            while k & 1:  # a right child: everything further right hangs off an ancestor
                k >>= 1
            if k == 0:
                return None
            k += 1
        while k < self.size:
            k = 2 * k if self.counts[2 * k] else 2 * k + 1
        room = k - self.size
        self._count(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    """Rows as lists of indices of ``lengths`` (none above ``width``), longest first; of equal ones the first."""
    tree, rows = RoomTree(width), []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        got = tree.take(lengths[k])
        if got is None:
            got = width, len(rows)
            rows.append([])
        room, row = got
        rows[row].append(k)
        tree.add(room - lengths[k], row)
    return rows


def pack_window(documents: list[tuple[int | None, np.ndarray]], width: int) -> Iterator[tuple]:
    """Packed rows of documents (id, ids): ids, cumulative lengths, resets, document ids and offsets in them."""
    pieces = [
        (name, at, ids[at : at + width]) for name, ids in documents for at in range(0, len(ids), width)
    ]
    for row in best_fit_decreasing([len(p[2]) for p in pieces], width):
        parts = [pieces[k] for k in row]
        ends = np.cumsum([0, *(len(p[2]) for p in parts)])
        used = int(ends[-1])
        ids = np.concatenate([*(p[2] for p in parts), np.full(width - used, END, "<u2")])
        resets = ends[: -1 if used == width else None]  # the filling counts from 0 as well
        yield used, ids.tobytes(), ends.tolist(), resets.tolist(), [p[0] for p in parts], [p[1] for p in parts]


def pack_token_ids(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = DEFAULT_VOCABULARY,
    width: int = WIDTH,
    window_tokens: int = WINDOW_TOKENS,
) -> DataFrame:
    """Pack the token ids of all documents into rows of ``width`` ids.

    One row per packed row: ``pack_id``; ``n_tokens`` without filling; ``input_ids``, ``width`` 16-bit values,
    little end first; ``cu_seqlens``, the cumulative segment lengths from 0; ``position_resets``, where positions
    start from 0 again (segments, and the filling); ``doc_ids`` and ``doc_offsets``, the document of each
    segment and the place of its first token there. Every document ends with the id END, and so does the filling
    consist of it. A document longer than a row is cut at multiples of ``width``; joined by offset its
    pieces are the document. Null and empty texts are the id END alone. Repeated rows are packed as they are; a
    null id stays null. The vocabulary must have fewer than 65,536 ids. Other columns are not read.
    """
    # A vocabulary has a fixed size, some hundred thousand short lines.
    ranks = docs.sparkSession.sparkContext.broadcast(_read(vocabulary))

    def run(batches):
        encoder = Encoder(ranks.value)
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[int | None, np.ndarray]] = []
        tokens = 0

        def flush():
            nonlocal number
            rows = list(pack_window(held, width))
            for at in range(0, len(rows), 1000):
                part = rows[at : at + 1000]
                columns = list(zip(*part, strict=True))
                kinds = [pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 2]
                names = list(range(number, number + len(part)))
                number += len(part)
                yield pa.record_batch(
                    [pa.array(names, pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                    names=[
                        "pack_id",
                        "n_tokens",
                        "input_ids",
                        "cu_seqlens",
                        "position_resets",
                        "doc_ids",
                        "doc_offsets",
                    ],
                )

        for batch in batches:
            for name, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                ids = np.frombuffer(encoder.ids(text.as_py() or "") + END.to_bytes(2, "little"), "<u2")
                held.append((name, ids))
                tokens += len(ids)
                if tokens >= window_tokens:
                    yield from flush()
                    held.clear()
                    tokens = 0
        if held:
            yield from flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def write_packs(packs: DataFrame, path: str) -> None:
    """Write packed rows as Parquet; read back, ``numpy.frombuffer`` gives the id matrix of a file."""
    packs.write.parquet(path)
