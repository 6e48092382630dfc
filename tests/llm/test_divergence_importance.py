"""Source divergence and importance resampling against plain counting."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from harvestgrid.llm import byte_words
from harvestgrid.llm.byte_words import LETTERS, LETTERS_AND_DIGITS, word_pieces
from harvestgrid.llm.importance import RunningCrc, carry, importance_resample
from harvestgrid.llm.source_divergence import PARTS, source_divergence

DOCS = "doc_id long, text string, lang string, source string, rank int, value string"
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
ROWS = [
    (1, "The cat, the dog; the Élan", "en", "a"), (1, "The cat, the dog; the Élan", "en", "a"), (2, None, "en", "b"), (3, "", "en", "c"),
    (4, "cat dog elan Élan éLAN the", "en", "b"), (5, "dog dog dog cat 99 x1y x y", "en", "d"), (None, "the x y cat's dog", None, None),
    (6, "x the y cat", "", ""), (7, "y x y the CAT", None, "z"), (8, "eins zwei", "de", "a"), (9, "eins drei", "de", "b"), (9, "eins", "de", None),
    (10, "allein", "fr", "only"), (11, "the " * 3000 + "cat " * 500, "en", "e"), (12, "日本 語 日本", "ja", "a"), (13, "日本 日本 語", "ja", "b"),
    (14, "日本", "ja", "b"), (15, "tie1 tie2 one two", "en", "f"), (16, "one two tie", "en", "g"), (17, "two one tie", "en", "h"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], DOCS)


def plain_divergence(rows):
    docs = [(r[2] or "", r[3] or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (r[1] or "").translate(UPPER))) for r in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [(s, w) for x, s, w in docs if x == lang]
        holding = collections.Counter(t for _, w in mine for t in set(w))
        kept = [t for t in holding if holding[t] >= 3]
        uses = {s: collections.Counter(t for x, w in mine if x == s for t in w if t in set(kept)) for s in {m[0] for m in mine}}
        every = sum(uses.values(), collections.Counter())

        def share(count, term, kept=kept):
            return 1 + PARTS * (count[term] + 1) // (sum(count.values()) + len(kept))

        for source, count in uses.items():
            pairs = [
                (-sum((share(count, t) - share(other, t)) ** 2 // share(other, t) for t in kept), name.encode(), name)
                for name, other in uses.items()
                if name != source
            ]
            apart = [
                (-((share(count, t) - share(every, t)) ** 2 // share(every, t)), t.encode(), t)
                for t in kept
                if count[t] and share(count, t) > share(every, t)
            ]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(apart)[:200])):
                out.update((lang, source, part, name, -value, k + 1) for k, (value, _, name) in enumerate(found))
    return out


@pytest.mark.parametrize("blocks", [(64, 4096), (2, 2), (1, 1)])
def test_divergence_equals_plain_counts(spark, blocks):
    got = source_divergence(frame(spark), group_block=blocks[0], term_block=blocks[1]).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == plain_divergence(ROWS)


def test_divergence_of_a_hot_source_and_none(spark):
    rows = [(k, f"word{chr(97 + k % 7)} same", "en", "hot" if k % 3 else f"s{k % 12}") for k in range(3000)]
    assert {tuple(r) for r in source_divergence(frame(spark, rows), term_block=2).collect()} == plain_divergence(rows)
    assert source_divergence(frame(spark, [])).count() == 0


def test_divergence_shuffles_counts_not_words(spark, tables):
    plan = source_divergence(tables("documents"))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aAZz09 -_\n\x00é日𠀀~", max_size=80), st.integers(1, 9))
def test_pieces_hold_the_words_of_the_text(text, size):
    old, byte_words.PIECE = byte_words.PIECE, size
    try:
        for pattern in (LETTERS, LETTERS_AND_DIGITS):
            whole = re.findall(pattern, text.translate(UPPER).encode())
            assert [w for words in word_pieces(text.encode(), pattern) for w in words] == whole
    finally:
        byte_words.PIECE = old


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=1, max_size=9), max_size=6), max_size=5), st.integers(1, 4))
def test_prefixes_give_the_crc_of_every_gram(pieces, longest):
    scan, got = RunningCrc(longest), [[] for _ in range(longest)]
    for words in pieces:
        for n, found in enumerate(scan.grams(words)):
            got[n].extend(found.tolist())
    words = [w for p in pieces for w in p]
    for n in range(1, longest + 1):
        assert got[n - 1] == [zlib.crc32(b" ".join(words[k : k + n])) for k in range(len(words) - n + 1)]


def test_long_words_are_carried():
    lengths = [0, 1, 255, 256, 257, 1000, 70_000]
    for length in lengths:
        a, b = b"before", b"x" * length
        got = carry(np.array([zlib.crc32(a)], np.uint32), np.array([length]))[0] ^ zlib.crc32(b)
        assert int(got) == zlib.crc32(a + b)


def plain_resample(rows, target, percent=10, longest=1, least=20):
    def grams(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UPPER))
        return len(words), [" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]

    def counts(texts):
        return collections.Counter(zlib.crc32(g.encode()) % 10_000 for t in texts for g in grams(t)[1])

    s, t = counts(r[1] for r in rows), counts(target)
    size_s, size_t = sum(s.values()), sum(t.values())
    out, ranked = [], []
    for k, r in enumerate(rows):
        words, found = grams(r[1])
        gain = [
            math.floor(1000 * math.log((t[b] + 1) * (size_s + 10_000) / ((s[b] + 1) * (size_t + 10_000))))
            for b in (zlib.crc32(g.encode()) % 10_000 for g in found)
        ]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([r[0], len(found), weight, score, None])
        if words >= least:
            ranked.append((-score, r[0] is None, r[0] or 0, len(found), weight, k))
    for rank, row in enumerate(sorted(ranked)[: percent * len(ranked) // 100]):
        out[row[-1]][4] = rank + 1
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("longest,percent", [(1, 10), (3, 50), (1, 100)])
def test_resample_equals_plain_counts(spark, tables, longest, percent):
    docs = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in tables("documents").collect()]
    rows = docs + [r for r in ROWS if r[0] != 1] + docs[:5]
    target = [r["text"] for r in tables("benchmark").collect()] + [None, ""]
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance_resample(frame(spark, rows), aims, longest=longest, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert ordered(got.collect()) == ordered(plain_resample(rows, target, percent, longest))


def test_resample_of_equal_rows_and_empty_tables(spark):
    rows = [(1, "one two " * 10, "en", "a")] * 20_000 + [(None, "three " * 20, "en", "a")] * 40
    none = spark.createDataFrame([], "text string")
    ranked = importance_resample(frame(spark, rows).repartition(8), none)
    ranks = sorted(r["rank"] for r in ranked.where("rank IS NOT NULL").collect())
    assert ranks == list(range(1, 2005))
    assert importance_resample(frame(spark, []), none).count() == 0
    few = importance_resample(frame(spark, rows[:9]), none).collect()
    assert len(few) == 9 and all(r["rank"] is None for r in few)
