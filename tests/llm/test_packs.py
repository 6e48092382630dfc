"""Token packs, best-fit packing, sharding and decontamination."""

import collections
import os
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from harvestgrid.llm.decontaminate import contaminated, place
from harvestgrid.llm.packing import Bins, pack_best_fit
from harvestgrid.llm.sharding import schedule, shard_documents
from harvestgrid.llm.token_packs import DEFAULT_VOCABULARY, END, Encoder, best_fit_decreasing, pack_token_ids
from harvestgrid.llm.words import word_hashes

DOCS = "doc_id long, text string, source string, piece int, shard int, size string, bin string"


@given(st.lists(st.integers(1, 50), max_size=60))
@settings(max_examples=100, deadline=None)
def test_tree_search_equals_plain_best_fit(lengths):
    rooms, rows = [], []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        fits = [r for r in rooms if r >= lengths[k]]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - lengths[k])
        else:
            rooms.append(50 - lengths[k])
            rows.append(k)
    got = best_fit_decreasing(lengths, 50)
    assert sorted(50 - sum(lengths[k] for k in row) for row in got) == sorted(rooms)
    assert sorted(k for row in got for k in row) == list(range(len(lengths)))


needs_vocabulary = pytest.mark.skipif(not os.path.exists(DEFAULT_VOCABULARY), reason="no vocabulary")
ODD = [None, "", "a  b   c", " lead", "trail ", "tab\tx \n y", "<|endoftext|>", "é ü 漢字 🎉", "word " * 9000, "don't", "x\n\n z"]


@needs_vocabulary
def test_remembered_words_change_nothing(texts):
    with open(DEFAULT_VOCABULARY, "rb") as f:
        encoder = Encoder(f.read())
    for text in [*[t for t in ODD if t], *texts.values()]:
        assert np.frombuffer(encoder.ids(text), "<u2").tolist() == encoder.bpe.encode_ordinary(text)


@needs_vocabulary
@pytest.mark.parametrize("window", [5_000, 4_000_000])
def test_packs_round_trip(spark, window):
    rows = [(k, t, "s", 0, 0, "", "") for k, t in enumerate(ODD)] + [(None, "no id", "s", 0, 0, "", "")]
    packs = pack_token_ids(spark.createDataFrame(rows, DOCS), width=64, window_tokens=window).collect()
    with open(DEFAULT_VOCABULARY, "rb") as f:
        bpe = Encoder(f.read()).bpe
    pieces = collections.defaultdict(dict)
    for p in packs:
        ids, cuts = np.frombuffer(p["input_ids"], "<u2"), p["cu_seqlens"]
        assert len(ids) == 64 and cuts[0] == 0 and cuts[-1] == p["n_tokens"] and (ids[p["n_tokens"] :] == END).all()
        assert p["position_resets"] == (cuts[:-1] if cuts[-1] == 64 else cuts)
        for a, b, d, at in zip(cuts, cuts[1:], p["doc_ids"], p["doc_offsets"], strict=False):
            assert at not in pieces[d]
            pieces[d][at] = ids[a:b].tolist()
    whole = {d: [x for at in sorted(ps) for x in ps[at]] for d, ps in pieces.items()}
    assert {d: bpe.decode(ids[:-1]) for d, ids in whole.items()} == {r[0]: r[1] or "" for r in rows}
    assert all(ids[-1] == END for ids in whole.values()) and len({p["pack_id"] for p in packs}) == len(packs)
    assert pack_token_ids(spark.createDataFrame([], DOCS)).count() == 0


def test_successor_search_takes_the_tightest_compatible_bin():
    bins = Bins(10)
    a, b, c = bins.put(7, 1, 1), bins.put(6, 2, 2), bins.put(5, 4, 4)
    assert len({a, b, c}) == 3
    assert bins.put(3, 8, 8) == a
    assert bins.put(3, 2, 16) == c
    assert bins.put(2, 0, 0) == c
    assert bins.put(4, 16, 2) == 3


def test_packing_by_brute_force(spark, tables):
    docs = tables("documents")
    extra = [(None, "no id", None), (None, None, "s"), (7000, "", "s"), (7001, None, None), (7002, "é" * 40_000, "s"), (7003, "same", "s"), (7003, "same", "s"), (7004, " SAME ", "t")]
    docs = docs.select("doc_id", "text", "source").union(spark.createDataFrame(extra, "doc_id long, text string, source string"))
    rows = docs.collect()
    info = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    got = pack_best_fit(docs, window=64).collect()
    bins = collections.defaultdict(list)
    for p in got:
        bins[p["bin"]].append(p)
    sizes = collections.Counter()
    for own in bins.values():
        own.sort(key=lambda p: (p["at"], p["length"]))
        assert sum(p["length"] for p in own) <= 16_384
        assert [p["at"] for p in own] == np.cumsum([0, *(p["length"] for p in own)])[:-1].tolist()
        named = [info[p["doc_id"]] for p in own if p["doc_id"] is not None]
        sources = [r["source"] for r in named if r["source"] is not None]
        clusters = [t for r in named if (t := " ".join((r["text"] or "").lower().split()))]
        assert len(set(sources)) == len(sources) and len(set(clusters)) == len(clusters)
        for p in own:
            sizes[p["doc_id"]] += p["length"]
    want = collections.Counter()
    for r in rows:
        want[r["doc_id"]] += len((r["text"] or "").encode())
    assert +sizes == +want and {p["doc_id"] for p in got} == set(want)
    assert sorted(p["start"] for p in got if p["doc_id"] == 7002) == [0, 16_384, 32_768, 49_152, 65_536]
    assert pack_best_fit(docs.limit(0)).count() == 0


def test_schedule():
    assert schedule([("a", 5), ("b", 4), ("c", 3), ("d", 3), ("e", 3)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


def test_shards(spark, tables):
    rows = [(r["doc_id"], r["text"]) for r in tables("documents").collect()]
    rows += [(9000 + k, "the same text") for k in range(50)] + [(9500, None), (9501, None), (None, None), (9502, ""), (9503, ""), (9504, "é" * 30_000), (9000, "the same text")]
    df = spark.createDataFrame([(*r, "s", 0, 5, "x", "b") for r in rows], DOCS)
    got = shard_documents(df).collect()
    key = lambda i, t: (i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got) == sorted(key(*r) for r in rows)
    loads, slots, homes = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        if r["size"] > 1:
            homes[r["text_crc32"], r["size"]].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert set(loads) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    assert max(loads.values()) - min(loads.values()) <= 0.02 * max(loads.values())
    assert shard_documents(df.limit(0)).count() == 0


def test_shards_of_many_small_texts_use_parcels(spark):
    df = spark.range(40_000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    loads = [r["s"] for r in shard_documents(df).groupBy("shard").agg({"size": "sum"}).toDF("shard", "s").collect()]
    assert len(loads) == 8 and max(loads) - min(loads) <= 0.01 * max(loads)


def slow_align(a, b):
    h, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
    for i, j in np.ndindex(len(a), len(b)):
        h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        best = max(best, h[i + 1, j + 1])
    return best


@given(st.lists(st.integers(0, 4), min_size=1, max_size=12), st.lists(st.integers(0, 4), max_size=20))
@settings(max_examples=150, deadline=None)
def test_alignment_equals_the_table(a, b):
    score, start, end = place(np.array(a, np.uint64), np.array(b, np.uint64))
    assert score == slow_align(a, b) / (2 * len(a)) and 0 <= start <= end <= len(b)
    assert slow_align(a, b[start:end]) == slow_align(a, b)


def test_contaminated_documents(spark, tables, texts):
    items = {r["item_id"]: r["text"] for r in tables("benchmark").collect()}
    random.seed(4)
    passage = items[0].split()
    edited = [w if random.random() > 0.15 else "changed" for w in passage]
    clean = " ".join(f"word{k}" for k in range(200))
    extra = {5000: clean + " " + " ".join(passage) + " " + clean, 5001: clean + " " + " ".join(edited), 5002: clean, 5003: None, 5004: "", 5005: items[1] * 3}
    rows = [*texts.items(), *extra.items(), (None, items[0]), (5000, extra[5000])]
    df = spark.createDataFrame([(i, t, "s", 0, 0, "", "") for i, t in rows], DOCS)
    bench = tables("benchmark").union(spark.createDataFrame([(None, clean), (800, None), (801, "")], "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): (r["score"], r["start"], r["end"]) for r in contaminated(df, bench).collect()}
    assert got[5000, 0] == (1.0, 200, 200 + len(word_hashes(items[0]))) and 0.5 < got[5001, 0][0] < 1 and got[5005, 1][0] == 1.0
    assert not {d for d, _ in got} & {5002, 5003, 5004, None}
    for name, text in {**texts, **extra}.items():
        for item, passage in items.items():
            whole = text is not None and " ".join(passage.split()) in " ".join(text.split())
            assert not whole or got[name, item][0] == 1.0
    assert contaminated(df.limit(0), bench).count() == 0 and contaminated(df, bench.limit(0)).count() == 0
