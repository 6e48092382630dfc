"""Word hashes, block comparison and components."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from harvestgrid.llm import links
from harvestgrid.llm.links import compare_blocks, components
from harvestgrid.llm.ngram_join import forest_recall, jaccard_at_least, prefix_depth, shingle_set
from harvestgrid.llm.words import gram_hashes, word_hashes


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_words_are_runs_of_letters_and_digits(text):
    words = ["".join(g) for g in re.findall(r"((?:[^\W_])+)", text.lower())]
    got = word_hashes(text)
    assert len(got) >= len(words) - 1
    names = {}
    for w in re.findall(r"[a-z0-9]+", " ".join(re.findall(r"[a-z0-9]+", text.lower()))):
        assert names.setdefault(w, int(word_hashes(w)[0])) == int(word_hashes(w)[0])


def test_word_hashes_know_words_not_places():
    a, b = word_hashes("The cat, the CAT."), word_hashes("cat")
    assert a[1] == a[3] == b[0] and a[0] == a[2] != a[1]
    assert len(word_hashes(None)) == len(word_hashes("")) == len(word_hashes(" .;")) == 0
    assert len(word_hashes("é" * 300_000 + " x")) == 2


def test_grams():
    words = word_hashes("a b c d e f")
    assert len(gram_hashes(words, 5)) == 2 and len(gram_hashes(words[:3], 5)) == 1 and len(gram_hashes(words[:0], 5)) == 0
    assert gram_hashes(words, 5)[0] != gram_hashes(words[::-1], 5)[1]


def test_jaccard_of_blocks():
    sets = [shingle_set(t) for t in ("a b c d e f g h i j", "a b c d e f g h i k", "x", "a b c d e f g h i j")]
    loads = [s.tobytes() for s in sets]
    got = jaccard_at_least(5 / 7)(loads, loads)
    np.fill_diagonal(got, True)
    assert got.tolist() == [[True, True, False, True], [True, True, False, True], [False, False, True, False], [True, True, False, True]]
    assert jaccard_at_least(0.8)(loads[:2], loads[2:]).tolist() == [[False, True], [False, False]]


def test_prefix_reaches_the_target():
    depth = prefix_depth(0.8, 0.9999)
    assert forest_recall(depth, 0.8) >= 0.9999 > forest_recall(depth + 1, 0.8)


def test_blocks_find_what_one_comparison_finds(spark):
    random = np.random.default_rng(3)
    values = {k: int(v) for k, v in enumerate(random.integers(0, 40, 150))}
    rows = [(7, 150, k, 1 + k % 3, bytes([v])) for k, v in values.items()]
    rows += [(8, 1, 900, 1, b"\1"), rows[0]]
    members = spark.createDataFrame(rows, "grp long, n long, item long, weight long, payload binary")

    def near(a, b):
        x, y = (np.frombuffer(b"".join(s), np.uint8).astype(int) for s in (a, b))
        return np.abs(x[:, None] - y[None, :]) == 0

    found = compare_blocks(members, near, len(rows), 16).collect()
    counts = {}
    for r in found:
        if r["other"] is None:
            counts[r["item"]] = counts.get(r["item"], 0) + r["links"]
    want = {a: sum(1 + b % 3 for b, w in values.items() if w == v and b != a) for a, v in values.items()}
    assert counts == {k: v for k, v in want.items() if v}
    edges = spark.createDataFrame([(r["item"], r["other"]) for r in found if r["other"] is not None], "a long, b long")
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    assert roots == {k: min(j for j, w in values.items() if w == v) for k, v in values.items() if want[k]}


def test_components_of_a_chain_a_star_and_nothing(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_with_heavy_nodes(spark):
    # Stars whose centre is the least, the greatest and a middle node, each with more edges than HEAVY, and a bridge.
    edges = [(0, k) for k in range(1, 300)] + [(999, k) for k in range(500, 700)] + [(1500, k) for k in range(1400, 1600) if k != 1500]
    edges += [(-5, k) for k in range(1450, 1550)] + [(299, 699)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    low, high = [*range(300), *range(500, 700), 999], [*range(1400, 1600), -5]
    assert got == {**dict.fromkeys(low, 0), **dict.fromkeys(high, -5)}


def test_few_and_many_edges_give_the_same_components(spark, monkeypatch):
    edges = [(0, k) for k in range(1, 200)] + [(k, k + 1) for k in range(300, 330)] + [(900, k) for k in range(150, 320)]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(4)
    few = sorted(components(frame).collect())
    monkeypatch.setattr(links, "FEW_EDGES", 0)
    assert few == sorted(components(frame).collect()) and {r["root"] for r in few} == {0}


def test_few_edges_take_few_exchanges(spark):
    plan = links._few_step(spark.createDataFrame([(1, 2), (2, 1)], "u long, v long"))._jdf.queryExecution().executedPlan().toString()
    # The least neighbours stand in the plan twice, the second time as a reused exchange.
    assert plan.count(" Exchange hashpartitioning") == 3 and "SortMergeJoin" not in plan
