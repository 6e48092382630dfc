"""N-gram join and embedding join against brute force."""

import numpy as np

from harvestgrid.llm.embedding_join import embedding_near_duplicates, encode, fit_index, probes
from harvestgrid.llm.ngram_join import (
    POOL,
    SEED,
    TREES,
    forest_recall,
    match_prefixes,
    ngram_jaccard_join,
    prefix_depths,
    shingle_set,
    signature,
)

DOCS = "doc_id long, text string, class_id int, n int, print string, other string"


def classes(links, names):
    root = {k: k for k in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {k: find(k) for k in names}


def brute_documents(texts):
    sets = {k: set(shingle_set(t).tolist()) for k, t in texts.items()}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    ]
    counts = {k: sum(k in p for p in links) for k in texts}
    return {k: (c, counts[k]) for k, c in classes(links, texts).items()}


def got_documents(df):
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_jaccard_join(df).collect()}


def test_documents_equal_brute_force(tables, texts):
    assert got_documents(tables("documents")) == brute_documents(texts)


def test_odd_documents(spark):
    base = " ".join(f"w{k}" for k in range(60))
    edited = base.replace("w30 ", "other ")
    texts = {1: base, 2: base.upper(), 3: edited, 4: None, 5: "", 6: " ... ", 7: "two words", 8: "Two words!", 9: "x " * 50_000, 10: ""}
    rows = [(k, t, 5, 6, "p", "q") for k, t in texts.items()] + [(1, base, 0, 0, "", ""), (None, base, 0, 0, "", ""), (None, None, 0, 0, "", "")]
    got = got_documents(spark.createDataFrame(rows, DOCS))
    assert got.pop(None) == (None, 0)
    assert got == brute_documents(texts)
    assert got[3] == (1, 2) and got[8] == (7, 1) and got[4] == (4, 0)
    assert got_documents(spark.createDataFrame([], DOCS)) == {}


def test_many_near_copies_keep_all_links(spark):
    words = [f"w{k}" for k in range(120)]
    texts = {k: " ".join([*words[: 3 * k % 110], f"new{k}", *words[3 * k % 110 + 1 :]]) for k in range(300)}
    assert got_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")) == brute_documents(texts)


def test_texts_under_one_id_are_all_compared(spark):
    a, b, c = (" ".join(f"{name}{k}" for k in range(60)) for name in "uvw")
    near_a, near_b = a.replace("u30 ", "other "), b.replace("v30 ", "other ")
    rows = [(1, a), (1, c), (3, near_a), (4, c), (5, a + "!"), (5, b), (7, near_b), (8, "alone"), (8, "else"), (9, None), (9, a), (None, a), (1, a)]
    got = got_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    # The texts a, near_a, c, b and near_b hang together over the ids 1 and 5; (a, 1), (a, 5) and (a, 9) are copies.
    assert got == {1: (1, 4), 3: (1, 3), 4: (1, 1), 5: (1, 4), 7: (1, 1), 8: (8, 0), 9: (1, 3), None: (None, 0)}


def test_hot_id_with_many_texts(spark):
    rows = [(0, f"text{k} " * 6 + f"end{k}") for k in range(3000)] + [(1, "text7 " * 6 + "end7"), (2, "lone")]
    assert got_documents(spark.createDataFrame(rows, "doc_id long, text string")) == {0: (0, 1), 1: (0, 1), 2: (2, 0)}


def test_forest_keeps_every_shared_prefix(spark):
    words = [f"w{k}" for k in range(150)]
    texts = {k: " ".join([*words[:k], f"new{k}", *words[k + 1 :]]) for k in range(1, 60)}
    texts |= {100 + k: " ".join([*words[: 2 * k], *(f"v{j}" for j in range(2 * k, 150))]) for k in range(40)}
    values = {k: signature(shingle_set(t)) for k, t in texts.items()}
    signed = spark.createDataFrame([(k, v.tobytes()) for k, v in values.items()], "rep long, signature binary")
    depths = prefix_depths(0.8, 0.9999)
    assert depths == sorted(depths, reverse=True) and forest_recall(depths[-1], 0.8) >= 0.9999
    met, edges = match_prefixes(signed, depths)
    cluster = classes([(r["a"], r["b"]) for r in edges.collect()], texts)
    nodes = {}
    for r in met.collect():
        nodes.setdefault(r["prefix"], set()).add(r["rep"])
    together = {(a, b) for node in nodes.values() for a in node for b in node if a < b}
    random = np.random.default_rng(SEED + 1)
    picks = [random.permutation(POOL)[: depths[-1]] for _ in range(TREES)]
    shared = [
        (a, b) for a in values for b in values
        if a < b and any((values[a][p] == values[b][p]).all() for p in picks)
    ]
    assert shared and all(cluster[a] == cluster[b] or (a, b) in together for a, b in shared)
    # Longer prefixes join the near copies, so most pairs need no comparison of signatures.
    assert sum(cluster[a] == cluster[b] for a, b in shared) > len(shared) / 2
    assert all(len({cluster[k] for k in node}) > 1 for node in nodes.values())


VECTORS = "vec_id long, embedding array<float>, label int, links int, unit string"


def brute_vectors(rows):
    def usable(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    unit = {k: (label, np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64))) for k, v, label in rows if usable(v, label)}
    links = [
        (a, b) for a, (la, x) in unit.items() for b, (lb, y) in unit.items()
        if a < b and la == lb and len(x) == len(y) and x @ y >= 0.98
    ]
    names = [r[0] for r in rows]
    return {k: (sum(k in p for p in links), c, c == k) for k, c in classes(links, names).items()}


def got_vectors(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_near_duplicates(df).collect()}


def test_vectors_equal_brute_force(spark):
    random = np.random.default_rng(11)
    centres = random.normal(size=(40, 24))
    rows = [
        (k, (centres[k % 40] + random.normal(scale=0.17, size=24)).tolist(), int(k % 40 % 3)) for k in range(700)
    ]
    rows += [(900 + k, centres[0].tolist(), 0) for k in range(30)]
    got = got_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    want = brute_vectors(rows)
    assert sum(w[0] for w in want.values()) > 500
    assert got == want


def test_odd_vectors(spark):
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1),
        (7, [1.0, None], 1), (8, [float("nan"), 1.0], 1), (9, [float("inf"), 1.0], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1),
        (12, [1.0, 0.05], 1), (13, [-1.0, 0.0], 1), (14, [1e-30, 0.0], 1), (15, [1e30, 1e28], 1),
    ]
    df = spark.createDataFrame([(*r, 3, "u") for r in rows] + [(1, [1.0, 0.0], 1, 3, "u"), (None, [1.0, 0.0], 1, 3, "u")], VECTORS)
    got = got_vectors(df)
    assert got.pop(None) == (0, None, None)
    assert got == brute_vectors(rows)
    assert got_vectors(spark.createDataFrame([], VECTORS)) == {}


def test_probes_suffice():
    random = np.random.default_rng(5)
    x = random.normal(size=(800, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = fit_index(x, 16.0, 2)
    assert index.subspaces == 2 and [len(c) for c in index.centres] == [4] * 4
    met = 0
    for s in range(2):
        home, row, cell = probes(index, x, s, 0.2)
        visits = set(zip(row.tolist(), cell.tolist(), strict=True))
        part = index.subspace(x, s)
        near = np.linalg.norm(part[:, None] - part[None], axis=2) <= 0.2
        for a, b in zip(*np.nonzero(near), strict=True):
            if home[a] < home[b]:
                met += 1
                assert (a, home[b]) in visits
        assert all(cell > home[row])
    assert met > 100


def test_codes_know_their_error():
    random = np.random.default_rng(6)
    x = random.normal(size=(300, 10))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = fit_index(x, 4.0, 8)
    centre, word, errors = encode(index, x)
    for h in range(len(index.centres)):
        gone = ((index.half(x, h) - index.decode(h, centre[:, h], word[:, h])) ** 2).sum(1)
        assert np.allclose(gone, errors[:, h])
    back = np.concatenate([index.half(x, h) for h in range(len(index.centres))], axis=1)
    assert sorted(index.order.tolist()) == list(range(10)) and np.allclose(back, x[:, index.order])
