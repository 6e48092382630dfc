"""Decontamination against alignment of every document with every item."""

import random

import numpy as np
import pyarrow as pa

from harvestgrid.llm.decontaminate import Seeds, align, contaminated, drift, seeds_needed
from harvestgrid.llm.words import word_hashes

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def brute(docs, items):
    found = {}
    for d, text in docs.items():
        for i, item in items.items():
            words = word_hashes(item)
            score = align(words, word_hashes(text))[0] / (2 * len(words))
            if score >= max(0.5, min(1.0, 4 / len(words))) and (len(words) >= 4 or len(words) == len(word_hashes(text))):
                found[d, i] = score
    return found


def got(spark, docs, items):
    rows = contaminated(spark.createDataFrame([*docs.items()], DOCS), spark.createDataFrame([*items.items()], ITEMS))
    return {(r["doc_id"], r["item_id"]): r["score"] for r in rows.collect()}


def filler(pick, n):
    return [f"f{pick.randrange(3000)}" for _ in range(n)]


def test_many_edited_copies_beside_one_exact_copy(spark):
    pick = random.Random(1)
    item = [f"w{k}" for k in range(40)]
    edited = [f"x{k}" if k % 6 == 3 else w for k, w in enumerate(item)]
    docs = {0: " ".join(filler(pick, 30) + item)}
    docs |= {k: " ".join(filler(pick, 20) + edited + filler(pick, 9)) for k in range(1, 60)}
    docs |= {k: docs[1] for k in range(60, 120)}
    items = {7: " ".join(item)}
    assert got(spark, docs, items) == brute(docs, items) and len(brute(docs, items)) == 120


def test_every_reworded_copy_that_scores_enough_is_found(spark):
    pick = random.Random(2)
    common = ["the", "of", "a", "in", "to"]
    items = {k: " ".join(pick.choice(common) if pick.random() < 0.4 else f"w{pick.randrange(400)}" for _ in range(n)) for k, n in enumerate((4, 5, 7, 12, 20, 33, 40, 90))}
    docs = {}
    for item in items.values():
        words = item.split()
        copies = [
            [f"x{k}" if k % 4 == 3 else w for k, w in enumerate(words)],
            [f"x{k}" if k % 3 == 2 else w for k, w in enumerate(words)],
            [w for k, w in enumerate(words) if k % 4 != 3],
            [x for k, w in enumerate(words) for x in (w, f"x{k}")],
        ]
        for rate in (0.15, 0.25, 0.3, 0.35, 0.4):
            copy = []
            for w in words:
                turn = pick.random() / rate
                copy += [w] if turn > 1 else [f"x{pick.randrange(99)}"] if turn > 0.6 else [w, pick.choice(common)] if turn > 0.3 else []
            copies.append(copy)
        for copy in copies:
            docs[len(docs)] = " ".join(filler(pick, pick.randrange(150)) + copy + pick.choices(common, k=5) + filler(pick, 20))
    want = brute(docs, items)
    assert got(spark, docs, items) == want and 50 < len(want)


def test_short_items(spark):
    """Whole matches count from four words on; shorter items count only as a document's whole text."""
    pick = random.Random(3)
    items = {0: "solitary", 1: "two words", 2: "three little words", 3: "a b a b", 4: "a a a", 5: "four words in line", 6: "one two three four five six"}
    docs = {0: " ".join([*filler(pick, 200), "Solitary", *filler(pick, 50)]), 1: " ".join([*filler(pick, 99), "two", "words"])}
    docs |= {2: " ".join([*filler(pick, 99), "three x little", *filler(pick, 9)]), 3: "three little", 4: "a " * 3000, 5: " ".join(filler(pick, 99))}
    docs |= {6: "Solitary!", 7: "two, words", 8: "a a a", 9: " ".join([*filler(pick, 99), "four words in line", *filler(pick, 9)]), 10: "x a b a b y"}
    docs |= {11: "x four words of line", 12: "x one two three four nine six y", 13: "x one two nine four nine six y", 14: ""}
    want = brute(docs, items)
    assert got(spark, docs, items) == want
    assert set(want) == {(6, 0), (7, 1), (8, 4), (9, 5), (10, 3), (12, 6)}


def test_a_benchmark_of_common_words_leaves_the_corpus(spark, tables):
    rows = {r["doc_id"]: r["text"] for r in tables("documents").collect()}
    assert got(spark, rows, {0: "the", 1: "of", 2: "the and", 3: "in the of"}) == {}


def test_many_and_very_long_items(spark):
    pick = random.Random(5)
    items = {k: " ".join(filler(pick, 12)) for k in range(3000)} | {3000: " ".join(filler(pick, 4000))}
    docs = {k: f"{' '.join(filler(pick, 50))} {items[k * 7]} {' '.join(filler(pick, 5))}" for k in range(40)}
    docs[40] = items[3000]
    found = got(spark, docs, items)
    assert {(k, k * 7) for k in range(40)} | {(40, 3000)} <= set(found)
    assert all(score == 1.0 for (d, i), score in found.items() if i == (d * 7 if d < 40 else 3000))


def test_seeds_of_an_alignment_are_as_many_as_said():
    random_ = np.random.default_rng(4)
    for least in (0.5, 0.7):
        for _ in range(3000):
            size = int(random_.integers(4, 30))
            copy, at, penalty, matched = [], [], 0, 0
            for k in range(size):
                turn = random_.random()
                if turn < 0.15:
                    copy.append(-1)
                elif turn > 0.25:
                    at.append((k, len(copy)))
                    copy.append(k)
                    copy += [-1] * int(random_.integers(0, 3) * (random_.random() < 0.4))
            matched = len(at)
            gaps = [(b[0] - a[0], b[1] - a[1]) for a, b in zip(at, at[1:], strict=False)]
            penalty = sum(max(i, d) - 1 for i, d in gaps)
            if 2 * matched - penalty >= 2 * least * size:
                assert sum(i == 1 and d <= 2 for i, d in gaps) >= seeds_needed(size, least)
                assert max(j - i for i, j in at) - min(j - i for i, j in at) < drift(size, least)


def test_no_count_comes_from_a_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"common start w{k} x{k} y{k} z{k} common end") for k in range(40)], DOCS)
    items = spark.createDataFrame([(k, f"common start w{k} x{k} y{k} z{k} common end") for k in range(0, 40, 2)], ITEMS)

    def refused(*args, **kwargs):
        raise AssertionError("a sample was drawn")

    monkeypatch.setattr(type(docs), "sample", refused)
    found = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, items).where("score = 1").collect()}
    assert found == {(k, k) for k in range(0, 40, 2)}


def test_first_look_leaves_out_what_most_items_have():
    ids = pa.array(range(20))
    seeds = Seeds.of(ids, [f"common start of a{k} b{k} c{k} d{k} e{k} f{k} g{k} h{k}" for k in range(20)], 0.5)
    seeds.rank()
    shared = {int(k) for k in np.flatnonzero(np.bincount(seeds.key) == 20)}
    looked = np.flatnonzero(np.diff(seeds.look_first))
    assert len(shared) == 2 and not shared & set(looked.tolist())
