"""URL filter, language identification, HTML extraction and quality classifier."""

import collections
import zlib

import pytest
from pyspark.sql import functions as F

from harvestgrid.llm.html_text import extract_main_text, main_text
from harvestgrid.llm.language_id import four_grams, identify_languages
from harvestgrid.llm.quality import LABELLERS, classify_quality, fit_accuracies
from harvestgrid.llm.url_filter import RULES, url_verdicts

PAGES = "page_id long, url string, html string, host string, score int, rule string"


def parts(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    return host, tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]


def rule_of(host, path):
    fits = []
    for said, rule in RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            fits.append((len(rule), rule, said))
    return max(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "no scheme", "http://", "http://a.com", "HTTP://A.COM/x?y=1", "http://WWW.example.com/en/1", "https://x.www.example.com/en/",
    "http://badexample.com/en/1", "https://example.com/en", "ftp://b.net/es/9#top", "http://b.net/fr/", "http://c.org/en/1?a=1&b=2", "a://É.Com/q",
    "http://d.org", "http://user@e.com:80/en/?q=http://z.net/es/", "x://y://z.com/", "http://c.org/" + "long/" * 5000,
]


def test_rules_equal_plain_reading(spark, tables):
    rows = [(k, u, None, "x", 1, "r") for k, u in enumerate(URLS)] * 2
    for df in (spark.createDataFrame(rows, PAGES), tables("pages")):
        urls = {r["page_id"]: r["url"] for r in df.collect()}
        got = url_verdicts(df).collect()
        assert len(got) == df.count()
        for r in got:
            host, path = parts(urls[r["page_id"]])
            rule, said = rule_of(host, path)
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule), urls[r["page_id"]]
            assert r["verdict"] == said if said else r["verdict"] == ("block" if r["score"] >= 0.5 else "allow")


def test_url_filter_without_labels(spark):
    assert url_verdicts(spark.createDataFrame([], PAGES)).count() == 0
    one = spark.createDataFrame([(1, "http://x.org/a", None, "", 0, "")], PAGES)
    assert url_verdicts(one).first()["verdict"] == "allow"
    two = spark.createDataFrame([(1, "http://x.org/a", None, "", 0, ""), (2, "http://x.net/es/a", None, "", 0, "")], PAGES)
    assert {r["verdict"] for r in url_verdicts(two).collect()} == {"block"}


def test_url_filter_learns(spark):
    rows = [(k, f"http://h{k}.{'net/es' if k % 2 else 'com'}/{'9' * 30 if k % 2 else 'abc'}", None, "", 0, "") for k in range(400)]
    rows += [(1000 + k, f"http://h{k}.org/{'9' * 33 if k % 2 else 'abd'}", None, "", 0, "") for k in range(40)]
    got = {r["page_id"]: r["verdict"] for r in url_verdicts(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[1000 + k] == ("block" if k % 2 else "allow") for k in range(40))


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_language_of_held_out_documents(tables):
    docs = tables("documents")
    trains = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0
    rows = {r["doc_id"]: r for r in docs.collect()}
    got = identify_languages(docs, trains).collect()
    assert len(got) == len(rows) and all(r["trains"] != held_out(r["id"]) for r in got)
    test = [r for r in got if not r["trains"]]
    assert sum(r["lang_pred"] == rows[r["id"]]["lang"] for r in test) >= 0.95 * len(test)
    assert all(0 <= r["score"] <= 1 for r in got) and sum(r["rejected"] for r in got) <= 0.01 * len(got)


DOCS = "doc_id long, text string, lang string, size int, best string, score string, keep int"


def test_odd_languages(spark):
    english = "the cat and the dog were in the house with this and that "
    german = "der hund und die katze waren nicht in dem haus und das "
    rows = [(k, (english, german)[k % 2] * (1 + k % 3), ("en", "de")[k % 2]) for k in range(40)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "123 ... 456", None), (103, german, None), (104, "ขอบคุณมากครับ" * 30, None), (None, english, None)]
    rows += [(105, "x", None), (106, english * 5000, None), (0, english, "en")]
    df = spark.createDataFrame([(*r, 1, "b", "s", 0) for r in rows], DOCS)
    got = identify_languages(df, F.col("lang").isNotNull()).collect()
    assert len(got) == len(rows)
    by = {r["id"]: r for r in got}
    for k in (100, 101, 102):
        assert (by[k]["lang_pred"], by[k]["score"], by[k]["rejected"]) == ("und", 0.0, True)
    assert by[103]["lang_pred"] == "de" and by[None]["lang_pred"] == "en" and by[106]["lang_pred"] == "en"
    assert by[104]["rejected"] and not by[103]["rejected"] and by[105]["lang_pred"] in ("en", "de")
    for source in (df.where("lang IS NULL"), df.limit(0)):
        assert all(r["lang_pred"] == "und" for r in identify_languages(source, F.col("lang").isNotNull()).collect())


def test_probabilities_sum_to_one(spark):
    from harvestgrid.llm.language_id import train_model

    text = "abab abba baba caba "
    model = train_model(spark.createDataFrame([("en", text), ("de", "cacc bacb"), (None, "zz"), ("fr", None)], "lang string, text string"))
    letters = [ord(c) for c in " abc"]
    context = int(four_grams("ab")[0]) & 0xFFFFFFFFFFFF
    import numpy as np

    grams = np.array([(context << 16 | c) & 0xFFFFFFFFFFFFFFFF for c in letters], np.uint64)
    total = np.exp(model.log_probabilities(grams)).sum(0)
    assert model.languages == ["de", "en"] and (total < 1.001).all() and (total > 0.7).all()
    with pytest.raises(KeyError):
        model.tables["p", 5]


ARTICLE = "The first part of this text is about the sea and the land that lies in it, as it was told to us by them."


def test_blocks_of_a_page():
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav>
    <div class="cookie-notice">We use the cookies that are in the box and you are with us.</div>
    <article><h1>A &amp; B</h1><p>One  two\nthree<br>four<p class='x'>Five &lt;b&gt; <b>six</b>&nbsp;<script>var a='</p>';</script>
    <div id="comments"><p>I think this is the best of all that was in it.</p></div><form><input>name</form><!-- <p>no</p> --></article>
    <aside>See also the other pages that we have on this.</aside><footer>&copy; us</footer></body>"""
    assert main_text(page) == "A & B\nOne two three four\nFive <b> six"


def test_blocks_without_an_article_take_stop_words_and_neighbours():
    page = f"<div><p>{ARTICLE * 3}</p><p>Short one</p><p>{ARTICLE * 3}</p></div><div><p><a href=a>{ARTICLE}</a></p><p>buy buy buy {'now ' * 60}</p><p>Tail</p></div>"
    assert main_text(page) == "\n".join([" ".join((ARTICLE * 3).split()), "Short one", " ".join((ARTICLE * 3).split())])
    assert main_text("<p>only</p>") == "" and main_text(None) == "" and main_text("<<<>>&&") == ""


def test_html_rows(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>"), (1, "u", f"<article>{ARTICLE}</article>"), (None, None, None), (2, "v", ""), (3, "w", "<article><p>é" + "a b " * 200_000)]
    got = extract_main_text(spark.createDataFrame([(*r, "h", 1, "r") for r in rows], PAGES)).collect()
    assert [(r["page_id"], r["url"], r["n_chars"]) for r in got] == [(1, "u", len(ARTICLE))] * 2 + [(None, None, 0), (2, "v", 0), (3, "w", 800_000)]
    assert got[2]["text"] == "" and extract_main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_accuracies_are_found():
    import numpy as np

    random = np.random.default_rng(1)
    good = random.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.8, 0.7])
    said = np.where(random.random((20_000, 4)) < right, good[:, None], ~good[:, None]).astype(int)
    said[random.random(said.shape) < 0.2] = 2
    count = collections.Counter(map(tuple, said.tolist()))
    patterns = np.array(list(count))
    share, rates, posterior = fit_accuracies(patterns, np.array(list(count.values()), float))
    assert abs(share - 0.8) < 0.05
    assert np.abs(rates[1, :, 1] - right).max() < 0.06 and np.abs(rates[0, :, 0] - right).max() < 0.1
    verdict = dict(zip(map(tuple, patterns.tolist()), posterior > 0.5, strict=True))
    assert np.mean([verdict[tuple(s)] == g for s, g in zip(said.tolist(), good, strict=True)]) > 0.93


def test_quality_keeps_clean_documents(spark, tables):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r["id"]: r["keep"] for r in classify_quality(docs).collect()}
    labels = labels.collect()
    clean = [got[r["doc_id"]] for r in labels if r["quality"] == 1 and r["doc_id"] in got]
    junk = [got[r["doc_id"]] for r in labels if r["quality"] == 0 and r["doc_id"] in got]
    assert all(clean) and junk.count(False) >= 0.7 * len(junk)


def test_odd_quality(spark):
    good = "the house of the man is in the town and it was old. "
    rows = [(k, good * (k % 4 + 1)) for k in range(30)] + [(50 + k, "BUY!! NOW!! $$$ %%% " * 20) for k in range(6)]
    rows += [(90, None), (91, ""), (92, "  \n"), (None, good), (93, good * 3000), (0, good)]
    df = spark.createDataFrame([(*r, "en", 1, "b", "s", 0) for r in rows], DOCS)
    got = classify_quality(df, carry=True)
    kept = {r["id"]: (r["keep"], r["score"]) for r in got.collect()}
    assert got.count() == len(rows) and got.select("row.*").columns == df.columns
    assert all(kept[k] == (False, 0.0) for k in (90, 91, 92))
    assert kept[None][0] and kept[93][0] and all(kept[k][0] for k in range(30)) and not any(kept[50 + k][0] for k in range(6))
    assert classify_quality(df.limit(0)).count() == 0 and len(LABELLERS) == 8
