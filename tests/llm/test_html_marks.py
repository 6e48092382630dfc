"""Marks, foreign elements and languages of web pages."""

import time

from harvestgrid.llm.html_text import main_text

TEXT = "The ship went over the sea and it came to the land that was far away from us."


def test_state_names_do_not_remove_the_article():
    for mark in ("class='site has-sidebar'", "class='header-fixed'", "class=with-comments", "data-role='header'", "data-id=search", "id=sidebar", "class='widget x'"):
        assert main_text(f"<body><div {mark}><article><p>{TEXT}</p></article></div></body>") == TEXT, mark
    assert main_text(f"<form id=f><main><p>{TEXT}</p></main></form>") == TEXT


def test_named_parts_stay_out():
    for mark in ("class='comment-list'", "class='cookie-notice x'", "id=site-header", "role=navigation", "class=ad"):
        assert main_text(f"<article><p>{TEXT}</p><div {mark}><p>Not this.</p><article>Nor this</article></div></article>") == TEXT, mark
    assert main_text(f"<article class=comment><p>{TEXT}</p></article><aside><article>{TEXT}</article></aside>") == ""


def test_foreign_elements():
    assert main_text(f"<article><svg width='1'/><p>{TEXT}</p><svg><text>no</text></svg><p>Tail</p></article>") == f"{TEXT}\nTail"
    assert main_text("<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</p></article>") == "So x=2 holds"


def test_languages_without_stop_words():
    russian = "Корабль вышел в море и долго шёл вдоль берега под ровным ветром. " * 4
    for head in ("<html lang=ru>", "<html>", ""):
        assert main_text(f"{head}<body><div><p>{russian}</p><p><a href=a>{russian}</a></p></div>") == russian.strip(), head
    assert main_text(f"<html lang='en'><body><p>{'buy now ' * 60}</p></body></html>") == ""


def test_inline_parts_that_are_out_leave_no_text():
    inside = "Text. <span class='advert'>BUY NOW</span> and <button>CLICK</button>more <select><option>ONE<option>TWO</select>"
    assert main_text(f"<article><p>{inside}</p></article>") == "Text. and more"
    assert main_text("<article><div>a<span class=ad><p>no</p></span></div><p>b</p></article>") == "a\nb"
    assert main_text("<article><p><label>Name</label></p><p>b</p></article>") == "b"


def test_linked_blocks_of_an_article_stay():
    page = f"<article><p>{TEXT}</p><p><a href=x>All linked</a></p><ul><li><a href=y>One</a><li><a href=z>Two</a></ul></article>"
    assert main_text(page) == f"{TEXT}\nAll linked\nOne\nTwo"


def test_compound_names():
    for mark in ("comment-respond", "post-comments", "sidebar-left", "site-header-main", "adBanner", "SidebarRight"):
        assert main_text(f"<article><p>{TEXT}</p><div class='{mark}'><p>No.</p></div></article>") == TEXT, mark
    for mark in ("has-sidebar", "no-sidebar", "sidebar-layout", "page-with-comments", "adFree", "header-fixed", "thread"):
        assert main_text(f"<article><div class='{mark}'><p>{TEXT}</p></div></article>") == TEXT, mark


def test_unclosed_and_deep_elements_take_no_square_of_time():
    start = time.perf_counter()
    assert main_text("<article><p>" + "<b><i>word</i>" * 100_000).count("word") == 100_000
    assert main_text("<article><ul><li><ul>" + "<b>" * 50_000 + "<li>x</li>" * 50_000).count("x") == 50_000
    assert main_text("<article>" + "<div>" * 50_000 + TEXT + "</div>" * 50_000) == TEXT
    assert time.perf_counter() - start < 30
