"""op5: slots decide what is template; alignment stays linear; groups of a large host agree."""

from __future__ import annotations

import random
import time

import pytest

from strokelake.llm import wrappers


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def article(i, notice="", extra=""):
    rng = random.Random(i)
    parts = [f"Title {i} {words(rng, 3)}", *[f"{words(rng, rng.randint(4, 30))} {i}" for _ in range(rng.randint(1, 5))]]
    body = f"<h1>{parts[0]}</h1>" + "".join(f"<p>{x}</p>" for x in parts[1:])
    page = f"<body><nav><ul><li>{words(rng, 1)}</li></ul></nav><article>{notice}{body}{extra}</article><footer>{words(rng, 4)}</footer></body>"
    return page, "\n\n".join(parts)


@pytest.mark.parametrize("notice", ["<div>Read our terms first.</div>", "<p>Read our terms first.</p>"])
def test_constant_notice_in_the_article_is_template(notice):
    made = [article(i, notice) for i in range(30)]
    assert wrappers.extract_group([p for p, _ in made]) == [t for _, t in made]


def test_a_slot_of_its_own_needs_fewer_pages():
    made = [article(i, "<div>Read our terms first.</div>") for i in range(6)]
    assert wrappers.extract_group([p for p, _ in made]) == [t for _, t in made]


def test_notice_without_article_elements():
    made = [article(i, "<p>Read our terms first.</p>") for i in range(30)]
    pages = [p.replace("<article>", "<div>").replace("</article>", "</div>") for p, _ in made]
    assert wrappers.extract_group(pages) == [t for _, t in made]


def test_words_of_sections_and_headings_do_not_decide():
    extra = '<section id="related-work"><h2 id="search">Search {0}</h2><p>Others {0}.</p></section><div class="comments"><p>reader {0}</p></div><div class="ad">buy {0}</div>'
    made = [article(i, extra=extra.format(i)) for i in range(12)]
    assert wrappers.extract_group([p for p, _ in made]) == [f"{t}\n\nSearch {i}\n\nOthers {i}." for i, (_, t) in enumerate(made)]


def test_copies_of_one_page_are_no_template():
    copy = article(1)
    assert wrappers.extract_group([copy[0]] * 50) == [copy[1]] * 50
    near = [copy[0].replace("</footer>", f"{i}</footer>").replace("<li>", f"<li>{i}") for i in range(50)]
    assert wrappers.extract_group(near) == [copy[1]] * 50


def test_all_articles_of_a_page_and_small_hosts():
    page = "<article class='a'><p>one</p></article><div><p>between</p></div><article class='b'><p>two</p></article>"
    assert wrappers.extract_group([page]) == ["one\n\ntwo"]
    same = [f"<article><p>Same words.</p><p>Other {i}</p></article>" for i in range(3)]
    assert wrappers.extract_group(same) == [f"Same words.\n\nOther {i}" for i in range(3)]
    assert wrappers.extract_group([]) == [] and wrappers.extract_group([""]) == [""]


def test_long_irregular_pages_take_linear_time():
    rng = random.Random(5)
    tags = ["p", "div", "blockquote", "li", "h2", "pre", "section"]

    def page(n):
        return "<article>" + "".join(f"<{t}>{i}</{t}>" for i in range(n) for t in [rng.choice(tags)]) + "</article>"

    started = time.monotonic()
    texts = wrappers.extract_group([page(50_000), page(50_000), page(30_000)])
    assert time.monotonic() - started < 30
    assert [t.count("\n\n") + 1 for t in texts] == [50_000, 50_000, 30_000]


def test_alignment_gives_increasing_equal_pairs():
    rng = random.Random(3)
    for n, m, k in [(0, 5, 3), (40, 40, 3), (300, 280, 4), (500, 20, 400), (400, 400, 300)]:
        a, b = [str(rng.randrange(k)) for _ in range(n)], [str(rng.randrange(k)) for _ in range(m)]
        got = wrappers.matches(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
    same = [str(i % 7) for i in range(1000)]
    assert wrappers.matches(same, same) == [(i, i) for i in range(1000)]


def test_wrapper_accepts_all_streams():
    streams = [(wrappers.page_blocks(article(i, extra="<ul><li>x</li><li>y</li></ul>" * (i % 3))[0])[0], 1) for i in range(20)]
    wrapper, places = wrappers.aligned(streams)
    for (tokens, _), place in zip(streams, places):
        assert len(place) == len(tokens) and place == sorted(place)
        for token, at in zip(tokens, place):
            assert token in wrappers.plain(wrapper[at]).split(" ")


def test_a_large_host_agrees_with_one_group(spark, monkeypatch):
    made = [article(i, "<p>Read our terms first.</p>") for i in range(3000)]
    rows = [(i, f"http://big/{i}", p) for i, (p, _) in enumerate(made)] + [(5000 + i, f"http://s{i}/", made[i][0]) for i in range(5)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == t for i, (_, t) in enumerate(made))
    assert wrappers.extract_group([p for p, _ in made]) == [t for _, t in made]
    assert all(got[5000 + i] == f"Read our terms first.\n\n{made[i][1]}" for i in range(5))
