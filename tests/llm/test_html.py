import re
from html import unescape

import pytest

from lodestone.llm import html


def test_template_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html.extract(pages).collect():
        page = source[r.page_id]
        article = page[page.index("<article>") + 9 : page.index("</article>")]
        blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("<article>A &lt;b&gt; &amp;amp; caf&eacute;&#33;<br>x</article>", "A <b> &amp; café! x"),
        ("<article><h1>T</h1><p>one <a href=x>two</a>\n three<p>four<ul><li>a<li>b</ul></article>", "T\none two three\nfour\na\nb"),
        ("<nav>m</nav><main><p>x</p><aside>s</aside><form>f</form><script>p('</p>')</script><p>y</p></main><footer>c</footer>", "x\ny"),
        ('<article><p>x</p><div class="ad-box"><div>in</div>buy</div><p>y</p></article><section id="comments"><p>nice</p></section>', "x\ny"),
        ("<article><p>x</p><!-- <p>no</p> --><style>p{}</style><p>y", "x\ny"),
        ("<ARTICLE><P CLASS=ad>buy<P>x</ARTICLE>", "x"),
        ("just text", "just text"),
    ],
)
def test_small_pages(page, text):
    assert html.main_text(page) == text


def test_unmarked_pages_by_the_distribution():
    menu = "".join(f"<li><a href=/{k}>Item {k}</a>" for k in range(8))
    body = "".join(f"<p>This is paragraph {k} of the story, with enough words that it is text and not a menu.</p>" for k in range(5))
    page = f"<div><ul>{menu}</ul></div><div>{body}</div><div><ul>{menu}</ul></div><p>Short.</p>"
    assert html.main_text(page) == "\n".join(f"This is paragraph {k} of the story, with enough words that it is text and not a menu." for k in range(5))


@pytest.mark.parametrize("middle", ["".join(f"<li><a href=/{k}>Item {k}</a>" for k in range(4)), "<div class=related><p>a<p>b<p>c<p>d</div>", "<div class=ad>" + "<p>Buy this, it is cheap and good, and it is on sale only this week." * 5 + "</div>"])
def test_unmarked_articles_keep_the_parts_around_links_and_adverts(middle):
    parts = [[f"This is paragraph {k} of part {j}, with enough words that it is text and not a menu." for k in range(n)] for j, n in enumerate((5, 2))]
    first, second = ("".join(f"<p>{x}</p>" for x in part) for part in parts)
    assert html.main_text(f"<div>{first}{middle}{second}</div>") == "\n".join(parts[0] + parts[1])


def test_a_short_end_after_a_side_part_is_kept():
    assert html.main_text("<p>" + "Long text. " * 9 + "<div class=ad><p>a<p>b<p>c<p>d</div><p>The end.") == ("Long text. " * 9).strip() + "\nThe end."


_STORY = "This is a long paragraph of the story, with enough words that it is text and not a menu."


@pytest.mark.parametrize(
    "page, text",
    [
        ('<div class="layout with-sidebar"><article><p>x</article></div>', "x"),
        ('<div class="no-comments"><main><p>x</main></div>', "x"),
        ('<div class="social header"><div class="widget"><article><p>x<div class="ad">buy</div></article></div></div>', "x"),
        ('<div class="widget"><main><p>x</main></div><article>teaser</article>', "x\nteaser"),
        ('<article><div class="article-header"><h1>T</h1></div><p>x</article>', "T\nx"),
        ('<article><div class="entry-header"><h1>T</h1></div><p>x</article>', "T\nx"),
        ('<div class="header-row"><article>one</article></div><div class="footer-row"><article>two</article></div>', "one\ntwo"),
        ('<article><p>x</article><section id="comments"><article class="comment">' + _STORY * 2 + "</article></section>", "x"),
        ('<main><article><p>' + _STORY + '</article><div id="comments"><article>' + _STORY * 3 + "</article></div></main>", _STORY),
        ('<div class="widget search"><p>' + _STORY + "<p>" + _STORY + "</div><p>Short.", _STORY + "\n" + _STORY + "\nShort."),
        ('<main><h1>T</h1><div class="widget social"><p>' + _STORY + "</div></main>", "T\n" + _STORY),
        ('<article><p>x<div class="casino-ads"><p>buy</div></article>', "x"),
    ],
)
def test_marks_do_not_hold_around_the_text(page, text):
    assert html.main_text(page) == text


def test_many_nested_marks():
    assert html.main_text("<div class=ad>" * 3000 + "<article>x</article>" * 3000) == "\n".join("x" * 3000)


def test_awkward_rows(spark):
    rows = [(1, "u", None, "t"), (1, "u", None, "t"), (None, None, "<article>" + "<p>x" * 20_000, None), (2, "v", "<" * 5000, ""), (3, "w", "<p" + " a" * 3000, "")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract(d).collect()
    assert len(got) == 5 and max(r.n_chars for r in got) == 2 * 20_000 - 1
    assert html.extract(d.where("false")).count() == 0


def _p(*texts):
    return "".join(f"<p>{x}</p>" for x in texts)


def _story(k):
    return f"Sentence {k} of the story is long enough, by far, to be told from a menu or a button of the page."


_A = [_story(k) for k in range(4)]
_FLAT = "\n".join(_A)
_MENU = "<ul>" + "".join(f"<li><a href=/{k}>Item {k}</a></li>" for k in range(6)) + "</ul>"

#: Pages without <article> and <main>, but for what the last ones test; the text is _FLAT if none is given.
_PAGES = [
    _p(*_A),
    _MENU + _p(*_A) + _MENU,
    f"<nav>{_MENU}</nav><div>{_p(*_A)}</div><footer>Imprint</footer>",
    f'<div id="page" class="site has-sidebar"><div class="content">{_p(*_A)}</div><div class="sidebar">{_p("Weather", "News of the day")}</div></div>',
    f'<div class="layout no-sidebar">{_p(*_A)}</div>',
    f'<div class="layout with-sidebar">{_p(*_A)}<div id="sidebar"><p>Popular today</p></div></div>',
    f"<table><tr><td>{_MENU}</td><td>{_p(*_A)}</td></tr></table>",
    f"<div>{_p(*_A[:2])}</div>{_MENU}<div>{_p(*_A[2:])}</div>",
    f"{_p(*_A[:2])}<div class=ad>{_p('Buy now, cheap and good, only this week, in every shop near you.')}</div>{_p(*_A[2:])}",
    f"{_p(*_A[:2])}<div class=advert><p>Buy one<p>Buy two<p>Buy three<p>Buy four</div>{_p(*_A[2:])}",
    f"{_p(*_A)}<div class=comments>{_p('Nice', 'I do not think so at all, and this is why I say it here.')}</div>",
    f"{_p(*_A)}<section id=comments><div class=comment>{_p(_story(8))}</div></section>",
    f"<form><input><label>Name</label><p>Fill in</p></form>{_p(*_A)}",
    f"<script>var a='<p>no</p>';</script><style>p{{}}</style>{_p(*_A)}<noscript><p>no</p></noscript>",
    f"<div class=cookie-notice><p>We use cookies and so on.</p></div>{_p(*_A)}",
    f"<header>{_MENU}<p>Site name</p></header>{_p(*_A)}<aside><p>aside</p></aside>",
    f"<div class=breadcrumb><a href=/>Home</a> / <a href=/x>X</a></div>{_p(*_A)}",
    f"<body><p>{'<p>'.join(_A)}",
    f"<div><p>{'</div><div><p>'.join(_A)}</div>",
    f"<ul><li>{'<li>'.join(_A)}</ul>",
    f"<b>{_p(*_A)}</b></i></u>",
    f"<div><div><div><div>{_p(*_A)}</div></div>",
    f"<!-- <p>no</p> -->{_p(*_A)}<!-- <p>open",
    f"<div class='share social'><a href=/f>F</a><a href=/t>T</a><p>Share this</p></div>{_p(*_A)}",
    (f"<h1>A title</h1>{_p(*_A)}", "A title\n" + _FLAT),
    (f'<div class="article-header"><h1>A title</h1></div>{_p(*_A)}', "A title\n" + _FLAT),
    (f"{_p(*_A)}<p>Short end.</p>", _FLAT + "\nShort end."),
    (f"{_p(*_A)}{_MENU}<p>Short.</p>", _FLAT),
    (f"<h2>One</h2>{_p(*_A[:2])}<h2>Two</h2>{_p(*_A[2:])}", "One\n" + "\n".join(_A[:2]) + "\nTwo\n" + "\n".join(_A[2:])),
    (f"{_p(*_A)}<pre>a\n  b</pre>", _FLAT + "\na b"),
    (f"<div class=ad>Buy it{_p(*_A)}", _FLAT),
    # Pages that mark an article
    f"<article>{_p(*_A)}</article><p>{_story(9)}</p>",
    f"<article>{_p(*_A)}{_MENU}</article>",
    f"<main><article>{_p(*_A)}</article></main><section><article><p>Teaser one</p></article><article><p>Teaser two</p></article></section>",
    f"<main><article>{_p(*_A)}</article><article><h3><a href=/1>Teaser</a></h3><p>More of it</p></article></main>",
    f"<article>{_p(*_A)}</article><article class=comment>{_p(_story(8))}</article>",
    f"<article>{_p(*_A)}<div class=related><article><p>Related thing</p></article></div></article>",
    f'<article>{_p(*_A[:2])}<div class="ad"><p>Buy it now</p>{_p(*_A[2:])}</article>',
    f"<article><p>Teaser one</p></article><article><p>Teaser two</p></article><div>{_p(*_A)}</div>",
    (f"<main><h1>A title</h1><article>{_p(*_A)}</article></main>", "A title\n" + _FLAT),
]


@pytest.mark.parametrize("case", _PAGES)
def test_hand_written_pages(case):
    page, text = case if isinstance(case, tuple) else (case, _FLAT)
    for before, after in (("", ""), ("<!DOCTYPE html><html><head><title>T</title></head><body>", "</body></html>")):
        if not after or "<!-- <p>open" not in page:
            assert html.main_text(before + page + after) == text


@pytest.mark.parametrize("unit", ["<b>|</i>", "<div class=ad>|x", "<b>|<dt>", "<p><b>|", "<a '|", "<a \"'|", "<li><b>|", "<div>|</span>", "<article>x|", "<td>|", "<article class=comment>x|</article>", "&amp|;", "<div class=ad>x|</div>"])
def test_nested_and_open_markup_in_linear_time(unit):
    import time

    first, second = unit.split("|")
    html.main_text(first * 10 + second * 10)
    n = 500_000 // (len(first) + len(second))
    began = time.process_time()
    html.main_text(first * n + second * n)
    once = time.process_time() - began
    html.main_text(first * 2 * n + second * 2 * n)
    assert time.process_time() - began - once < 3 * once + 0.5 and once < 10


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<article><p><a href=/>Lead of links only</a></p>{_p(*_A)}<p><a href=/x>The last paragraph links</a></p></article>", "Lead of links only\n" + _FLAT + "\nThe last paragraph links"),
        (f"<article>{_p(*_A)}{_MENU}<p>Short end.</p></article>", _FLAT + "\nShort end."),
        (f"<article>{_p('One.', 'Two.', 'Three.', 'Four.', 'Five.', *_A)}</article>", "One.\nTwo.\nThree.\nFour.\nFive.\n" + _FLAT),
        (f'<article>{_p(*_A[:2])}<section class="market-share">{_p(_A[2])}</section><section id="social-history">{_p(_A[3])}</section></article>', _FLAT),
        (f'<article>{_p(*_A)}<div class="share"><p>Share</p><p>Tweet it</p></div></article>', _FLAT),
    ],
)
def test_marked_articles_are_whole(page, text):
    assert html.main_text(page) == text


def test_window_and_surge_decide_on_unmarked_pages():
    verse = [f"Short line {k}" for k in range(6)]
    page = f"<div>{_p(*verse)}</div>{_MENU}<div>{_p(*_A)}</div>"
    assert html.main_text(page) == "\n".join(verse) + "\n" + _FLAT  # half of an average window is enough
    assert html.main_text(page, surge=10**6) == html.main_text(page)
    close = f"<div>{_p('A note.')}</div>{_MENU}<div>{_p(*_A)}</div>"
    assert html.main_text(close) == _FLAT and html.main_text(close, surge=1) == "A note.\n" + _FLAT


def plain_stretches(weighed, window, surge):
    """Stretches by trying every line: from a line that weighs whose window ahead holds a surge, up to where a whole window holds nothing."""
    out, k, n = [], 0, len(weighed)
    while k < n:
        if weighed[k] and sum(weighed[max(0, min(k + window - 1, n - 1) - window + 1) : min(k + window - 1, n - 1) + 1]) >= surge:
            end = k
            while end < n and sum(weighed[max(0, end - window + 1) : end + 1]):
                end += 1
            out += [i for i in range(k, max(i for i in range(k, end) if weighed[i]) + 1)]
            k = end
        k += 1
    return out or list(range(n))


@pytest.mark.parametrize("seed", range(60))
def test_stretches_against_trying_every_line(seed):
    import random

    rng = random.Random(seed)
    lines = [(f"w{k} " + "word " * rng.choice([0, 0, 1, 3, 20]), rng.random() < 0.4) for k in range(rng.randrange(1, 40))]
    page = "".join(f"<p><a href=x>{t}</a></p>" if link else f"<p>{t}</p>" for t, link in lines)
    weighed = [0 if link else len(t.replace(" ", "")) for t, link in lines]
    window, surge = rng.choice([1, 2, 3, 5]), rng.choice([1, 20, 60, 400])
    some = [w for w in weighed if w]
    want = "" if not some else "\n".join(" ".join(lines[k][0].split()) for k in plain_stretches(weighed, window, min(surge, max(1, int(0.25 * window * sum(some) / len(some))))))
    assert html.main_text(page, window, surge) == want
