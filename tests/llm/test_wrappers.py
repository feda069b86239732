"""Page shapes with texts written out by hand, wrappers of small sites, and hostile pages."""

import time

import pytest

from lodestone.llm import wrappers
from lodestone.llm.wrappers import Page, Wrapper, expression, extract, fold, infer, lcs, settled

SHAPES = {
    "open head": ("<html><head><title>x</title><body><p>Hello there.</p>", "Hello there."),
    "no markup": ("Just  text\nof two lines", "Just text of two lines"),
    "empty": ("", ""),
    "only a menu": ("<nav><a href=/>Home</a></nav>", ""),
    "article header": ("<article><header><h1>Head</h1></header><p>Body</p><footer>Tags</footer></article>", "Head\n\nBody"),
    "page header": ("<body><header><h1>Site</h1></header><article><h1>T</h1><p>B</p></article></body>", "T\n\nB"),
    "comments as articles": ("<article><p>Text</p><section id='comments'><article class='comment'><p>c1</p></article></section></article>", "Text"),
    "comment list": ("<main><p>Text</p></main><ol class='commentlist'><li>c1</li></ol>", "Text"),
    "form around the page": ("<body><form action='/p.aspx'><h1>T</h1><p>Text</p><input name=q></form></body>", "T\n\nText"),
    "search form": ("<body><form>Search <button>Go</button></form><p>Text of the page itself, which is longer.</p></body>", "Text of the page itself, which is longer."),
    "class that wraps": ("<body class='has-sidebar'><div class='content-with-sidebar'><article><p>Text</p></article></div><div class='sidebar'>s</div></body>", "Text"),
    "wrapper named so": ("<div class='sidebar-left'><article><p>Text</p></article></div>", "Text"),
    "word in a class of text": ("<article><p class='related-work'>Kept</p><p class='notice'>Gone</p></article>", "Kept"),
    "advert": ("<p>A</p><div class='ad-slot'>Buy</div><div class='advert'>Buy</div><ins class='adsbygoogle'>Buy</ins><p>B</p>", "A\n\nB"),
    "cookie notice": ("<div id='cookie-notice'><p>We use</p></div><article>Text</article>", "Text"),
    "scripts": ("<p>A<script>if (a<b) '</p>'</script>B</p><style>p{}</style><noscript>N</noscript>", "AB"),
    "references": ("<p>a &amp; b &#233;&nbsp;c &lt;p&gt;</p>", "a & b é c <p>"),
    "line breaks": ("<p>one<br>two<br/>three</p>", "one two three"),
    "unclosed": ("<article><p>One<p>Two <b>bold<p>Three<ul><li>a<li>b</ul></article>", "One\n\nTwo bold\n\nThree\n\na\n\nb"),
    "table": ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
    "quoted bracket": ("<p title='a > b' data-x=\"<i>\">Text</p>", "Text"),
    "quote in a bare value": ("<p title=it's>Text</p>", "Text"),
    "comment": ("<p>a<!-- > <p>no</p> -->b</p><!-->c", "ab\n\nc"),
    "less-than": ("<p>1 < 2 and 3<4</p>", "1 < 2 and 3<4"),
    "cut tag": ("<p>Text</p><a href='x", "Text"),
    "links": ("<ul><li><a href=1>Home</a></li><li><a href=2>News</a></li><li><a href=3>Shop</a></li></ul><p>A text that is no link.</p>", "A text that is no link."),
    "links in an article": ("<article><p>See:</p><ul><li><a href=1>A</a></li><li><a href=2>B</a></li><li><a href=3>C</a></li></ul></article>", "See:\n\nA\n\nB\n\nC"),
    "upper case": ("<BODY><ARTICLE><H1>T</H1><P>x</P></ARTICLE></BODY>", "T\n\nx"),
    "stray ends": ("</div><p>a</b></p></article>", "a"),
}


@pytest.mark.parametrize("name", SHAPES)
def test_shapes(name):
    page, want = SHAPES[name]
    assert extract(page, None) == want


def site(k: int) -> str:
    """A page without article, header, nav or footer elements; its menu, strap line and foot are the same everywhere."""
    rest = "".join(f"<p>Paragraph {j} of page {k}.</p>" for j in range(k % 4))
    side = f"<div class='k9'><p>Most read: item {k}</p></div>"
    return f"<html><body><div class='x7'><b>Home</b> <b>About us</b></div><div class='x8'><h1>Title {k}</h1><div class='b2'><p>First words of page {k} with more after them.</p>{rest}<p>Rate this story</p></div></div>{side}<div class='z'>All rights reserved</div></body></html>"


def learnt(pages):
    read = [Page(p) for p in pages]
    return Wrapper(settled(infer(read), len(read)))


def test_a_wrapper_finds_the_article_of_a_site_without_tags_for_it():
    pages = [site(k) for k in range(8)]
    wrapper = learnt(pages)
    for k, page in enumerate(pages):
        want = [f"Title {k}", f"First words of page {k} with more after them.", *(f"Paragraph {j} of page {k}." for j in range(k % 4))]
        assert extract(page, wrapper) == "\n\n".join(want)
        assert extract(page, None) != extract(page, wrapper)
    assert extract(site(90), wrapper).startswith("Title 90\n\nFirst words of page 90") and "Rate" not in extract(site(91), wrapper)


def test_groups_and_slots():
    page = lambda k: f"<div><h2>Fixed</h2>{'<dl><dt>a</dt><dd>b</dd></dl>' if k else ''}<ul>{''.join(f'<li>{k}{j}</li>' for j in range(k + 1))}</ul></div>"
    assert expression(infer([Page(page(k)) for k in range(3)])) == "#[div[h2[text] (dl[dt[text] dd[text]])? ul[(li[#])+]]]"
    pairs = "<dl>" + "<dt>a</dt><dd>b</dd>" * 3 + "</dl>"
    assert expression(infer([Page(pairs)])) == "#[dl[(dt[text] dd[text])+]]"


def test_copies_teach_no_template():
    assert settled(infer([Page("<p>same</p><p>text</p>")] * 6), 6) == ""


def test_a_page_of_another_template_falls_back_to_its_own_tags():
    assert extract("<section><p>Other</p></section>", learnt([site(k) for k in range(6)])) == "Other"


def test_fold_and_lcs():
    assert fold(list("xababaty")) == [(0, 1, 1), (1, 2, 2), (5, 1, 1), (6, 1, 1), (7, 1, 1)]
    assert lcs(list("abcbd"), list("xabd")) == [(0, 1), (1, 2), (4, 3)]
    long = [f"l{i % 900}" for i in range(1200)]
    assert len(lcs(["x", *long], [*long, "y"])) == 1200


def test_hostile_pages_take_little_time():
    began = time.time()
    for page in ("<a " * 100_000, "<div>" * 50_000 + "x", "<a href=\"x" * 50_000, "<!--" * 50_000, "<p><b>" * 20_000 + "y", "<script>" * 20_000, "<li>x" * 30_000):
        extract(page, None)
    assert time.time() - began < 20


def test_pages_of_hosts_through_spark(spark):
    rows = [(k, f"http://a.example/{k}", site(k)) for k in range(30)] + [(98, None, "<p>No host</p>"), (99, "http://b.example/", None), (99, "http://b.example/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(pages).collect()}
    assert got[98] == "No host" and got[99] == "" and wrappers.main_text(pages).count() == len(rows)
    assert got[5] == "Title 5\n\nFirst words of page 5 with more after them.\n\nParagraph 0 of page 5."


def test_wrappers_that_are_too_large_to_broadcast_are_joined_salted(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", -1)
    pages = spark.createDataFrame([(k, f"http://a.example/{k}", site(k)) for k in range(9)], "page_id long, url string, html string")
    assert all("Rate" not in r["text"] and r["text"].startswith("Title") for r in wrappers.main_text(pages).collect())
