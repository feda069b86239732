"""Listing and detail pages by elements, postings as variants, and URL references."""

from urllib.parse import urljoin

from pyspark.sql import functions as F

from lodestone.functions import elements as el
from lodestone.functions import posting, urls
from lodestone.sources import sites

LONG = "You will learn with the team on real projects, and we pay a salary from the first day on in a bright office."


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return frame.select(column.alias("out")).first()["out"]


def pages(spark, rows):
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, source string, html string")


def detail(spark, rows):
    return [r.asDict() for r in sorted(sites.details(pages(spark, rows)).collect(), key=lambda r: r.n)]


PAGE = "<ul id=u><li class='a b'>one<svg>x</svg><li>two<br>three</ul><p>four<p data-k='v w'>five<script>six</script></p><div><span>seven</span> <b hidden>eight</b></div>"


def test_tree(spark):
    nodes = el.elements(F.col("p"))
    got = one(spark, nodes, p=PAGE)
    assert [n["pos"] for n in got] == list(range(len(got))) and one(spark, nodes, p=None) == []
    assert [n["tag"] for n in got if n["tag"][0] != "#"] == ["ul", "li", "svg", "li", "br", "p", "p", "script", "div", "span", "b"]

    def texts(test, within=None, without=None):
        return one(spark, el.let_nodes(nodes, lambda n: F.transform(el.find(n, test, None if within is None else el.first(n, within)), lambda x: el.raw_text(n, x, without))), p=PAGE)

    assert texts(el.mark("li")) == ["onex", "twothree"] and texts(el.mark("li"), without=el.mark("svg")) == ["one", "twothree"]
    assert texts(el.mark(cls="b")) == ["onex"] and texts(el.mark(cls="c")) == [] and texts(el.mark("li", id="u")) == []
    assert texts(el.mark(attr="data-k", part="w")) == texts(el.mark("p", attr="data-k", value="v w")) == ["fivesix"] and texts(el.mark(attr="hidden")) == ["eight"]
    assert texts(el.inside(el.mark("ul"), el.mark("svg"))) == ["x"] and texts(el.inside(el.mark("div"), el.mark("svg"))) == []
    assert texts(el.any_of(el.mark("svg"), el.mark("span"))) == ["x", "seven"] and texts(el.mark("b"), within=el.mark("ul")) == []
    shown = el.let_nodes(nodes, lambda n: el.shown_text(n, el.first(n, el.mark("p", attr="data-k"))))
    assert one(spark, shown, p=PAGE) == "five\n" and one(spark, el.let_nodes(nodes, lambda n: el.shown_text(n, el.first(n, el.mark("ul")))), p=PAGE) == "one\ntwo\nthree\n\n"
    near = el.let_nodes(nodes, lambda n: F.struct(el.following(n, el.first(n, el.mark("span")))["tag"].alias("next"), el.closest(n, el.first(n, el.mark("svg")), el.any_of(el.mark("ul"), el.mark("li")))["tag"].alias("near"), el.following(n, el.first(n, el.mark("div"))).alias("none")))
    assert tuple(one(spark, near, p=PAGE)) == ("b", "li", None)


CASES = ["x", "./x", "../x", "../../../x", "/x/./y/../z", "//h.org/p", "?q=1", "#f", "", "x?y#z", "https://u@B.org:443/a", "HTTPS://B.org/a/..", "g/..", "..", ".", "a//b", "/a b/é", "  /t\n", "http://c.org", "/%7Ex/%2e%2e/y"]


def test_references(spark):
    base = "https://www.a.org/b/c/d?e=f"
    want = {"a//b": "https://www.a.org/b/c/a//b", "//h.org/p": "https://h.org/p", "https://u@B.org:443/a": "https://b.org/a", "HTTPS://B.org/a/..": "https://b.org/", "/a b/é": "https://www.a.org/a%20b/%C3%A9", "  /t\n": "https://www.a.org/t", "http://c.org": "http://c.org/", "/%7Ex/%2e%2e/y": "https://www.a.org/y"}
    frame = spark.createDataFrame([(link,) for link in CASES], "l string")
    got = {r[0]: r[1] for r in frame.select("l", urls.shown(urls.resolve(F.col("l"), F.lit(base)))).collect()}
    assert got == {link: want.get(link, urljoin(base, link)) for link in CASES}


def test_references_without_a_host(spark):
    assert one(spark, urls.resolve(F.col("l"), F.col("b")), l="mailto:a@b.org", b="https://a.org/") is None or one(spark, urls.resolve(F.col("l"), F.col("b")), l="mailto:a@b.org", b="https://a.org/")["scheme"] == "mailto"
    assert one(spark, urls.resolve(F.col("l"), F.col("b")), l="x", b="no base") is None and one(spark, urls.resolve(F.col("l").cast("string"), F.col("b")), l=None, b="https://a.org/") is None


def test_links_of_sites(spark):
    def link(source, href):
        s = sites.SITES[source]
        return one(spark, urls.allowed(F.col("l"), s.origin, s.path, s.aliases), l=href)

    first, second, third = sites.SITES
    assert link(first, "/ro/joburi/qa/1/22?x=1#y") == "https://www.rabota.md/ro/locuri-de-munca/qa/22" and link(first, "../ru/locuri-de-munca/qa/7/") == "https://www.rabota.md/ru/locuri-de-munca/qa/7"
    assert link(second, "https://lucru.md/ro/munca/dev/5/6") == "https://www.lucru.md/ro/lucru/dev/6" and link(second, "//www.lucru.md/ro/lucru/dev/5") == "https://www.lucru.md/ro/lucru/dev/5"
    assert link(third, "job/9") == "https://www.delucru.md/job/9"
    for source, bad in ((second, "https://evil.test/ro/lucru/job/1"), (second, "http://www.lucru.md/ro/lucru/dev/5"), (second, "/ro/lucru"), (third, "/ro/jobs/1"), (second, "javascript:alert(1)")):
        assert link(source, bad) is None


def test_listing(spark):
    first, second, third = sites.SITES
    card = "<div class='vacancyCardItem'><a class='vacancyShowPopup' href='{}'><svg>i</svg><span>{}</span><i class='badge'>NEW</i><b class='salary'>500 EUR</b></a><a href='/ro/companies/7'>{}</a></div>"
    page = card.format("/ro/lucru/a/1", "Junior\n QA", "Alfa SRL") + card.format("https://lucru.md/ro/munca/b/2/3", "Tester", "+373 22") + card.format("/ro/lucru", "All", "x") + card.format("/ro/lucru/c/4", "", "x") + card.format("/ro/lucru/a/1/", "Again", "Beta")
    other = "<div class=job-item><h3 class=job-title><a class=link-job href=/ro/job/5>Operator</a></h3><span class=company-name>Gama</span></div><a class=link-job href=/job/6>Elsewhere</a>"
    got = sites.listing(pages(spark, [(second, page), (third, other), ("unknown", page), (first, None), (first, page)])).collect()
    assert sorted(map(tuple, got)) == [(third, "https://www.delucru.md/ro/job/5", "Operator", "Gama"), (second, "https://www.lucru.md/ro/lucru/a/1", "Again", "Beta"), (second, "https://www.lucru.md/ro/lucru/b/3", "Tester", "N/A")]


def test_details(spark):
    first, second, third = sites.SITES
    script = '<script type="application/ld+json">{}</script>'
    graph = script.format("{not json") + script.format('{"@graph":[{"@type":"WebPage"},[{"@type":["Thing","JobPosting"],"hiringOrganization":{"name":"Good Employer"},"jobLocation":[{"address":{"addressLocality":"Balti"}},{"address":{}},{"address":{"addressLocality":"Cahul"}}],"datePosted":"2026-01-02"}]]}')
    graph += f"<nav>5 years of experience</nav><h1 class='vacancy-title'>Tester</h1><div class='vacancy-content'><h2>Requirements:</h2><p>{LONG}</p><button>Apply</button></div><article>Unrelated blog</article>"
    # a short first element gives way to the next, and all of them to the posting's own text
    chain = f"<div class=vacancy-content>Short</div><div itemprop=description><p>{LONG}</p></div><p class=vacancy-info><a href='/ro/companies/1'>Alfa</a></p>" + "".join(f"<b class=vacancy-summary-item-mobile>{x}</b>" for x in ("Orhei", "1 an", "Full", "Medii", "Oficiu")) + "<i class=vacancy-salary> 900 EUR</i><i data-js-vacancy-content></i><h1>Head</h1>"
    told = script.format(f'[{{"@type":"JobPosting","title":"QA","description":"<p>{LONG}</p><p>End</p>","jobLocationType":"TELECOMMUTE","jobLocation":{{"address":{{"addressLocality":"Soroca"}}}}}}]') + "<div class=vacancy-content>Short</div>"
    rows = "".join(f"<div><span class='text-muted3'>{k}</span><span>{v}</span></div>" for k, v in (("Oraș:", "Ungheni"), ("Salariu:", "700"), ("Studii:", "Medii")))
    labelled = f"<div id='job-description'>Menu {LONG}<div class='content-text'>{LONG}</div></div>{rows}<h1 class='job-item-title'>Op</h1><p class='page-head-detail'><a href='/company/x'>Beta</a></p>"
    bad = [(third, "<body>A blog and a menu only</body>"), (second, None), (second, "<div class=vacancy-content>" + "long " * 6000 + "</div>"), ("unknown", graph)]
    a, b, c, d, *rest = detail(spark, [(second, graph), (first, chain), (second, told), (third, labelled), *bad])
    assert (a["company"], a["title"], a["location"], a["date_posted"], a["error"], a["notice"]) == ("Good Employer", "Tester", "Balti, Cahul", "2026-01-02", None, None) and a["description"] == f"Requirements:\n{LONG}"
    assert b["description"] == LONG and [b[k] for k in ("title", "company", "location", "experience", "schedule", "education", "work_mode", "salary")] == ["Head", "Alfa", "Orhei", "1 an", "Full", "Medii", "Oficiu", "900 EUR"]
    assert (c["description"], c["work_mode"], c["location"], c["company"]) == (f"{LONG}\nEnd", "Remote", "Soroca", "N/A")
    assert d["description"] == LONG and [d[k] for k in ("title", "company", "location", "salary", "education", "schedule")] == ["Op", "Beta", "Ungheni", "700", "Medii", ""]
    assert len(rest) == 4 and [r["error"] for r in rest] == ["description too short", "description too short", "description too long", "unknown source"]


def test_closed(spark):
    first, second, third = sites.SITES
    advert = f"<div class='vacancy-content'>{LONG}</div>"
    dated = '<script type="application/ld+json">{{"@type":"JobPosting","title":"x","description":"y","validThrough":"{}"}}</script>'
    shut = [(second, f"<div class='alert'>Acest anunț nu mai este activ</div>{advert}"), (second, f"<h1>Вакансия закрыта</h1>{advert}"), (second, "<main><p>This job has expired</p></main>"), (third, dated.format("2026-05-01"))]
    still = [f"<p>This job is closed</p>{advert}", f"<div class='alert' hidden>This job has expired</div>{advert}", f"<aside><h2>This job is closed</h2></aside>{advert}", f"<div class='similar-jobs'><h2>This job is closed</h2></div>{advert}", f"<div style='display: none'><h1>This job is closed</h1></div>{advert}"]
    rows = shut + [(second, h) for h in still] + [(third, dated.format("2026-07-01")), (third, dated.format("soon"))]
    got = sites.details(pages(spark, rows)).select("n", sites.closed(F.expr("TIMESTAMP '2026-06-01'")).alias("c")).orderBy("n").collect()
    assert [r.c.closed for r in got] == [True] * 4 + [False] * 7 and got[0].c.reason == "Acest anunț nu mai este activ" and all(r.c.reason is None for r in got[4:])


def test_postings_through_graphs(spark):
    title = el.let_nodes(posting.posting(el.elements(F.col("p"))), lambda v: posting.field(v, "$.title"))
    said = lambda *js: "".join(f'<script type="application/ld+json">{j}</script>' for j in js)
    post = '{"@type":"JobPosting","title":"%s"}'
    assert one(spark, title, p=said(post % "a", post % "b")) == "a" and one(spark, title, p=said("[[[" + post % "deep" + "]]]")) == "deep"
    assert one(spark, title, p=said('{"@graph":{"@type":"JobPosting","title":"in"},"@type":"JobPosting","title":"out"}')) == "out"
    assert one(spark, title, p=said("nonsense", "3", "null", '{"@type":"Event","title":"no"}')) is None and one(spark, title, p="<script>" + post % "x" + "</script>") is None


def test_memory_of_a_batch_of_pages():
    """A batch of 2,000 pages is parsed without its trees standing as Python objects all at once."""
    import tracemalloc

    import pyarrow as pa

    pages_ = pa.array(["<div class='a b' id=x>" + "<p data-k=v>word <b>bold</b></p>" * 40 + "</div>", None] * 1000)
    tracemalloc.start()
    got = el._trees(pages_)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 2000 and len(got[0]) == 202 and len(got[1]) == 0 and most < 16 << 20
