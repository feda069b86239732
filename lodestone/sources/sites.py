"""Listing and detail pages of the known sites: which elements hold a title, an employer, a description and the other fields."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import posting as ld
from ..functions.elements import NODE, TEXT, Test, ancestors, any_of, apart, closest, elements, find, first, following, inside, mark, raw_text, shown_text, under
from ..functions.html import CLOSED, text_of
from ..functions.text import clean, let, normalize, valid_company
from ..functions.urls import allowed
from .shared import arrow_batches

SHORT, LONG, TITLE = 100, 25_000, 240


@dataclass(frozen=True)
class Site:
    """Where a site's pages hold what.

    ``content`` is tried in its order until one has SHORT characters; a page
    with a ``block`` is an advert. ``heading`` is the title of a detail page;
    where ``headed`` is on it, its first h1 will do. Fields stand beside labels,
    or in a summary in a fixed order.
    """

    origin: str
    path: str
    link: Test
    content: tuple[Test, ...]
    block: Test
    heading: Test
    employer: Test
    aliases: tuple[tuple[str, str], ...] = ()
    headed: Test | None = None
    label: Test | None = None
    summary: Test | None = None
    pay: Test | None = None


# The sites, their addresses and paths, and the marks of their elements.
CARD = any_of(mark(cls="job-item"), mark(cls="vacancyCardItem"), mark(cls="previewCard"), mark("div", attr="data-vacancy-id"))
CARD_COMPANY = any_of(mark("a", attr="href", part="/compan"), mark(cls="company-name"), mark(cls="preview-card-company"))
IN_TITLE = any_of(mark("svg"), mark(cls="badge"), mark(cls="salary"))
ALIASES = ((r"/joburi/([^/]+)/\d+/(\d+)$", "/locuri-de-munca/$1/$2"), (r"/munca/([^/]+)/\d+/(\d+)$", "/lucru/$1/$2"))
_MARKED = mark(attr="data-js-vacancy-content")
_POPUP = {
    "link": mark("a", cls="vacancyShowPopup"), "content": (mark(cls="vacancy-content"), mark(cls="vacancy-description"), _MARKED, mark(attr="itemprop", value="description")), "block": any_of(mark(cls="vacancy-content"), mark(cls="vacancy-description"), _MARKED), "heading": mark(cls="vacancy-title"),
    "employer": inside(mark(cls="vacancy-info"), mark("a", attr="href", part="/companies/")), "aliases": ALIASES, "headed": _MARKED, "summary": mark(cls="vacancy-summary-item-mobile"), "pay": mark(cls="vacancy-salary"),
}
SITES = {
    "Rabota.md": Site("https://www.rabota.md", r"^/(?:ro|ru)/(?:locuri-de-munca|joburi)/[^/]+/\d+(?:/\d+)?/?$", **_POPUP),
    "Lucru.md": Site("https://www.lucru.md", r"^/(?:ro|ru)/(?:lucru|munca)/[^/]+/\d+(?:/\d+)?/?$", **_POPUP),
    "Delucru.md": Site(
        "https://www.delucru.md", r"^/(?:ro/)?job/\d+/?$", link=inside(mark(cls="job-title"), mark("a", cls="link-job")),
        content=(inside(mark(id="job-description"), mark(cls="content-text")), mark(id="job-description"), mark(attr="itemprop", value="description")),
        block=mark(id="job-description"), heading=mark(cls="job-item-title"), employer=inside(mark(cls="page-head-detail"), mark("a", attr="href", part="/company/")), label=mark(cls="text-muted3"),
    ),
}
#: Pages of no known site: any of the marks, else the page's main part; the title is that of the document.
GENERIC = Site(
    "https://localhost", "^$", link=mark("a"), content=(*_POPUP["content"], mark(id="job-description"), mark("main"), mark("article")), block=any_of(_POPUP["block"], mark(id="job-description")),
    heading=mark("title"), employer=mark(cls="company-name"), label=mark(cls="text-muted3"), summary=_POPUP["summary"], pay=_POPUP["pay"],
)
# Where a stored page of a site has its advert, where that ends, and what only pages without it hold.
STORED = {"Delucru.md": ("descrierea pozitiei vacante", r"trimite cv|despre companie|locuri de munca similare", r"cititi in intregime|top angajator|generator cv online")}
LABELS = {"oras:": "location", "locatie:": "work_mode", "program de lucru:": "schedule", "salariu:": "salary", "studii:": "education", "experienta:": "experience"}
SUMMARY = ("location", "experience", "schedule", "education", "work_mode")
STATUS = any_of(mark(attr="role", value="alert"), *(mark(cls=c) for c in ("alert", "vacancy-status", "job-status", "job-expired", "vacancy-not-found")), mark("h1"), mark("h2"))
ASIDE = any_of(*(mark(t) for t in ("script", "style", "nav", "footer", "aside")), *(mark(cls=c) for c in ("similar-jobs", "related-jobs", "recommended-jobs")))
HIDDEN = any_of(mark(attr="hidden"), mark(attr="aria-hidden", value="true"), mark(cls="hidden"), mark(cls="uk-hidden"), mark(attr="style", part="display: none"), mark(attr="style", part="display:none"))


def line(text: Column) -> Column:
    """The text on one line, with single spaces."""
    return F.regexp_replace(clean(text), r"\s+", " ")


def _by_source(source: Column, sites: dict[str, Site], value, alike=lambda site: site) -> Column:
    """``value(site)`` of the row's site, worked out alike for sites that are ``alike``; null for unknown ones."""
    groups: dict = {}
    for name, site in sites.items():
        groups.setdefault(alike(site), []).append(name)
    return reduce(lambda out, names: out.when(source.isin(names), value(sites[names[0]])), groups.values(), F).when(F.lit(False), None)


def listing(pages: DataFrame, sites: dict[str, Site] = SITES, source_col: str = "source", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """source, link, title and company of the adverts on each stored listing page, and the columns of the page that are to be kept.

    Titles are the links' texts without icons, badges and pay. The company is
    that of the card around the link, or N/A. Links off the site and titles of
    over TITLE characters or none are left out; a link that a page repeats is
    one row, the last. Null pages and unknown sources have none.
    """

    def advert(nodes: Column, site: Site) -> Column:
        def one(a: Column) -> Column:
            card = closest(nodes, a, CARD)
            company = valid_company(line(raw_text(nodes, first(nodes, CARD_COMPANY, card))))
            link = allowed(a["attrs"]["href"], site.origin, site.path, site.aliases)
            return F.struct(a["pos"].alias("pos"), link.alias("link"), line(raw_text(nodes, a, IN_TITLE)).alias("title"), F.coalesce(company, F.lit("N/A")).alias("company"))

        return F.transform(find(nodes, site.link), one)

    arrow_batches(pages.sparkSession)
    parsed = pages.select(F.col(source_col).alias("__source"), *keep, elements(F.col(html_col)).alias("__nodes"))
    found = _by_source(F.col("__source"), sites, lambda s: advert(F.col("__nodes"), s))
    good = F.filter(found, lambda x: x["link"].isNotNull() & F.length(x["title"]).between(1, TITLE))
    last = let(good, lambda all_: F.filter(all_, lambda x: ~F.exists(all_, lambda y: (y["link"] == x["link"]) & (y["pos"] > x["pos"]))))
    rows = parsed.select(*keep, F.col("__source").alias("source"), F.explode(last).alias("__x"))
    return rows.select("source", "__x.link", "__x.title", "__x.company", *keep)


DETAILS = ("title", "description", "company", "location", "work_mode", "schedule", "salary", "education", "experience", "date_posted", "valid_through", "notice", "error")


def _labelled(nodes: Column, label: Test) -> Column:
    """map<field, text>: what stands beside known labels, or last in what holds them; of fields that are named twice the last counts."""

    def beside(node: Column) -> Column:
        inner = F.filter(under(nodes, F.try_element_at(ancestors(nodes, node), F.lit(-1))), lambda n: ~F.startswith(n["tag"], F.lit("#")))
        # the last child starts after all that lies in the others
        last = F.aggregate(inner, F.lit(None).cast(NODE), lambda held, n: F.when(held.isNull() | (n["pos"] > held["last"]), n).otherwise(held))
        value = let(clean(raw_text(nodes, following(nodes, node))), lambda v: F.when(v != "", v).otherwise(clean(raw_text(nodes, last))))
        return F.struct(named[F.trim(normalize(raw_text(nodes, node)))].alias("key"), value.alias("value"))

    named = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    pairs = F.filter(F.transform(find(nodes, label), beside), lambda x: x["key"].isNotNull())
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != x["key"]), F.create_map(x["key"], x["value"])))


def _summed(nodes: Column, site: Site) -> Column:
    """map<field, text> of a summary's entries in their fixed order, and of the pay."""
    texts = F.transform(find(nodes, site.summary), lambda n: clean(raw_text(nodes, n)))
    entries = let(texts, lambda t: F.map_from_entries(F.slice(F.arrays_zip(F.array(*map(F.lit, SUMMARY)), t), F.lit(1), F.least(F.size(t), F.lit(len(SUMMARY))))))
    return F.map_concat(entries, F.create_map(F.lit("salary"), clean(raw_text(nodes, first(nodes, site.pay)))))


def _fields(nodes: Column, site: Site) -> Column:
    """map<field, text>; a label's text comes before one of the summary."""
    if site.label is None:
        return _summed(nodes, site)
    if site.summary is None:
        return _labelled(nodes, site.label)
    return F.map_zip_with(_labelled(nodes, site.label), _summed(nodes, site), lambda k, a, b: F.coalesce(a, b))


def _read(nodes: Column, post: Column, site: Site) -> Column:
    """What a detail page says, but for its posting's description, which may be markup of its own."""
    bodies = F.array(*[clean(shown_text(nodes, first(nodes, t))) for t in site.content])
    body = let(F.filter(bodies, lambda b: F.length(b) > 0), lambda held: F.coalesce(F.get(F.filter(held, lambda b: F.length(b) >= SHORT), F.lit(0)), F.try_element_at(held, F.lit(-1)), F.lit("")))
    spare = F.lit("") if site.headed is None else F.when(F.size(find(nodes, site.headed)) > 0, line(raw_text(nodes, first(nodes, mark("h1"))))).otherwise("")
    heading = let(line(raw_text(nodes, first(nodes, site.heading))), lambda h: F.when(h != "", h).otherwise(spare))
    company = F.coalesce(valid_company(ld.field(post, "$.hiringOrganization.name")), valid_company(line(raw_text(nodes, first(nodes, site.employer)))), F.lit("N/A"))
    def notice(seen: Column) -> Column:
        """The first status that says so, among what a visitor sees outside menus and recommendations."""
        text = lambda n: clean(raw_text(seen, n))
        signals = F.transform(F.filter(seen, lambda n: STATUS(n, seen)), text)
        main = F.coalesce(first(seen, mark("main")), first(seen, mark("body")))
        rest = F.when(main.isNotNull(), text(main)).otherwise(clean(F.array_join(F.transform(F.filter(seen, lambda n: n["tag"] == TEXT), lambda n: n["text"]), "")))
        bare = ~F.exists(seen, lambda n: site.block(n, seen)) & ld.field(post, "$.description").isNull()
        signals = F.concat(signals, F.when(bare, F.array(F.substring(rest, 1, 3000))).otherwise(F.array().cast("array<string>")))
        return F.substring(F.get(F.filter(signals, lambda s: normalize(s).rlike(CLOSED)), F.lit(0)), 1, 300)

    # entries keep their places in the array, so that slices still hold: what is hidden loses its name and text
    blank = lambda n: n.withField("tag", F.lit("#gone")).withField("text", F.lit(None).cast("string"))
    seen = let(find(nodes, any_of(ASIDE, HIDDEN)), lambda gone: F.transform(nodes, lambda n: F.when(apart(n, gone), n).otherwise(blank(n))))
    return F.struct(body.alias("__body"), heading.alias("__heading"), company.alias("__company"), _fields(nodes, site).alias("__fields"), let(seen, notice).alias("__notice"))


def details(pages: DataFrame, sites: dict[str, Site] = SITES, source_col: str = "source", html_col: str = "html") -> DataFrame:
    """The rows with the columns of DETAILS, read from each stored detail page.

    The description is the first content element of SHORT characters, else the
    posting's; under SHORT or over LONG characters there is an error, and what
    was found is not to be stored. A posting's title and employer come before those of the page,
    and its places stand in for a missing location. ``notice`` is the first
    visible status that says the advert is closed; on pages without content and
    posting, the start of the page counts as one. Texts without a value are
    empty; dates are null. An unknown source is an error.
    """
    arrow_batches(pages.sparkSession)
    taken = [c for c in pages.columns if c not in DETAILS]
    parsed = pages.withColumn("__nodes", elements(F.col(html_col))).withColumn("__post", ld.posting(F.col("__nodes")))
    read = _by_source(F.col(source_col), sites, lambda s: _read(F.col("__nodes"), F.col("__post"), s), lambda s: (s.content, s.label, s.summary))
    # a generator, so that what is read from the tree is worked out once, whatever refers to it
    read = parsed.select(*taken, "__post", F.inline_outer(F.array(read)))
    told = F.when(F.length("__body") < SHORT, ld.field(F.col("__post"), "$.description"))
    read = read.withColumn("__told", clean(text_of(told)))
    body = F.when((F.length("__body") >= SHORT) | (F.length("__told") == 0), F.col("__body")).otherwise(F.col("__told"))
    error = F.when(F.col("__body").isNull(), "unknown source").when(F.length(body) < SHORT, "description too short").when(F.length(body) > LONG, "description too long")
    post, said = F.col("__post"), lambda k: F.coalesce(F.col("__fields")[k], F.lit(""))
    title = F.coalesce(ld.field(post, "$.title"), F.col("__heading"))
    return read.select(
        *taken, line(title).alias("title"), body.alias("description"), F.col("__company").alias("company"),
        F.when(said("location") != "", said("location")).otherwise(ld.places(post)).alias("location"), F.when(ld.field(post, "$.jobLocationType") == "TELECOMMUTE", "Remote").otherwise(said("work_mode")).alias("work_mode"),
        *[said(k).alias(k) for k in ("schedule", "salary", "education", "experience")], ld.field(post, "$.datePosted").alias("date_posted"), F.when(ld.field(post, "$.title").isNotNull(), ld.field(post, "$.validThrough")).alias("valid_through"),
        F.col("__notice").alias("notice"), error.alias("error"),
    )


def closed(as_of: Column) -> Column:
    """struct<closed, reason> of a row of details(): a status that says so, or a titled posting past its date."""
    past = F.coalesce(F.col("valid_through").try_cast("timestamp") < as_of, F.lit(False))
    reason = F.when(F.col("notice").isNotNull(), F.col("notice")).when(past, "posting expired")
    return F.struct(reason.isNotNull().alias("closed"), reason.alias("reason"))


def stored_text(text: Column, quality: Column, source: Column, bounds: dict[str, tuple[str, str, str]] = STORED) -> Column:
    """struct<text, quality> of a stored description, repaired where it is a whole page.

    Empty: missing. Verified: kept as it is. Over LONG characters: contaminated,
    and nothing is kept. On a site with bounds: what stands from the last mark
    to the first end after it, both looked for in folded text, is recovered; a
    text with a sign of a page but no mark is contaminated. Others are recovered.
    """
    state = lambda t, q: F.struct(t.alias("text"), F.lit(q).alias("quality"))
    nothing, whole = F.lit(""), F.coalesce(text, F.lit(""))

    def between(mark_: str, end: str) -> Column:
        def cut(folded: Column) -> Column:
            tail = F.substring_index(folded, mark_, -1)
            start, stop = F.length(folded) - F.length(tail), F.regexp_instr(tail, F.lit(end))
            return clean(F.substring(whole, start + 1, F.when(stop > 0, stop - 1).otherwise(F.length(whole))))

        return let(normalize(whole), cut)

    out = F.when(whole == "", state(nothing, "missing")).when(quality == "verified", state(whole, "verified")).when(F.length(whole) > LONG, state(nothing, "contaminated"))
    for name, (mark_, end, sign) in bounds.items():
        folded = normalize(whole)
        out = out.when((source == name) & F.contains(folded, F.lit(mark_)), state(between(mark_, end), "recovered")).when((source == name) & folded.rlike(sign), state(nothing, "contaminated"))
    return out.otherwise(state(clean(whole), "recovered"))
