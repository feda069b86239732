"""Main-text extraction by wrappers: union-free regular expressions inferred from pages of one host.

A page is a stream of element starts, texts and element ends. The wrapper of a
host is such a stream with texts that became slots and with optional and
repeated groups; it is inferred by aligning page after page with it. Extraction
aligns a page with its host's wrapper: texts at a place where the host's pages
have the same text are template and go, and the region where the slots gather
is the article wherever the page doesn't name it by its own tags.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small

#: Pages of a host that its wrapper is inferred from, read whole: those with the smallest hash of url and page_id.
SAMPLE = 12
#: A text is template if it stands at one place in this share of the sampled pages, and in so many at least.
SAME_SHARE, SAME_PAGES = 0.8, 3
#: Share of the slots' characters that the region must hold.
REGION_SHARE = 0.8
#: A block of so many texts of which links make up this share is a list of links.
LINK_TEXTS, LINK_SHARE = 3, 0.8
#: Copies of each wrapper in the join, so that a host with a third of all pages meets in many tasks.
SALT = 64
#: Bytes of wrappers that are broadcast; beyond it, the join shuffles.
BROADCAST_BYTES = 8 << 20
BROADCAST_ROWS = 100_000
#: Lists of parts with a larger product of lengths are aligned first-fit.
EXACT_CELLS = 250_000

# Element names by what they mean for layout.
SKIP = frozenset("script style noscript template nav footer aside button iframe svg select textarea title menu dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr script style template noscript button svg select textarea iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template noscript iframe".split())
IN_HEAD = frozenset("base link meta title style script noscript template".split())
TEXT_LEVEL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead table ul ol dl blockquote pre figure figcaption".split())
MAIN = frozenset(["article", "main"])
#: Elements that a new start tag of one of these kinds closes.
CLOSED_BY = {"p": frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl div section article table pre blockquote header footer nav aside form hr main figure address".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
#: Words that name what is no part of an article in a class, id or role.
NOISE_WORD = r"ads?|advert\w*|adsbygoogle|sponsor\w*|promo\w*|banner|cookies?|consent|notice|popup|modal|newsletter|subscri\w+|share|sharing|social|related|recommend\w*|sidebar|side-bar|widgets?|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|comments?|commentlist|respond|replies|disqus|contentinfo|complementary"
BEFORE, AFTER = r"site|page|main|top|left|right|bottom|global|primary|secondary|mobile|sub|user|reader", r"box|bar|area|list|section|container|wrapper|wrap|block|inner|links?|items?|form|slot|unit|top|bottom|left|right|thread|body|posts?|articles?|stories|text|message|menu|content|\d+"
NOISE = re.compile(rf"(?i)(?:(?:{BEFORE})[-_]*)?(?:{NOISE_WORD})(?:[-_]*(?:{AFTER}))*")
#: Elements of text carry such a word alone.
NOISE_TEXT = re.compile(rf"(?i)(?:{NOISE_WORD})")

PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)\s*(/?)>")
TAG_START = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
TAG_END = re.compile(r">|=\s*([\"'])")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
DIGITS = re.compile(r"\d+")


def tokens(page: str):
    """(kind, name, class-id-role, text) in page order, in time linear in the page: kind is open, close or text. Comments go; raw elements give no text."""
    at, size = 0, len(page)
    while at < size:
        if page[at] != "<":
            end = page.find("<", at)
            end = size if end < 0 else end
            yield "text", "", "", page[at:end]
            at = end
        elif found := PLAIN_TAG.match(page, at) or TAG_START.match(page, at):
            name, a = found[2].lower(), found.end()
            if found.re is TAG_START:  # up to the bracket outside quoted values; a tag that the page's end cuts is none
                b = a
                while end := TAG_END.search(page, b):
                    b = end.end()
                    if not end[1]:
                        break
                    b = page.find(end[1], b) + 1
                    if not b:
                        return
                else:
                    return
                marks, at = page[a : b - 1], b
                marks = " ".join(x or y or z for k, x, y, z in ATTRIBUTE.findall(marks) if k.lower() in ("class", "id", "role")) if "=" in marks else ""
            else:
                marks, at = "", a
            if found[1]:
                yield "close", name, "", ""
                continue
            yield "open", name, marks, ""
            if name in RAW:
                end = re.compile(rf"(?i)</{re.escape(name)}(?=[\s/>])").search(page, at)
                at = end.start() if end else size
        elif page.startswith("<!--", at):
            end = page.find("-->", at + (2 if page.startswith("<!-->", at) else 4))
            at = size if end < 0 else end + 3
        elif page[at + 1 : at + 2] in ("!", "?", "/") and page[at + 1 : at + 3] != "/ ":
            end = page.find(">", at)
            at = size if end < 0 else end + 1
        else:
            yield "text", "", "", "<"
            at += 1


class Page:
    """The blocks of a page: elements in document order with parent and label, texts with their block element, and what is kept of it."""

    def __init__(self, source: str):
        self.name, self.label, self.parent = ["#"], ["#"], [-1]
        self.noise, self.block_of = [False], [0]
        #: (element, text) in page order; a None text ends a block.
        self.stream: list[tuple[int, str | None]] = []
        self._build(source)
        self._choose()

    def _build(self, source: str) -> None:
        stack, held = [0], {"#": 1}

        def pop() -> str:
            name = self.name[stack.pop()]
            held[name] -= 1
            if name not in INLINE:
                self.stream.append((stack[-1], None))
            return name

        for kind, name, marks, text in tokens(source):
            if kind == "text":
                if held.get("head") and not text.isspace():
                    while held["head"]:
                        pop()
                self.stream.append((stack[-1], text))
                continue
            if kind == "close":
                if held.get(name) and name != "#":
                    while pop() != name:
                        pass
                continue
            if held.get("head") and name not in IN_HEAD:
                while held["head"]:
                    pop()
            while name in CLOSED_BY.get(self.name[stack[-1]], ()):
                pop()
            if held.get("p") and name in CLOSED_BY["p"]:
                while pop() != "p":
                    pass
            new = len(self.name)
            words = marks.split()
            loud = (NOISE_TEXT if name in TEXT_LEVEL or name in INLINE else NOISE).fullmatch
            self.noise.append(name in SKIP or name in ("form", "header", "head") or (name not in ("html", "body") and any(loud(w) for w in words)))
            self.name.append(name)
            self.label.append(DIGITS.sub("0", f"{name} {' '.join(words)}") if words else name)
            self.parent.append(stack[-1])
            self.block_of.append(self.block_of[stack[-1]] if name in INLINE else new)
            if name not in INLINE:
                self.stream.append((stack[-1], None))
            elif name == "br":
                self.stream.append((stack[-1], " "))
            if name not in VOID:
                stack.append(new)
                held[name] = held.get(name, 0) + 1

    def _choose(self) -> None:
        """Which elements go by their own tags and marks, and which are named as the article."""
        n = len(self.name)
        chars, links, count, names_main = [0] * n, [0] * n, [0] * n, [False] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = in_link[self.parent[i]] or self.name[i] == "a"
        for i, text in self.stream:
            if text and (size := len(text) - text.count(" ") - text.count("\n")):
                chars[i] += size
                links[i] += size * in_link[i]
                count[i] += 1
        total = [0] * n
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            skipped = self.name[i] in SKIP
            names_main[i] |= (self.name[i] in MAIN or self.name[i] == "h1") and not self.noise[i]
            total[i] += 0 if skipped else chars[i]
            total[up] += total[i]
            links[up] += links[i]
            count[up] += count[i]
            names_main[up] |= names_main[i] and not skipped
        total[0] += chars[0]
        # what wraps the article goes through, whatever it is called
        gone, main = [False] * n, [False] * n
        for i in range(1, n):
            up, name = self.parent[i], self.name[i]
            main[i] = main[up] or (name in MAIN and not self.noise[i])
            noise = self.noise[i]
            if noise and name not in SKIP and name != "head":
                if name == "header" and main[up]:
                    noise = any(NOISE.fullmatch(w) for w in self.label[i].split()[1:])
                elif name == "form":
                    noise = not (names_main[i] or 2 * total[i] >= total[0])
                else:
                    noise = not (names_main[i] and not main[up])
            gone[i] = gone[up] or noise
        self.gone, self.has_main = gone, any(m and not g for m, g in zip(main, gone, strict=True))
        self.main = main
        #: Lists of links, which go outside an article that the page names.
        self.listing = [False] * n
        for i in range(1, n):
            mass = total[i] if self.name[i] not in SKIP else 0
            self.listing[i] = self.listing[self.parent[i]] or (self.name[i] not in INLINE and self.name[i] != "body" and count[i] >= LINK_TEXTS and links[i] >= LINK_SHARE * max(mass, 1))

    def blocks(self) -> list[tuple[int, str]]:
        """(element, text) of the blocks that stay."""
        if self.has_main:
            keep = [m and not g for m, g in zip(self.main, self.gone, strict=True)]
        else:
            keep = [not (g or x) for g, x in zip(self.gone, self.listing, strict=True)]
        out: list[tuple[int, str]] = []
        held: list[str] = []
        where = 0
        for i, text in [*self.stream, (0, None)]:
            if text is None:
                if held and (line := " ".join(entities.unescape("".join(held)).split())):
                    out.append((where, line))
                held = []
            elif keep[i]:
                if not held:
                    where = self.block_of[i]
                held.append(text)
        return out


def lcs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence of two lists as pairs of places; for very long lists first-fit, which is common but may be shorter."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    pairs = [(i, i) for i in range(head)]
    x, y = a[head:], b[head:]
    if len(x) * len(y) > EXACT_CELLS:
        where: dict[str, list[int]] = {}
        for i, label in enumerate(x):
            where.setdefault(label, []).append(i)
        last = -1
        for j, label in enumerate(y):
            places = where.get(label, [])
            k = bisect_left(places, last + 1)
            if k < len(places):
                last = places[k]
                pairs.append((head + last, head + j))
        return pairs
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            pairs.append((head + i, head + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return pairs


def fold(labels: list[str]) -> list[tuple[int, int, int]]:
    """(first, width, times) of a list's parts: runs of equal blocks, of whatever width, are one repeated group."""
    following: list[int] = [0] * len(labels)
    seen: dict[str, int] = {}
    for i in range(len(labels) - 1, -1, -1):
        following[i] = seen.get(labels[i], 0)
        seen[labels[i]] = i
    out, i = [], 0
    while i < len(labels):
        j, times = following[i], 1
        width = j - i if j else 1
        if j and labels[i:j] == labels[j : j + width]:
            while labels[i : i + width] == labels[i + times * width : i + (times + 1) * width]:
                times += 1
            out.append((i, width, times))
            i += times * width
        else:
            out.append((i, 1, 1))
            i += 1
    return out


class Part:
    """An element of a wrapper: its label, the repeated group that it belongs to (0: none), its parts, and in how many pages each of its texts stands."""

    __slots__ = ("group", "label", "last", "pages", "parts", "texts")

    def __init__(self, label: str, group: int = 0):
        self.label, self.group, self.parts, self.texts, self.pages, self.last = label, group, [], {}, 0, -1


def _tree(page: Page) -> tuple[list[list[int]], list[list[str]]]:
    """Children (block elements that hold a kept text) and texts of each block element."""
    kids: list[list[int]] = [[] for _ in page.name]
    texts: list[list[str]] = [[] for _ in page.name]
    used = [False] * len(page.name)
    for i, text in page.blocks():
        texts[i].append(text)
        while i >= 0 and not used[i]:
            used[i] = True
            i = page.parent[i]
    for i in range(1, len(page.name)):
        if used[i] and page.block_of[i] == i:
            kids[page.block_of[page.parent[i]]].append(i)
    return kids, texts


def _items(page: Page, nodes: list[int], turn: int) -> list[tuple[str, int, list[int]]]:
    """(label, group, elements) of a list of siblings with its repeated groups folded."""
    out = []
    for first, width, times in fold([page.label[k] for k in nodes]):
        turn += 1
        for w in range(width):
            out.append((page.label[nodes[first + w]], turn if times > 1 else 0, nodes[first + w : first + times * width : width]))
    return out


def infer(pages: list[Page]) -> Part:
    """The wrapper of some pages of one host: each page is aligned with what the ones before gave.

    Where an element's parts differ, the unmatched ones of either side stay as
    optional groups; repeated siblings become one repeated group, whose members
    are aligned with each other; differing texts make a slot.
    """
    root = Part("#")
    for number, page in enumerate(pages):
        kids, texts = _tree(page)
        todo = [(root, [0])]
        while todo:
            part, nodes = todo.pop()
            if part.last != number:
                part.pages, part.last = part.pages + 1, number
            for text in {t for k in nodes for t in texts[k]}:
                seen, size, at = part.texts.get(crc32(text.encode()), (0, len(text), -1))
                part.texts[crc32(text.encode())] = (seen + (at != number), size, number)
            for k in nodes:
                items = _items(page, kids[k], number << 20)
                pairs = lcs([p.label for p in part.parts], [x[0] for x in items])
                merged, i, j = [], 0, 0
                for a, b in [*pairs, (len(part.parts), len(items))]:
                    merged += part.parts[i:a]
                    for label, group, found in items[j:b]:
                        merged.append(Part(label, group))
                        todo.append((merged[-1], found))
                    if a < len(part.parts):
                        merged.append(part.parts[a])
                        merged[-1].group = merged[-1].group or items[b][1]
                        todo.append((merged[-1], items[b][2]))
                    i, j = a + 1, b + 1
                part.parts = merged
    return root


def expression(part: Part) -> str:
    """The wrapper as a regular expression without unions: # is a slot, ( )? an optional and ( )+ a repeated group."""
    inside, held, last = [], [], 0
    for p in [*part.parts, Part("", -1)]:
        if held and p.group != last:
            inside.append(f"({' '.join(held)})+" if last else " ".join(held))
            held = []
        last = p.group
        if p.label:
            held.append(expression(p) if p.pages == part.pages or last else f"({expression(p)})?")
    text = [] if not part.texts else ["#"] if any(seen < part.pages for seen, _, _ in part.texts.values()) else ["text"]
    return f"{part.label}[{' '.join(text + inside)}]"


def settled(root: Part, pages: int) -> str:
    """What extraction needs of a wrapper, as JSON: parent, label, template texts and place in the region of each part. '' if too few pages differ.

    Template texts count only while the slots hold most of the text: pages
    that are copies of each other say nothing about their host.
    """
    parts, parents, todo = [], [], [(root, -1)]
    while todo:
        part, up = todo.pop()
        parts.append(part)
        parents.append(up)
        todo.extend((p, len(parts) - 1) for p in reversed(part.parts))
    most = max(SAME_PAGES, SAME_SHARE * pages)
    fixed = [{h for h, (seen, _, _) in p.texts.items() if seen >= most} for p in parts]
    mass = [sum(seen * size for h, (seen, size, _) in p.texts.items() if h not in f) for p, f in zip(parts, fixed, strict=True)]
    same = sum(p.texts[h][0] * p.texts[h][1] for p, f in zip(parts, fixed, strict=True) for h in f)
    if pages < SAME_PAGES or sum(mass) <= same:
        return ""
    heading = [p.label.split(" ")[0] == "h1" and m > 0 and 2 * p.pages >= pages for p, m in zip(parts, mass, strict=True)]
    some_heading = any(heading)
    for i in range(len(parts) - 1, 0, -1):
        mass[parents[i]] += mass[i]
        heading[parents[i]] |= heading[i]
    region = 0
    for i in range(1, len(parts)):  # parents come first
        if parents[i] == region and mass[i] >= REGION_SHARE * mass[0] and (heading[i] or not some_heading) and parts[i].label.split(" ")[0] not in TEXT_LEVEL:
            region = i
    inside = [False] * len(parts)
    for i in range(len(parts)):
        inside[i] = i == region or (parents[i] >= 0 and inside[parents[i]])
    return json.dumps([[u, p.label, sorted(f), int(s)] for u, p, f, s in zip(parents, parts, fixed, inside, strict=True)])


class Wrapper:
    """A settled wrapper, ready to be matched with pages."""

    def __init__(self, text: str):
        rows = json.loads(text)
        self.label = [r[1] for r in rows]
        self.fixed = [set(r[2]) for r in rows]
        self.inside = [bool(r[3]) for r in rows]
        self.parts: list[list[int]] = [[] for _ in rows]
        for i, r in enumerate(rows):
            if r[0] >= 0:
                self.parts[r[0]].append(i)

    def match(self, page: Page) -> tuple[dict[int, int], list[bool]]:
        """The part of each matched element, and whether an element lies in the region (unmatched ones as their parent does)."""
        kids, _ = _tree(page)
        of = {0: 0}
        inside = [False] * len(page.name)
        todo = [(0, 0)]
        while todo:
            k, part = todo.pop()
            inside[k] = self.inside[part]
            items = _items(page, kids[k], 0)
            pairs = dict((b, a) for a, b in lcs([self.label[p] for p in self.parts[part]], [x[0] for x in items]))
            for j, (_, _, nodes) in enumerate(items):
                if j in pairs:
                    for node in nodes:
                        of[node] = self.parts[part][pairs[j]]
                        todo.append((node, of[node]))
        for k in range(1, len(page.name)):
            if k not in of:
                inside[k] = inside[page.block_of[page.parent[k]]]
        return of, inside


def extract(page: str, wrapper: Wrapper | None) -> str:
    """The article of a page by its host's wrapper; without one, or where the wrapper leaves nothing, by the page's own tags."""
    read = Page(page)
    blocks = read.blocks()
    if wrapper and blocks:
        of, inside = wrapper.match(read)
        rest = [(k, t) for k, t in blocks if not (k in of and crc32(t.encode()) in wrapper.fixed[of[k]])]
        if not read.has_main:
            rest = [(k, t) for k, t in rest if inside[k]] or rest
        blocks = rest or blocks
    return "\n\n".join(t for _, t in blocks)


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def wrappers(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(host, wrapper): each host's settled wrapper, from at most ``sample`` of its pages.

    The pages are chosen from urls alone, by rank within the host, which Spark
    cuts in each task before the shuffle. A page without host gets no wrapper.
    """
    keyed = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("url", "page_id").alias("h"), "html").where("host <> ''")
    chosen = keyed.select("host", "h").distinct().withColumn("turn", F.row_number().over(Window.partitionBy("host").orderBy("h"))).where(F.col("turn") <= sample).select("host", "h")
    picked = keyed.join(small(cut(chosen), BROADCAST_ROWS), ["host", "h"], "left_semi").groupBy("host", "h").agg(F.max(F.coalesce("html", F.lit(""))).alias("html"))

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        texts = list(dict.fromkeys(rows.sort_values("h")["html"]))
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [settled(infer([Page(x) for x in texts]), len(texts)) if len(texts) >= SAME_PAGES else ""]})

    return picked.groupBy("host").applyInPandas(learn, "host string, wrapper string").where("wrapper <> ''")


def main_text(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url and the main text of each page (needs page_id, url, html).

    Null html gives an empty text, a null url belongs to no host. Pages meet
    their host's wrapper in a broadcast join where the wrappers' size is counted
    to be small, else in a join salted by page. Rows may repeat; other columns
    are ignored; an empty table gives an empty one.
    """
    pages = pages.select("page_id", "url", "html")
    learnt = cut(wrappers(pages, sample))
    keyed = pages.withColumn("host", host_of(F.col("url")))
    if (learnt.agg(F.sum(F.octet_length("wrapper") + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        joined = keyed.join(F.broadcast(learnt), "host", "left")
    else:
        salted = learnt.select("host", "wrapper", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
        joined = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int")).join(salted, ["host", "salt"], "left")

    def run(batches):
        held: dict[str, Wrapper] = {}
        for batch in batches:
            texts = []
            for page, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if text and text not in held:
                    if len(held) > 64:
                        held.clear()
                    held[text] = Wrapper(text)
                texts.append(extract(page or "", held[text] if text else None))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = dict(pages.dtypes)
    return joined.select("page_id", "url", "html", "wrapper").mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string")
