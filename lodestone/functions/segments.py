"""Sentences, sections and quoted evidence; quotes are unchanged parts of the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folding import MARKED
from .literals import Words, needed
from .text import let, normalize

#: Stands between pieces; it occurs in no text that passed clean().
MARK = "\u0001"
# Section headers by kind, without accents.
HEADERS = {
    "responsibilities": r"responsabilitat(?:i|ile)(?: tale| candidatului)?|atributii|ce ai de facut|cum arata munca|what you['’]?ll do|what you will (?:do|be doing)|(?:your )?duties(?: and responsibilities)?|(?:key |job )?responsibilities|(?:your )?role|чем вы будете заниматься|(?:(?:ключевые|должностные) )?обязанности(?: кандидата)?|задачи",
    "requirements": r"cerinte(?:le)?(?: obligatorii| de calificare| fata de candidat)?|ce asteptam de la tine|ce trebuie sa ai|vom aprecia sa ai|(?:job )?requireme?n?ts|this is what we expect from you|what we['’]?re looking for|what we (?:look|are looking) for|(?:your skills, experience, and )?qualifications(?: required)?|your (?:profile|skills)|что мы ожидаем от кандидата|(?:обязательные )?требования(?: к кандидат[а-я]*)?",
    "benefits": r"oferta(?: companiei)?|beneficii|ce (?:iti )?oferim|oferim|ce primiti|what (?:do )?we offer|why join us|(?:these are your |extra )?benefits(?: we offer)?|условия(?: работы)?|(?:что )?мы предлагаем|компания предлагает",
    "preferred": r"(?:constituie|vor fi|va fi).{0,15}avantaj|nice to have|good to have|preferred qualifications|would be a plus|(?:будет|является) (?:плюсом|преимуществом)|желательно",
}
TITLES = {"intro": "Introduction", "responsibilities": "Responsibilities", "requirements": "Requirements", "preferred": "Preferred qualifications", "benefits": "Benefits"}
_FIELD = "\u0002"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """array<string>: unchanged pieces of the text with their ends, which are line ends, ``;``, ``!``, ``?`` and periods before a space and a letter; e.g., i.e. and their like do not end one."""
    cut = F.regexp_replace(F.coalesce(text, F.lit("")), r"([\n;!?])", f"$1{MARK}")
    cut = F.regexp_replace(cut, r"(?iu)\.(?<!т\.\s?[дп]\.)(?<![ei]\.\s?[ge]\.)(?=\s+\p{L})", f".{MARK}")
    return F.filter(F.transform(F.split(cut, MARK), trimmed), lambda s: F.length(s) > 0)


def records(text: Column, section: str) -> Column:
    """array<struct<text, section, normalized>> of the sentences."""
    plain = lambda s: trimmed(F.regexp_replace(normalize(s), r"[;.!?]+$", ""))
    return F.transform(sentences(text), lambda s: F.struct(s.alias("text"), F.lit(section).alias("section"), plain(s).alias("normalized")))


def accented(pattern: str) -> str:
    """``pattern`` with each plain Latin letter standing for its marked forms too, so that it can run on unchanged text."""
    marks: dict[str, str] = {}
    for marked, base in MARKED.items():
        marks[base] = marks.get(base, "") + marked
    out, inside, escaped = [], False, False
    for c in pattern:
        inside = (c == "[") or (inside and c != "]")
        # marked forms are many and are tried on other characters than those of ASCII only
        out.append(f"(?:{c}|(?!\\p{{ASCII}})[{c}{marks[c]}])" if c in marks and not inside and not escaped else c)
        escaped = c == "\\"
    return "".join(out)


def _plain() -> dict[str, str]:
    """Characters that a pattern takes for another one, whatever the case and, on Latin letters, the marks."""
    out = {}
    for code in range(0x80, 0x30000):
        c = chr(code)
        if 0xD800 <= code < 0xE000:
            continue
        low = c.upper() if len(c.upper()) == 1 else c
        low = low.lower() if len(low.lower()) == 1 else low
        base = MARKED.get(c) or MARKED.get(low) or low
        if base != c:
            out[c] = base
    return out


_PLAIN = _plain()


def plain(text: Column) -> Column:
    """``text`` in lower case and without marks on Latin letters, of as many characters as before."""
    return let(text, lambda t: F.when(~t.rlike(r"[^\x00-\x7F]"), F.lower(t)).otherwise(F.lower(F.translate(t, "".join(_PLAIN), "".join(_PLAIN.values())))))


def sections(text: Column, headers: dict[str, str] | None = None) -> Column:
    """struct of intro, one field a section kind, and full_text.

    A header stands at the start, within two characters after a line end or a
    mark that ends a sentence, or before a colon. Repeated headers add to their
    section. Without a header all text counts as the first kind.
    """
    headers = headers or HEADERS
    body, kinds = F.coalesce(text, F.lit("")), list(headers)
    groups = "|".join(f"({accented(p)})" for p in headers.values())
    around = r"(?<=\A|[\n.!?:]|[\n.!?:].)(?:{0})|(?:{0})(?=\s{{0,4}}:)"
    header = "(?isu)" + around.format(groups)
    n = len(kinds)
    # most texts hold no header, which a text of plain letters tells at less cost
    low = all(p == p.lower() for p in headers.values())
    looked = lambda t: t.rlike(f"({'?s' if low else '?isu'})" + around.format("|".join(headers.values())))
    # and of those most hold no word of any
    words = Words(headers.values()) if low and all(map(needed, headers.values())) else None
    some = let(plain(body), lambda t: F.when(t.rlike(words.any()), looked(t)).otherwise(False) if words else looked(t))
    marked = F.when(~some, body).otherwise(F.regexp_replace(body, header, MARK + "".join(f"${i + 1}${i + 1 + n}{_FIELD}" for i in range(n))))

    def parted(parts: Column) -> Column:
        split = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda p: F.split(p, _FIELD, n + 1))

        def of(i: int) -> Column:
            mine = F.filter(split, lambda f: F.length(F.get(f, i)) > 0)
            return trimmed(F.array_join(F.transform(mine, lambda f: trimmed(F.regexp_replace(F.get(f, n), r"^\s*[:\-]\s*", ""))), "\n"))

        some = F.size(parts) > 1
        fields = [trimmed(F.when(some, parts[0]).otherwise("")).alias("intro")]
        fields += [F.when(some, of(i)).otherwise(trimmed(parts[0]) if i == 0 else F.lit("")).alias(k) for i, k in enumerate(kinds)]
        return F.struct(*fields, body.alias("full_text"))

    return let(F.split(marked, MARK), parted)


def evidence(found: Column, pattern: str, n: int = 3) -> Column:
    """The first ``n`` different (text, section) of the records that hold the pattern."""
    hits = F.filter(found, lambda r: r["normalized"].rlike(pattern))
    return F.slice(F.array_distinct(F.transform(hits, lambda r: F.struct(r["text"].alias("text"), r["section"].alias("section")))), 1, n)
