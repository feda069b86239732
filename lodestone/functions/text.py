"""Text, URL and JSON columns of the listing model; everything stays in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folding import folded, let


def normalize(text: Column) -> Column:
    """Lower case, plain letters for compatibility forms and Latin letters with marks (other scripts keep theirs), plain quotes, dashes and spaces. Null: empty."""
    return folded(F.coalesce(text, F.lit("")))


def clean(text: Column) -> Column:
    """One space between words, no spaces around line ends, at most one empty line in a row."""
    out = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "\u00a0", " "), r"[ \t]+", " ")
    out = F.regexp_replace(F.regexp_replace(out, r" *\n *", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def phrase(text: Column, pattern: str) -> Column:
    """Whether ``pattern`` stands in the normalized text between characters that are no letters or digits."""
    return normalize(text).rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{pattern})(?![\p{{L}}\p{{N}}])")


def words(text: Column) -> Column:
    return F.trim(F.regexp_replace(normalize(text), r"[^\p{L}\p{N}]+", " "))


# Legal forms before and after company names.
FORMS_BEFORE, FORMS_AFTER = ("ics ", "ocn ", "o c n "), (" srl", "s r l", " sa", " s a")


def company(name: Column, before: tuple[str, ...] = FORMS_BEFORE, after: tuple[str, ...] = FORMS_AFTER) -> Column:
    """Company words without a legal form at either end."""
    return F.trim(F.regexp_replace(words(name), rf"^(?:{'|'.join(before)})|(?:{'|'.join(after)})$", ""))


def rewritten(text: Column, pattern: str, body) -> Column:
    """``text`` with each match of a pattern replaced by ``body(match)``."""
    cut = F.split(F.regexp_replace(text, f"({pattern})", "\x01$1\x01"), "\x01")
    return F.array_join(F.transform(cut, lambda piece, i: F.when(i % 2 == 1, body(piece)).otherwise(piece)), "")


def valid_company(name: Column) -> Column:
    """The name with single spaces, or null where it is no name: empty, over 150 characters, a placeholder, a rank among employers, or digits only."""
    out = F.trim(F.regexp_replace(name, r"\s+", " "))
    return F.when(F.length(out).between(1, 150) & ~out.rlike(r"(?i)^(?:n/a|linkedin|facebook|instagram|top angajator.*|[+\d\s]+)$"), out)


# Places in titles, remarks on pay, and forms of one occupation.
PLACES, PAY_REMARK = "moldova|chisinau", r"\d.{0,15}(?:usd|mdl|eur)"
SYNONYMS = ((r"системный администратор|сис\.?\s*админ|administrator de sistem", "system administrator"),)
SAME_TITLES = ((r"^(system administrator)(?: system administrator)+$", "$1"), (r"^(?:internship it|it internship)$", "it internship"))


def title(name: Column, employer: Column, places: str = PLACES) -> Column:
    """Title words in one spelling, without employer and place at the end.

    Brackets go if they hold just the employer, a place, or pay; others stay, as
    they tell adverts apart.
    """

    def known(who: Column) -> Column:
        def remark(block: Column) -> Column:
            return let(words(block), lambda said: F.when((said == who) | said.rlike(rf"^(?:{places})$") | said.rlike(PAY_REMARK), F.lit(" ")).otherwise(block))

        out = rewritten(normalize(name), r"\([^)]*\)", remark)
        for pattern, value in SYNONYMS:
            out = F.regexp_replace(out, pattern, value)
        out = let(words(out), lambda t: F.when((F.length(who) > 0) & F.endswith(t, F.concat(F.lit(" "), who)), F.trim(F.substring(t, F.lit(1), F.length(t) - F.length(who)))).otherwise(t))
        out = F.trim(F.regexp_replace(out, rf"(?:^|\s)(?:{places})$", ""))
        for pattern, value in SAME_TITLES:
            out = F.regexp_replace(out, pattern, value)
        return out

    return let(company(employer), known)


def shingles(text: Column, n: int = 5, hashed: bool = False) -> Column:
    """Distinct runs of ``n`` words, or their 64-bit hashes; none for shorter texts."""
    def runs(tokens: Column) -> Column:
        run = lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(-1, n - 1)]) if hashed else F.concat_ws(" ", F.slice(tokens, i, n))
        found = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), run)
        return F.when(F.size(tokens) < n, F.array().cast("array<bigint>" if hashed else "array<string>")).otherwise(F.array_distinct(found))

    return let(F.split(words(text), " "), runs)


def dice(a: Column, b: Column) -> Column:
    """Twice the shared elements over all elements of two distinct arrays; 0 where both are empty."""
    return F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)), F.lit(0.0))


# Number words before a word for years, in the cases that they take there.
NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "ten": 10, "un": 1, "doi": 2, "doua": 2, "trei": 3, "patru": 4, "cinci": 5, "один": 1, "одного": 1, "два": 2, "двух": 2, "три": 3, "трех": 3, "четыре": 4, "пять": 5, "пяти": 5}


def number_words(text: Column, unit: str = "years?|ani?|год|года|лет") -> Column:
    """Number words as digits where a unit follows."""
    after = rf" (?=(?:{unit})(?:$|[^\p{{L}}\p{{N}}]))"

    def replaced(out: Column) -> Column:
        for word, n in NUMBERS.items():
            out = F.regexp_replace(out, rf"(?<![\p{{L}}\p{{N}}]){word}{after}", f"{n} ")
        return out

    return let(normalize(text), lambda t: F.when(t.rlike(rf"(?:{'|'.join(NUMBERS)}){after}"), replaced(t)).otherwise(t))


def safe_link(link: Column, hosts: list[str] | None = None, path: str = "/.*", schemes: str = "https") -> Column:
    """The link without query, fragment and closing slash, or null unless scheme, host and path are allowed; www. does not count."""
    scheme, where = F.try_parse_url(link, F.lit("PROTOCOL")), F.regexp_replace(F.try_parse_url(link, F.lit("HOST")), r"^www\.", "")
    rest = F.regexp_replace(F.coalesce(F.try_parse_url(link, F.lit("PATH")), F.lit("")), r"/+$", "")
    good = scheme.rlike(f"^(?:{schemes})$") & rest.rlike(f"^(?:{path})$")
    if hosts is not None:
        good &= where.isin(hosts)
    return F.when(good, F.concat(scheme, F.lit("://"), where, rest))


def trailing_id(link: Column) -> Column:
    """The number at the end of a link's path, else empty."""
    return F.regexp_extract(link, r"/(\d+)/?(?:[?#].*)?$", 1)


def json_array(text: Column, kind: str = "array<string>") -> Column:
    """A JSON array, empty where the text is none."""
    return F.coalesce(F.from_json(text, kind), F.array().cast(kind))


def json_object(text: Column, kind: str = "map<string,string>") -> Column:
    return F.coalesce(F.from_json(text, kind), F.create_map().cast(kind))


def cell(text: Column) -> Column:
    """A Markdown table cell: bars escaped, line ends as spaces."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\|", r"\\|"), r"\r?\n", " ")


def shown_date(at: Column, zone: str) -> Column:
    """A UTC time shown as day, month, year and minutes in another zone."""
    return F.date_format(F.from_utc_timestamp(at, zone), "dd/MM/yyyy, HH:mm")


def shown_number(value: Column) -> Column:
    """At most two decimals, without closing zeros."""
    return F.regexp_replace(F.format_string("%.2f", value), r"\.?0+$", "")


def repaired(text: Column, quality: Column, marker: str, boundary: str, junk: str, limit: int = 25_000) -> Column:
    """struct<text, quality> of a stored description.

    Empty: missing. Verified: kept. With the marker: what follows its last
    occurrence up to the boundary, recovered. Over ``limit`` characters or with
    junk: contaminated. Else recovered.
    """
    after = F.substring_index(F.coalesce(text, F.lit("")), marker, -1)
    window = clean(F.substring_index(after, boundary, 1))
    body = clean(text)
    state = lambda t, q: F.struct(t.alias("text"), F.lit(q).alias("quality"))
    return (
        F.when(F.length(body) == 0, state(F.lit(""), "missing"))
        .when(quality == "verified", state(body, "verified"))
        .when(F.contains(text, F.lit(marker)) & (F.length(window) > 0), state(window, "recovered"))
        .when((F.length(body) > limit) | F.contains(body, F.lit(junk)), state(body, "contaminated"))
        .otherwise(state(body, "recovered"))
    )
