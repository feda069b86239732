"""Folding of characters: compatibility forms and marks on Latin letters go, in tables that follow from the Unicode data."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, also where the body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


# Curly single quotes, long dashes and the no-break space, with what stands for them.
SIGNS = dict(zip("‘’–— ", "''-- ", strict=True))


def fold(text: str) -> str:
    """The folding in plain Python, from which the tables are made: decompose, drop marks after Latin letters, compose, lower case, plain signs."""
    out: list[str] = []
    latin = False
    for c in unicodedata.normalize("NFKD", text):
        mark = unicodedata.category(c).startswith("M")
        if not (mark and latin):
            out.append(c)
        latin = latin and mark or unicodedata.name(c, "").startswith("LATIN ")
    return "".join(SIGNS.get(c, c) for c in unicodedata.normalize("NFC", "".join(out)).lower())


def _tables() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """Characters that become one other; that become several or none; and pairs of a letter and a mark that become one."""
    single, several, pairs = {}, {}, {}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        if unicodedata.category(c) in ("Cn", "Co", "Cs") or 0xAC00 <= code <= 0xD7A3:  # syllables of Hangul come back as they were
            continue
        out = fold(c)
        if out != c:
            (single if len(out) == 1 else several)[c] = out
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and parts[0][0] != "<" and out == c and unicodedata.normalize("NFC", c) == c:
            pairs[chr(int(parts[0], 16)) + chr(int(parts[1], 16))] = c
    return single, several, pairs


SINGLE, SEVERAL, PAIRS = _tables()
#: Single Latin letters with marks, and their plain letters in lower case.
MARKED = {c: v for c, v in SINGLE.items() if v.isascii() and v.isalpha() and unicodedata.decomposition(c)[:1] not in ("", "<")}
#: Characters whose lower-case form would be folded otherwise.
_FIRST = {c: v for c, v in SINGLE.items() if fold(c.lower()) != v}
_FROM, _TO = "".join(SINGLE), "".join(SINGLE.values())
#: Texts with a character that becomes several pass through a look-up; what precedes this point is listed, the rest is taken as likely.
_POINT = 0x2000


def _ranges(characters) -> str:
    """Characters as a class of a pattern."""
    codes, out = sorted(map(ord, characters)), []
    for code in codes:
        if out and out[-1][1] == code - 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" if b > a else f"\\x{{{a:X}}}" for a, b in out)


_CLASS = f"{_ranges(c for c in SEVERAL if ord(c) < _POINT)}\\x{{{_POINT:X}}}-\\x{{10FFFF}}"


def _quiet() -> str:
    """Wide ranges without such characters: a few, so that most characters are told by them and not by the many of _CLASS."""
    held = [-1, *sorted(ord(c) for c in SEVERAL if ord(c) < _POINT), _POINT]
    return "".join(f"\\x{{{a + 1:X}}}-\\x{{{b - 1:X}}}" for a, b in zip(held, held[1:]) if b - a > 128)


_SEVERAL = f"[[^{_quiet()}]&&[{_CLASS}]]"
_WIDTH = 256


def _pages() -> str:
    """What characters become, as a text of rows of _WIDTH characters each, cut by the signs for rows and units; empty for those that stay."""
    rows = []
    for row in range(max(map(ord, SEVERAL)) // _WIDTH + 1):
        held = {ord(c) % _WIDTH: v or "\x1d" for c, v in SEVERAL.items() if ord(c) // _WIDTH == row}
        rows.append("\x1f".join(held.get(i, "") for i in range(max(held) + 1)) if held else "")
    return "\x1e".join(rows)


_PAGES = _pages()


def _looked_up(text: Column) -> Column:
    rows = F.split(F.lit(_PAGES), "\x1e")  # a constant, worked out once a plan; a transform of it would be worked out for each piece

    def one(c: Column) -> Column:
        code = F.ascii(c)
        found = F.get(F.split(F.get(rows, F.floor(code / _WIDTH).cast("int")), "\x1f"), code % _WIDTH)
        return F.when(F.coalesce(found, F.lit("")) == "", c).otherwise(F.replace(found, F.lit("\x1d"), F.lit("")))

    pieces = F.regexp_extract_all(text, F.lit(f"[{_quiet()}]+|[{_CLASS}]|[^{_CLASS}]+"), F.lit(0))
    return F.array_join(F.transform(pieces, one), "")


def _composed(text: Column) -> Column:
    """Letters joined with the mark that follows them, where there is such a letter."""
    pairs = F.str_to_map(F.lit("\x1e".join(f"{k}\x1f{v}" for k, v in PAIRS.items())), F.lit("\x1e"), F.lit("\x1f"))  # a constant: worked out once a plan
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)\P{M}\p{M}|\P{M}+(?!\p{M})|."), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(F.length(p) == 2, F.coalesce(pairs[p], p)).otherwise(p)), "")


def folded(text: Column) -> Column:
    """fold() of each text: lower case, compatibility forms as plain characters, Latin letters without marks; other scripts keep theirs.

    Most texts are plain, and only others pay for more than lower case. Marks
    are joined with a letter in their order of writing, two at most.
    """
    several = lambda t: F.when(t.rlike(_SEVERAL), _looked_up(t)).otherwise(t)
    plain = lambda t: F.when(t.rlike(r"\p{M}"), let(F.regexp_replace(t, r"(\p{IsLatin})\p{M}+", "$1"), lambda u: _composed(_composed(u)))).otherwise(t)
    low = lambda t: F.lower(F.translate(t, "".join(_FIRST), "".join(_FIRST.values())))
    # what is left of most texts is plain by now
    joined = lambda t: let(F.translate(low(t), _FROM, _TO), lambda u: F.when(~u.rlike(r"[^\x00-\x7F]"), u).otherwise(let(several(u), plain)))
    # the text may be costly, and it is used several times
    return let(text, lambda t: F.when(~t.rlike(r"[^\x00-\x7F]"), F.lower(t)).otherwise(joined(t)))
