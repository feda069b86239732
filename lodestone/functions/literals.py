"""Words without which a pattern cannot match. Those that stand in a text are found in one pass over it, so that patterns without any of theirs are not tried."""

from __future__ import annotations

import re
from collections.abc import Iterable
from re import _constants as op
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shorter words stand in most texts.
LEAST = 2


def _of(tree) -> frozenset[str] | None:
    """The best of the parts that stand in every match, as words of which there is one at least."""
    run, found = "", []
    for kind, arg in [*tree, (None, None)]:
        if kind is op.LITERAL:
            run += chr(arg)
            continue
        if run:
            found.append(frozenset([run]))
        run, inner = "", None
        if kind is op.SUBPATTERN and not arg[1]:
            inner = _of(arg[3])
        elif kind is op.BRANCH:
            each = [_of(b) for b in arg[1]]
            inner = frozenset().union(*each) if all(each) else None
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] > 0:
            inner = _of(arg[2])
        if inner:
            found.append(inner)
    return max(found, key=lambda s: (min(map(len, s)), -len(s)), default=None)


def needed(pattern: str) -> frozenset[str] | None:
    """Words of which one stands in all that a Java pattern matches; null where there are none of LEAST characters, and for patterns that take either case."""
    try:
        tree = _parser.parse(re.sub(r"\\p\{\w+\}", r"\\w", pattern))
    except re.error:
        return None
    words = None if tree.state.flags & re.IGNORECASE else _of(tree)
    return words if words and min(map(len, words)) >= LEAST else None


def _tree(words: Iterable[str]) -> str:
    """A pattern for any of some words, none of which starts another. Where many characters may come next, their range is asked for first."""
    by: dict[str, list[str]] = {}
    for w in sorted(words):
        by.setdefault(w[0], []).append(w[1:])
    sign = {c: c if c.isalnum() else f"\\{c}" for c in by}
    parts = [sign[c] + ("" if "" in rest else _tree(rest)) for c, rest in by.items()]
    if len(parts) > 6:
        first, n = list(by), round(len(parts) ** 0.5)
        parts = [f"(?=[{sign[first[i]]}-{sign[first[min(i + n, len(first)) - 1]]}])(?:{'|'.join(parts[i : i + n])})" for i in range(0, len(parts), n)]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


class Words:
    """The words that some patterns need, each as the shortest of them that it starts with."""

    def __init__(self, patterns: Iterable[str]):
        self.needed = {p: needed(p) for p in patterns}
        words = {w for s in self.needed.values() for w in s or ()}
        self.words = sorted(w for w in words if not any(w != v and w.startswith(v) for v in words))

    def any(self) -> str:
        """A pattern for texts that hold one of the words."""
        return _tree(self.words)

    def standing(self, text: Column) -> Column:
        """array<string>: the words in a text, wherever they stand, over each other too."""
        if not self.words:
            return F.array().cast("array<string>")
        return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({self.any()}))"), F.lit(1)))

    def when(self, standing: Column, pattern: str, test: Column, none: Column | bool = False) -> Column:
        """``test``, which is ``none`` unless ``pattern`` matches, tried only if one of its words is standing."""
        mine = self.needed.get(pattern)
        if mine is None:
            return test
        held = F.arrays_overlap(standing, F.array(*[F.lit(v) for v in self.words if any(w.startswith(v) for w in mine)]))
        return F.when(held, test).otherwise(none)
