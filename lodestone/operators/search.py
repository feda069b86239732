"""Filters and facets over cards."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, normalize

FITS = ("beginner", "stretch", "review", "other", "excluded")
MAX_TAGS, MAX_TEXT = 30, 250


def tagged(text: Column, rules: dict[str, str]) -> Column:
    """array<string>: names of the rules whose pattern stands as a word in the text, in rule order.

    Patterns that are words are looked up in the set of the text's words, which
    takes one pass for all of them; the others are searched for one by one.
    """
    plain_words = [p for p in rules.values() if re.fullmatch(r"[^\W_]+", p)]

    def found(plain: Column) -> Column:
        words = F.array_intersect(F.array(*map(F.lit, plain_words)).cast("array<string>"), F.split(plain, r"[^\p{L}\p{N}]+"))
        stands = lambda p, held: F.array_contains(held, p) if p in plain_words else plain.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{p})(?![\p{{L}}\p{{N}}])")
        return let(words, lambda held: F.array_compact(F.array(*[F.when(stands(p, held), F.lit(k)) for k, p in rules.items()])))

    return let(normalize(text), found)


def all_of(column: str, wanted: list[str]) -> Column:
    """Whether an array holds every wanted value; an empty wish holds always."""
    return F.size(F.array_except(F.array(*map(F.lit, wanted)).cast("array<string>"), F.col(column))) == 0


def search(cards: DataFrame, fit: str = "all", category: str = "", tags: list[str] | None = None, source: str = "", mode: str = "", review: str = "", text: str = "", fits: tuple[str, ...] = FITS, reasons: tuple[str, ...] = (), over: tuple[str, ...] = ("title", "company", "description")) -> DataFrame:
    """Cards that meet every given condition.

    ``source`` matches any source of a card, so this runs after clustering.
    ``text`` is a literal part of the normalized fields and tags. Unknown fits
    or reasons and over 30 tags raise ValueError; values count to 250
    characters.
    """
    tags = list(dict.fromkeys(t[:MAX_TEXT] for t in tags or []))
    if fit != "all" and fit not in fits or review and review not in reasons or len(tags) > MAX_TAGS:
        raise ValueError("unknown fit or reason, or too many tags")
    out = cards
    if fit != "all":
        out = out.where(F.col("fit") == fit)
    if category:
        out = out.where(F.col("category") == category[:MAX_TEXT])
    if tags:
        out = out.where(all_of("tags", tags))
    if source:
        out = out.where(F.exists("sources", lambda s: s["name"] == source[:MAX_TEXT]))
    if mode:
        out = out.where(F.array_contains("tags", mode[:MAX_TEXT]))
    if review:
        out = out.where(F.array_contains("review_reasons", review))
    if text:
        needle = normalize(F.lit(text[:MAX_TEXT]))
        # a generator, so that tags are worked out once and not again in the filter; they are looked at only where the fields do not decide
        columns = out.columns
        out = out.select(*[c for c in columns if c != "tags"], F.inline(F.array(F.struct("tags"))))
        out = out.where(F.when(F.contains(normalize(F.concat_ws(" ", *over)), needle), True).otherwise(F.contains(normalize(F.concat_ws(" ", *[F.right(c, F.lit(MAX_TEXT)) for c in over], F.array_join("tags", " "))), needle))).select(*columns)
    return out


def review_reasons(flags: Column, fit: Column, reasons: dict[str, list[str]]) -> Column:
    """Reasons with any of their flags, in order; none unless the fit is review."""
    found = F.array_compact(F.array(*[F.when(F.arrays_overlap(flags, F.array(*map(F.lit, f))), F.lit(k)) for k, f in reasons.items()]))
    return F.when(fit == "review", found).otherwise(F.array().cast("array<string>"))


def counts(df: DataFrame, column: str, keys: list[str], total: str | None = None) -> DataFrame:
    """Rows of each key, zeros included, and optionally of all, in one aggregation."""
    named = [F.count_if(F.col(column) == k) for k in keys] + ([F.count(F.lit(1))] if total else [])
    labels = keys + ([total] if total else [])
    one = df.agg(*[c.alias(f"n{i}") for i, c in enumerate(named)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"n{i}").alias("n")) for i, k in enumerate(labels)])).alias("x")).select("x.*")


def member_counts(df: DataFrame, column: str, dim: DataFrame, key: str) -> DataFrame:
    """Rows per member of an array column for each key of a dimension, zeros included."""
    got = df.select(F.explode(column).alias(key)).groupBy(key).count()
    return dim.join(got, key, "left").select(key, F.coalesce("count", F.lit(0)).alias("n"))


def candidate(title: Column, senior: str, junior: str, wanted: str) -> Column:
    """Titles to follow: no senior word unless a junior word stands beside it, and a wanted word."""
    bound = lambda p: rf"(?<![\p{{L}}\p{{N}}])(?:{p})(?![\p{{L}}\p{{N}}])"
    return let(normalize(title), lambda plain: (~plain.rlike(bound(senior)) | plain.rlike(bound(junior))) & plain.rlike(bound(wanted)))


def hidden_out(cards: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """Cards without an entry in ``entries``."""
    return cards.join(entries.select(key).distinct(), key, "left_anti")


def personal_view(entries: DataFrame, cards: DataFrame, key: str, fit: str = "all", fits: tuple[str, ...] = FITS, **wanted) -> DataFrame:
    """The cards of a person's entries that meet the conditions of search(), best score first; equal ones in the order of their keys."""
    mine = cards.join(entries.select(key).distinct(), key, "left_semi")
    return search(mine, fit=fit, fits=fits, **wanted).orderBy(F.desc("fit_score"), key)
