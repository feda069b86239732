"""Visible text and links of pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .elements import Tree, elements, find, let_nodes, mark, raw_text
from .text import clean

# Closure notices.
CLOSED = r"(?:acest (?:anunt|job|loc de munca)|(?:anuntul|vacanta|pozitia)(?: de angajare)?|oferta)(?:\s+\S+){0,4}\s+(?:nu mai este (?:activ|disponibil)|a expirat|este (?:inchis[ăa]?|inactiv[ăa]?|expirat[ăa]?|arhivat[ăa]?))|(?:this (?:job|vacancy|position)|job (?:posting|offer)|vacancy)(?:\s+\S+){0,3}\s+(?:has expired|is (?:closed|no longer available|inactive|archived)|has been (?:closed|removed))|(?:вакансия|объявление)(?:\s+\S+){0,3}\s+(?:закрыта|закрыто|неактивна|неактивно|удалена|удалено|в архиве|больше не (?:актуальна|доступна))|(?:anunt|vacanta|job|vacancy) (?:not found|indisponibil[ăa]?|inexistent[ăa]?)|вакансия не найдена"


def _texts(pages: pd.Series) -> pd.Series:
    return pages.fillna("").map(lambda page: Tree(page).text())


def html_to_text(page: Column) -> Column:
    """Visible text of each page, a line a block; null counts as empty."""
    return clean(F.pandas_udf(_texts, "string")(page))


def text_of(value: Column) -> Column:
    """Text of a value that may be markup: only values with something like a tag are sent to the parser."""
    markup = value.rlike(r"(?i)</?[a-z][^>]*>")
    return F.when(markup, html_to_text(F.when(markup, value))).otherwise(F.coalesce(value, F.lit("")))


def listing_links(page: Column) -> Column:
    """Links of each page in order, with their texts on one line."""

    def one(nodes: Column) -> Column:
        line = lambda n: F.trim(F.regexp_replace(raw_text(nodes, n), r"\s+", " "))
        return F.transform(find(nodes, mark("a")), lambda n, i: F.struct(i.alias("pos"), F.coalesce(n["attrs"]["href"], F.lit("")).alias("link"), line(n).alias("title")))

    return let_nodes(elements(page), one)
