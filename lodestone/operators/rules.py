"""Rules as data: categories, skills and languages in a table that can be changed without code, under a version that follows from it."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexicon as lex

#: Version of the built-in rules; tables with other ones have a version of their own, far above it.
VERSION = 9
SCHEMA = "kind string, rank int, field string, pattern string, label string"
#: Most rows of a table of rules: each is an expression of the plan.
MOST = 2_000


@dataclass(frozen=True)
class Rules:
    """Categories (label, pattern in titles, pattern in duties) in the order of matching, skills and languages by label."""

    categories: tuple[tuple[str, str, str], ...] = tuple(lex.CATEGORIES)
    skills: dict[str, str] = field(default_factory=lambda: dict(lex.SKILLS))
    languages: dict[str, str] = field(default_factory=lambda: dict(lex.LANGUAGES))

    def rows(self) -> list[tuple]:
        out = [("category", i, f, p, k) for i, (k, t, b) in enumerate(self.categories) for f, p in (("title", t), ("duties", b))]
        return out + [(kind, i, "any", p, k) for kind, held in (("skill", self.skills), ("language", self.languages)) for i, (k, p) in enumerate(held.items())]

    @property
    def version(self) -> int:
        """A number for just these rules: rows that were analysed under others are due again."""
        mine = repr(self.rows())
        return VERSION if mine == repr(Rules().rows()) else 1_000_000 + zlib.crc32(mine.encode()) % 1_000_000_000


def table(spark: SparkSession, rules: Rules | None = None) -> DataFrame:
    """(kind, rank, field, pattern, label): a row a pattern. Categories have one for title and one for duties."""
    return spark.createDataFrame((rules or Rules()).rows(), SCHEMA)


def read(rules: DataFrame) -> Rules:
    """The rules of a table, in the order of their ranks. Rows of unknown kind or field, patterns that cannot be read and more than MOST rows raise ValueError."""
    held = rules.select("kind", "rank", "field", "pattern", "label").orderBy("kind", "rank", "field", "label").limit(MOST + 1).collect()
    fields = {"category": ("title", "duties"), "skill": ("any",), "language": ("any",)}
    if len(held) > MOST:
        raise ValueError(f"more than {MOST} rules")
    for r in held:
        if r["field"] not in fields.get(r["kind"], ()) or not r["pattern"] or not r["label"]:
            raise ValueError(f"no rule: {r}")
    spark = rules.sparkSession
    try:
        spark.range(1).select(*[F.lit("").rlike(p) for p in sorted({r["pattern"] for r in held})]).collect()
    except Exception as error:
        raise ValueError(f"a pattern cannot be read: {str(error)[:300]}") from error
    categories: dict[str, dict[str, str]] = {}
    for r in held:
        if r["kind"] == "category":
            categories.setdefault(r["label"], {})[r["field"]] = r["pattern"]
    never = r"(?!)"
    of = lambda kind: {r["label"]: r["pattern"] for r in held if r["kind"] == kind}
    return Rules(tuple((k, c.get("title", never), c.get("duties", never)) for k, c in categories.items()), of("skill"), of("language"))
