"""Job postings in the JSON-LD scripts of a page, read as variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .elements import find, mark, raw_text
from .text import let

#: Arrays and graphs that may lie around a posting.
DEPTH = 4
SCRIPT = mark("script", attr="type", value="application/ld+json")


def _is_posting(value: Column) -> Column:
    one, many = F.try_variant_get(value, "$['@type']", "string"), F.try_variant_get(value, "$['@type']", "array<string>")
    return F.coalesce(F.when(many.isNotNull(), F.array_contains(many, "JobPosting")).otherwise(one == "JobPosting"), F.lit(False))


def _opened(held: Column) -> Column:
    """Each array replaced by its values, and each object not looked into yet by itself and what its graph holds, in their order."""
    entry = lambda v, done: F.struct(v.alias("v"), F.lit(done).alias("done"))

    def one(x: Column) -> Column:
        values, graph = F.try_variant_get(x["v"], "$", "array<variant>"), F.try_variant_get(x["v"], "$['@graph']", "variant")
        return F.when(x["done"], F.array(x)).when(values.isNotNull(), F.transform(values, lambda v: entry(v, False))).when(graph.isNotNull(), F.array(entry(x["v"], True), entry(graph, False))).otherwise(F.array(entry(x["v"], True)))

    return F.flatten(F.transform(held, one))


def posting(nodes: Column) -> Column:
    """The first posting of a page as a variant, through arrays and graphs to DEPTH; null where there is none. Scripts that are no JSON count as empty."""
    scripts = let(nodes, lambda n: F.transform(find(n, SCRIPT), lambda s: F.struct(F.try_parse_json(raw_text(n, s)).alias("v"), F.lit(False).alias("done"))))
    held = F.filter(scripts, lambda x: x["v"].isNotNull())
    for _ in range(DEPTH):
        held = let(held, _opened)
    return F.get(F.filter(held, lambda x: _is_posting(x["v"])), F.lit(0))["v"]


def field(found: Column, path: str, kind: str = "string") -> Column:
    """A value of a posting; null where it is absent, of another kind, or an empty text."""
    got = F.try_variant_get(found, path, kind)
    return F.when(got != "", got) if kind == "string" else got


def places(found: Column) -> Column:
    """The towns of a posting's one or many locations, comma-joined; empty where there are none."""
    many = F.coalesce(F.try_variant_get(found, "$.jobLocation", "array<variant>"), F.array(F.try_variant_get(found, "$.jobLocation", "variant")))
    towns = F.transform(many, lambda v: F.try_variant_get(v, "$.address.addressLocality", "string"))
    return F.coalesce(F.array_join(F.filter(towns, lambda t: F.coalesce(t != "", F.lit(False))), ", "), F.lit(""))
