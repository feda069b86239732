"""Source divergence audit: how the word use of each source departs from that of the others and of its language.

DuckDB counts terms inside the tasks, first over blocks of texts, then over
shards by language and term, where all rows of a term meet; there it also forms
the partial sums of pairs of sources. Spark deals the shards out and merges sums
and ranks. All arithmetic is on integers.
"""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, cut, small

#: A term is kept in a language if at least so many of its documents hold it.
MIN_DOCS = 3
TOP_TERMS = 200
#: Bytes of text that DuckDB counts at once, rows that a task holds before it sends them, bytes of text and kept rows a shard.
BLOCK_BYTES, HELD_ROWS, SHARD_BYTES, SHARD_ROWS = 2 << 20, 300_000, 8 << 20, 150_000
#: Sources of a language whose pairs one shard sums; beyond it pairs are dealt out in squares of this side.
SIDE = 256
GROUPS = 200_000

_COUNT = r"""
INSERT INTO held SELECT lang, source, term, sum(c)::BIGINT, count(*)::BIGINT FROM (
  SELECT id, lang, source, term, count(*) AS c
  FROM (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM block)
  GROUP BY ALL) GROUP BY ALL
"""
_MERGED = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(d)::BIGINT AS d FROM {} GROUP BY ALL"
_KEPT = f"""
SELECT lang, source, term, n, (sum(n) OVER same)::BIGINT AS total, row_number() OVER (same ORDER BY source) = 1 AS first
FROM ({_MERGED.format("shard")}) WINDOW same AS (PARTITION BY lang, term) QUALIFY sum(d) OVER same >= {MIN_DOCS}
"""
_RATED = """
CREATE TEMP TABLE rated AS SELECT lang, source, term, n, side, i, j, (1 + (1000000000::HUGEINT * (n + 1)) // (size + terms))::BIGINT AS p, 1 + 1000000000 // (size + terms) AS p0,
  (1 + (1000000000::HUGEINT * (total + 1)) // (lang_size + terms))::BIGINT AS q FROM shard
"""
_PARTS = f"""
SELECT 'pair' AS part, a.lang, a.source, b.source AS item, sum(f(a.p, b.p) - f(a.p, b.p0) - f(a.p0, b.p) + f(a.p0, b.p0))::DECIMAL(38, 0) AS value, NULL::BIGINT AS n
FROM rated a JOIN rated b ON a.term = b.term AND a.source <> b.source AND a.side = a.i AND b.side = b.j GROUP BY ALL
UNION ALL
SELECT 'count', lang, source, NULL, count(*)::DECIMAL(38, 0), n FROM rated WHERE i = side AND j = side GROUP BY ALL
UNION ALL
SELECT 'term', lang, source, term, f(p, q)::DECIMAL(38, 0), NULL FROM rated WHERE i = side AND j = side AND p > q
QUALIFY row_number() OVER (PARTITION BY source ORDER BY f(p, q) DESC, term) <= {TOP_TERMS}
"""


def _duck(shard: pa.Table | None = None):
    held = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
    held.sql("CREATE MACRO f(p, q) AS ((p - q) * (p - q)) // q")
    if shard is not None:
        held.register("shard", shard)
    return held


def _blocks(batch: pa.RecordBatch):
    """The batch in slices of about BLOCK_BYTES of text, or of one longer text."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(ends):
        end = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BLOCK_BYTES, "right")))
        yield batch.slice(first, end - first)
        first = end


def _counted(batches):
    """Rows (lang, source, term, n, d) of a task's texts: n occurrences in d documents. What many blocks share is summed up before it is sent."""
    duck = _duck()
    duck.sql("CREATE TABLE held (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, d BIGINT)")

    def send():
        yield from duck.sql(_MERGED.format("held")).to_arrow_reader(100_000)
        duck.sql("DELETE FROM held")

    for batch in batches:
        for part in _blocks(batch):
            duck.register("block", pa.table({"id": pa.array(range(len(part))), **{c: part.column(c) for c in ("lang", "source", "text")}}))
            duck.sql(_COUNT)
            if duck.sql("SELECT count(*) FROM held").fetchall()[0][0] > HELD_ROWS:
                duck.sql(f"CREATE OR REPLACE TABLE held AS {_MERGED.format('held')}")
                if duck.sql("SELECT count(*) FROM held").fetchall()[0][0] > HELD_ROWS // 2:
                    yield from send()
    yield from send()


def _kept(shard: pa.Table) -> pa.Table:
    return _duck(shard).sql(_KEPT).to_arrow_table()


def _summed(shard: pa.Table) -> pa.Table:
    duck = _duck(shard)
    duck.sql(_RATED)
    return duck.sql(_PARTS).to_arrow_table()


def _p(n, size, terms) -> Column:
    return F.lit(1) + F.expr(f"(CAST(1000000000 AS DECIMAL(19, 0)) * ({n} + 1)) DIV ({size} + {terms})")


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: every other source of the language by its divergence over all kept terms;
    part ``term``: up to TOP_TERMS terms that the source uses more than its language does.

    Null text, lang and source count as empty strings. Each row is a document,
    repeated rows too. A group of rows without terms takes part like any other;
    in a language without kept terms all pairs have value 0. A language with one
    source has no pairs. An empty table gives an empty one. Equal values are
    ranked by the item's bytes. Columns other than the three are ignored.

    A term that one of two sources lacks has a fixed p there. So the sum over
    all terms is that over the terms that both hold, corrected by what each
    source's own counts give against the other's fixed p, and rows are needed
    only for terms that occur.
    """
    docs = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    shards = max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES))
    arrow_batches(docs.sparkSession)
    counted = docs.mapInArrow(_counted, "lang string, source string, term string, n long, d long")
    by_term = F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).alias("shard")
    kept = cut(counted.select("*", by_term).groupBy("shard").applyInArrow(_kept, "lang string, source string, term string, n long, total long, first boolean"))

    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = kept.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("terms"), F.sum("n").alias("lang_size"))
    found = docs.select("lang", "source").distinct()
    sides = found.groupBy("lang").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("sides"))
    groups = cut(found.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").join(sides, "lang").fillna(0, ["size", "terms", "lang_size"]))
    known = small(groups, GROUPS)

    shards = max(1, -(-kept.count() // SHARD_ROWS))
    side = F.pmod(F.xxhash64("source"), F.col("sides")).cast("int")
    rows = kept.drop("first").join(known, ["lang", "source"]).withColumn("side", side)
    every = F.sequence(F.lit(0), F.col("sides") - 1)
    squares = F.array_union(F.transform(every, lambda j: F.struct(F.col("side").alias("i"), j.alias("j"))), F.transform(every, lambda i: F.struct(i.alias("i"), F.col("side").alias("j"))))
    rows = rows.withColumn("at", F.explode(squares)).select("lang", "source", "term", "n", "total", "size", "terms", "lang_size", "side", "at.i", "at.j", F.pmod(F.xxhash64("term"), F.lit(shards)).alias("shard"))
    parts = cut(rows.groupBy("lang", "i", "j", "shard").applyInArrow(_summed, "part string, lang string, source string, item string, value decimal(38,0), n long"))

    one = known.where("terms > 0").select("lang", F.col("source").alias("other"), _p("0L", "size", "terms").alias("other0"), F.col("size").alias("other_size"))
    counts = parts.where("part = 'count'").groupBy("lang", "source", "n").agg(F.sum("value").cast("long").alias("times"))
    counts = counts.join(known.select("lang", "source", "size", "terms"), ["lang", "source"]).withColumns({"p": _p("n", "size", "terms"), "p0": _p("0L", "size", "terms")})
    facing = counts.join(one, "lang").where("source <> other")
    here = F.col("times").cast("decimal(19,0)") * (_f(F.col("p"), F.col("other0")) - _f(F.col("p0"), F.col("other0")))
    there = F.col("times").cast("decimal(19,0)") * (_f(F.col("other0"), F.col("p")) - _f(F.col("other0"), F.col("p0")))
    both = F.array(F.struct(F.col("source"), F.col("other").alias("item"), here.cast("decimal(38,0)").alias("value")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"), there.cast("decimal(38,0)").alias("value")))
    alone = facing.select("lang", F.explode(both).alias("x")).select("lang", "x.*")

    left, right = groups.select("lang", "source", "terms", "size"), known.select("lang", F.col("source").alias("item"), F.col("size").alias("item_size"))
    base = _f(_p("0L", "size", "terms"), _p("0L", "item_size", "terms"))
    floor = left.join(right, "lang").where("source <> item").select("lang", "source", "item", F.when(F.col("terms") == 0, F.lit(0)).otherwise(F.col("terms").cast("decimal(19,0)") * base).cast("decimal(38,0)").alias("value"))
    sums = floor.unionByName(alone).unionByName(parts.where("part = 'pair'").select("lang", "source", "item", "value"))
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    every = pairs.unionByName(parts.where("part = 'term'").select("lang", "source", "item", "value", "part"))
    ranked = every.withColumn("value", F.col("value").cast("long")).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= TOP_TERMS)).select("lang", "source", "part", "item", "value", "rank")
