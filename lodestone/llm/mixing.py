"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, plain_words, small

#: Weights of the sources in their order, repeating, and how often a source may be gone through.
WEIGHTS, EPOCHS = (1, 2, 3), 3
#: Words of a block.
BLOCK = 2048
#: Documents of a source, and slots of a schedule, that one running count goes over.
RUN = 8192
SOURCES = 100_000


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size and target of each source; null is a source, the last one.

    Weights follow the sources in the order of their code points. A source that
    its share would bring over ``epochs`` times its size gets just that, and the
    rest is shared by weight among the others. Sources fill up in the order of
    their limit for each unit of weight, so source k is full if and only if its
    limit is at most its share of what the sources before it leave. All of it is
    integer arithmetic until the last division. The windows go over one small
    row a source.
    """
    each = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(place - 1, F.lit(len(weights))) + 1).cast("decimal(12,0)")
    limit = (F.col("source_size") * epochs).cast("decimal(25,0)")
    each = each.select("source", "source_size", weight.alias("weight"), limit.alias("limit"))
    before = Window.orderBy(F.col("limit") / F.col("weight"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    full = lambda c: F.sum(c).over(Window.partitionBy()).cast("decimal(25,0)")
    each = each.select("*", (full("source_size") - F.coalesce(F.sum("limit").over(before), F.lit(0))).cast("decimal(25,0)").alias("left"), (full("weight") - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("decimal(12,0)").alias("among"))
    capped = F.col("limit") * F.col("among") <= F.col("weight") * F.col("left")
    each = each.withColumn("capped", capped)
    free = F.max(F.when(~F.col("capped"), F.struct(F.col("among"), F.col("left")))).over(Window.partitionBy())
    share = (F.col("weight") * free["left"]).cast("double") / free["among"].cast("double")
    return each.select("source", "source_size", F.when(F.col("capped"), F.col("limit").cast("double")).otherwise(share).alias("target"))


def _earlier(rows: DataFrame, stretch: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of the same ``number`` before each, by ``order``.

    Stretches follow one another in that order. Rows are sorted within their
    stretch only; over the whole source only the sums of stretches are added up.
    """
    rows = rows.withColumn("__stretch", stretch)
    run = Window.partitionBy("number").orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy("number", "__stretch").agg(F.sum(value).alias("__sum")).select("number", "__stretch", F.coalesce(F.sum("__sum").over(run), F.lit(0)).alias("__head"))
    inside = Window.partitionBy("number", "__stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(small(heads, SOURCES), ["number", "__stretch"]).withColumn(name, F.col(name) + F.col("__head")).drop("__stretch", "__head")


def bit_reversed(place: Column, bits: int) -> Column:
    """The van der Corput point of a number below 2**bits, times 2**bits: its binary digits in reverse."""
    return F.conv(F.reverse(F.lpad(F.bin(place), bits, "0")), 2, 10).cast("long")


class Mix:
    """A mix of documents by source, planned over one pass over the texts.

    Each row of ``docs`` is a document, repeated rows too; null ids, sources and
    texts are allowed, and columns other than these three are ignored. A
    document without words is in no block. An empty table gives empty results.
    The order within a source is that of a hash of id and text, so reruns agree;
    rows alike in both are interchangeable.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, block: int = BLOCK):
        self.block, self.epochs = block, epochs
        key = F.md5(F.concat_ws(" ", F.lit("mix"), F.col(id_col).cast("string"), F.md5(F.col(text_col))))
        size = F.size(plain_words(F.col(text_col))).cast("long")
        sized = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key")))
        goals = targets(sized, weights, epochs).withColumn("goal", F.floor(F.col("target") + 0.5))
        #: number, source, source_size, target and goal (the target in whole words) of each source.
        self.sources = cut(goals.withColumn("number", F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))))
        each = small(self.sources.withColumnRenamed("source", "__source"), SOURCES)
        #: The documents with their source's numbers.
        self.docs = sized.join(each, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")

    def streams(self) -> DataFrame:
        """Documents with words in the shuffled order of their source: ``start`` is the number of the source's words before each."""
        parts = F.ceil(F.count("*") / F.lit(RUN))
        each = self.docs.where("size > 0")
        each = each.join(small(each.groupBy("number").agg(parts.alias("parts")), SOURCES), "number")
        stretch = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("parts") / F.lit(1 << 32))
        return _earlier(each, stretch, ["key"], F.col("size"), "start").drop("parts", "key")

    def pieces(self, streams: DataFrame) -> DataFrame:
        """Which words of which document each block of a source holds. A source is gone through again from its start until its goal is met."""
        passes = streams.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(self.epochs - 1)))).withColumn("low", F.col("epoch") * F.col("source_size") + F.col("start"))
        passes = passes.withColumn("high", F.least(F.col("low") + F.col("size"), F.col("goal"))).where("low < high")
        blocks = passes.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / self.block), F.floor((F.col("high") - 1) / self.block))))
        low = F.greatest(F.col("low"), F.col("block") * self.block)
        return blocks.select("number", "block", "doc_id", "size", "start", "source", "source_size", "target", (low - F.col("low")).alias("first"), (F.least(F.col("high"), (F.col("block") + 1) * self.block) - low).alias("words"))

    def slots(self) -> DataFrame:
        """The schedule: ``slot``, the source ``number`` it goes to, and ``block``, its rank among the source's slots.

        The cumulative weights, in blocks, cut the line of 2**bits places into
        one interval a source. Slot s goes to the source in whose interval its
        van der Corput point lies; places beyond the last interval are no slots.
        Reversing bits is its own inverse, so the slots of a source are the
        reversed places of its interval: each source gets as many as its goal
        has blocks, spread evenly over every stretch of the schedule.
        """
        need = F.ceil(F.col("goal") / F.lit(self.block))
        each = self.sources.select("number", need.alias("need")).where("need > 0")
        each = each.withColumn("first", F.sum("need").over(Window.orderBy("number")) - F.col("need"))
        bits = max(1, int((each.agg(F.sum("need")).first()[0] or 1) - 1).bit_length())
        runs = each.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("need") - 1) / RUN)))).repartition("number", "run")
        place = F.explode(F.sequence(F.col("first") + F.col("run") * RUN, F.col("first") + F.least(F.col("need"), (F.col("run") + 1) * RUN) - 1))
        slots = runs.select("number", place.alias("place")).select("number", bit_reversed(F.col("place"), bits).alias("slot"))
        return _earlier(slots, F.floor(F.col("slot") / RUN), ["slot"], F.lit(1), "block")

    def schedule(self, streams: DataFrame | None = None) -> DataFrame:
        """The mix: for each slot, the pieces of documents in its block: doc_id, first (word of the document) and words."""
        return self.slots().join(self.pieces(self.streams() if streams is None else streams), ["number", "block"])

    def taken(self) -> DataFrame:
        """Per document: doc_id, size, source_size, target (its source's) and taken (words that the schedule takes, repeats counted)."""
        columns = ["doc_id", "size", "source_size", "target"]
        streams = cut(self.streams())
        held = self.schedule(streams).select(*columns, "number", "start", "words").unionByName(streams.select(*columns, "number", "start", F.lit(0).cast("long").alias("words")))
        counted = held.groupBy("number", "start", *columns).agg(F.sum("words").alias("taken")).select(*columns, "taken")
        return counted.unionByName(self.docs.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken")))
