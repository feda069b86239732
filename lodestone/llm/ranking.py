"""Ranked lexical search by WAND: each shard of documents finds its best for every item, and the heaps of the shards are merged."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import alnum_words, arrow_batches, cut

TOP = 50
#: Distinct terms of items that one pass over the documents looks for; more items go in further passes.
ITEM_TERMS = 200_000
#: One in so many documents is searched first, for scores that the others must reach.
SEED_SHARE = 16
#: Postings that a shard holds at once.
SHARD_POSTINGS = 1_000_000
#: What the bytes of a text become: ASCII letters lower-case, other bytes of terms themselves, separators a space.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def _vectors(known, batches):
    """Per document with a term: how many terms it has, and which of the items' terms how often."""
    numbers = known.value
    for batch in batches:
        size, terms, counts = [], [], []
        for text in batch.column(1).cast(pa.large_binary()):
            words = (text.as_py() or b"").translate(_BYTES).split()
            which, times = np.unique([k for w in words if (k := numbers.get(w)) is not None], return_counts=True)
            size.append(len(words))
            terms.append(which.astype(np.int32))
            counts.append(times)
        out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "size", "terms", "counts"])
        yield out.filter(pc.greater(out.column("size"), 0))


def best(lists: list[tuple[list[int], list[int], int]], k: int, least: int) -> list[tuple[int, int]]:
    """(score, document) of the k documents of highest score, of those that reach ``least``; of equal scores the smaller number goes first.

    ``lists`` has for each term its documents in ascending order, their impacts
    and the largest impact. The pivot is the first document at which the largest
    impacts of the terms that may hold it add up to more than the threshold:
    none before it can enter the heap, so all lists skip to it.
    """
    heap: list[tuple[int, int]] = []
    threshold = max(least, 1) - 1
    live = sorted((docs[0], j, 0) for j, (docs, _, _) in enumerate(lists))
    while live:
        bound = 0
        for place, (pivot, j, _) in enumerate(live):
            bound += lists[j][2]
            if bound > threshold:
                break
        else:
            break
        score, moved = 0, []
        for n, (doc, j, at) in enumerate(live):
            if n > place and doc > pivot:
                moved += live[n:]
                break
            docs, impacts, _ = lists[j]
            if doc < pivot:
                at = bisect_left(docs, pivot, at)
            if at < len(docs) and docs[at] == pivot:
                score += impacts[at]
                at += 1
            if at < len(docs):
                moved.append((docs[at], j, at))
        if score > threshold:
            (heapq.heappushpop if len(heap) == k else heapq.heappush)(heap, (score, -pivot))
            if len(heap) == k:
                threshold = max(threshold, heap[0][0])
        live = sorted(moved)
    return sorted(((score, -doc) for score, doc in heap), key=lambda x: (-x[0], x[1]))


def _searched(sent, k: int, batches):
    """The best documents of each shard for each item. A shard is what a task reads, or as much of it as SHARD_POSTINGS."""
    docs, total, weights, items, least = sent.value

    def shard(held: pa.Table):
        held = held.take(pc.sort_indices(held, [("doc_id", "ascending")], null_placement="at_end")).combine_chunks()
        size, counts = held["size"].to_numpy(), held["counts"].combine_chunks()
        doc = np.repeat(np.arange(len(held)), np.diff(counts.offsets.to_numpy()))
        term, tf = held["terms"].combine_chunks().flatten().to_numpy(), counts.flatten().to_numpy()
        order = np.argsort(term, kind="stable")
        term, doc, tf = term[order], doc[order], tf[order]
        impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * (50 + (50 * size * docs) // total)[doc]))
        first = np.searchsorted(term, np.arange(len(weights) + 1))
        lists = {t: (doc[a:b].tolist(), impact[a:b].tolist(), int(impact[a:b].max())) for t in range(len(weights)) if (a := first[t]) < (b := first[t + 1]) and weights[t] > 0}
        found = [(n, score, d) for n, terms in enumerate(items) for score, d in best([lists[t] for t in terms if t in lists], k, least[n])]
        item, score, place = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), held["doc_id"].combine_chunks().take(pa.array(place)), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    held, postings = [], 0
    for batch in batches:
        held.append(batch)
        postings += len(batch.column("terms").flatten())
        if postings >= SHARD_POSTINGS:
            yield shard(pa.Table.from_batches(held))
            held, postings = [], 0
    if held:
        yield shard(pa.Table.from_batches(held))


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the k documents of highest score above 0 for each item, ranked against all documents.

    Null and empty texts have no terms: such documents and items are in no row.
    Each row of ``docs`` is a document, repeated rows too; rows of ``items``
    that share an id are one item with the terms of all. Equal scores are ranked
    by ascending id, null ids last. Empty tables give an empty one. Columns
    other than ids and texts are ignored.

    A first search over one document in SEED_SHARE gives each item a score that
    k documents reach, so no document below it can be among the best of all.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    wanted = cut(items.select(F.col(item_col).alias("item_id"), F.explode(F.array_distinct(alnum_words(F.col(item_text_col)))).alias("term")).distinct())
    passes = max(1, -(-wanted.count() // ITEM_TERMS))
    out = None
    for turn in range(passes):
        # one block of items with their terms; a block holds about ITEM_TERMS terms, or one longer item
        block = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == turn).groupBy("item_id").agg(F.collect_list("term").alias("terms")).collect()
        found = _block(texts, wanted.select("item_id").schema, {r[0]: r[1] for r in block}, k)
        out = found if out is None else out.unionByName(found)
    return out


def _block(texts: DataFrame, item_schema: StructType, items: dict, k: int) -> DataFrame:
    """The ranked documents of one block of items."""
    spark, kind = texts.sparkSession, dict(texts.dtypes)["doc_id"]
    terms = sorted({t for held in items.values() for t in held})
    number = {t: n for n, t in enumerate(terms)}
    arrow_batches(spark)
    known = spark.sparkContext.broadcast({t.encode(): n for t, n in number.items()})
    vectors = cut(texts.mapInArrow(lambda batches: _vectors(known, batches), f"doc_id {kind}, size long, terms array<int>, counts array<long>"))
    count, total = vectors.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    df = np.zeros(len(terms), np.int64)
    for n, times in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each of the block's terms at most
        df[n] = times
    weights = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    names = list(items)
    held = [[number[t] for t in items[i]] for i in names]

    def heaps(rows: DataFrame, least: list[int]) -> DataFrame:
        sent = spark.sparkContext.broadcast((count, total, weights, held, least))
        found = rows.mapInArrow(lambda batches: _searched(sent, k, batches), f"item int, doc_id {kind}, score long")
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    seed = vectors.where(F.pmod(F.xxhash64("doc_id"), F.lit(SEED_SHARE)) == 0)
    least = [0] * len(held)
    for n, score in heaps(seed, least).where(F.col("rank") == k).select("item", "score").collect():  # a row an item
        least[n] = score
    ids = spark.createDataFrame([(n, i) for n, i in enumerate(names)], StructType([StructField("item", IntegerType()), *item_schema]))
    return heaps(vectors, least).join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")
