"""Benchmark decontamination over a positional inverted index of the training tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, cut, let, small

WINDOW = 10
#: Item words kept together; longer items are cut into segments that overlap by a window.
SEGMENT = 64
#: Most rows of a table derived from the test set that may be broadcast, if their size is small too; beyond it, joins shuffle.
BROADCAST_ROWS = 100_000


def token_stream(docs: DataFrame) -> DataFrame:
    """One row (doc_id, pos, term) for each training token."""
    return docs.select("doc_id", F.posexplode(alnum_words(F.col("text"))).alias("pos", "term"))


def segments(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Item words in segments: (seg, item_id, words, width), where width is the window's length."""
    words = items.select("item_id", alnum_words(F.col("text")).alias("w")).where(F.size("w") > 0).withColumn("width", F.least(F.size("w"), F.lit(window)))
    starts = words.select("item_id", "width", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("width"), F.lit(SEGMENT))).alias("at"))
    part = starts.select("item_id", "width", "at", F.slice("w", F.col("at") + 1, SEGMENT + F.col("width") - 1).alias("words"))
    return part.select(F.xxhash64("item_id", "at", "words").alias("seg"), "item_id", "width", "words").distinct()


def leads(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """Each segment's windows with the offsets of their two rarest terms in the corpus.

    Returns (seg, item_id, width, words, windows array<struct<k, a, b>>). A
    window with a term that the corpus lacks cannot occur and is left out.
    """
    terms = parts.select("seg", "width", F.size("words").alias("len"), F.posexplode("words").alias("o", "term")).join(counts, "term")
    over = F.sequence(F.greatest(F.lit(0), F.col("o") - F.col("width") + 1), F.least(F.col("o"), F.col("len") - F.col("width")))
    each = terms.select("seg", "width", F.explode(over).alias("k"), F.struct("n", "o").alias("x"))
    ranked = each.groupBy("seg", "width", "k").agg(F.sort_array(F.collect_list("x")).alias("x")).where(F.size("x") == F.col("width"))
    heads = F.struct("k", F.get("x", 0)["o"].alias("a"), F.coalesce(F.get("x", 1)["o"], F.get("x", 0)["o"]).alias("b"))
    return parts.join(ranked.groupBy("seg").agg(F.collect_list(heads).alias("windows")), "seg").select("seg", "item_id", "width", "words", "windows")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: (term, doc_id, pos) for the given terms, kept in the shared folder."""
    return cut(token_stream(docs).join(small(terms.select("term").distinct(), BROADCAST_ROWS), "term").select("term", "doc_id", "pos"))


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Candidate diagonals (doc_id, item_id, shift, words, width, ks) whose windows have both lead terms in place.

    Frequencies of the test terms over the whole corpus name each window's two
    rarest terms; only their postings are stored. Lists are adjusted by their
    offset in the item and intersect on (document, segment, shift).
    """
    parts = cut(segments(items, window))
    terms = small(parts.select(F.explode("words").alias("term")).distinct(), BROADCAST_ROWS)
    counts = cut(token_stream(docs).join(terms, "term").groupBy("term").agg(F.count("*").alias("n")))
    led = cut(leads(parts, counts))
    heads = led.select("seg", "words", F.explode("windows").alias("w")).select("seg", F.explode(F.array("w.a", "w.b")).alias("o"), "words").select("seg", "o", F.get("words", F.col("o")).alias("term")).distinct()
    index = postings(docs, heads)
    diagonals = index.join(small(heads, BROADCAST_ROWS), "term").groupBy("doc_id", "seg", (F.col("pos") - F.col("o")).alias("shift")).agg(F.collect_set("o").alias("found"))
    placed = diagonals.join(small(led, BROADCAST_ROWS), "seg")
    ks = F.transform(F.filter("windows", lambda w: F.array_contains("found", w["a"]) & F.array_contains("found", w["b"])), lambda w: w["k"])
    return placed.select("doc_id", "item_id", "shift", "words", "width", ks.alias("ks")).where(F.size("ks") > 0)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, hits (word positions inside a benchmark window), items (their ids).

    Candidates come from the index; each is compared word by word with its
    document, so matches are exact. Null texts have no words; an item without
    words matches nothing; an empty table on either side gives no hits. Rows
    that repeat a doc_id are compared each with its own text; a null doc_id is a
    key like any other. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    found = matches(docs, items, window)
    listed = found.groupBy(F.col("doc_id").alias("key")).agg(F.collect_list(F.struct("item_id", "shift", "words", "width", "ks")).alias("near"))
    both = docs.join(listed, F.col("doc_id").eqNullSafe(F.col("key")), "left").select("doc_id", "text", "near")

    def rate(words):
        here = lambda c, k: F.forall(F.sequence(F.lit(0), c["width"] - 1), lambda j: F.get(c["words"], k + j) == F.coalesce(F.get(words, c["shift"] + k + j), F.lit("")))
        tried = F.transform("near", lambda c: F.struct(c["item_id"].alias("item_id"), c["shift"].alias("shift"), c["width"].alias("width"), F.filter(c["ks"], lambda k: here(c, k)).alias("ks")))
        return F.struct(F.size(words).cast("long").alias("n_words"), F.filter(tried, lambda c: F.size(c["ks"]) > 0).alias("exact"))

    # the words are bound once a row: a column of words would be split again for every word that is compared
    rated = both.select("doc_id", let(alnum_words(F.col("text")), rate).alias("rated"))
    exact = F.coalesce(F.col("rated.exact"), F.array())
    at = F.flatten(F.transform(exact, lambda c: F.flatten(F.transform(c["ks"], lambda k: F.sequence(c["shift"] + k, c["shift"] + k + c["width"] - 1)))))
    return rated.select("doc_id", F.col("rated.n_words").alias("n_words"), F.array_sort(F.array_distinct(at)).alias("hits"), F.array_distinct(F.transform(exact, lambda c: c["item_id"])).alias("items"))


def proximity(docs: DataFrame, items: DataFrame, slop: int = 3, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Proximity matches (doc_id, item_id, pos): a window's two rarest terms at their distance give or take ``slop`` words.

    Both posting lists are dealt into cells of slop words, so the join is on
    equal keys and yields only neighbours.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    parts = cut(segments(items, window))
    counts = token_stream(docs).join(small(parts.select(F.explode("words").alias("term")).distinct(), BROADCAST_ROWS), "term").groupBy("term").agg(F.count("*").alias("n"))
    led = cut(leads(parts, cut(counts)))
    pairs = led.select("item_id", "words", F.explode("windows").alias("w")).select("item_id", F.get("words", F.col("w.a")).alias("ta"), F.get("words", F.col("w.b")).alias("tb"), (F.col("w.b") - F.col("w.a")).alias("gap")).distinct()
    index = postings(docs, pairs.select(F.explode(F.array("ta", "tb")).alias("term")))
    cell = slop + 1
    left = index.join(small(pairs, BROADCAST_ROWS), F.col("term") == F.col("ta")).select("doc_id", "item_id", "tb", "pos", (F.col("pos") + F.col("gap")).alias("want"))
    left = left.select("*", F.explode(F.array(*[F.floor(F.col("want") / cell) + d for d in (-1, 0, 1)])).alias("cell"))
    right = index.select(F.col("doc_id").alias("d"), F.col("term").alias("t"), F.col("pos").alias("p"), F.floor(F.col("pos") / cell).alias("c"))
    near = left.join(right, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tb") == F.col("t")) & (F.col("cell") == F.col("c")) & (F.abs(F.col("p") - F.col("want")) <= slop))
    return near.select("doc_id", "item_id", "pos").distinct()
