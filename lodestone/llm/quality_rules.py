"""Quality rules under weak supervision: rules vote or abstain, EM weighs them, a posterior decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import weak
from .common import cut, let, plain_words

SYMBOLS = "#*$%&|<>"
WINDOW = 5


def repeated_words(words: Column) -> Column:
    """Words inside 5-word windows that occur at least twice in the array, first occurrence included.

    Windows are compared by a 64-bit hash. Without a repeated window, as in most
    texts, only a distinct count runs; else windows are sorted with their
    positions, so that the cost stays n log n for texts of any length.
    """
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    gap = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    same = lambda s, e, i: F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False))
    found = lambda h: let(
        F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        lambda s: let(F.sort_array(F.transform(F.filter(s, lambda e, i: same(s, e, i)), lambda e: e["i"])), gap),
    )
    return F.when(F.size(words) < WINDOW, 0).otherwise(let(hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(found(h)))).cast("long")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document; a null text counts as an empty one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), plain_words(text).alias("words"))
    split = split.select("doc_id", "text", "words", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    return split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("text", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        (F.length("text") - F.length(F.translate("text", "!", ""))).cast("long").alias("n_shouts"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
    )


def rules() -> dict[str, Column]:
    """The default rules over features(): each votes good (1), bad (-1) or abstains (0).

    Failures vote bad and their absence abstains; two rules vote for prose.
    """
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    symbols, upper, mean = F.col("n_symbols") / chars, F.col("n_upper") / chars, F.col("word_chars") / words
    repeat, shouts = F.col("n_repeat_words") / words, F.col("n_shouts") / words
    fresh = F.col("n_distinct") / words
    letters, lines = F.col("n_letters") / chars, F.greatest("n_lines", F.lit(1))
    long = F.col("n_words") >= 30
    return {
        "v_symbols": F.when(symbols > 0.05, -1).otherwise(0),
        "v_letters": F.when(long & (letters < 0.85), -1).when((letters > 0.92) & (repeat < 0.2), 1).otherwise(0),
        "v_upper": F.when(upper > 0.4, -1).otherwise(0),
        "v_shouts": F.when(shouts > 0.3, -1).otherwise(0),
        "v_repeat": F.when(long & (repeat > 0.2), -1).otherwise(0),
        "v_fresh": F.when(long & (fresh < 0.1), -1).otherwise(0),
        "v_lines": F.when(F.col("n_dup_lines") > 0.3 * lines, -1).otherwise(0),
        "v_mean": F.when((mean < 2) | (mean > 14), -1).otherwise(0),
        "v_prose": F.when(long & (repeat < 0.05) & (symbols < 0.02) & (upper < 0.15), 1).otherwise(0),
    }


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Features, votes, posterior quality and verdict of each document.

    One pass over the texts gives narrow rows, kept in the shared folder; the
    counts of vote patterns over all of them feed EM, and its weights turn the
    votes into a posterior without a join. ``base_failed`` documents are never
    kept. Null texts count as empty; repeated rows are judged each; an empty
    table gives an empty result; other columns are ignored.
    """
    votes = rules()
    names = list(votes)
    rows = cut(features(docs, id_col, text_col).select("*", *[v.alias(k) for k, v in votes.items()]))
    model = weak.fit(weak.pattern_counts(rows, names), len(names))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = rows.select("*", weak.posterior(model, names).alias("quality"), failed.alias("base_failed"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
