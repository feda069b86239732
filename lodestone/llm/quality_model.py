"""Quality classifier: label models over labellers of form and of wording, whose posteriors train a hashed linear scorer."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quality_rules, weak, wording
from .blocks import bucket, byte_blocks, frugal, grams
from .common import arrow_batches, free

#: Buckets of byte grams, and of words beside them.
BITS, WORD_BITS = 12, 11
SIZE = (1 << BITS) + (1 << WORD_BITS)
#: Documents in the fit of the scorer; the label model counts votes over all documents.
MAX_TRAIN = 4000
STEPS, RATE, DECAY = 200, np.float32(4), np.float32(1e-4)


def hashed(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x SIZE: square roots of the shares of byte 1- and 3-grams and of words, hashed.

    The last eight of the grams mark how concentrated the 3-grams are, the last
    eight of the words how dense abuse is.
    """
    return _features(data, offsets)[0]


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """hashed(), and the counts of wording that it needs."""
    rows, size = len(offsets) - 1, (1 << BITS) - 8
    out = np.zeros((rows, SIZE), np.float32)
    for n in (1, 3):
        row, code = grams(data, offsets, n)
        counts = np.bincount(row * size + bucket(code, n, 32) % size, minlength=rows * size).reshape(rows, size)
        share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        out[:, :size] += np.sqrt(share).astype(np.float32)
    level = np.clip(np.log2(1e-6 + (share**2).sum(axis=1)) + 9, 0, 7).astype(int)
    out[np.arange(rows), size + level] = 1
    row, code, _ = found = wording.words(data, offsets)
    size = (1 << WORD_BITS) - 8
    count = np.bincount(row * size + bucket(code, 0, 32) % size, minlength=rows * size).reshape(rows, size)
    out[:, 1 << BITS : (1 << BITS) + size] = np.sqrt(count / np.maximum(count.sum(axis=1, keepdims=True), 1))
    said = wording.counts(found, rows)
    out[np.arange(rows), (1 << BITS) + size + wording.level(said)] = 1
    return out, said


def _vectors(weights: list[float]):
    """A map of texts with the posterior of their form to vectors with that of form and wording."""

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in byte_blocks(batch.column(0), 1 << 18, 64):
                x, said = _features(data, offsets)
                clean = 1 / (1 + np.exp(-(wording.votes(said) @ np.array(weights))))
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(1).slice(a, b - a).to_numpy() * clean), pa.array([v.tobytes() for v in x], pa.binary())], ["p", "x"])

    return run


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    """Logistic regression on soft labels by gradient descent."""
    rows = rows.sort_values(["p", "x"], kind="stable")
    x, p = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(len(rows), -1), rows["p"].to_numpy()
    p, w, b = p.astype(np.float32), np.zeros(x.shape[1], np.float32), np.float32(0)
    for _ in range(STEPS):
        miss = (1 / (1 + np.exp(-(x @ w + b))) - p) / len(p)
        w -= RATE * (x.T @ miss + DECAY * w)
        b -= RATE * miss.sum()
    return pd.DataFrame({"w": [np.append(w, b).astype(np.float64).tobytes()]})


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> np.ndarray:
    """Weights of the scorer: votes of all documents are counted for EM; a hash of id and text picks about max_train different ones for the fit.

    Form and wording have a label model each, as good form says nothing of the
    wording and would outvote it; a document is good if it is so in both.
    """
    arrow_batches(docs.sparkSession)
    labellers = quality_rules.rules()
    names = list(labellers)
    voted = lambda d: quality_rules.features(d, id_col, text_col).select("doc_id", *[v.alias(k) for k, v in labellers.items()])
    patterns = weak.pattern_counts(voted(docs), names)
    total = sum(n for _, n in patterns)
    if not total:
        return np.zeros(SIZE + 1)
    model = weak.fit(patterns, len(names))
    clean = weak.fit(weak.pattern_counts(wording.voted(docs, text_col), list(wording.VOTES)), len(wording.VOTES))
    drawn = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit("quality"))
    picked = docs.where(F.pmod(drawn, F.lit(1 << 20)) / F.lit(1 << 20) < min(1.0, max_train / total))
    picked = picked.select(drawn.alias("h"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).dropDuplicates(["h"]).drop("h")
    labelled = quality_rules.features(picked.withColumn("doc_id", F.struct("doc_id", "text"))).select("doc_id", *[v.alias(k) for k, v in labellers.items()])
    rows = labelled.select("doc_id.text", weak.posterior(model, names).alias("p"))
    found = rows.mapInArrow(_vectors(clean["weights"]), "p double, x binary").groupBy().applyInPandas(_fit, "w binary").collect()
    return np.frombuffer(found[0][0]) if found else np.zeros(SIZE + 1)


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", out_col: str = "quality_score") -> DataFrame:
    """``docs`` with the probability that each whole text is good; nulls count as empty texts.

    One pass without a shuffle. Columns stay, whatever their names; where one is
    called ``out_col``, ours ends in an underscore. Rows may repeat; an empty
    table gives an empty one.
    """
    out_col = free(out_col, docs.columns)
    arrow_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # SIZE + 1 numbers

    def rate(batches):
        frugal()
        w = sent.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            parts = [1 / (1 + np.exp(-(hashed(data, offsets) @ w[:-1] + w[-1]))) for _, _, data, offsets in byte_blocks(column, 1 << 18, 64)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())], [*batch.schema.names, out_col])

    schema = docs.select("*", F.lit(0.0).alias(out_col)).schema
    return docs.mapInArrow(rate, schema)
