"""Language identification by a blended-spectrum presence kernel, Nyström landmarks and one-versus-rest kernel ridge regression."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import bucket, byte_blocks, grams
from .common import arrow_batches

SPECTRUM = (1, 2, 3, 4)
BITS = 15
#: Labelled rows in the fit, shared out evenly among the languages, and landmarks among them.
MAX_TRAIN = 2000
LANDMARKS = 256
RIDGE = 1e-3


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x 2**BITS matrix of which n-gram buckets occur."""
    rows = len(offsets) - 1
    seen = np.zeros(rows << BITS, np.uint8)
    for n in SPECTRUM:
        row, code = grams(data, offsets, n)
        seen[(row << BITS) + bucket(code, n, BITS)] = 1
    return seen.reshape(rows, 1 << BITS)


def _packed(batches):
    for batch in batches:
        for a, b, data, offsets in byte_blocks(batch.column(0), 1 << 18, 64):
            bits = np.packbits(presence(data, offsets), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array([r.tobytes() for r in bits], pa.binary())], ["lang", "bits"])


def _unit(bits: list[bytes]) -> np.ndarray:
    x = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1).astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    """Kernel ridge on Nyström features, folded into one weight per bucket and language."""
    rows = rows.sort_values(["lang", "bits"], kind="stable").reset_index(drop=True)
    langs = sorted(rows["lang"].unique())
    turn = rows.groupby("lang").cumcount()
    bits = rows["bits"].tolist()
    z = _unit([bits[i] for i in np.lexsort((rows["lang"], turn))[:LANDMARKS]])
    kmm = (z @ z.T).astype(np.float64)
    values, vectors = np.linalg.eigh(kmm)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.vstack([_unit(bits[i : i + 64]) @ z.T for i in range(0, len(bits), 64)]).astype(np.float64) @ root
    target = (rows["lang"].to_numpy()[:, None] == np.array(langs)[None, :]).astype(np.float64)
    weight = 1 / np.maximum(target.sum(axis=0), 1)[np.argmax(target, axis=1)]
    gram = phi.T @ (phi * weight[:, None]) + RIDGE * np.eye(phi.shape[1])
    alpha = root @ np.linalg.solve(gram, phi.T @ (target * weight[:, None]))
    folded = (z.T.astype(np.float64) @ alpha).astype(np.float32)
    return pd.DataFrame({"lang": langs, "weights": [np.ascontiguousarray(folded[:, j]).tobytes() for j in range(len(langs))]})


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_train: int = MAX_TRAIN) -> tuple[list[str], np.ndarray]:
    """Languages and their folded weights from rows with a label: a hash of id and text picks about max_train different rows, as many of each language."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return [], np.zeros((1 << BITS, 0), np.float32)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, max_train / len(counts) / n))])
    drawn = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit("language"))
    picked = rows.where(F.pmod(drawn, F.lit(1 << 20)) / F.lit(1 << 20) < F.element_at(share, F.col(lang_col)))
    picked = picked.select(drawn.alias("h"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropDuplicates(["h"]).select("text", "lang")
    arrow_batches(docs.sparkSession)
    model = picked.mapInArrow(_packed, "lang string, bits binary").groupBy().applyInPandas(_fit, "lang string, weights binary").collect()
    model.sort(key=lambda r: r[0])
    return [r[0] for r in model], np.stack([np.frombuffer(r[1], np.float32) for r in model], axis=1) if model else np.zeros((1 << BITS, 0), np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (decision value held to 0..1) of each whole text, by products of presence blocks with the model.

    ``und`` with score 0 where the text is null, has no letter, or nothing was
    learned. Rows may repeat; an empty table gives an empty one.
    """
    langs, weights = model
    arrow_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS floats a language, whatever the input's size

    def score(batches):
        table = sent.value
        for batch in batches:
            for a, b, data, offsets in byte_blocks(batch.column(1), 1 << 18, 64):
                x = presence(data, offsets).astype(np.float32)
                s = (x @ table) / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
                best = s.argmax(axis=1) if langs else np.zeros(b - a, int)
                name = [langs[i] for i in best] if langs else ["und"] * (b - a)
                value = np.clip(s[np.arange(b - a), best], 0, 1) if langs else np.zeros(b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(name, pa.string()), pa.array(value.astype(np.float64)), batch.column(2).slice(a, b - a)], ["doc_id", "lang", "value", "letter"])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col), F.col(text_col), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    out = rows.mapInArrow(score, f"doc_id {kind}, lang string, value double, letter boolean")
    return out.select("doc_id", F.when(F.col("letter"), F.col("lang")).otherwise("und").alias("lang_pred"), F.when(F.col("letter"), F.col("value")).otherwise(0.0).alias("score"))
