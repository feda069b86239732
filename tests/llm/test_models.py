"""Label model, kernel ridge and scorer against plain computations, and against labels."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.llm import language, quality_model, quality_rules, weak

DATA = "/root/testdata/sf0.001"


def em_by_hand(rows, n_rules, rounds=60, start=0.8):
    """EM row by row: accuracies and the posterior of each row."""
    accuracy = np.full(n_rules, start)
    for _ in range(rounds):
        p = posteriors(rows, accuracy)
        for j in range(n_rules):
            right, cast = start, 1.0
            for votes, good in zip(rows, p, strict=True):
                if votes[j]:
                    right += good if votes[j] > 0 else 1 - good
                    cast += 1
            accuracy[j] = min(0.99, max(0.5, right / cast))
    return accuracy, posteriors(rows, accuracy)


def posteriors(rows, accuracy):
    out = []
    for votes in rows:
        good = bad = 0.5
        for v, a in zip(votes, accuracy, strict=True):
            if v:
                good, bad = (good * a, bad * (1 - a)) if v > 0 else (good * (1 - a), bad * a)
        out.append(good / (good + bad))
    return out


def drawn_votes():
    draw = random.Random(2)
    rows = []
    for _ in range(400):
        truth = draw.random() < 0.7
        rows.append(tuple(0 if draw.random() < 0.2 else (1 if (draw.random() < a) == truth else -1) for a in (0.95, 0.8, 0.65)))
    return rows


def test_label_model_against_row_by_row():
    rows = drawn_votes()
    patterns = sorted((v, rows.count(v)) for v in set(rows))
    model = weak.fit(patterns, 3)
    want, _ = em_by_hand(rows, 3)
    assert model["accuracy"] == pytest.approx(list(want), abs=1e-9)
    assert model["accuracy"][0] > model["accuracy"][1] > model["accuracy"][2]
    assert weak.fit([], 2)["accuracy"] == [0.8, 0.8]


def test_posterior_and_verdict_of_rules_against_row_by_row(spark):
    judged = quality_rules.judge(spark.read.parquet(f"{DATA}/documents.parquet")).toPandas()
    names = list(quality_rules.rules())
    rows = [tuple(r) for r in judged[names].itertuples(index=False)]
    _, want = em_by_hand(rows, len(names))
    assert judged["quality"].to_numpy() == pytest.approx(np.array(want), abs=1e-9)
    assert (judged["kept"] == (~judged["base_failed"] & (judged["quality"] >= 0.5))).all()


def test_presence_against_sets():
    texts = ["Ab cab", "", "ßx", "aaaa"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    got = language.presence(data, offsets)
    for row, b in zip(got, raw, strict=True):
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in b)
        grams = {low[i : i + n] for n in language.SPECTRUM for i in range(len(low) - n + 1)}
        places = {((int.from_bytes(g, "big") + len(g)) * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - language.BITS) for g in grams}
        assert set(np.flatnonzero(row)) == places


def test_folded_weights_are_kernel_ridge_on_landmarks():
    """With all rows as landmarks, scores equal those of kernel ridge through the Nyström map computed from kernels alone."""
    draw = np.random.default_rng(4)
    rows = pd.DataFrame({"lang": ["a", "b"] * 12, "bits": [np.packbits(draw.random(1 << language.BITS) < (0.02 if i % 2 else 0.05)).tobytes() for i in range(24)]})
    fitted = language._fit(rows).set_index("lang")["weights"].map(lambda b: np.frombuffer(b, np.float32))
    x = language._unit(rows["bits"].tolist()).astype(np.float64)
    kernel = x @ x.T
    target = (rows["lang"].to_numpy()[:, None] == np.array(["a", "b"])).astype(float)
    weight = 1 / 12
    # phi phi^T = K, so ridge in phi is (W K + r I) in the dual
    dual = np.linalg.solve(weight * kernel + language.RIDGE * np.eye(24), weight * target)
    assert np.stack([x @ fitted["a"], x @ fitted["b"]], axis=1) == pytest.approx(kernel @ dual, abs=1e-3)


def test_language_of_odd_rows(spark):
    train = spark.createDataFrame([(i, f"the cat and the dog {i}", "en") for i in range(20)] + [(i + 50, f"der hund und die katze {i}", "de") for i in range(20)] + [(99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string")
    model = language.train(train, "doc_id", "text", "lang")
    rows = [(1, None), (2, ""), (3, "123 !"), (4, "the dog and the cat " * 5000), (None, "die katze und der hund"), (5, "the dog"), (5, "the dog")]
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()]
    assert sorted((str(k), v) for k, v, _ in got) == [("1", "und"), ("2", "und"), ("3", "und"), ("4", "en"), ("5", "en"), ("5", "en"), ("None", "de")]
    assert all(0 <= s <= 1 for _, _, s in got) and all(s == 0 for _, v, s in got if v == "und")


def test_scorer_against_labels(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    found = quality_model.score(docs, quality_model.train(docs)).join(labels, "doc_id").select("quality", "toxic", (F.col("quality_score") >= 0.5).alias("kept")).toPandas()
    good = found[(found.quality == 1) & (found.toxic == 0)]
    assert good.kept.mean() >= 0.95 and found[found.quality == 0].kept.mean() <= 0.1


def test_gradient_descent_against_plain_logistic_regression():
    draw = np.random.default_rng(1)
    x = draw.random((40, 6)).astype(np.float32)
    p = 1 / (1 + np.exp(-(x @ np.array([3, -2, 0, 1, 0, 0]) - 0.5)))
    got = np.frombuffer(quality_model._fit(pd.DataFrame({"p": p, "x": [r.tobytes() for r in x]}))["w"].iloc[0])
    w, b = np.zeros(6), 0.0
    for _ in range(quality_model.STEPS):
        miss = [(1 / (1 + math.exp(-(float(r @ w) + b))) - q) / 40 for r, q in zip(x.astype(float), p, strict=True)]
        w, b = w - 4 * (sum(m * r for m, r in zip(miss, x.astype(float), strict=True)) + 1e-4 * w), b - 4 * sum(miss)
    assert got == pytest.approx([*w, b], abs=1e-3)


def test_a_column_with_the_name_of_the_score_stays(spark):
    docs = spark.createDataFrame([(1, "some text", 5), (2, None, 6)], "doc_id long, text string, quality_score int")
    done = quality_model.score(docs, quality_model.train(docs))
    assert done.columns == ["doc_id", "text", "quality_score", "quality_score_"] and {r["quality_score"] for r in done.collect()} == {5, 6}
