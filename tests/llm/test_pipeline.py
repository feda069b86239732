"""The pipeline's stages, each against brute force on the rows that the one before kept."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import pieces
from lodestone.llm.queries import PIECES

from .test_operators import DATA, components_by_hand, low

PROSE = "In the spring the gardener planted rows of beans beside the wall, watered them each morning, and wrote down in a small notebook how tall they had grown since the week before the rain"
ALPHA = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return [w for w in ALPHA.split(low(text or "")) if w]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    documents = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("kept", F.lit("x")).withColumn("__score", F.lit(1)).withColumn("__id", F.lit(1))
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").first()["text"]
    more = [(900_001, PROSE), (900_002, PROSE), (900_003, PROSE), (900_003, PROSE), (900_004, PROSE.replace("morning", "evening")), (900_005, f"{PROSE[:60]} {item} {PROSE[80:]}"), (900_006, f"Mr John Smith met us. {PROSE[::-1]} Write to john.smith@example.org"), (900_007, None), (900_008, ""), (None, PROSE.upper().lower() + " once more")]
    rows = spark.createDataFrame(more, "doc_id long, text string").select("doc_id", "text", *[F.lit(None).cast(t).alias(c) for c, t in documents.dtypes[2:]])
    docs = documents.unionByName(rows)
    tables = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        tables.append(docs.toPandas())
    return dict(zip(["documents", *dict(corpus_pipeline.STAGES)], tables, strict=True)), spark.read.parquet(f"{folder}/benchmark.parquet").toPandas()


def test_all_but_the_last_return_the_columns_of_documents(stages):
    tables, _ = stages
    assert all(list(t.columns) == list(tables["documents"].columns) for k, t in tables.items() if k != "pieces")
    assert sorted(tables["pieces"]["doc_id"].dropna()) == sorted(tables["pii"]["doc_id"].dropna())


def test_quality_keeps_good_documents_of_labels(stages, spark):
    tables, _ = stages
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    kept = set(tables["quality"]["doc_id"])
    good, bad = labels[(labels.quality == 1) & (labels.toxic == 0)].doc_id, labels[labels.quality == 0].doc_id
    assert sum(k in kept for k in good) >= 0.95 * len(good) and sum(k in kept for k in bad) <= 0.1 * len(bad)


def test_one_of_each_group_of_near_duplicates_stays(stages):
    tables, _ = stages
    before = tables["quality"].dropna(subset=["doc_id"])
    want = components_by_hand({int(k): t or "" for k, t in zip(before["doc_id"], before["text"], strict=True)})
    got = tables["near_duplicates"]["doc_id"].dropna().astype(int).tolist()
    assert sorted(got) == sorted(k for k, (_, _, kept) in want.items() if kept)
    assert tables["near_duplicates"]["doc_id"].isna().sum() == tables["quality"]["doc_id"].isna().sum()


def test_documents_with_a_benchmark_window_go(stages):
    tables, items = stages
    windows = {tuple(w[i : i + min(10, len(w))]) for w in map(words, items["text"]) for i in range(max(0, len(w) - 9) or bool(w))}
    sizes = {len(x) for x in windows}
    clean = lambda t: not any(tuple(w[i : i + k]) in windows for w in [words(t)] for k in sizes for i in range(len(w) - k + 1))
    before, after = tables["near_duplicates"], tables["decontamination"]
    assert sorted(before[[clean(t) for t in before["text"]]]["doc_id"].fillna(-1)) == sorted(after["doc_id"].fillna(-1)) and 900_005 not in set(after["doc_id"])


def test_personal_data_goes_and_the_rest_stays(stages):
    tables, _ = stages
    before, after = (tables[k].fillna({"doc_id": -1}).set_index("doc_id")["text"].to_dict() for k in ("decontamination", "pii"))
    assert before.keys() == after.keys()
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z.]+")
    real = {m for t in before.values() if t for m in mail.findall(t)}
    assert real and not any(m in t for t in after.values() if t for m in real)
    plain = [k for k, t in before.items() if t and not re.search(r"\d|@|=|:|Mr|Ms|Frau|Herr|M[a-z]{2,7} |Se|S[a-z]{1,2}\.? |гос", t)]
    assert plain and all(after[k] == before[k] for k in plain)


def test_pieces_give_the_texts_back(stages):
    tables, _ = stages
    lattice = pieces.lattice(PIECES)
    texts = tables["pii"].set_index("doc_id")["text"].to_dict()
    for r in tables["pieces"].itertuples():
        if r.ids is not None and r.doc_id == r.doc_id:
            assert lattice.decode(list(r.ids)) == texts[r.doc_id] and r.n_pieces == len(r.ids) and r.round_trip


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
