"""A training-corpus pipeline: each stage applies one text operator to all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, near_duplicates, pieces, pii, quality_model
from lodestone.llm.common import cut, free, shared_dir, small
from lodestone.llm.queries import PIECES, surrogate_key

BROADCAST_ROWS = 100_000


def _only(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` whose doc_id is among ``ids`` (or is not, by a left_anti join); a null id is an id like any other."""
    ids = ids.select(F.col("doc_id").alias(free("__id", docs.columns)))
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col(ids.columns[0])), how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null and empty texts are judged as empty ones; repeated rows alike."""
    score = free("__score", docs.columns)
    rated = quality_model.score(docs, quality_model.train(docs), out_col=score)
    return rated.where(F.col(score) >= 0.5).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Null and empty texts are like nothing and stay, and so do rows without an
    id; of rows that repeat an id and its text, one stays.
    """
    linked = cut(near_duplicates.link(docs).select("doc_id", "kept"))
    kept = _only(docs, linked.where("kept"))
    again = small(linked.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), BROADCAST_ROWS)
    once = _only(kept, again).dropDuplicates(["doc_id", "text"])
    return _only(kept, again, "left_anti").unionByName(once)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window. Null and empty texts have none; of rows that repeat an id all go if one has a window."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = cut(found.where(F.size("hits") > 0).select("doc_id").distinct())
    return _only(docs, small(hit, BROADCAST_ROWS), "left_anti")


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; nulls, empty texts and those without entities stay as they are."""
    done = pii.pseudonymise(docs, surrogate_key(spark)).select(*docs.columns)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, with the scores of its best segmentations; null texts have null ids, empty ones none."""
    done = pieces.encode(docs, PIECES).withColumn("ids", F.get("segmentations", 0))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.transform("scores", lambda x: F.round(x, 3)).alias("scores"), "round_trip")


STAGES = [("quality", quality), ("near_duplicates", distinct), ("decontamination", decontaminated), ("pii", pseudonyms), ("pieces", encoded)]
#: EM, minimum hashes and the piece lattice have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is a Parquet table in a new folder of the shared one, which the next one reads. The caller owns the folder."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
