"""Listing feeds and fetched pages; fetching itself happens outside Spark, which starts from stored pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Defaults of the stored listing table.
DEFAULTS = {
    "company": ("string", "N/A"), "category": ("string", "General IT"), "status": ("string", "active"), "description_quality": ("string", "unverified"), "availability": ("string", "unknown"),
    "entry_fit": ("string", "review"), "payment_status": ("string", "unknown"), "fit_score": ("int", 0), "exposure_score": ("double", 0.0), "analysis_version": ("int", 0), "experience_min": ("double", None),
    "detail_checked_at": ("timestamp", None), "detail_attempted_at": ("timestamp", None), "detail_error": ("string", None), "analyzed_at": ("timestamp", None), "raw_description": ("string", None),
}


def feed_pages(feeds: DataFrame, pages: int, style: Column) -> DataFrame:
    """Each feed (url) with its pages 1..``pages`` (1 to 10); ``style`` joins url and page."""
    return feeds.withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(max(1, min(10, pages)))))).withColumn("link", style)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases from a JSON file of many lines."""
    return spark.read.json(path, multiLine=True)


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    df.write.mode("overwrite").json(path)
