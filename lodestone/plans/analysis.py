"""The derive step: rows whose rules are out of date are evaluated anew, the rest stay as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import text_of
from ..functions.text import clean
from ..operators import engine, state
from ..operators.rules import Rules
from ..sources.versions import commit


def analyse(table: DataFrame, as_of: Column, only_pending: bool = True, rules: Rules = engine.DEFAULT) -> DataFrame:
    """``table`` with every due row evaluated; rows under the current rules pass through untouched, without a join."""
    current = F.coalesce((F.col("analysis_version") == rules.version) & F.col("analyzed_at").isNotNull(), F.lit(False))
    todo = state.pending(table, rules.version) if only_pending else table
    done = engine.evaluate(todo.withColumn("text", clean(text_of(F.col("text")))), rules).withColumn("analyzed_at", as_of)
    return done.unionByName(table.where(current), allowMissingColumns=True) if only_pending else done


def write_back(spark: SparkSession, root: str, as_of: Column, only_pending: bool = True, lease: int | None = None, rules: Rules = engine.DEFAULT) -> int:
    """Analyses the newest version of the table at ``root`` and publishes the result as its next one: all rows or none, and on what other writers left."""

    def change(table: DataFrame | None) -> DataFrame:
        if table is None:
            raise ValueError(f"no table at {root}")
        return analyse(table, as_of, only_pending, rules)

    return commit(spark, root, change, lease=lease)
