"""The folder that the driver and all executors share, and tables kept there so that lost executors cost no recomputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local session without that setting takes its warehouse."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
        held = context._jsc.sc().getCheckpointDir()
    return held.get()


def arrow_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Holds batches on their way to Python workers to ``size`` bytes, unless the session asks for less: the trees of a batch of pages take several times the room of the pages."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key).rstrip("b")
    if not held.isdigit() or not 0 < int(held) <= size:
        spark.conf.set(key, str(size))


def cut(df: DataFrame) -> DataFrame:
    """Runs ``df`` once and keeps its rows in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
