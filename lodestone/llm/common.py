"""Helpers shared by the text operators: word patterns, lineage cuts, bounded broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of plain words: the six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]+"
#: Separators of alphanumeric words: every ASCII character but letters and digits.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text: Column) -> Column:
    """Words between ASCII white space; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def alnum_words(text: Column) -> Column:
    """Lower-cased words between ASCII characters that are neither letters nor digits."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. It is named by spark.checkpoint.dir; a local session without that setting takes its warehouse."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
        held = context._jsc.sc().getCheckpointDir()
    return held.get()


def arrow_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Holds batches of texts on their way to Python workers to ``size`` bytes, unless the session asks for less: else a batch of long texts takes 64 MB on both sides, and its copies more."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key).rstrip("b")
    if not held.isdigit() or not 0 < int(held) <= size:
        spark.conf.set(key, str(size))


def cut(df: DataFrame) -> DataFrame:
    """Run ``df`` once and keep its rows in the shared folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, rows: int, size: int = 32 << 20) -> DataFrame:
    """``df`` marked for broadcast if a count proves that it has at most ``rows`` rows of ``size`` bytes as text in all, else unmarked."""
    held = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return F.broadcast(df) if held[0] <= rows and held[1] <= size else df


def free(name: str, taken) -> str:
    """``name``, with as many underscores after it as it takes to differ from every taken column name, whatever its case."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
