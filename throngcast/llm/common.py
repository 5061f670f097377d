"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import run_folder

#: Rows and bytes of an Arrow batch, whichever comes first.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def written(df: DataFrame, name: str = "llm") -> DataFrame:
    """The rows, written once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = run_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have yet (names compare without case, as Spark does)."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def content(column: str | Column) -> Column:
    """A text, empty when missing."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def small_batches(df: DataFrame, rows: int = ARROW_ROWS) -> DataFrame:
    """Arrow batches of few rows and bytes, so that a batch of very long texts still fits a worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df
