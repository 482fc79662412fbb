"""Helpers shared by the training-data operators."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import configure, scratch_path
from ..sources.tables import read_table

# Rows of text handed to Python at once: bounds a worker's memory when texts are long.
ROWS_PER_BATCH = "500"


def prepared(spark: SparkSession) -> SparkSession:
    """The session with this library's settings and small Arrow batches."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)
    return spark


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read from there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def text_bytes(column: str = "text"):
    """The UTF-8 bytes of a text, empty for NULL."""
    return F.coalesce(F.col(column).cast("binary"), F.lit("").cast("binary"))
