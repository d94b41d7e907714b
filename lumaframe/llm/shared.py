"""Shared folder, lineage cuts and plain helpers of the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.sources.scratch import discard, folder, written  # noqa: F401

#: Texts of an Arrow batch.
TEXT_ROWS = 1000


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path for one run below the shared folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to sizes that hold whole texts in a worker's share of memory.

    The default of 10,000 rows is made for numbers; smaller settings of the session stay.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > TEXT_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))


def count_between(text: Column, separators: str) -> Column:
    """How many stretches of text stand between matches of separators, a character class with +; null text: 0.

    Splitting where words end is several times faster than matching the words.
    """
    at_edge = lambda c: F.when(c.rlike(separators), 1).otherwise(0)
    parts = F.size(F.split(text, separators)) - at_edge(F.substring(text, 1, 1)) - at_edge(F.right(text, F.lit(1)))
    return F.when(text.isNull() | (text == ""), 0).otherwise(parts).cast("long")


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of a whole text column; sizes the number of buckets."""
    return df.select(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
