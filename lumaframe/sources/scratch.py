"""Tables that operators write on the way: they cut lineage and fix what a plan reads twice.

They live below spark.checkpoint.dir, which driver and executors share. Where that is not
set, only a local master gets a folder of its own, which goes when Python ends.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder(application: str) -> str:
    folder = tempfile.mkdtemp(prefix="scratch-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError(f"spark.checkpoint.dir is not set: executors of {spark.sparkContext.master} share no folder")
    return _own_folder(spark.sparkContext.applicationId)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table: what is read from it later is the same each time, and a lost executor loses none of it."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table that written() made and no plan reads any more."""
    context = df.sparkSession.sparkContext
    for place in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
