"""Sinks: nested sequences, presets, reports, replacing a table by a finished one."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.functions.wording import counted


def sequence_json(rows: DataFrame, group: str, rank: str, pos: str, fields: list[str]) -> DataFrame:
    """(group, body): each group's rows in order of pos as JSON, groups in order of rank.

    A group is a chapter; its rows are gathered only here, at the sink.
    """
    made = rows.groupBy(group, rank).agg(F.array_sort(F.collect_list(F.struct(pos, *fields))).alias("rows"))
    return made.orderBy(rank).select(group, F.to_json(F.transform("rows", lambda r: F.struct(*[r[f].alias(f) for f in fields]))).alias("body"))


def sequence_pages(numbered: DataFrame, group: str, fields: list[str], page: int = 1000) -> DataFrame:
    """(group, page, body): sequences as JSON arrays of at most page rows, from rows with their place in their group."""
    rows = numbered.withColumn("page", F.floor(F.col("place") / page).cast("long"))
    made = rows.groupBy(group, "page").agg(F.array_sort(F.collect_list(F.struct("place", *fields))).alias("rows"))
    return made.select(group, "page", F.to_json(F.transform("rows", lambda r: F.struct(*[r[f].alias(f) for f in fields]))).alias("body"))


def write_pages(pages: DataFrame, group: str, path: str) -> None:
    """Writes sequence_pages() as a store: one JSON file for each page, in folders by group and page."""
    pages.repartition(group, "page").write.partitionBy(group, "page").text(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Writes df beside path and then moves it there; the old table is deleted only once the new one stands.

    The old table is renamed aside, the new one renamed in, and the old one deleted; if the
    second rename fails, the first is undone. Between the two renames path is missing for
    an instant, and a crash there leaves both tables beside it. Renames are Hadoop's; on
    object stores they are copies, and a table format is the better sink.
    """
    spark = df.sparkSession
    fresh, aside = (f"{path}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    df.write.parquet(fresh)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = at(fresh).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = store.exists(at(path))
    if had and not store.rename(at(path), at(aside)):
        raise OSError(f"{path} could not be moved aside")
    if not store.rename(at(fresh), at(path)):
        if had:
            store.rename(at(aside), at(path))
        raise OSError(f"{fresh} could not be moved to {path}")
    if had:
        store.delete(at(aside), True)


def escaped(text: Column) -> Column:
    """Text as it stands in an XML attribute."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def preset(fields: dict[str, Column]) -> Column:
    """A preset as XML attributes; fields without a value are left out."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f'  crs:{k}="'), escaped(v.cast("string")), F.lit('"'))) for k, v in fields.items()]
    return F.concat(F.lit("<rdf:Description\n"), F.concat_ws("\n", *parts), F.lit("/>"))


def aligned(rows: DataFrame, group: str, order: str, left: str, right: str) -> DataFrame:
    """(group, report): lines of two columns, the first padded to its widest."""
    width = rows.groupBy(group).agg(F.max(F.length(left)).alias("__w"))
    lines = rows.join(width, group).select(group, order, F.concat(F.rpad(F.col(left), F.col("__w") + 2, F.lit(" ")), F.col(right)).alias("__t"))
    made = lines.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, "__t"))).alias("__l"))
    return made.select(group, F.array_join(F.transform("__l", lambda x: x["__t"]), "\n").alias("report"))


def listed(rows: DataFrame, group: str, name: str, heading: str, one: str, shown: int = 12) -> DataFrame:
    """(group, report): a heading with the count, the first names in order, and how many more there are.

    Counts are aggregated, and only the names that are shown are collected.
    """
    first = Window.partitionBy(group).orderBy(name)
    counts = rows.groupBy(group).agg(F.count("*").alias("__n"))
    top = rows.select(group, name).withColumn("__i", F.row_number().over(first)).where(F.col("__i") <= shown)
    names = top.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("__i", F.concat(F.lit("  "), F.col(name).cast("string")).alias("t")))).alias("__l"))
    more = F.when(F.col("__n") > shown, F.concat(F.lit("  …and "), (F.col("__n") - shown).cast("string"), F.lit(" more")))
    head = F.concat(F.lit(f"{heading} "), counted(F.col("__n"), one), F.lit(":"))
    return counts.join(names, group).select(group, F.concat_ws("\n", head, F.array_join(F.transform("__l", lambda x: x["t"]), "\n"), more).alias("report"))
