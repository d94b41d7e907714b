"""Connected components over edge tables that never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def beside(rows: DataFrame, by: list[str], spread: str, **aggregates) -> DataFrame:
    """rows with aggregates (name=(min, max, sum or bit_xor, column)) over all rows of the same by.

    The rows of one key are dealt over as many salts as the session has shuffle
    partitions, by the column spread: an aggregate is taken for each salt, then over the
    salts, and goes back to the salts that the key has. No task meets all rows of a key.
    """
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    parts = rows.groupBy(*by, "_salt").agg(*[f(c).alias(name) for name, (f, c) in aggregates.items()])
    whole = parts.groupBy(*by).agg(*[f(name).alias(name) for name, (f, _) in aggregates.items()], F.collect_list("_salt").alias("_salts"))
    whole = whole.select(*[F.col(c).alias(f"_{c}") for c in by], *aggregates, F.explode("_salts").alias("_own"))
    same = F.col("_salt") == F.col("_own")
    for c in by:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return rows.join(whole, same).drop("_salt", "_own", *[f"_{c}" for c in by])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """One row (id, component) for each id on an edge; component is the smallest id that edges reach.

    Large-star and small-star rounds (Kiveris et al., 2014) until nothing changes. Each
    round is written to the shared folder, so neither lineage nor driver memory grows.
    Self-edges, repeated and reversed edges and null ends are allowed; null ends are ignored.
    """
    now = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = now.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = written(now, "edges")
    before = _signature(now)
    while before[0]:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = beside(both, ["u"], "v", m=(F.min, "v")).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = large.distinct()
        small = beside(large, ["u"], "v", m=(F.min, "v"))
        small = small.select("v", "m", "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").where("u != v").distinct()
        last, now = now, written(small, "edges")
        discard(last)
        after = _signature(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
