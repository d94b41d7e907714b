"""Queries that write stores and files of a table's rows and read them back, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumaframe.operators import archive, ledger
from lumaframe.sources import feeds, scratch, sinks

from .archive import query, table
from .ledger import audited

#: Rows of a page of the stored sequences.
PAGE = 50


def place(spark, name: str) -> str:
    return f"{scratch.folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"""SELECT p_brand AS brand, (row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) - 1)//{PAGE} AS page, p_partkey AS id, p_name AS name, CASE WHEN p_partkey%9 = 0 THEN NULL ELSE p_size END AS size FROM part""")
def sequence_store(spark, sf_dir):
    """Every brand's parts in order, written as a store of JSON pages and read back with their page."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 9 != 0, F.col("p_size")).alias("size"), F.col("p_size").alias("rank"))
    path = place(spark, "sequences")
    sinks.write_pages(sinks.sequence_pages(archive.numbered(rows, ["brand"], ["rank", "id"]), "brand", ["id", "name", "size"], PAGE), "brand", path)
    return feeds.json_store(spark, path, "id long, name string, size int, brand string, page long").select("brand", "page", "id", "name", "size")


@query("""SELECT c_nationkey AS nation, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey) - 1 AS place FROM customer""")
def numbered_rows(spark, sf_dir):
    """Each customer's place among those of its nation, by segment and key."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"), "c_mktsegment")
    return archive.numbered(rows, ["nation"], ["c_mktsegment", "id"]).select("nation", "id", "place")


@query("""SELECT substr(sha256(n_name || chr(10)), 1, 16) AS id, octet_length(encode(n_name)) + 1 AS length FROM nation WHERE n_nationkey%3 <> 0""")
def stored_originals(spark, sf_dir):
    """Files of a folder by their ending, named by their content: each nation is a file, some of another kind."""
    path, rows = place(spark, "originals"), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    rows.where("k % 3 != 0").repartition("k").write.partitionBy("k").text(path)
    rows.where("k % 3 = 0").repartition("k").write.mode("append").partitionBy("k").json(path)
    return feeds.originals(spark, path, "*.txt", below=True).select("id", "length")


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey%4 <> 0")
def replaced_store(spark, sf_dir):
    """A store replaced by a finished one: readers find all of the new rows and none of the old."""
    path, rows = place(spark, "store"), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    sinks.replace_table(rows, path)
    sinks.replace_table(spark.read.parquet(path).where("id % 4 != 0"), path)
    return spark.read.parquet(path)


@query("SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY 1")
def guarded_build(spark, sf_dir):
    """A build that would fail if the audit had missing files; here all but these faults are known."""
    built = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"))
    return ledger.guarded(built, audited(spark, sf_dir).where("fault != 'missing'"))
