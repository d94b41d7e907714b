"""Queries that cover every row of their tables."""

from pyspark.sql import functions as F

from lumaframe.plans import catalogue
from lumaframe.plans.archive import photos, table
from lumaframe.plans.light import instants

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return catalogue.QUERIES[name](spark, SF)


def test_every_row_has_a_result(spark):
    for name, rows in (("sun_times", instants(spark, SF)), ("golden_hours", instants(spark, SF)), ("cast_shadow", table(spark, SF, "part").select(F.col("p_partkey").alias("id")))):
        assert sorted(r.id for r in run(spark, name).select("id").collect()) == sorted(r.id for r in rows.select("id").collect()), name
    parts = {r.p_partkey for r in table(spark, SF, "part").collect()}
    assert set(map(int, run(spark, "stamp").first().ids.split(","))) == parts
    assert sum(r.body.count("p_partkey") for r in run(spark, "sequence_export").collect()) == len(parts)


def test_chapter_fold_takes_every_photo(spark):
    from lumaframe.operators import archive

    chapters = archive.split_chapters(photos(spark, SF), "base")
    assert {r.chapter for r in run(spark, "chapter_fold").collect()} == {r.chapter for r in chapters.select("chapter").distinct().collect()}


def test_day_plan_weighs_every_customer(spark):
    keys = {r.c_custkey for r in table(spark, SF, "customer").collect()}
    plans = {r.plan for r in run(spark, "day_plan").select("plan").collect()}
    assert plans == {k // 6 for k in keys}


def test_sun_alignments_cover_a_year(spark):
    t = run(spark, "sun_alignments").agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    assert t.b - t.a > 360 * 86_400
