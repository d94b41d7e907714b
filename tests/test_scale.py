"""What keeps queries within limits on larger tables: tasks, pairs of places, walks that are made once."""

import numpy as np
from pyspark.sql import functions as F

from lumaframe.functions import geodesy, sky, vectors
from lumaframe.functions.formulas import COMPILED
from lumaframe.operators import clusters, places, spots, timeline
from lumaframe.plans import archive, catalogue, extras, scout

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_long_formulas_are_compiled(spark):
    """a method above the JVM's limit is interpreted for every row."""
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    geodesy.BETWEEN.on(spark.sql("SELECT 1e0 AS lat1, 2e0 AS lon1, 3e0 AS lat2, 4e0 AS lon2, 0.5e0 AS part"))
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == COMPILED


def test_small_files_are_many_tasks(spark):
    """A small file is one task, however long a row takes."""
    for name in ("frame_regions", "curve_table", "preset_files"):
        assert catalogue.QUERIES[name](spark, SF).rdd.getNumPartitions() > 1, name


def test_a_curve_of_many_points(spark):
    """stretches cover every step once; ends are level, equal places jump, missing points are passed over."""
    rows = [(0, [(10.0, 5.0), (100.0, 50.0), (100.0, 80.0), (200.0, 20.0)]), (1, [(30.0, 7.0)]), (2, []), (3, None), (4, [(0.0, 1.0), (None, 9.0), (255.0, 256.0)])]
    df = spark.createDataFrame(rows, "id int, p array<struct<x:double,y:double>>")
    got = {r.id: r.v for r in df.select("id", vectors.curve(F.col("p")).alias("v")).collect()}
    assert all(len(v) == 256 for v in got.values())
    assert got[0][0] == got[0][10] == 5.0 and got[0][55] == 27.5 and got[0][100] == 80.0 and got[0][150] == 50.0 and got[0][255] == 20.0
    assert set(got[1]) == {7.0} and set(got[2]) == set(got[3]) == {None} and got[4] == [i + 1.0 for i in range(256)]


def test_samples_of_a_spot_are_never_shuffled(spark):
    """series are made where their windows are, in tasks whose number grows with the spots."""
    spots = spark.range(3000).selectExpr("id AS spot", "id % 60 * 1e0 AS lat", "id * 1e0 AS lon", "1772323200L + id AS start", "1772330400L + id AS end")
    found = timeline.intervals_where(spots, ["spot"], sky.SUN, "sun_altitude", 0.0, True, "start", "end", 3600)
    text = plan(found)
    assert text.count("Exchange") == 1 and text.count("Generate explode") == 2
    n = timeline.dealt_out(spots.union(spots).union(spots).union(spots).union(spots).union(spots), ["spot"]).rdd.getNumPartitions()
    assert n == max(4 * spark.sparkContext.defaultParallelism, 18)


def test_points_of_one_place_are_walked_once(spark):
    """copies of a point cost a join, not a ray each; unknown places stay clear."""
    cells = spark.range(16 * 16).selectExpr("cast(id / 16 as int) AS row", "cast(id % 16 as int) AS col", "CASE WHEN id % 16 = 12 THEN 900e0 ELSE 0e0 END AS height")
    points = spark.range(400).selectExpr("id", "CASE WHEN id % 4 < 3 THEN id % 4 * 5e0 END AS row", "3e0 AS col", "1e0 AS height")
    shaded = {r.id: r.shaded for r in places.shaded_at(points, cells, F.lit(90.0), F.lit(20.0), 30.0, 16).collect()}
    assert len(shaded) == 400 and all(v == (k % 4 < 3) for k, v in shaded.items())
    found = places.terrain_horizon(points.withColumn("row", F.col("row").cast("int")).withColumn("col", F.lit(3)), cells, 30.0, 16, 8, most=20)
    by = found.groupBy("bin").agg(F.count("*").alias("n"), F.countDistinct("angle").alias("angles")).collect()
    assert len(by) == 8 and all(r.n == 400 for r in by)
    for df in (places.shaded_at(points, cells, F.lit(90.0), F.lit(20.0), 30.0, 16), found):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        assert "min(struct" in text  # alike points are one before rays are made


def test_distances_are_rounded_between_places(spark):
    """a rounding for each pair of places, not for each pair of rows."""
    rows = spark.range(60).selectExpr("id", "id % 3 / 10000e0 AS lat", "0e0 AS lon")
    made = places.within(rows, rows, 60.0, digits=4)
    plain = places.within(rows, rows, 60.0).select("a_id", "b_id", F.round("distance", 4).alias("distance"))
    assert made.count() == 60 * 60 and sorted(made.collect()) == sorted(plain.collect())
    assert "round" not in catalogue.QUERIES["spatial_self_join"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("\n")[0]


def test_copies_of_a_place_are_looked_at_together(monkeypatch):
    """distances are taken between places, so their number does not grow with the copies."""
    seen = []
    plain = clusters._metres
    monkeypatch.setattr(clusters, "_metres", lambda a, b, c, d: seen.append(np.size(a)) or plain(a, b, c, d))

    def looked(copies: int) -> int:
        seen.clear()
        lat = np.tile(55.9 + np.arange(40) % 8 / 4000, copies)
        clusters._grow(lat, np.tile(-3 + np.arange(40) // 8 / 2000, copies), np.ones(len(lat), bool), 60.0, 250.0, False)
        return sum(seen)

    assert looked(80) < 12 * looked(10)


def test_only_photos_that_are_named_are_measured(spark):
    """images name ten photos; textures of no others are needed."""
    wanted = spark.createDataFrame([(1,), (3,), (3,)], "photo long")
    some, every = archive.textures(spark, SF, wanted), archive.textures(spark, SF)
    assert sorted(some.collect()) == sorted(every.where("id IN (1, 3)").collect())
    told, _ = extras.image_details(spark, SF)
    assert "LeftSemi" in told._jdf.queryExecution().optimizedPlan().toString()


def test_saved_lists_are_read_once(spark):
    """lists are read and checked once for all three uses."""
    made = catalogue.QUERIES["spots_logged_and_removed"](spark, SF)
    assert "customer.parquet" not in "".join(made.inputFiles())


def test_a_days_light_sends_no_samples_to_the_driver(spark):
    """tables that are read again are written, and nothing that grows with the samples is broadcast."""
    made = catalogue.QUERIES["day_light"](spark, SF)
    assert "lineitem.parquet" not in "".join(made.inputFiles()) and "Generate" not in plan(made)
    profile = spark.range(8).selectExpr("id % 2 AS spot", "cast(id / 2 as int) AS bin", "id * 1e0 AS v")
    assert "Broadcast" not in plan(places.resampled(profile, ["spot"], "v", 4, 8))


def test_crops_go_to_python_in_batches_and_once(spark):
    """pixels are made where their crop is measured, crops go to Python as rows and are measured once."""
    images = archive.textured(spark, SF)
    text = plan(archive.texture.crops(archive.crop_pixels(archive.texture.origins(images, archive.SMALL_CROP)), ["id", "gx", "gy"]))
    assert text.count("ArrowEvalPython") == 1 and text.count("Exchange") == 1 and "FlatMapGroupsInPandas" not in text


def test_a_long_list_is_never_one_body(spark, monkeypatch):
    """a list comes in bodies of bounded size, and every task passes on only the latest of its own entries."""
    told = lambda: sorted(map(str, scout.saved(spark, SF).collect()))
    whole = told()
    monkeypatch.setattr(scout, "PART", 40)
    lists = scout.spot_lists(spark, SF)
    assert lists.selectExpr("max(json_array_length(body)) AS n").first().n <= 40 and lists.count() > lists.select("list").distinct().count()
    assert told() == whole
    assert "WindowGroupLimit" in plan(scout.saved(spark, SF))
    assert "customer.parquet" not in "".join(catalogue.QUERIES["spots_saved_over"](spark, SF).inputFiles())


def test_the_spot_that_was_opened_is_saved_over(spark):
    """three spots of a list stand at one place; the one opened is moved to the front, without one named the first."""
    rows = spark.range(5).selectExpr("7 AS list", "cast(id AS int) AS pos", "CASE WHEN id % 2 = 1 THEN 10e0 ELSE id * 1e0 END AS lat", "3e0 AS lon", "concat('note ', id) AS note", *[f"cast(null AS string) AS {c}" for c in spots.NOTEBOOK if c != "note"])
    again = rows.where("pos = 3").withColumns({"lat": F.lit(10.0003), "note": F.lit(None).cast("string")})
    notes = lambda new: [r.note for r in spots.save(rows, new, ["list"]).orderBy("pos").collect()]
    assert notes(again.withColumnRenamed("pos", "opened")) == ["note 3", "note 0", "note 1", "note 2", "note 4"]
    assert notes(again.drop("pos")) == ["note 1", "note 0", "note 2", "note 3", "note 4"]
    away = again.withColumnRenamed("pos", "opened").withColumn("lat", F.lit(2.0))  # what was opened is out of reach
    assert notes(away) == ["note 2", "note 0", "note 1", "note 3", "note 4"]
    seen = spots.matched(rows, again.withColumnRenamed("pos", "opened"), ["list"]).first()
    assert (seen.list, seen.pos) == (7, 3)


def test_a_days_light_looks_to_the_fields_edge(spark, monkeypatch):
    """a ridge 200 cells away and a wall 1000 m away stand in a spot's profile, at all bearings that the operators name."""
    told = []
    monkeypatch.setattr(extras, "heights", lambda s, d: s.range(256 * 256).selectExpr("cast(id / 256 AS int) AS row", "cast(id % 256 AS int) AS col", "CASE WHEN id % 256 >= 200 THEN 5000e0 ELSE 0e0 END AS height"))
    monkeypatch.setattr(extras, "edges", lambda s, d: s.sql("SELECT 0L AS spot, -500e0 AS ax, 1000e0 AS ay, 500e0 AS bx, 1000e0 AS by, 2000e0 AS height"))
    monkeypatch.setattr(extras.daylight, "light_windows", lambda spots, profiles: told.append(profiles) or spark.sql("SELECT 0L AS spot, 0 AS run, true AS lit, false AS below, 0L AS start, 60L AS end"))
    catalogue.QUERIES["day_light"](spark, SF)
    profile = told[0].where("spot = 0").first().profile
    assert len(profile) == 720 and round(profile[0]) == 63 and 30 < profile[180] < 40 and profile[540] == 0


def test_photos_are_measured_by_whole_crops(spark):
    """a crop is as large as the measure takes it, in tasks of few crops; a pixel without light costs its crop alone."""
    assert archive.SMALL_CROP == archive.texture.CROP == 192
    made = archive.crop_pixels(archive.texture.origins(archive.textured(spark, SF)).where("gx = 0 AND gy = 0"))
    sides = made.groupBy("id").agg(F.count("*").alias("n"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h")).collect()
    assert sides and all((r.n, r.w, r.h) == (192 * 192, 192, 192) for r in sides)
    places = spark.range(6400).selectExpr("id", "0 AS gx", "0 AS gy", "0 AS left", "0 AS top")
    assert archive.crop_pixels(places).rdd.getNumPartitions() == 100
    grid = spark.range(2 * 144).selectExpr("id % 2 AS image", "cast(id / 2 AS long) % 12 AS x", "cast(id / 24 AS long) AS y").withColumn("luma", F.when((F.col("image") == 0) | (F.col("x") != 5), (F.col("x") * F.col("y") % 7).cast("double")))
    assert [r.image for r in archive.texture.crops(grid, ["image"]).collect()] == [0]
