from lumaframe.streaming import ingest

SF = "/root/testdata/sf0.001"


def run(spark, df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return spark.sql(f"SELECT * FROM {name}")


def events(spark):
    one = spark.read.parquet(f"{SF}/events.parquet")
    return spark.readStream.schema(one.schema).parquet(f"{SF}/events.parquet*"), one


def test_once_each(spark):
    stream, batch = events(spark)
    assert run(spark, ingest.once_each(stream, "event_id", "ts"), "once").count() == batch.select("event_id").distinct().count()


def test_hourly(spark):
    stream, batch = events(spark)
    got = run(spark, ingest.hourly(stream, "ts", "value"), "hourly", "complete")
    assert got.agg({"n": "sum"}).first()[0] == batch.count()


def test_throttled(spark):
    stream, _ = events(spark)
    got = run(spark, ingest.throttled(stream, "user_id", "ts", 3600.0), "throttled", "append").toPandas()
    gaps = got.sort_values("at").groupby("key")["at"].diff().dropna()
    assert len(got) and gaps.min() >= 3600


def test_bursts(spark):
    """Every burst that is closed by the end of the stream has the count of its own events."""
    stream, batch = events(spark)
    got = run(spark, ingest.bursts(stream, "event_type", "ts"), "bursts").collect()
    seconds = {}
    for r in batch.selectExpr("event_type", "unix_micros(cast(ts as timestamp)) / 1e6 AS s").collect():
        seconds.setdefault(r.event_type, []).append(r.s)
    assert got
    for r in got:
        inside = [s for s in seconds[r[0]] if r.start.timestamp() <= s < r.end.timestamp()]
        assert r.n == len(inside) > 0
