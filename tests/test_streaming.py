from pyspark.sql import functions as F

from lodestone.streaming import outliers


def test_stream_agrees_with_the_table(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "in").mkdir()
    table.write.parquet(str(tmp_path / "in" / "events"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in" / "events"))
    low, high = outliers.limits(table, "value")
    for name, make in (("flags", lambda d: outliers.flag(d, "value", low, high).select("event_id", "value_iqr_pass")), ("windows", lambda d: outliers.window_statistics(d, "ts", "value", "1 day", by=["event_type"]).drop("quartiles"))):
        q = make(stream).writeStream.format("memory").queryName(name).outputMode("append" if name == "flags" else "complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        key = lambda df: sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in df.collect())
        assert key(spark.table(name)) == key(make(table))
    assert outliers.flag(table, "value", low, high).where(~F.col("value_iqr_pass")).count() > 0
