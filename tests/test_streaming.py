from strandlake.streaming import counts


def test_windowed_counts(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("CAST(ts AS timestamp) AS ts", "event_type")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = counts.value_counts(stream, "event_type").writeStream.outputMode("complete").format("memory").queryName("stream_counts").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.event_type: r.n for r in spark.table("stream_counts").collect()}
    assert got == {r.event_type: r["count"] for r in events.groupBy("event_type").count().collect()}
    batch = counts.windowed_counts(events, "ts", "event_type")
    assert sum(r.n for r in batch.collect()) == events.count()
