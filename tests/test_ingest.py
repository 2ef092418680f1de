from pyspark.sql import functions as F

from layerlake.streaming import ingest

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_stream_sessions_equal_batch(spark, tmp_path):
    batch = spark.read.parquet(EVENTS)
    (tmp_path / "in").mkdir()
    batch.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = (
        ingest.sessions(stream.withWatermark("ts", "60 days"), "user_id", "ts")
        .writeStream.format("memory").queryName("sessions").outputMode("complete").start()
    )
    q.processAllAvailable()
    q.stop()
    want = ingest.sessions(batch, "user_id", "ts")
    key = lambda r: (r.user_id, str(r.started), r.n_events)
    assert sorted(map(key, spark.table("sessions").collect())) == sorted(map(key, want.collect()))


def test_stream_dedup(spark, tmp_path):
    rows = spark.range(20).selectExpr("id % 5 AS k", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts")
    rows.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "d"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "d"))
    q = ingest.dedup_stream(stream, "k", "ts").writeStream.format("memory").queryName("dedup").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("dedup").count() == 5
