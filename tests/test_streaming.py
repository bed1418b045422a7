from pyspark.sql import functions as F

from sweepline.operators.bars import ticks_to_bars
from sweepline.streaming.bars import stream_bars


def test_stream_equals_batch(spark, data, tmp_path):
    ticks = spark.read.parquet(f"{data}/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    ticks.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))
    bars = stream_bars(stream, "event_type", "ts", "value", "1 hour", "60 days")
    run = bars.writeStream.format("memory").queryName("bars").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    want = ticks_to_bars(ticks, "event_type", "ts", "value", "ts", "hour").select("symbol", F.col("ts").cast("string"), "high", "low", "volume")
    got = spark.table("bars").select("symbol", F.col("ts").cast("string"), "high", "low", "volume")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
