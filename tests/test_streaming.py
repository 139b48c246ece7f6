from pyspark.sql import functions as F

from assayer.streaming import coverage_stream


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:{m:02d}:00", f"f{m % 2}", m % 3 > 0) for h in range(4) for m in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "t string, file string, hit boolean").select(F.to_timestamp("t").alias("ts"), "file", "hit")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = coverage_stream.line_hits(stream).writeStream.format("memory").queryName("hits").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("hits").collect())) == sorted(map(str, coverage_stream.line_hits(df).collect()))
