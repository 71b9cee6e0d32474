"""The streaming extension over a small file source."""

from pyspark.sql import functions as F

from fjordframe.streaming.blocks import streaming_block_means


def test_block_means_of_a_stream(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id AS int)) AS ts, id % 2 AS w, cast(id AS double) AS v FROM range(240)")
    rows.write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = streaming_block_means(live, "ts", ["w"], F.col("v"), "60 minutes", "10 minutes").writeStream.outputMode("complete").format("memory").queryName("blocks").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["block"]["start"].hour, r["w"]): (r["mean"], r["n"]) for r in spark.table("blocks").collect()}
    assert got[0, 0] == (29.0, 30) and got[3, 1] == (210.0, 30)
