from pyspark.sql import functions as F

from strandloom.operators import contacts
from strandloom.streaming import deltas
from tests.test_layout_and_contacts import INPUT_1K, block, contacts_of, placed, rows


def layout(spark):
    return placed(spark, block(1, "ctgA", 0, 4000, 0), block(2, "ctgB", 0, 4000, 4100), block(3, "ctgC", 0, 4000, 8100), block(4, "ctgD", 0, 4000, 12_300))


def test_stream_equals_batch_and_replay_counts_once(spark, tmp_path):
    source = contacts_of(spark)
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = deltas.map_deltas(stream, layout(spark), 1000).writeStream.outputMode("complete").format("memory").queryName("map_deltas").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("map_deltas")) == INPUT_1K
    sink = deltas.merge_batch(str(tmp_path / "out"))
    cells = contacts.project(source, layout(spark), 1000)
    for batch_id in (0, 1, 1):  # the last comes again
        sink(cells.filter(F.col("x_bin") % 2 == batch_id), batch_id)
    assert rows(deltas.merged(spark, str(tmp_path / "out"), ["x_bin", "y_bin"], "count")) == INPUT_1K


def test_event_windows_drop_late_rows(spark, tmp_path):
    def put(name, *data):
        spark.createDataFrame(list(data), "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "ev"))

    put("a", (1, "2024-01-01 00:05:00", 1, "x", 1.0), (2, "2024-01-01 05:00:00", 1, "x", 2.0))
    schema = spark.read.parquet(str(tmp_path / "ev")).schema
    q = deltas.event_windows(spark.readStream.schema(schema).parquet(str(tmp_path / "ev"))).writeStream.outputMode("append").format("memory").queryName("ev").start()
    q.processAllAvailable()
    put("b", (3, "2024-01-01 00:10:00", 1, "x", 10.0), (4, "2024-01-01 09:00:00", 1, "x", 4.0))
    q.processAllAvailable()
    q.stop()
    assert {(r.n, r.total) for r in spark.table("ev").collect()} == {(1, 1.0), (1, 2.0)}
