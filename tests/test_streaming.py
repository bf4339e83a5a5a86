from pyspark.sql import functions as F

from termloom.plans.annotate import Rules, Vocabulary
from termloom.streaming.annotate_stream import annotate_stream, windowed_counts


def test_stream_of_samples_as_batch(spark, tmp_path):
    schema = "sample_id string, kv_key string, kv_value string"
    for i, rows in enumerate(([("a", "note", "red ring")], [("b", "note", "a ring")])):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in" / f"{i}"))
    names = spark.createDataFrame([("red", "T:red", "TERM_NAME"), ("ring", "T:ring", "TERM_NAME")], "s string, term_id string, target string")
    vocab = Vocabulary(names, spark.createDataFrame([], "child string, parent string"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    annotate_stream(stream, vocab, Rules(), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "mapped"))
    assert {(r.sample_id, r.term_id) for r in got.collect()} == {("a", "T:red"), ("a", "T:ring"), ("b", "T:ring")}


def test_windows_of_a_stream(spark, tmp_path):
    rows = [(0, "x"), (10, "x"), (3599, "y"), (3600, "x"), (20000, "x")]
    df = spark.createDataFrame(rows, "s long, k string").select(F.timestamp_seconds("s").alias("ts"), "k")
    df.write.parquet(str(tmp_path / "ev"))
    stream = windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "ev")), "ts", "k")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows_test").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("windows_test").select(F.unix_timestamp("window.start").alias("s"), "k", "n").collect()
    assert {tuple(r) for r in got} == {(0, "x", 2), (0, "y", 1), (3600, "x", 1), (18000, "x", 1)}
