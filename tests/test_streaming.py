from pyspark.sql import functions as F

from quillstream.operators import result_cache
from quillstream.sources.payloads import read_entries
from quillstream.streaming import jobs


def _stream(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))
    return spark.readStream.schema(schema).parquet(str(path))


def _run(df, name, tmp_path, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_memo(spark, tmp_path):
    rows = [("t", "x", 0), ("t", "x", 60), ("t", "y", 60)]
    stream = _stream(spark, rows, "tool_name string, content string, s long", tmp_path / "in")
    kept = jobs.memo_stream(stream.withColumn("ts", F.timestamp_seconds("s")))
    assert sorted(r["content"] for r in _run(kept.select("content"), "memo", tmp_path, "append")) == ["x", "y"]


def test_cache_matches_batch(spark, tmp_path):
    keys = "abacbdaab"
    rows = [("t", k, i) for i, k in enumerate(keys)]
    stream = _stream(spark, rows, "tool_name string, key string, ts_ms long", tmp_path / "in")
    got = _run(jobs.cache_stream(stream, 2, 10**9), "cache", tmp_path, "update")[-1]
    log = spark.createDataFrame(rows, "tool_name string, key string, seq long")
    assert got["hits"] == result_cache.lru_hits(log, 2).filter("hit").count() and got["hits"] + got["misses"] == len(keys)


def test_stats_and_windows(spark, tmp_path):
    rows = [("t", True, 10, 5, 0), ("t", False, 10, 0, 30), ("u", True, 20, 5, 700)]
    schema = "tool_name string, was_optimized boolean, original_tokens long, savings long, s long"
    stream = _stream(spark, rows, schema, tmp_path / "in")
    got = {r["tool_name"]: r for r in _run(jobs.stats_stream(stream), "stats", tmp_path, "complete")}
    assert (got["t"]["total_requests"], got["t"]["optimized_requests"], got["u"]["total_savings"]) == (2, 1, 5)
    wide = jobs.windowed_stats(stream.withColumn("ts", F.timestamp_seconds("s")))
    assert len(_run(wide.select("tool_name", "total_requests"), "windows", tmp_path, "complete")) == 2


def test_entry_sink(spark, tmp_path):
    stream = _stream(spark, [("a", "1"), ("b", "2")], "key string, value string", tmp_path / "in")
    jobs.entry_sink(stream, str(tmp_path / "out"), str(tmp_path / "c"), 100).awaitTermination(120)
    assert read_entries(spark, str(tmp_path / "out/0")).count() == 2
