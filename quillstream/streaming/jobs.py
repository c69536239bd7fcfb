"""Structured Streaming forms of the cache and of the statistics."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.compact import cache_key
from ..operators.result_cache import evict, put


def memo_stream(payloads: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """Payloads (tool_name, content, ts) whose key wasn't seen within the time to live."""
    keyed = payloads.withColumn("cache_key", cache_key(F.col("tool_name"), F.col("content")))
    return keyed.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["cache_key"])


def cache_stream(requests: DataFrame, max_size: int, ttl_ms: int) -> DataFrame:
    """Hit, miss and expiry counts of requests (tool_name, key, ts_ms), with a
    least-recently-used cache of bounded size kept as state for each tool.
    Requests are taken as they arrive, by time within each batch that Spark hands over."""

    def run(tool: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, made, hits, misses, gone = state.get if state.exists else ([], [], 0, 0, 0)
        held = dict(zip(keys, made))
        for rows in batches:  # one at a time: a tool's requests are never all in memory
            rows = rows.sort_values(["ts_ms", "key"], kind="stable")
            for key, now in zip(rows["key"], rows["ts_ms"]):
                born = held.pop(key, None)
                if born is not None and now <= born + ttl_ms:
                    hits += 1
                    held[key] = born
                    continue
                gone += born is not None
                misses += 1
                if len(held) >= max_size:
                    del held[next(iter(held))]
                held[key] = int(now)
        state.update((list(held), list(held.values()), hits, misses, gone))
        yield pd.DataFrame({"tool_name": [tool[0]], "hits": [hits], "misses": [misses], "expirations": [gone], "size": [len(held)]})

    return requests.groupBy("tool_name").applyInPandasWithState(
        run, "tool_name string, hits long, misses long, expirations long, size long",
        "keys array<string>, made array<long>, hits long, misses long, gone long", "update", GroupStateTimeout.NoTimeout,
    )


def stats_stream(metrics: DataFrame) -> DataFrame:
    """Running totals by tool; written in complete or update mode."""
    done = F.col("was_optimized")
    return metrics.groupBy("tool_name").agg(
        F.count(F.lit(1)).alias("total_requests"), F.count_if(done).alias("optimized_requests"), F.sum("original_tokens").alias("tokens_before"),
        F.sum("savings").alias("total_savings"),
    )


def windowed_stats(metrics: DataFrame, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Totals of tumbling windows; rows later than the watermark are dropped."""
    return metrics.withWatermark("ts", late).groupBy(F.window("ts", width), "tool_name").agg(
        F.count(F.lit(1)).alias("total_requests"), F.sum("savings").alias("total_savings")
    )


def entry_sink(
    new: DataFrame, path: str, checkpoint: str, ttl_ms: int, trigger: dict | None = None, max_size: int = 500, clock: Callable[[], int] | None = None
) -> StreamingQuery:
    """Upserts new entries (key, value) batch by batch; the trigger is the debounce.

    `clock` gives the time of a batch in milliseconds (the present one). Expired
    entries and those over max_size are dropped with every batch."""
    from ..sources.payloads import read_entries, write_state

    clock = clock or (lambda: time.time_ns() // 1_000_000)

    def upsert(rows: DataFrame, batch: int) -> None:
        spark, now = rows.sparkSession, clock()
        # two folders in turn: a batch never overwrites what it reads
        old, new_path = f"{path}/{(batch + 1) % 2}", f"{path}/{batch % 2}"
        write_state(evict(put(read_entries(spark, old, now), rows.select("key", "value"), now, ttl_ms), max_size), new_path)

    writer = new.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
