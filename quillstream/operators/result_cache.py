"""Result cache: keyed entries with a time to live and a limit on their number.

Entries: key, value, created, last_accessed, access_count, expires_at (all
times in milliseconds). All operators take the time as a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY = "key string, value string, created long, last_accessed long, access_count long, expires_at long"


def live(entries: DataFrame, now: int | Column) -> DataFrame:
    """Entries whose expiry isn't past; one that expires now is still live."""
    return entries.filter(F.col("expires_at") >= now)


def expired(entries: DataFrame, now: int | Column) -> DataFrame:
    return entries.filter(F.col("expires_at") < now)


def probe(requests: DataFrame, entries: DataFrame, now: int | Column) -> DataFrame:
    """Adds hit and value to requests (key)."""
    found = live(entries, now).select("key", "value")
    return requests.join(found, "key", "left").withColumn("hit", F.col("value").isNotNull())


def touch(entries: DataFrame, hits: DataFrame, now: int) -> DataFrame:
    """Entries after the hits (key): counted and moved to the front."""
    counted = hits.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    joined = entries.join(counted, "key", "left")
    return joined.withColumn("access_count", F.col("access_count") + F.coalesce("_n", F.lit(0))).withColumn(
        "last_accessed", F.when(F.col("_n").isNotNull(), F.lit(now)).otherwise(F.col("last_accessed"))
    ).drop("_n")


def put(entries: DataFrame, new: DataFrame, now: int, ttl_ms: int) -> DataFrame:
    """Upserts new (key, value): counters start again."""
    made = new.dropDuplicates(["key"]).select(
        "key", "value", F.lit(now).cast("long").alias("created"), F.lit(now).cast("long").alias("last_accessed"),
        F.lit(0).cast("long").alias("access_count"), F.lit(now + ttl_ms).cast("long").alias("expires_at"),
    )
    return entries.join(made.select("key"), "key", "left_anti").unionByName(made)


def evict(entries: DataFrame, max_size: int) -> DataFrame:
    """The max_size entries accessed last: a top-k, not a sort of all."""
    return entries.orderBy(F.desc("last_accessed"), F.desc("created"), "key").limit(max_size)


def remove(entries: DataFrame, keys: DataFrame) -> DataFrame:
    return entries.join(keys.select("key"), "key", "left_anti")


def has(requests: DataFrame, entries: DataFrame, now: int | Column) -> DataFrame:
    return requests.join(live(entries, now).select("key"), "key", "left_semi")


def replay(log: DataFrame, ttl_ms: int, order: str = "ts_ms") -> DataFrame:
    """Hit or miss of each request of a log (key, ts_ms, event_id) under a time
    to live that counts from creation, without a limit on entries.

    Misses create an entry; requests up to its expiry hit it. The requests of
    a key stream through one task in order of (time, event_id); the task holds
    one creation time, whatever the key's length."""
    import pyarrow as pa

    rows = log.select("key", F.col(order).cast("long").alias("t"), F.col("event_id").cast("long").alias("event_id"))
    rows = rows.repartition("key").sortWithinPartitions("key", "t", "event_id")

    def run(batches):
        now, made = object(), None
        for batch in batches:
            hits = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != now:
                    now, made = k, None
                hit = made is not None and t is not None and t <= made + ttl_ms
                hits.append(hit)
                if not hit:
                    made = t
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(hits, pa.bool_())], ["key", "event_id", "hit"])

    return rows.mapInArrow(run, f"key {log.schema['key'].dataType.simpleString()}, event_id long, hit boolean")


def lru_hits(log: DataFrame, max_size: int, scope: str = "tool_name") -> DataFrame:
    """Hit or miss of each request (scope, key, seq) under a limit on entries,
    with one cache for each scope: least recently used entries go first. The
    requests of a scope stream through one task in order; the task holds
    max_size keys, whatever the scope's length."""
    import pyarrow as pa

    fields = [f for f in log.schema if f.name in (scope, "key", "seq")]
    rows = log.select(*(f.name for f in fields)).repartition(scope).sortWithinPartitions(scope, "seq")
    names = [f.name for f in fields]

    def run(batches):
        now, held = object(), {}
        for batch in batches:
            scopes, keys = batch.column(names.index(scope)).to_pylist(), batch.column(names.index("key")).to_pylist()
            hits = []
            for s, k in zip(scopes, keys):
                if s != now:
                    now, held = s, {}
                hits.append(k in held)
                held.pop(k, None)
                held[k] = True
                if len(held) > max_size:
                    del held[next(iter(held))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.bool_())], [*names, "hit"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return rows.mapInArrow(run, f"{kinds}, hit boolean")


def stats(entries: DataFrame, hits: int = 0, misses: int = 0) -> DataFrame:
    total = hits + misses
    return entries.agg(
        F.count(F.lit(1)).alias("size"), F.lit(hits / total if total else 0.0).alias("hit_rate"),
        F.coalesce(F.sum("access_count") / F.count(F.lit(1)), F.lit(0.0)).alias("average_access_count"),
    )
