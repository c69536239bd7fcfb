"""Runs of alike neighbouring lines, as array expressions and as window relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import at, let


def collapse_lines(
    rows: Column, key: Callable[[Column], Column], min_run: int, head: int, tail: int, note: Callable[[Column], Column]
) -> Column:
    """Each run of at least min_run lines of one key becomes its first `head`
    lines, a note made from its length, and its last `tail` lines. A null key
    is never in a run."""

    def body(keyed: Column) -> Column:
        first = lambda r: (r["i"] == 0) | r["k"].isNull() | ~r["k"].eqNullSafe(at(keyed, r["i"] - 1)["k"])

        def emit(starts: Column) -> Column:
            def run(s: Column, j: Column) -> Column:
                end = F.coalesce(at(starts, j + 1)["i"], F.size(keyed))
                part = lambda a, n: F.transform(F.slice(keyed, a + 1, n), lambda r: r["x"])
                short = F.concat(part(s["i"], F.lit(head)), F.array(note(end - s["i"])), part(end - tail, F.lit(tail)))
                return F.when(s["k"].isNotNull() & (end - s["i"] >= min_run), short).otherwise(part(s["i"], end - s["i"]))

            return F.flatten(F.transform(starts, run))

        return let(F.filter(keyed, first), emit)

    return let(F.transform(rows, lambda x, i: F.struct(x.alias("x"), key(x).alias("k"), i.alias("i"))), body)


def exploded(df: DataFrame, text: str = "content", key: str = "payload_id") -> DataFrame:
    """The relation (payload_id, pos, line) of a column of texts."""
    return df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))


def collapse_runs(
    rows: DataFrame, run_key: Column, min_run: int, head: int, tail: int, note: Callable[[Column], Column], key: str = "payload_id"
) -> DataFrame:
    """The same over the relation (payload_id, pos, line): gaps and islands on
    one partitioning by payload. Gives payload_id, pos, part and line in order."""
    by = Window.partitionBy(key).orderBy("pos")
    marked = rows.withColumn("_k", run_key)
    new = F.col("_k").isNull() | ~F.col("_k").eqNullSafe(F.lag("_k").over(by)) | (F.row_number().over(by) == 1)
    islands = marked.withColumn("_new", new.cast("int")).withColumn("_island", F.sum("_new").over(by))
    run = Window.partitionBy(key, "_island")
    sized = islands.withColumn("_n", F.count(F.lit(1)).over(run)).withColumn("_at", F.row_number().over(run.orderBy("pos")))
    long_ = F.col("_k").isNotNull() & (F.col("_n") >= min_run)
    kept = sized.filter(~long_ | (F.col("_at") <= head) | (F.col("_at") > F.col("_n") - tail))
    notes = F.when(long_ & (F.col("_at") == head), F.array(F.col("line"), note(F.col("_n")))).otherwise(F.array("line"))
    return kept.select(key, "pos", F.posexplode(notes).alias("part", "line"))
