"""Line dedup by levelled sorted runs of line hashes (DataFrame operations only).

Every document contributes the distinct 128-bit hashes of its long lines. The
hashes arrive in batches. A batch is aggregated, merge-joined with the sorted
runs of the earlier batches, and split: keys that no run holds (the anti-join)
become the batch's own sorted run, keys already held become increments. When a
level has collected `fanout` runs they are merged into one run of the next
level, so that a key is rewritten once a level. Keys are unique across runs,
and all runs are bucketed alike, so that none is shuffled or sorted again.
A key's document count and largest document are its run row plus its
increments; lines of keys with enough documents are then dropped everywhere
but in the largest document that holds them.
"""

from __future__ import annotations

import contextlib
import functools
import string
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh_path, materialise

BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 2


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased (other letters stay)."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def line_hash(line: Column, min_chars: int) -> Column:
    """128-bit hash of a line's key, null for keys that are too short."""
    key = line_key(line)
    return F.when(F.length(key) >= min_chars, F.unhex(F.md5(key)))


def lines_of(text: Column) -> Column:
    """The lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


#: Spark refuses tables of more buckets.
MOST_BUCKETS = 100_000


@contextlib.contextmanager
def ordered_scans(spark: SparkSession) -> Iterator[None]:
    """Lets merge joins rely on the order inside a run's buckets (one file each) instead of sorting them again."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class LevelledRuns:
    """Sorted runs (h, n, top) by level; h is unique over all runs.

    A run is a table in the shared folder, bucketed and sorted by h, one file a
    bucket, so that batches are merged with it where it lies: only the batch's
    own aggregated keys are shuffled. A batch's table holds its run (held = 0)
    and its increments of keys that earlier runs hold (held = 1). close()
    removes the tables from the catalog."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.root = spark, fanout, fresh_path(spark, "line-runs")
        self.buckets = min(MOST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.levels: list[list[str]] = [[]]
        self.batches: list[str] = []
        self.tables: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"line_runs_{self.root[-12:]}_{len(self.tables)}"
        out = rows.select("h", "n", "top", "held").write.partitionBy("held").bucketBy(self.buckets, "h").sortBy("h")
        self.tables.append(name)
        with ordered_scans(self.spark):
            out.option("path", f"{self.root}/{len(self.tables)}").saveAsTable(name, format="parquet")
        return name

    def _read(self, name: str, held: int = 0) -> DataFrame:
        return self.spark.table(name).filter(F.col("held") == held).select("h", "n", "top")

    def _union(self, parts: list[DataFrame]) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], "h binary, n long, top long")

    def _names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def runs(self) -> DataFrame:
        return self._union([self._read(name) for name in self._names()])

    def add(self, keys: DataFrame) -> DataFrame:
        """Adds a batch of rows (h, doc_id), one for each key and document;
        returns the batch's new keys, which no earlier batch had."""
        batch = keys.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))
        flags = []
        for k, name in enumerate(self._names()):
            batch = batch.join(self._read(name).select("h", F.lit(1).alias(f"_in{k}")).hint("merge"), "h", "left")
            flags.append(F.col(f"_in{k}"))
        name = self._write(batch.withColumn("held", F.coalesce(*flags, F.lit(0))))
        self.levels[0].append(name)
        self.batches.append(name)
        self._compact()
        return self._read(name)

    def _compact(self) -> None:
        """Merges a level's runs, once there are `fanout`, into one run of the next level."""
        k = 0
        while k < len(self.levels):
            if len(self.levels[k]) >= self.fanout:
                first, *others = (self._read(name) for name in self.levels[k])
                for other in others:  # both sides lie in order, bucket by bucket
                    other = other.select("h", F.col("n").alias("_n"), F.col("top").alias("_top")).hint("merge")
                    first = first.join(other, "h", "full").select("h", F.coalesce("n", "_n").alias("n"), F.coalesce("top", "_top").alias("top"))
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._write(first.withColumn("held", F.lit(0))))
                self.levels[k] = []
            k += 1

    def frequent(self, min_docs: int) -> DataFrame:
        """Keys held by at least min_docs documents, with the largest of them.

        Increments are few, as only keys that come again have them; they go to the runs, which stay where they are."""
        more = self._union([self._read(name, 1) for name in self.batches])
        more = more.groupBy("h").agg(F.sum("n").alias("_n"), F.max("top").alias("_top"))
        parts = []
        for name in self._names():
            both = self._read(name).join(more.hint("merge"), "h", "left")
            total = both.select("h", (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), F.greatest("top", "_top").alias("top"))
            parts.append(total.filter(F.col("n") >= min_docs))
        return self._union(parts).select("h", "top")

    def close(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """All columns of docs with `text` rewritten, plus n_lines and n_dropped.

    docs needs doc_id and text; other columns pass through, whatever their
    names (n_lines and n_dropped are replaced). Each row is one document: rows
    that repeat a doc_id count one by one, and all rows of the largest doc_id
    keep the line. A null or empty text is one empty line and stays empty; a
    document that loses all lines gets an empty text; a row without doc_id
    counts as a document but never loses a line. An empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    staged = fresh_path(spark, "line-hashes")
    hashes = F.array_distinct(F.array_compact(F.transform(lines_of(F.col("text")), lambda x: line_hash(x, min_chars))))
    (
        docs.select("doc_id", F.explode(hashes).alias("h"), F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"))
        .write.partitionBy("batch").parquet(staged)
    )
    schema = "doc_id long, h binary, batch int"
    lines = spark.read.schema(schema).parquet(staged)
    runs = LevelledRuns(spark, fanout)
    for k in range(batches):
        runs.add(lines.filter(F.col("batch") == k))
    # written, so that the join deals both sides itself and can split a hot line's rows
    with ordered_scans(spark):
        frequent = materialise(runs.frequent(min_docs), "frequent-lines")
    runs.close()
    lost = (
        lines.select("doc_id", "h").join(frequent, "h").filter(F.col("doc_id") != F.col("top"))
        .groupBy(F.col("doc_id").alias("_lost_id")).agg(F.collect_set("h").alias("_lost"))
    )
    # the row travels as one struct, so that no name of its columns can clash
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(F.struct(*names).alias("row"))
    joined = rows.join(lost, F.col("row.doc_id") == F.col("_lost_id"), "left")
    every = lines_of(F.col("row.text"))
    kept = F.when(
        F.col("_lost").isNotNull(),
        F.filter(every, lambda x: ~F.coalesce(F.array_contains(F.col("_lost"), line_hash(x, min_chars)), F.lit(False))),
    ).otherwise(every)
    done = joined.select("row", F.size(every).cast("long").alias("n_lines"), kept.alias("kept"))
    text = F.array_join("kept", "\n")
    return done.select(
        *((text if c == "text" else F.col("row").getField(c)).alias(c) for c in names),
        "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT d.doc_id, d.rid, u.pos, d.parts[u.pos] AS line,
         translate(trim(d.parts[u.pos], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
       LATERAL (SELECT unnest(range(1, len(d.parts) + 1)) AS pos) u
), frequent AS (
  SELECT k, max(doc_id) AS top FROM (SELECT DISTINCT rid, doc_id, k FROM lines WHERE length(k) >= 40)
  GROUP BY k HAVING count(*) >= 5
), marked AS (
  SELECT l.*, coalesce(f.top <> l.doc_id, false) AS gone FROM lines l LEFT JOIN frequent f ON l.k = f.k
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""
