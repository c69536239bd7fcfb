"""Shared plumbing of the training-data operators: shared-folder tables, Arrow
map helpers and the hold-out rule."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of one Arrow batch sent to Python; the byte limit below binds first on long texts.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20

_written: list[tuple[SparkSession, str]] = []
#: Tables written since the innermost settle() began.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where
    that is unset, a session on one machine (tests) gets a local one, and a
    cluster is an error, as its executors would each write to their own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _local_dir()
    return base.rstrip("/")


@functools.cache
def _local_dir() -> str:
    # kept here, as Spark lets no running session set spark.checkpoint.dir
    return "file://" + tempfile.mkdtemp(prefix="quillstream-")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    held = _passing.get()
    _written.append((spark, path)) if held is None else held.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts the
    lineage, survives lost executors, and costs each expensive pass only once."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make()'s result as materialise() gives it; the tables that make() wrote on
    its way are deleted as soon as the result is written, or make() has failed."""
    path = fresh_path(spark, name)
    outer = _passing.set([])
    try:
        made = make()
        made.write.parquet(path)
    finally:
        for old in _passing.get():
            _delete(spark, old)
        _passing.reset(outer)
    return spark.read.schema(made.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _tidy() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session is gone; the folder belongs to the cluster
            return


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, min(BATCH_ROWS, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes)))
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow over slices bounded in rows and, by their mean, in bytes: Spark
    bounds what it sends, and the slices bound the Python objects made of it at
    once. The session's settings stay as they are."""
    return df.mapInArrow(lambda batches: fn(_sliced(batches)), schema)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """The fixed hold-out fold: crc32 of doc_id as text; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def training_rows(df: DataFrame, modulus: int, remainder: int) -> DataFrame:
    return df.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder))


def bounded_sample(rows: DataFrame, by: str, per_class: int) -> DataFrame:
    """About per_class rows of each value of `by`, chosen by the hash of
    doc_id: a counting pass over two narrow columns fixes each class's share,
    so no row is ranked or shuffled. A class at or below the bound is taken
    whole. The classes themselves must be few (languages, labels)."""
    share = {r[0]: min(1.0, per_class / r[1]) for r in rows.groupBy(by).count().collect()}
    if not share:
        return rows.limit(0)
    unit = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    keep = F.lit(False)
    for value, part in sorted(share.items(), key=str):
        keep = keep | (F.col(by).eqNullSafe(F.lit(value)) & (unit < part))
    return rows.filter(keep)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, per_class: int
) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, text and label of about per_class training documents of each
    class, and the classes' true sizes. The narrow labels are sampled first;
    the sample's bound makes it fit for a broadcast, so no text is shuffled.
    Of repeated labels of a document the largest counts; labels other than 0
    and 1 are left out."""
    marks = training_rows(labels, modulus, remainder).filter(F.col(label).isin(0, 1))
    marks = marks.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    sizes = {r[0]: r[1] for r in marks.groupBy("label").count().collect()}
    chosen = bounded_sample(marks, "label", per_class)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), sizes
