"""A training-corpus pipeline over `documents`: toxic documents go, repeated
lines go, one document of each group of near duplicates stays, documents that
hold benchmark items go, and what is left is packed into token windows.

Every stage treats each row as a document of its own, also where doc_ids repeat
or are null: what a stage decides hangs on the row's text, not on its doc_id.
All but the last return the columns of their input, whatever their names, and
give an empty result for an empty table.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm.common import documents, materialise, settle, table
from quillstream.llm.decontaminate import find_leaks
from quillstream.llm.line_dedup import drop_repeated_lines
from quillstream.llm.near_copies import near_copies
from quillstream.llm.packing import pack
from quillstream.llm.toxicity import drop_toxic, toxicity_machine


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine of the training fold does not reject.

    Each row is scored by its whole text; a null or empty text has the lowest
    score and stays. Repeated rows stay or go together. Labels whose document
    isn't in docs are not learned; without both labels nothing goes."""
    return drop_toxic(docs, toxicity_machine(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without lines that many documents share; n_chars follows the text.

    No row goes. A null text becomes empty; a text that loses all lines is
    empty. Rows that repeat a doc_id count one by one as holders of a line, and
    all rows of the largest doc_id keep it; a row without doc_id counts but
    loses nothing."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    # other columns travel as one struct, so that none can clash with the operator's own
    packed = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *rest).alias("_rest"))
    out = drop_repeated_lines(packed)
    value = {c: F.col(c) if c in ("doc_id", "text") else F.col("_rest").getField(c) for c in docs.columns}
    if "n_chars" in value:
        value["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*(value[c].alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (SimHash over five-word shingles, links checked at a similarity of 0.8) the row
    with the smallest doc_id, of rows that repeat it one; rows without a doc_id stay. Null and blank texts are copies
    of one another."""
    rows = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    named = rows.filter("doc_id IS NOT NULL").select(F.col("_row").alias("row"), "doc_id", "text")
    found = materialise(near_copies(named), "near-copies")
    first = found.join(named.select("row", "doc_id"), "row").groupBy("root").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "row")).alias("first")
    )
    first = materialise(first.filter("n > 1").select("root", F.col("first.row").alias("kept")), "kept-copies")
    lost = found.join(first, "root").filter("row <> kept").select(F.col("row").alias("_row"))
    return rows.join(materialise(lost, "near-duplicates"), "_row", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, plain or with other numbers, names and units.

    A row goes by its text, whatever its doc_id; null and empty texts stay."""
    mark = F.xxhash64("text")
    leaks = find_leaks(docs.select(mark.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    leaks = materialise(leaks.select(F.col("doc_id").alias("_leak")).distinct(), "leaks")
    return docs.join(leaks, mark == F.col("_leak"), "left_anti").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed documents; a null or empty text is the end id alone, every row is packed."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: SQL can express neither the string-kernel machine nor the tokenizer; tests/llm/test_pipeline.py holds each stage
#: against a rule of its own (scores one by one, line counts, all pairs, all places of all items, rebuilt texts).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`, each to all that the one before kept.

    A stage's result is written to the shared folder and read back; the tables
    of its operator are deleted then, so that one stage's at most lie there."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = settle(spark, functools.partial(stage, spark, docs, sf_dir), f"stage-{name}")
    return docs
