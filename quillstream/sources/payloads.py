"""Payload sources and state sinks.

A payload is a row (payload_id, tool_name, content, ts). The builders turn the
driver's tables into tool output of every kind that the engine handles.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import METRIC, failure
from ..operators.result_cache import ENTRY, live


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(F.col("event_id").alias("payload_id"), F.col("event_type").alias("tool_name"), F.col("props").alias("content"), F.col("ts").cast("timestamp").alias("ts"))


def text_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("payload_id"), F.col("source").alias("tool_name"), F.col("text").alias("content"))


def conversation_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("payload_id"), F.col("role").alias("tool_name"), F.col("text").alias("content"))


def order_payloads(spark: SparkSession, sf_dir: str, *formats: str) -> DataFrame:
    """A payload in each of the formats (json, csv) for each order, with its line items, from one aggregation."""
    item = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"))
    row = lambda r: F.concat_ws(",", r["l_linenumber"].cast("string"), r["l_partkey"].cast("string"), r["l_quantity"].cast("string"), r["l_returnflag"])
    content = {
        "json": F.to_json(F.struct(F.col("l_orderkey").alias("order"), "items"), {"pretty": "true"}),
        "csv": F.concat_ws("\n", F.lit("line,part,quantity,flag"), F.transform("items", row)),
    }
    made = F.explode(F.array(*(F.struct(F.lit(f"orders_{f}").alias("tool_name"), content[f].alias("content")) for f in formats or ("json",))))
    return items.select(F.col("l_orderkey").alias("payload_id"), made.alias("r")).select("payload_id", "r.tool_name", "r.content")


#: Events of a log and parts of a source file: payloads grow in number with the tables, not in size.
LOG_EVENTS, FILE_PARTS = 200, 50


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostic lines (payload_id, pos, line) made from events, one log for every 200 of them."""
    e = table(spark, sf_dir, "events")
    seq = F.col("event_id")
    line = (
        F.when(seq % 7 == 0, F.lit(""))
        .when(seq % 7 == 1, F.concat(F.lit("src/"), F.col("event_type"), F.lit(".ts:"), (seq % 90 + 1).cast("string"), F.lit(":5 - error TS2322: bad "), F.when(seq % 2 == 0, " ").otherwise(""), F.col("event_type")))
        .when(seq % 7 == 2, F.concat((seq % 40).cast("string"), F.lit(" | value")))
        .when(seq % 7 == 3, F.concat(F.lit("    at handler (/app/"), F.col("event_type"), F.lit(".js:10:3)")))
        .when(seq % 7 == 4, F.lit("      ^^^^"))
        .otherwise(F.concat(F.lit("warn: "), F.col("event_type")))
    )
    copies = F.explode(F.sequence(F.lit(1), (seq % 9 + 1).cast("int")))
    rows = e.select(F.expr(f"event_id div {LOG_EVENTS}").alias("payload_id"), "event_id", line.alias("line"), copies.alias("copy"))
    return rows.select("payload_id", (F.col("event_id") * 16 + F.col("copy")).alias("pos"), "line")


def log_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log_lines(spark, sf_dir)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda r: r["line"]), "\n")
    return rows.groupBy("payload_id").agg(joined.alias("content")).withColumn("tool_name", F.lit("logs"))


def code_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source file in each of two languages for every 50 parts, with imports, comments and repeated lines."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", F.expr(f"p_partkey div {FILE_PARTS}").alias("n"))
    ordered = F.sort_array(F.collect_list(F.struct("p_partkey", "p_brand", "p_size")))
    rows = p.groupBy("n").agg(ordered.alias("parts"))
    slash = lambda r: F.concat(F.lit("const part"), r["p_partkey"].cast("string"), F.lit(": number = "), r["p_size"].cast("string"), F.lit("; // "), r["p_brand"])
    imports = lambda r: F.concat(F.lit("import { p"), r["p_partkey"].cast("string"), F.lit(" } from '../../lib/deep/parts'"))
    ts = F.concat_ws("\n", F.transform(F.slice("parts", 1, 8), imports), F.lit(""), F.lit("// parts of a nation"), F.transform("parts", slash), F.lit("export const done = true"))
    py = F.concat_ws(
        "\n", F.lit("import os"), F.lit("import re"), F.lit("def build(x):"), F.lit('    """Builds.'), F.lit("    All of it."), F.lit('    """'),
        F.transform("parts", lambda r: F.concat(F.lit("    y = '"), r["p_brand"], F.lit("#'  # part "), r["p_partkey"].cast("string"))), F.lit("# end"),
    )
    both = F.explode(F.array(F.struct(F.lit("code-ts").alias("kind"), ts.alias("content")), F.struct(F.lit("code-py").alias("kind"), py.alias("content"))))
    out = rows.select("n", both.alias("r"))
    return out.select((F.col("n") * 2 + F.when(F.col("r.kind") == "code-py", 1).otherwise(0)).alias("payload_id"), F.col("r.kind").alias("tool_name"), F.col("r.content").alias("content"))


def requests(rows: DataFrame) -> DataFrame:
    """Requests (content, toolName) with an error envelope where the content is missing or empty."""
    bad = F.col("content").isNull() | (F.col("content") == "")
    return rows.withColumn("error", F.when(bad, failure("INVALID_INPUT", F.lit("content must be a non-empty string"))))


def hook_requests(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSON {tool_name, tool_response}; answers that are no text or shorter than 50 are left out."""
    rows = spark.read.schema("tool_name string, tool_response string").json(path)
    return rows.filter(F.length("tool_response") >= 50).select("tool_name", F.col("tool_response").alias("content"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Stored metric facts; none where nothing is stored."""
    return _read(spark, path, METRIC)


def read_entries(spark: SparkSession, path: str, now: int | None = None) -> DataFrame:
    """Stored cache entries; expired ones are skipped where a time is given."""
    rows = _read(spark, path, ENTRY)
    return rows if now is None else live(rows, now)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def state_bytes(spark: SparkSession, path: str) -> int:
    """Size of stored state; 0 where nothing is stored."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(where).getLength() if fs.exists(where) else 0


def clear_state(spark: SparkSession, path: str) -> None:
    """Removes stored state; nothing where nothing is stored."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def write_state(rows: DataFrame, path: str) -> None:
    """Replaces stored state; readers see the old or the new, by the committer's rename."""
    rows.write.mode("overwrite").parquet(path)


def allowed_path(path: str, roots: tuple[str, ...] | None = None) -> bool:
    """Whether a local path lies below the home or a temporary folder."""
    roots = roots or (os.path.expanduser("~"), tempfile.gettempdir())
    full = os.path.realpath(os.path.expanduser(path))
    return any(full == (r := os.path.realpath(root)) or full.startswith(r + os.sep) for root in roots)
