"""Cases that were wrong once: cache before rewrite, errors as reasons, keys, clocks, units, payload sizes."""

import time

import pytest
from pyspark.sql import functions as F

from quillstream.config import CacheConfig, Config
from quillstream.functions import text as tx
from quillstream.functions.text import js
from quillstream.operators import code, debug, evaluate, language, result_cache, structured
from quillstream.operators.compact import memoise, optimize, optimize_cached, register, routes
from quillstream.sources import payloads as src
from quillstream.streaming import jobs

from .test_streaming import _stream

TABLE = "[" + ", ".join(f'{{"id": {i}, "name": "user{i}", "active": true}}' for i in range(30)) + "]"
CHARS = Config(tokenizer="chars4")


def test_cache_comes_first(spark):
    rows = spark.createDataFrame([(1, "t", TABLE), (2, "t", TABLE), (3, "t", "plain"), (4, "t", None), (5, "u", TABLE)], "id long, tool_name string, content string")
    none = spark.createDataFrame([], result_cache.ENTRY)
    done, entries = optimize_cached(rows, none, 1000, CHARS)
    assert {r["id"]: (r["optimized"], r["was_cached"]) for r in done.collect()} == {1: (True, False), 2: (True, False), 3: (False, False), 4: (False, False), 5: (True, False)}
    assert entries.count() == 2  # only what was optimized is kept
    off = Config(tokenizer="chars4", enabled=False, skip_tools=("t",))
    again, after = optimize_cached(rows, entries, 2000, off)
    got = {r["id"]: r for r in again.collect()}
    assert got[1]["was_cached"] and got[1]["optimized"] and got[3]["reason"] == "Optimizer disabled" and got[4]["reason"].startswith("Invalid input")
    assert got[1]["optimized_content"] == done.filter("id = 1").first()["optimized_content"]
    assert sorted(r["access_count"] for r in after.collect()) == [1, 2]
    assert not optimize_cached(rows, entries, 1000 + 3_600_001, off)[0].filter("was_cached").count()
    assert optimize_cached(rows, none, 1, Config(tokenizer="chars4", cache=CacheConfig(max_size=1)))[1].count() == 1
    broken = entries.withColumn("value", F.lit("{"))
    assert optimize_cached(rows, broken, 2000, CHARS)[0].filter("was_cached").count() == 0


def test_errors_are_reasons(spark, monkeypatch):
    deep = "[" * 700 + "1" + "]" * 700
    rows = spark.createDataFrame([("t", deep), ("t", TABLE)], "tool_name string, content string")
    got = optimize(rows, CHARS).collect()
    assert got[0]["optimized_content"] == deep and not got[0]["optimized"] and got[1]["optimized"]
    assert got[0]["reason"].startswith("Error: ") or got[0]["reason"].startswith("Savings too low")
    monkeypatch.setattr(code, "strip_inline", lambda *a: 1 / 0)
    import pandas as pd

    assert code._strip(pd.Series(["x"]), pd.Series(["code-ts"]), pd.Series([False]))["error"][0] == "division by zero"


def test_rejected_payloads_have_no_format(spark):
    rows = spark.createDataFrame([("t", '{"a": 1}')], "tool_name string, content string")
    got = optimize(rows, Config(tokenizer="chars4", min_savings=99.0)).first()
    assert not got["optimized"] and got["format"] is None and got["reason"].startswith("Savings too low")


def test_register_and_routes(spark):
    assert routes()["debug-output"] == "debug-output" and routes()["code-ts"] == "code"
    from quillstream.operators import compact

    before = dict(compact._ROUTES)
    try:
        register(("json",), "upper", lambda text, fmt, profile: F.struct(F.lit("x").alias("text"), F.array(F.lit("upper")).alias("layers"), F.lit(None).cast("string").alias("error")))
        got = optimize(spark.createDataFrame([("t", TABLE)], "tool_name string, content string"), CHARS).first()
        assert got["optimized_content"] == "[TOON-JSON]\nx" and got["layers"] == ["upper"]
    finally:
        compact._ROUTES.clear()
        compact._ROUTES.update(before)


def test_missing_tool_is_not_skipped(spark):
    rows = spark.createDataFrame([(None, "x"), ("", "x"), ("unknown", "x")], "tool_name string, content string")
    assert [r[0] for r in rows.select(evaluate.admission(Config(skip_tools=("^unk", "^$")))).collect()] == [None, None, "Tool unknown in skip list"]


def test_null_and_empty_are_not_one_payload(spark):
    rows = spark.createDataFrame([(1, "t", None), (2, "t", "")], "id long, tool_name string, content string")
    got = {r["id"]: r["reason"] for r in memoise(rows, lambda df: optimize(df, CHARS)).collect()}
    assert got[1].startswith("Invalid input") and got[2] == "Not structured data"


def test_white_space_in_diagnostic_keys(column):
    joined = lambda c: F.array_join(debug.collapse_similar(tx.lines(c)), "\n")
    assert column(joined, "a.ts:1:2 - error TS1: bad  type x\nb.ts:3:4 - error TS1: bad type\tx") == "a.ts:1:2 - error TS1: bad  type x\n[compact] similar diagnostic repeated 1 more time"
    assert column(joined, "1:2  error  no  x  rule/a\n3:4  error  no x  rule/a").count("\n") == 1


def test_utf16_units_and_blanks(column):
    assert column(evaluate.chars4, "😀😀😀") == 2 and column(evaluate.chars4, "abcde") == 2
    assert structured.csv_fields("﻿a ,\x1cb") == ["a", "\x1cb"]
    assert structured.quoted("\x85x") == "\x85x" and structured.quoted("﻿x") == '"﻿x"'


@pytest.mark.parametrize(
    "pattern, text, want",
    [
        (r"\b(the|is)\b", "athe", False), (r"\b(the|is)\b", "the.", True), (r"\b(the|is)\b", "éthe", True), (r"\b(the|is)\b", "theé", True), (r"\b(e|é|do)\b", " é ", False),
        (r"\b:=\s", "x:= 1", True), (r"\b:=\s", " := 1", False), (r"\b[\w./-]+\.ts\b", "/a.ts", True), (r"\berror TS\d+:", "xerror TS1:", False), (r"\bfmt\.\w+", "(fmt.P", True),
        (r"\b\d+\b", "a1", False), (r"\b\d+\b", "(12)", True), (r"\bx?\b", "x", True), (r"\b[a-z][a-z]*\d+\b", "Xab1", False), (r"\b(FAIL|FAILURES?)\b", "FAILURES", True),
        (r"\b(FAIL|FAILURES?)\b", "FAILURESX", False),
    ],
)
def test_word_boundaries(column, pattern, text, want):
    import re

    assert column(lambda c: tx.test(c, pattern), text) is want
    assert (re.search(pattern, text, re.A) is not None) is want  # the same with ASCII words, as the notation has it


def test_sink_keeps_the_real_time(spark, tmp_path):
    stream = _stream(spark, [("a", "1"), ("b", "2")], "key string, value string", tmp_path / "in")
    began = time.time_ns() // 1_000_000
    jobs.entry_sink(stream, str(tmp_path / "out"), str(tmp_path / "c"), 60_000).awaitTermination(120)
    now = time.time_ns() // 1_000_000
    rows = src.read_entries(spark, str(tmp_path / "out/0"), now).collect()
    assert len(rows) == 2 and all(began <= r["created"] <= now and r["expires_at"] == r["created"] + 60_000 for r in rows)
    jobs.entry_sink(stream, str(tmp_path / "one"), str(tmp_path / "c1"), 60_000, max_size=1, clock=lambda: 7).awaitTermination(120)
    assert [r["created"] for r in src.read_entries(spark, str(tmp_path / "one/0")).collect()] == [7]
    assert src.state_bytes(spark, str(tmp_path / "out")) > 0
    src.clear_state(spark, str(tmp_path / "out"))
    assert src.state_bytes(spark, str(tmp_path / "out")) == 0 and src.read_entries(spark, str(tmp_path / "out/0")).count() == 0


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.01"), reason="the driver's tables are not here")
def test_payloads_grow_in_number_not_in_size(spark):
    longest = lambda df: df.agg(F.max(F.length("content")), F.count(F.lit(1))).first()
    for make in (src.log_payloads, src.code_payloads):
        (small, few), (large, many) = (longest(make(spark, f"/root/testdata/sf{s}")) for s in ("0.001", "0.01"))
        assert large <= 1.5 * small and many > 5 * few


def test_quick_patterns_count_alike(spark):
    """The look ahead changes no count and no case-insensitive find."""
    patterns = [p for profile in language.PROFILES for p in profile[5]]
    words = " ".join(w for p in patterns if p.startswith("\\b") for w in p[3:-3].split("|"))
    marks = "".join(p[1:-1] for p in patterns if p.startswith("["))
    texts = [words, words.upper(), words.replace(" ", "_"), words.replace(" ", "à"), words.title() + "ſKıİ", marks, marks.upper(), "plain", ""]
    s = F.col("s")
    same = [F.regexp_count(s, F.lit(js(p))) == F.regexp_count(s, F.lit(language.quick(p))) for p in patterns]
    same += [s.rlike("(?iu)" + js(p)) == s.rlike("(?iu)" + language.quick(p)) for p in patterns]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select(F.array(*same).alias("same")).collect()
    assert all(all(r["same"]) for r in rows)
    assert sum(language.quick(p) != js(p) for p in patterns) >= 10
