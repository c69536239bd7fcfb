"""Golden cases of the engine's operators."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstream.config import CacheConfig, Config, load_config
from quillstream.functions import text as tx
from quillstream.operators import code, debug, detect, evaluate, language, metrics, prompt_cache, result_cache, structured
from quillstream.operators.compact import hook_response, memoise, optimize
from quillstream.operators.runs import collapse_runs, exploded
from quillstream.sources import payloads as src


def test_white_space_and_boundaries(column):
    assert column(tx.trim, "\ufeff a\t\n\u00a0") == "a"
    assert column(lambda c: tx.test(c, r"\bà"), "Là") is True
    assert column(lambda c: tx.test(c, r"\bà\b"), " à ") is False
    assert column(tx.units, "😀a") == 3
    assert column(lambda c: tx.test(c, "^a$"), "a\n") is False


YAML = "name: x\nport: 80\nhost: y\nflag: on"


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"a": [1, 2]}', "json"), ('[1]', "json"), ('"just a string"', "unknown"), ('{"a": 1} x', "unknown"), ('{"a": NaN}', "unknown"),
        (YAML, "yaml"), ("a: 1\na: 2\nb: 3", "unknown"), ("a,b\n1,2", "csv"), ("a,b,c\n1,2\n1,2,3,4", "unknown"),
        ('n,t\n"a,b",1\n"c,d",2\n"e,f",3\n"g,h",4\n"i,j",5', "unknown"),
        ("import { a } from 'b'\nexport const x: number = 1\nconst y = () => {\n}", "code-ts"),
        ("def f(x):\n    return x\nclass A:\n    pass", "code-py"), ("<?php\nnamespace A;\nuse B;\n$this->x();", "code-php"),
        ("package main\nfunc main() {\n  fmt.Println(1)\n}", "code-go"), ("plain words here\nand there\nand more", "unknown"), ("", "unknown"),
        ("ERR one\nnpm ERR! x\nTraceback (most recent)\nE  AssertionError: x", "debug-output"),
    ],
)
def test_detect(spark, text, want):
    rows = spark.createDataFrame([(1, text)], "payload_id long, content string")
    assert detect.detect(rows).first()["format"] == want


def test_detect_null_and_empty_table(spark):
    rows = spark.createDataFrame([(1, None)], "payload_id long, content string")
    assert detect.detect(rows).first()["format"] == "unknown"
    assert detect.detect(rows.limit(0)).count() == 0


def test_debug_layers(column):
    tsc = "src/a.ts:1:2 - error TS1: bad\n\nsrc/b.ts:3:4 - error TS1: bad\n\nend"
    joined = lambda fn: lambda c: F.array_join(fn(tx.lines(c)), "\n")
    assert column(joined(debug.collapse_similar), tsc) == "src/a.ts:1:2 - error TS1: bad\n[compact] similar diagnostic repeated 1 more time\n\nend"
    assert column(joined(debug.collapse_similar), "\n \nx\n\ny") == "\n \nx\n\ny"
    assert column(joined(debug.collapse_similar), "src/a.ts:1:2 - error TS1: bad\n\n\n") == "src/a.ts:1:2 - error TS1: bad"
    assert column(joined(debug.collapse_duplicates), "a\na\na\nb\nc\nc") == "a\n[compact] repeated 2 more times\nb\nc\n[compact] repeated 1 more time"
    frames = "\n".join(f"  at f{i} (x.js:{i}:1)" for i in range(8))
    assert column(joined(debug.collapse_frames), "E\n" + frames).split("\n")[5:] == ["[compact] 3 more stack frames omitted", "  at f7 (x.js:7:1)"]
    assert column(joined(debug.drop_excerpts), "  41 | a\n> 43 | b\n12   x = 1\n     ~~") == "> 43 | b\n     ~~"
    assert column(joined(debug.drop_pointers), "a\n   ^^^\n | ~~\nb") == "a\nb"
    out = column(debug.compress_debug, "x\n\n\n\n\nx  \n   ^\n")
    assert out["text"] == "x\n\nx\n" and out["layers"] == ["merge-blank-lines", "remove-pointer-lines"]


def test_code_layers(column):
    ts = "const a = 'http' // note\nconst u = \"https://x//y\" // keep\n// only\n/** doc\n * more\n */\nx() // TODO now"
    out = column(lambda c: code.compress_code(c, F.lit("code-ts")), ts)
    assert out["text"] == "const a = 'http'\nconst u = \"https://x//y\" // keep\n/** doc\nx() // TODO now\n"
    py = 'x = "a # b"  # gone\ndef f():\n    """First.\n    second\n    """\n    # gone\n    return 1'
    assert column(lambda c: code.compress_code(c, F.lit("code-py")), py)["text"] == 'x = "a # b"\ndef f():\n    """First.\n    return 1\n'
    php = "#[Attr]\n$a = <<<EOT\n # in\n // in\nEOT;\n$b = 1; # out\n# gone"
    assert column(lambda c: code.compress_code(c, F.lit("code-php")), php)["text"] == "#[Attr]\n$a = <<<EOT\n # in\n // in\nEOT;\n$b = 1;\n"
    assert column(code.shorten_imports, "from '../../a/b/c'") == "from '…/c'"
    lines = "\n".join(f"import p{i}" for i in range(7))
    assert column(lambda c: F.array_join(code.summarise_imports(tx.lines(c), F.lit("code-py")), "\n"), lines) == "import p0\nimport p1\nimport p2\n// ... 4 more imports"
    same = "\n".join(f"const item{i} = make({i})" for i in range(6))
    assert column(lambda c: F.array_join(code.collapse_repetitive(tx.lines(c)), "\n"), same).split("\n")[3:] == ["// ... 4 more similar lines"]


def test_window_and_array_forms_agree(spark):
    texts = ["a\na\nb", "", "x\n\n\n\ny\ny", None, "q"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts) if t is not None], "payload_id long, content string")
    note = lambda n: F.concat(F.lit("n"), n.cast("string"))
    out = collapse_runs(exploded(rows), F.col("line"), 2, 1, 0, note).orderBy("payload_id", "pos", "part").collect()
    joined = {}
    for r in out:
        joined.setdefault(r["payload_id"], []).append(r["line"])
    from quillstream.operators.runs import collapse_lines

    want = rows.select("payload_id", collapse_lines(tx.lines(F.col("content")), lambda x: x, 2, 1, 0, note).alias("v")).collect()
    assert joined == {r["payload_id"]: r["v"] for r in want}


def test_toon():
    assert structured.toon_encode({"users": [{"id": 1, "name": "Al"}, {"id": 2, "name": "B,o"}]}) == 'users[2]{id,name}:\n  1,Al\n  2,"B,o"'
    assert structured.toon_encode({"a": {"b": [1, True, None], "e": []}, "x": "true", "f": 1e2}) == 'a:\n  b[3]: 1,true,null\n  e[0]:\nx: "true"\nf: 100'
    assert structured.toon_encode([{"a": 1, "b": {"c": 2}}, 5]) == "[2]:\n  - a: 1\n    b:\n      c: 2\n  - 5"
    assert structured.toon_encode({"2": 1, "10": 2}) == '"2": 1\n"10": 2'
    assert structured.toon_encode([[1, 2], []]) == "[2]:\n  - [2]: 1,2\n  - [0]:"


def test_readers():
    assert structured.csv_fields('a,"b ""c"", d", e ') == ["a", 'b "c", d', "e"]
    assert structured.read_csv("a,b\n1,2,3\n4") == [{"a": "1", "b": "2"}, {"a": "4", "b": ""}]
    assert structured.read_json('{"b":1,"2":0,"1":0}') == {"1": 0, "2": 0, "b": 1} and list(structured.read_json('{"b":1,"2":0,"1":0}')) == ["1", "2", "b"]
    assert structured.read_yaml("a: yes\nd: 2020-01-01\nn: 0o10\nf: 1.50") == {"a": "yes", "d": "2020-01-01", "n": 8, "f": 1.5}
    assert structured.read_json("[" * 100_000) is None


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text(max_size=6), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8))
def test_toon_takes_any_tree(tree):
    assert isinstance(structured.toon_encode(tree), str)


def test_language(column):
    pick = lambda t: column(language.detect_language, t)
    assert pick("The cat is on the mat and it is happy")["code"] == "en"
    assert (pick("")["code"], pick("")["confidence"]) == ("en", 0.0)
    zh = pick("你好，世界。这是一个测试。")
    assert zh["code"] == "zh" and zh["confidence"] > 0.7
    assert pick("こんにちは、これはテストです")["code"] == "ja"
    assert column(language.detect_mixed, "Hello 世界") == ["en", "zh"]
    assert column(lambda c: language.mixed_multiplier(language.detect_mixed(c)), "Hello 世界") == pytest.approx(0.4 * 1.5 + 0.6 * 2.0)
    assert column(lambda c: language.estimate_tokens(F.lit(10), language.detect_language(c)), "") == 10
    assert column(lambda c: language.multiplier(c), "xx") == 1.0


def test_evaluate_and_admission(spark):
    rows = spark.createDataFrame([(100, 70), (100, 71), (0, 0)], "o long, c long")
    got = evaluate.evaluate(rows, F.col("o"), F.col("c"), 30.0).collect()
    assert [r["worth"] for r in got] == [True, False, False]
    assert evaluate.valid_patterns(("(", "a")) == ["a"]
    rows = spark.createDataFrame([("t", None), ("skipme", "x"), ("(", "x"), (None, "x")], "tool_name string, content string")
    core = [r[0] for r in rows.select(evaluate.admission(Config(skip_tools=("skip", "(")))).collect()]
    assert core == ["Invalid input: content must be a string", "Tool skipme in skip list", None, None]
    hook = [r[0] for r in rows.select(evaluate.admission(Config(profile="hook", skip_tools=("(",)))).collect()]
    assert hook[2] == "Tool ( in skip list"
    small = Config(max_units=2)
    big = spark.createDataFrame([("t", "abc")], "tool_name string, content string").select(evaluate.admission(small)).first()[0]
    assert big.startswith("Content too large")


def test_optimize(spark):
    users = json.dumps({"users": [{"id": i, "username": f"user{i}", "email": f"u{i}@x.org", "active": True} for i in range(12)]}, indent=2)
    rows = spark.createDataFrame([(1, "t", users), (2, "t", "hello"), (3, "t", None), (4, "t", users)], "payload_id long, tool_name string, content string")
    got = {r["payload_id"]: r for r in optimize(rows).collect()}
    assert got[1]["optimized"] and got[1]["format"] == "json" and got[1]["optimized_content"].startswith("[TOON-JSON]\nusers[12]{id,username,email,active}:")
    assert got[2]["reason"] == "Not structured data" and got[2]["optimized_content"] == "hello"
    assert got[3]["reason"].startswith("Invalid input") and got[3]["original_tokens"] == 0
    assert {r["reason"] for r in optimize(rows, Config(enabled=False)).collect()} == {"Invalid input: content must be a string", "Optimizer disabled"}
    memo = {r["payload_id"]: r for r in memoise(rows, optimize).collect()}
    assert len(memo) == 4 and memo[4]["optimized"] and memo[1]["optimized_tokens"] == memo[4]["optimized_tokens"]
    assert optimize(rows.limit(0)).count() == 0
    hook = optimize(rows, Config(profile="hook"))
    answers = {r["payload_id"]: json.loads(r["a"]) for r in hook.select("payload_id", hook_response(hook).alias("a")).collect()}
    assert answers[2] == {"continue": True} and answers[1]["hookSpecificOutput"]["hookEventName"] == "PostToolUse"


def test_prompt_cache(spark):
    rows = spark.createDataFrame([("x", 2000), ("x", 10)], "content string, t int")
    got = rows.select(prompt_cache.wrap(F.col("content"), F.lit("tool"), F.lit("json"), F.col("t")).alias("c")).collect()
    assert got[0]["c"]["breakpoint"] and got[0]["c"]["static_prefix"].startswith("[SYSTEM] Token-Optimized Data from tool") and got[0]["c"]["dynamic_content"] == "\n[DATA]\nx"
    assert not got[1]["c"]["breakpoint"] and got[1]["c"]["dynamic_content"] == "[TOON-JSON]\nx"
    assert "users[2]{id,name}" in prompt_cache.PREFIX.replace("{{", "{").replace("}}", "}")
    cached = rows.select(prompt_cache.wrap(F.col("content"), F.lit("tool"), F.lit("json"), F.col("t")).alias("cached"))
    assert prompt_cache.cache_metrics(cached).first()["hit_rate"] == 0.0


def test_result_cache(spark):
    empty = spark.createDataFrame([], result_cache.ENTRY)
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "key string, value string")
    entries = result_cache.put(empty, new, 1000, 1000)
    asked = spark.createDataFrame([("a",), ("z",)], "key string")
    assert {(r["key"], r["hit"]) for r in result_cache.probe(asked, entries, 2000).collect()} == {("a", True), ("z", False)}
    assert result_cache.expired(entries, 2001).count() == 3 and result_cache.expired(entries, 2000).count() == 0
    touched = result_cache.touch(entries, asked, 1500)
    assert [r["key"] for r in result_cache.evict(touched, 1).collect()] == ["a"]
    assert result_cache.stats(touched, 1, 1).first()["hit_rate"] == 0.5 and result_cache.stats(empty).first()["average_access_count"] == 0.0
    log = spark.createDataFrame([("k", 0, 1), ("k", 5, 2), ("k", 11, 3), ("k", 12, 4)], "key string, ts_ms long, event_id long")
    assert {r["event_id"]: r["hit"] for r in result_cache.replay(log, 10).collect()} == {1: False, 2: True, 3: False, 4: True}
    seq = [("t", k, i) for i, k in enumerate("abacbda")]
    log = spark.createDataFrame(seq, "tool_name string, key string, seq long")
    got = {r["seq"]: r["hit"] for r in result_cache.lru_hits(log, 2).collect()}
    assert [got[i] for i in range(7)] == [False, False, True, False, False, False, False]
    assert result_cache.has(asked, entries, 1000).count() == 1 and result_cache.remove(entries, asked).count() == 2


def test_metrics(spark):
    empty = spark.createDataFrame([], metrics.METRIC)
    zero = metrics.token_stats(empty).first()
    assert zero["total_requests"] == 0 and zero["total_savings"] == 0 and zero["average_savings_percentage"] == 0.0
    text = metrics.status(metrics.token_stats(empty)).first()["status"]
    assert text == "No optimization activity yet."
    facts = [(1, "2026-01-01", "a", 100, 40, 60, 60.0, True, "json", None, None, None), (2, "2026-01-02", "b", 100, 100, 0, 0.0, False, None, "why", True, 7)]
    stats = metrics.token_stats(spark.createDataFrame(facts, metrics.METRIC))
    got = stats.first()
    assert (got["average_savings_percentage"], got["cache_hits"], got["cache_misses"], got["last_tool_name"], got["last_reason"]) == (30.0, 1, 1, "b", "why")
    assert "Cost savings" in metrics.dashboard(stats).first()["dashboard"]
    rows = spark.createDataFrame([("x", 1.0, 1), ("x", 3.0, 2), ("y", 2.0, 3), ("y", 8.0, 4)], "category string, savings_pct double, seq int")
    got = {r["category"]: r for r in metrics.savings_summary(rows).collect()}
    assert (got[None]["median"], got[None]["upper_median"], got["x"]["upper_median"]) == (2.5, 3.0, 3.0)


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"min_tokens": 5, "skip_tools": ["x"], "other": 1}')
    cfg = load_config(str(path), {"QUILL_MIN_TOKENS": "9", "QUILL_SKIP_TOOLS": "a, b", "QUILL_MIN_SAVINGS": "bad"})
    assert (cfg.min_tokens, cfg.skip_tools, cfg.min_savings) == (9, ("a", "b"), 30.0)
    path.write_text("{")
    assert load_config(str(path), {}) == Config()
    with pytest.raises(ValueError):
        CacheConfig(max_size=0)
    with pytest.raises(ValueError):
        Config(profile="x")


def test_sources(spark, tmp_path):
    path = str(tmp_path / "state")
    assert src.read_entries(spark, path).count() == 0 and src.read_metrics(spark, path).count() == 0
    entries = result_cache.put(spark.createDataFrame([], result_cache.ENTRY), spark.createDataFrame([("a", "1")], "key string, value string"), 10, 5)
    src.write_state(entries, path)
    assert src.read_entries(spark, path, 15).count() == 1 and src.read_entries(spark, path, 16).count() == 0
    (tmp_path / "r.json").write_text('{"tool_name": "t", "tool_response": "%s"}\n{"tool_name": "t", "tool_response": "x"}\n{"tool_name": "t", "tool_response": {"a": 1}}\n' % ("y" * 60))
    assert [r["content"][0] for r in src.hook_requests(spark, str(tmp_path / "r.json")).collect()] == ["y"]
    assert src.allowed_path("~/x") and not src.allowed_path("/etc/passwd", ("/tmp",))
    bad = src.requests(spark.createDataFrame([("",)], "content string")).first()["error"]
    assert json.loads(bad)["error"]["code"] == "INVALID_INPUT"
