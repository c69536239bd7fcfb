"""The engine's queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import code, debug, detect, evaluate, language, metrics, prompt_cache, result_cache, runs, structured
from ..operators.compact import cache_key, hook_response, memoise, optimize, optimize_cached
from ..sources import payloads as src

Query = Callable[[SparkSession, str], DataFrame]


def detect_json_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events' props by tool and format, with token sums."""
    found = detect.detect(src.event_payloads(spark, sf_dir))
    return found.groupBy("tool_name", "format").agg(F.count(F.lit(1)).alias("n"), F.sum(evaluate.chars4(F.col("content"))).alias("tokens"))


def detect_yaml_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.conversation_payloads(spark, sf_dir)
    return rows.select("payload_id", F.coalesce(detect.looks_like_yaml(F.col("content")), F.lit(False)).alias("is_yaml"))


def detect_csv_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.text_payloads(spark, sf_dir)
    return rows.select("payload_id", F.coalesce(detect.looks_like_csv(F.col("content")), F.lit(False)).alias("is_csv"))


def detect_code_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = src.table(spark, sf_dir, "pages").select(F.col("page_id").alias("payload_id"), detect.head_sample(F.coalesce("html", F.lit(""))).alias("s"))
    s = F.col("s")
    return pages.select(
        "payload_id", detect.hits(s, detect.TS).alias("ts"), detect.hits(s, detect.PY).alias("py"), detect.hits(s, detect.PHP).alias("php"),
        detect.hits(s, detect.GO).alias("go"), detect.hits(s, detect.GENERIC).alias("generic"),
    )


def detect_code_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first language in order with enough signs."""
    pages = src.table(spark, sf_dir, "pages").select(F.col("page_id").alias("payload_id"), F.coalesce("html", F.lit("")).alias("content"))
    rows = pages.unionByName(src.code_payloads(spark, sf_dir).select("payload_id", "content"))
    return rows.groupBy(F.coalesce(detect.code_type(F.col("content")), F.lit("none")).alias("code_type")).agg(F.count(F.lit(1)).alias("n"), F.sum("payload_id").alias("ids"))


def detect_debug_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = detect.debug_score(F.col("content"))
    rows = src.log_payloads(spark, sf_dir).select("payload_id", score.alias("score"))
    return rows.withColumn("confidence", F.round(detect.debug_confidence(F.col("score")), 6))


def skip_tool_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.event_payloads(spark, sf_dir)
    skip = evaluate.skipped_tool(F.col("tool_name"), ("^c", "sign", "("))
    return rows.groupBy("tool_name", skip.alias("skipped")).agg(F.count(F.lit(1)).alias("n"))


def admission_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = Config(profile="hook", skip_tools=("^src1$", "src2"), max_units=5000)
    rows = src.text_payloads(spark, sf_dir).withColumn("reason", evaluate.admission(cfg))
    return rows.groupBy(F.coalesce("reason", F.lit("admitted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def evaluate_chars4(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("content")
    rows = src.text_payloads(spark, sf_dir).withColumn("o", evaluate.chars4(text)).withColumn("c", evaluate.chars4(F.regexp_replace(text, "[|!]", "")))
    done = evaluate.evaluate(rows, F.col("o"), F.col("c"), 10.0)
    return done.select("payload_id", F.col("o").alias("original_tokens"), "savings_tokens", F.round("savings_pct", 6).alias("savings_pct"), "worth")


def bpe_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.text_payloads(spark, sf_dir).select("payload_id", evaluate.bpe(F.col("content")).alias("tokens"))


def merge_blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace("content", "\\. ", ".\n\n\n\n")
    rows = src.text_payloads(spark, sf_dir)
    return rows.select("payload_id", F.sha2(debug.merge_blank_lines(text), 256).alias("digest"))


def cleanup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ends trimmed, blank runs merged, one line feed at the end."""
    rows = src.conversation_payloads(spark, sf_dir)
    text = F.concat(F.lit("\u00a0\n"), F.regexp_replace(F.coalesce("content", F.lit("")), ", ", ", \t\n\n\n\n"), F.lit(" \ufeff"))
    return rows.select("payload_id", F.sha2(debug.cleanup(text), 256).alias("digest"))


def drop_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered source lines go."""
    rows = src.log_payloads(spark, sf_dir)
    return rows.select("payload_id", F.posexplode(debug.drop_excerpts(F.split("content", "\n", -1))).alias("pos", "line"))


def drop_pointer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.log_lines(spark, sf_dir)
    return rows.filter(~debug.is_pointer(F.col("line"))).groupBy("payload_id").agg(F.count(F.lit(1)).alias("n_lines"))


def _times(n):
    return F.concat(n.cast("string"), F.when(n > 1, F.lit(" more times")).otherwise(F.lit(" more time")))


def collapse_duplicate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = lambda n: F.concat(F.lit("[compact] repeated "), _times(n - 1))
    docs = src.text_payloads(spark, sf_dir).withColumn("content", F.coalesce("content", F.lit("")))
    return runs.collapse_runs(runs.exploded(docs), F.col("line"), 2, 1, 0, note).select(
        "payload_id", "pos", "part", F.sha2("line", 256).alias("digest")
    )


def collapse_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = lambda n: F.concat(F.lit("[compact] repeated "), _times(n - 1))
    return runs.collapse_runs(src.log_lines(spark, sf_dir), F.col("line"), 2, 1, 0, note)


def collapse_similar_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.log_payloads(spark, sf_dir)
    out = debug.collapse_similar(F.split("content", "\n", -1))
    return rows.select("payload_id", F.posexplode(out).alias("pos", "line"))


def collapse_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line")
    return runs.collapse_runs(src.log_lines(spark, sf_dir), F.when(debug.is_frame(line), F.lit("frame")), 6, 4, 1, debug.frames_note)


def shorten_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = src.table(spark, sf_dir, "part")
    text = F.concat(F.lit("import { p } from '../../lib/"), F.col("p_brand"), F.lit("/mod"), F.col("p_partkey").cast("string"), F.lit("'"))
    return parts.select("p_partkey", code.shorten_imports(text).alias("line"))


def _code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = src.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    line = F.when(k % 11 < 8, F.concat(F.lit("import p"), k.cast("string"))).when(
        k % 97 == 9, F.lit("return")
    ).otherwise(F.concat(F.lit("const part"), k.cast("string"), F.lit(" = '"), F.col("p_brand"), F.lit("'")))
    return parts.select(F.expr("p_partkey div 200").alias("payload_id"), (k % 200).alias("pos"), line.alias("line"))


def summarise_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = lambda n: F.concat(F.lit("// ... "), (n - 3).cast("string"), F.lit(" more imports"))
    key = F.when(code.is_import(F.col("line"), F.lit("code-ts")), F.lit("import"))
    return runs.collapse_runs(_code_lines(spark, sf_dir), key, 6, 3, 0, note)


def collapse_repetitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.collapse_runs(_code_lines(spark, sf_dir), code.structure_key(F.col("line")), 5, 3, 0, code.similar_note)


def strip_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.code_payloads(spark, sf_dir)
    return rows.select("payload_id", code.strip_comments(F.col("content"), F.col("tool_name"))["lines"].alias("content"))


def toon_tabular(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = src.table(spark, sf_dir, "nation")
    rows = n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))).alias("rows"))
    return rows.select("n_regionkey", structured.toon_table("nations", F.col("rows"), ["id", "name"]).alias("toon"))


def toon_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect(src.order_payloads(spark, sf_dir)).select("payload_id", "format", "toon")


def csv_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV payloads as the notation; their fields are texts."""
    return detect.detect(src.order_payloads(spark, sf_dir, "csv")).select("payload_id", "format", "confidence", "toon")


def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.text_payloads(spark, sf_dir).withColumn("found", language.detect_language(F.col("content")))
    return rows.select("payload_id", F.col("found.code").alias("code"), F.round("found.confidence", 6).alias("confidence"))


def mixed_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.text_payloads(spark, sf_dir).withColumn("codes", language.detect_mixed(F.col("content")))
    base = evaluate.chars4(F.col("content"))
    return rows.select(
        "payload_id", F.array_join("codes", ",").alias("codes"), F.round(language.mixed_multiplier(F.col("codes")), 6).alias("multiplier"),
        language.estimate_tokens_mixed(base, F.col("codes")).alias("tokens"),
    )


def adjusted_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.text_payloads(spark, sf_dir).withColumn("found", language.detect_language(F.col("content"))).withColumn("base", evaluate.chars4(F.col("content")))
    counted = rows.withColumn("adjusted", language.estimate_tokens(F.col("base"), F.col("found")))
    return counted.groupBy(F.col("found.code").alias("code")).agg(F.count(F.lit(1)).alias("n"), F.sum("base").alias("base"), F.sum("adjusted").alias("adjusted"))


def language_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary language, all languages, whether mixed, and the unguarded estimate."""
    rows = src.conversation_payloads(spark, sf_dir).withColumn("a", language.analyse(F.col("content"))).withColumn("found", language.detect_language(F.col("content")))
    made = language.encode_estimate(evaluate.chars4(F.col("content")), F.col("found"))
    rows = rows.withColumn("e", made)
    return rows.select(
        "payload_id", F.col("a.primary").alias("primary"), F.array_join("a.languages", ",").alias("languages"), F.round("a.multiplier", 6).alias("multiplier"),
        F.col("a.is_mixed").alias("is_mixed"), F.col("e.tokens").alias("tokens"), F.col("e.base_tokens").alias("base_tokens"),
    )


def cache_key_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.text_payloads(spark, sf_dir)
    return rows.groupBy(cache_key(F.lit("tool"), F.col("content")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("payload_id").alias("first_id"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.table(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(F.col("event_type").alias("tool_name"), cache_key(F.col("event_type"), F.col("user_id").cast("string")).alias("key"), "event_id", ms.alias("ts_ms"))


def cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of an unbounded cache: all but the first request of a key."""
    by = _log(spark, sf_dir).groupBy("tool_name", "key").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("tool_name").agg(
        (F.sum("n") - F.count(F.lit(1))).alias("hits"), F.count(F.lit(1)).alias("misses"),
        F.round((F.sum("n") - F.count(F.lit(1))) / F.sum("n"), 6).alias("hit_rate"),
    )


def cache_replay_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result_cache.replay(_log(spark, sf_dir), 3_600_000 * 24)


def cache_replay_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir).select("tool_name", "key", F.col("event_id").alias("seq"))
    return result_cache.lru_hits(log, 100).groupBy("tool_name").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).groupBy("key").agg(
        F.max("tool_name").alias("value"), F.min("ts_ms").alias("created"), F.max("ts_ms").alias("last_accessed"),
        (F.count(F.lit(1)) - 1).alias("access_count"), (F.min("ts_ms") + 3_600_000 * 24).alias("expires_at"),
    )


def lru_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result_cache.evict(_entries(spark, sf_dir), 100).select("key", "last_accessed", "access_count")


def cache_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that are set again start anew."""
    new = _log(spark, sf_dir).filter("tool_name = 'click'").select("key", F.lit("set again").alias("value"))
    out = result_cache.put(_entries(spark, sf_dir), new, 1_800_000_000_000, 3_600_000)
    return out.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.sum("access_count").alias("accesses"), F.max("expires_at").alias("expires_at"))


def cache_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that find a live entry."""
    entries, log = _entries(spark, sf_dir), _log(spark, sf_dir)
    now = entries.agg(F.max("created")).scalar()
    asked = result_cache.probe(log.select("tool_name", "key"), entries, now)
    there = result_cache.has(log.select("tool_name", "key"), entries, now).groupBy("tool_name").agg(F.count(F.lit(1)).alias("there"))
    counted = asked.groupBy("tool_name").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return counted.join(there, "tool_name", "left").select("tool_name", "hits", "misses", F.coalesce("there", F.lit(0)).alias("there"))


def ttl_expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _entries(spark, sf_dir)
    now = entries.agg(F.max("created")).scalar()
    return result_cache.expired(entries, now).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result_cache.stats(_entries(spark, sf_dir), 30, 10).withColumn("average_access_count", F.round("average_access_count", 6))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = src.table(spark, sf_dir, "events"), F.col("event_id")
    saved = k % 40
    return e.select(
        "event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("event_type").alias("tool_name"),
        (k % 100 + 50).alias("original_tokens"), (k % 100 + 50 - saved).alias("optimized_tokens"), saved.alias("savings"),
        (saved / (k % 100 + 50) * 100).alias("savings_percentage"), (saved > 10).alias("was_optimized"),
        F.when(saved > 10, "json").alias("format"), F.when(saved <= 10, "Not structured data").alias("reason"),
        (k % 17 == 0).alias("was_cached"), (k % 5).alias("cache_savings"),
    )


def _rounded(stats: DataFrame) -> DataFrame:
    for c in ("average_savings_percentage", "cache_hit_rate", "last_savings_percentage"):
        stats = stats.withColumn(c, F.round(c, 6))
    return stats


def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.token_stats(_metrics(spark, sf_dir)))


def token_stats_by_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.token_stats(_metrics(spark, sf_dir), ["tool_name"]))


def dashboard_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = metrics.token_stats(_metrics(spark, sf_dir), ["tool_name"])
    return stats.select("tool_name", F.round(metrics.cost_savings(F.col("total_savings") + F.col("cache_savings")), 6).alias("cost_savings"))


def dashboard_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.status(metrics.dashboard(metrics.token_stats(_metrics(spark, sf_dir)))).select("dashboard", "status")


def savings_stats_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _metrics(spark, sf_dir)
    out = metrics.savings_summary(rows, "tool_name", "savings_percentage", "event_id")
    return out.select("tool_name", "n", *(F.round(c, 6).alias(c) for c in ("mean", "lowest", "highest", "median", "upper_median")), "first_seen")


def prompt_cache_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.text_payloads(spark, sf_dir).withColumn("t", evaluate.chars4(F.col("content")))
    cached = prompt_cache.wrap(F.col("content"), F.col("tool_name"), F.lit("json"), F.col("t"))
    rows = rows.withColumn("c", cached)
    return rows.select(
        "payload_id", F.col("c.breakpoint").alias("breakpoint"), F.length("c.static_prefix").alias("prefix_chars"),
        F.sha2("c.dynamic_content", 256).alias("digest"), F.col("c.estimated_size").alias("estimated_size"),
    )


def prompt_cache_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.text_payloads(spark, sf_dir)
    c = prompt_cache.wrap(F.col("content"), F.col("tool_name"), F.lit("csv"), evaluate.chars4(F.col("content")), "openai")
    rows = rows.withColumn("c", c)
    return rows.select("payload_id", F.size(prompt_cache.as_blocks(F.col("c"))).alias("n_blocks"), F.length(prompt_cache.as_messages(F.col("c"))["system"]).alias("system_chars"))


def language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.profiles(spark).select("code", "name", "multiplier", "confidence", F.size("patterns").alias("n_patterns"))


def response_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.requests(src.text_payloads(spark, sf_dir))
    return rows.select("payload_id", F.coalesce("error", metrics.success(F.struct(evaluate.chars4(F.col("content")).alias("tokens")))).alias("response"))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [src.event_payloads(spark, sf_dir), src.text_payloads(spark, sf_dir), src.order_payloads(spark, sf_dir, "json", "csv")]
    parts += [src.log_payloads(spark, sf_dir), src.code_payloads(spark, sf_dir)]
    out = parts[0].select("payload_id", "tool_name", "content")
    for p in parts[1:]:
        out = out.unionByName(p.select("payload_id", "tool_name", "content"))
    return out


def optimize_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = optimize(_mixed(spark, sf_dir), Config(min_savings=10.0))
    return done.select("payload_id", "tool_name", "format", "optimized", "original_tokens", "optimized_tokens", "savings_tokens", "reason")


def optimize_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = optimize(_mixed(spark, sf_dir), Config(profile="hook", show_stats=True))
    return done.groupBy("format", "optimized").agg(F.count(F.lit(1)).alias("n"), F.sum("savings_tokens").alias("saved_chars"))


def optimize_memoised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal payloads are rewritten once and joined back."""
    rows = src.event_payloads(spark, sf_dir).select("payload_id", "tool_name", "content")
    done = memoise(rows, lambda df: optimize(df, Config(tokenizer="chars4", min_savings=0.0)))
    return done.select("payload_id", "format", "optimized", "original_tokens", "optimized_tokens")


def optimize_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON payloads from detection to the wrapped notation."""
    done = optimize(src.order_payloads(spark, sf_dir), Config(tokenizer="chars4", min_savings=10.0))
    return done.select(
        "payload_id", "format", "optimized", "original_tokens", "optimized_tokens", "savings_tokens", F.array_join("layers", ",").alias("layers"),
        F.sha2("optimized_content", 256).alias("digest"), "cached_savings",
    )


def hook_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hook's answers to JSON payloads."""
    done = optimize(src.order_payloads(spark, sf_dir), Config(profile="hook"))
    return done.select("payload_id", "optimized", F.sha2(hook_response(done), 256).alias("digest"))


def optimize_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: all events' payloads over a cache that has seen those of two tools."""
    rows, cfg = src.event_payloads(spark, sf_dir).select("payload_id", "tool_name", "content"), Config(tokenizer="chars4", min_savings=0.0)
    none = spark.createDataFrame([], result_cache.ENTRY)
    entries = optimize_cached(rows.filter("tool_name IN ('click', 'error')"), none, 1000, cfg)[1]
    done = optimize_cached(rows, entries, 2000, cfg)[0]
    return done.select("payload_id", "was_cached", "format", "optimized_content", "savings_tokens")


def metrics_of_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = optimize(src.order_payloads(spark, sf_dir), Config(tokenizer="chars4"))
    facts = metrics.metrics_of(done, F.col("payload_id"), F.lit("2026-01-01T00:00:00"))
    return metrics.token_stats(facts, ["tool_name"]).select("tool_name", "total_requests", "optimized_requests", "tokens_before", "tokens_after", "cache_misses")


NAMES = (
    detect_json_events, detect_yaml_gate, detect_csv_gate, detect_code_scores, detect_debug_score, skip_tool_filter, admission_reasons, evaluate_chars4,
    bpe_token_count, merge_blank_lines, drop_pointer_lines, collapse_duplicate_lines, collapse_log_lines, collapse_similar_diagnostics, collapse_stack,
    shorten_imports, summarise_imports, collapse_repetitive, strip_comments, toon_tabular, toon_nested, detect_language, mixed_multiplier,
    adjusted_tokens, cache_key_dedup, cache_hit_rate, cache_replay_ttl, cache_replay_lru, lru_top_k, ttl_expire, cache_stats, token_stats,
    token_stats_by_tool, dashboard_cost, dashboard_text, savings_stats_rollup, prompt_cache_wrap, prompt_cache_formats, language_profiles,
    detect_code_type, cleanup_lines, drop_excerpts, csv_read, language_analysis, cache_put, cache_probe, optimize_orders, hook_orders, optimize_cache_hits,
    response_envelope, optimize_pipeline, optimize_hook, optimize_memoised, metrics_of_pipeline,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in NAMES}
