"""The whole rewrite: admit, detect, route, compress, evaluate, wrap.

All in one pass over the payloads; each compressor works only on rows of its
formats. Equal payloads can be computed once and joined back (`memoise`), and
results can be kept from one call to the next (`optimize_cached`). An error in
a reader or compressor is the reason why its payload stays as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from .code import compress_code
from .debug import compress_debug
from ..functions.text import units
from .detect import CODE, STRUCTURED, detect
from .evaluate import admission, evaluate, savings_pct, tokens
from .prompt_cache import wrap
from .result_cache import evict, live, put, touch

#: A compressor maps (content, format, profile) to a struct of text, layers and error.
Compressor = Callable[[Column, Column, str], Column]
_ROUTES: dict[str, tuple[str, Compressor]] = {}


def register(formats: tuple[str, ...], name: str, compressor: Compressor) -> None:
    """Adds a compressor; the last one registered for a format counts."""
    for fmt in formats:
        _ROUTES[fmt] = (name, compressor)


def routes() -> dict[str, str]:
    """The name of the compressor of each format that one is registered for."""
    return {fmt: name for fmt, (name, _) in _ROUTES.items()}


register(CODE, "code", lambda text, fmt, profile: compress_code(text, fmt, profile))
register(("debug-output",), "debug-output", lambda text, fmt, profile: compress_debug(text).withField("error", F.lit(None).cast("string")))


def compress(detected: DataFrame, profile: str = "core") -> DataFrame:
    """Adds compressed, layers, compressor and error to rows with content, format, toon and parsed_error.

    One pass: each compressor is evaluated only on rows of its formats, and a
    Python function gets nulls for all others."""
    text, fmt = F.col("content"), F.col("format")
    kinds: dict[tuple[str, Compressor], list[str]] = {}
    for name, route in _ROUTES.items():
        kinds.setdefault(route, []).append(name)
    mine = fmt.isin(*(f for f in STRUCTURED if f not in _ROUTES))
    toon = F.struct(F.col("toon").alias("text"), F.array(F.lit("toon-encode")).alias("layers"), F.lit("toon").alias("name"), F.col("parsed_error").alias("error"))
    new = F.when(mine, toon)
    out = detected
    for k, ((name, compressor), formats) in enumerate(kinds.items()):
        its = fmt.isin(*formats)
        out = out.withColumn(f"_out{k}", F.when(its, compressor(F.when(its, text), fmt, profile)))
        made = F.col(f"_out{k}")
        new = new.when(its, F.struct(made["text"].alias("text"), made["layers"].alias("layers"), F.lit(name).alias("name"), made["error"].alias("error")))
    out = out.withColumn("_new", new)
    out = out.withColumn("compressed", F.col("_new.text")).withColumn("layers", F.col("_new.layers")).withColumn("compressor", F.col("_new.name"))
    out = out.withColumn("error", F.coalesce(F.col("_new.error"), F.col("parsed_error")))
    return out.drop("_new", "parsed_error", *(f"_out{k}" for k in range(len(kinds))))


RESULT_TYPES = (
    "optimized boolean, optimized_content string, original_tokens long, optimized_tokens long, savings_tokens long, savings_pct double, format string,"
    " layers array<string>, reason string, static_prefix string, cache_breakpoint boolean, cached_savings long"
)
RESULT = tuple(x.split()[0] for x in RESULT_TYPES.split(", "))


def optimize(payloads: DataFrame, cfg: Config | None = None) -> DataFrame:
    """Adds the columns of RESULT to payloads (tool_name, content, and any keys).

    A payload that isn't admitted, has no compressor, fails or saves too little
    keeps its content, with the reason and without a format."""
    cfg = cfg or Config()
    hook = cfg.profile == "hook"
    keep = [c for c in payloads.columns if c not in RESULT]
    judged = payloads.select(*keep).withColumn("_why", admission(cfg)).withColumn("_text", F.col("content"))
    judged = judged.withColumn("content", F.when(F.col("_why").isNull(), F.col("content")))  # what isn't admitted isn't looked at
    worked = compress(detect(judged, cfg.profile), cfg.profile).withColumn("content", F.col("_text")).drop("_text")
    count = (lambda c: units(c).cast("long")) if hook else (lambda c: tokens(c, cfg.tokenizer))
    invalid = F.col("_why").startswith("Invalid input") | F.col("_why").startswith("Content too large")
    worked = worked.withColumn("original_tokens", F.when(F.coalesce(invalid, F.lit(False)), F.lit(0)).otherwise(count(F.col("content"))).cast("long"))
    worked = worked.withColumn("_new_tokens", count(F.col("compressed")))
    limit = F.when(F.col("format").isin(*STRUCTURED), cfg.min_savings).otherwise(10.0) if hook else F.lit(float(cfg.min_savings))
    pct = savings_pct(F.col("original_tokens"), F.col("_new_tokens"))
    worth = F.coalesce(F.col("compressed").isNotNull() & (pct >= limit), F.lit(False))
    worked = worked.withColumn("savings_pct", pct).withColumn("optimized", worth)
    reason = (
        F.when(F.col("_why").isNotNull(), F.col("_why")).when(F.col("optimized"), F.lit(None).cast("string"))
        .when(F.col("error").isNotNull(), F.concat(F.lit("Error: "), F.col("error")))
        .when(F.col("format") == "unknown", F.lit("Not structured data"))
        .when(F.col("compressed").isNull(), F.concat(F.lit("No compressor for type: "), F.col("format")))
        .otherwise(F.concat(F.lit("Savings too low: "), F.format_string("%.1f", F.col("savings_pct")), F.lit("%")))
    )
    structured = F.col("format").isin(*STRUCTURED)
    tool = F.coalesce(F.col("tool_name"), F.lit("unknown"))
    caching = cfg.caching and not hook
    worked = worked.withColumn("_cached", wrap(F.col("compressed"), tool, F.col("format"), F.col("_new_tokens"), cfg.provider, caching))
    content = F.when(structured, F.concat(F.col("_cached.static_prefix"), F.col("_cached.dynamic_content"))).otherwise(F.col("compressed"))
    if cfg.show_stats and hook:
        label = F.when(F.col("format") == "debug-output", "DEBUG").otherwise(F.upper(F.regexp_replace("format", "^code-", "")))
        content = F.concat(content, F.format_string("\n\n--- %s compacted, ~%.0f%% smaller ---", label, F.col("savings_pct")))
    saved = F.col("original_tokens") - F.col("_new_tokens")
    mark = F.coalesce(F.col("optimized") & structured & F.col("_cached.breakpoint"), F.lit(False))
    return worked.select(
        *keep, "optimized", F.when(F.col("optimized"), content).otherwise(F.col("content")).alias("optimized_content"), "original_tokens",
        F.when(F.col("optimized"), F.col("_new_tokens")).alias("optimized_tokens"), F.when(F.col("optimized"), saved).alias("savings_tokens"),
        F.when(F.col("optimized"), F.col("savings_pct")).alias("savings_pct"), F.when(F.col("optimized"), F.col("format")).alias("format"),
        F.when(F.col("optimized"), F.col("layers")).alias("layers"), reason.alias("reason"),
        F.when(mark, F.col("_cached.static_prefix")).alias("static_prefix"), mark.alias("cache_breakpoint"),
        F.when(mark, F.floor(saved * 0.9)).otherwise(0).cast("long").alias("cached_savings"),
    )


def memoise(payloads: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work on the distinct (tool_name, content) only, its columns joined back to all rows by key."""
    key = cache_key(F.col("tool_name"), F.col("content"))
    # a missing and an empty text have one key, but aren't answered alike
    keyed = payloads.withColumn("_key", F.when(F.col("content").isNull(), F.concat(F.lit("null:"), key)).otherwise(key))
    done = work(keyed.select("_key", "tool_name", "content").dropDuplicates(["_key"])).drop("tool_name", "content")
    clash = [c for c in done.columns if c in payloads.columns]
    return keyed.drop(*clash).join(done, "_key", "left").drop("_key")


def cache_key(tool: Column, content: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(tool, F.lit("unknown")), F.lit(":"), F.coalesce(content, F.lit(""))), 256)


def optimize_cached(payloads: DataFrame, entries: DataFrame, now: int, cfg: Config | None = None) -> tuple[DataFrame, DataFrame]:
    """The columns of RESULT and `was_cached` for payloads, and the entries after it.

    Texts that are missing or too large are refused; then the cache is asked,
    before the optimizer's switch, the tools to skip and the rewrite. Only what
    was optimized is stored. Payloads without an entry are rewritten once for
    each key. An entry that can't be read counts as none."""
    cfg = cfg or Config()
    key = cache_key(F.col("tool_name"), F.col("content"))
    stored = live(entries, now).select(F.col("key").alias("_held"), F.from_json("value", RESULT_TYPES).alias("_value")).filter("_value.optimized")
    refused = F.col("content").isNull() | (units(F.col("content")) > cfg.max_units)
    asked = payloads.drop(*RESULT, "was_cached").withColumn("_key", F.when(~refused, key)).join(stored, F.col("_key") == F.col("_held"), "left").drop("_held")
    own = [c for c in asked.columns if c not in ("_key", "_value")]
    hit = asked.filter("_value IS NOT NULL")
    missed = memoise(asked.filter("_value IS NULL").drop("_value", "_key"), lambda df: optimize(df, cfg)).withColumn("_key", key)
    rows = hit.select("_key", *own, "_value.*", F.lit(True).alias("was_cached"))
    rows = rows.unionByName(missed.select("_key", *own, *RESULT, F.lit(False).alias("was_cached")))
    new = missed.filter("optimized").select(F.col("_key").alias("key"), F.to_json(F.struct(*RESULT)).alias("value"))
    after = put(touch(entries, hit.select(F.col("_key").alias("key")), now), new, now, cfg.cache.ttl_ms)
    return rows.drop("_key"), evict(live(after, now), cfg.cache.max_size)


def hook_response(optimized: DataFrame) -> Column:
    """The answer of the hook: passed through, or the new content."""
    new = F.to_json(
        F.struct(
            F.lit(True).alias("continue"), F.lit(True).alias("suppressOutput"),
            F.struct(F.lit("PostToolUse").alias("hookEventName"), F.col("optimized_content").alias("additionalContext")).alias("hookSpecificOutput"),
        )
    )
    return F.when(F.col("optimized"), new).otherwise(F.lit('{"continue":true}'))


__all__ = ["RESULT", "compress", "evaluate", "memoise", "cache_key", "optimize", "optimize_cached", "register", "routes", "hook_response"]
