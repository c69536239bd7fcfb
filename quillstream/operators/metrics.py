"""Metrics of requests: totals, last values, dashboards, benchmark statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRIC = (
    "event_id long, timestamp string, tool_name string, original_tokens long, optimized_tokens long, savings long, savings_percentage double,"
    " was_optimized boolean, format string, reason string, was_cached boolean, cache_savings long"
)


def metrics_of(optimized: DataFrame, event_id: Column, timestamp: Column) -> DataFrame:
    """The metric facts of optimised payloads."""
    return optimized.select(
        event_id.alias("event_id"), timestamp.cast("string").alias("timestamp"), F.coalesce("tool_name", F.lit("unknown")).alias("tool_name"),
        "original_tokens", F.coalesce("optimized_tokens", "original_tokens").alias("optimized_tokens"),
        F.coalesce("savings_tokens", F.lit(0)).cast("long").alias("savings"), F.coalesce("savings_pct", F.lit(0.0)).alias("savings_percentage"),
        F.col("optimized").alias("was_optimized"), "format", "reason", F.lit(None).cast("boolean").alias("was_cached"),
        F.lit(None).cast("long").alias("cache_savings"),
    )


def token_stats(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Running totals and last values, over all metrics or by columns. An empty
    table without `by` gives one row of zeros."""
    done = F.col("was_optimized")
    cached = F.coalesce(F.col("was_cached"), F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    hits, misses = F.count_if(cached), F.count_if(~cached & done)
    before, saved = F.sum("original_tokens"), F.sum("savings")
    last = lambda c: F.max_by(c, F.struct("timestamp", "event_id"))
    return metrics.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total_requests"), F.count_if(done).alias("optimized_requests"), F.count_if(~done).alias("skipped_requests"),
        zero(before).alias("tokens_before"), zero(F.sum("optimized_tokens")).alias("tokens_after"), zero(saved).alias("total_savings"),
        F.when((F.count_if(done) > 0) & (before > 0), saved / before * 100).otherwise(0.0).alias("average_savings_percentage"),
        hits.alias("cache_hits"), misses.alias("cache_misses"), F.when(hits + misses > 0, hits / (hits + misses)).otherwise(0.0).alias("cache_hit_rate"),
        zero(F.sum("cache_savings")).alias("cache_savings"), last("timestamp").alias("last_updated_at"), last("tool_name").alias("last_tool_name"),
        last("format").alias("last_format"), last("was_optimized").alias("last_was_optimized"), last("reason").alias("last_reason"),
        last("savings").alias("last_savings"), last("savings_percentage").alias("last_savings_percentage"),
    )


def _rate(part: Column, whole: Column) -> Column:
    return F.format_string("%.1f", F.when(whole > 0, part / whole * 100).otherwise(0.0))


def cost_savings(saved: Column) -> Column:
    """Dollars at three a million tokens."""
    return saved / 1_000_000 * 3


def dashboard(stats: DataFrame) -> DataFrame:
    """Adds dashboard, a text, to rows of token_stats."""
    n = lambda c: F.format_number(F.col(c), 0)
    cache = F.concat(
        F.lit("\n\nPrompt caching\nCache hits: "), F.col("cache_hits"), F.lit("\nCache misses: "), F.col("cache_misses"), F.lit("\nHit rate: "),
        F.format_string("%.1f", F.col("cache_hit_rate") * 100), F.lit("%\nAdditional cache savings: "), n("cache_savings"), F.lit(" tokens"),
    )
    return stats.withColumn(
        "dashboard",
        F.concat(
            F.lit("Token compaction statistics\nTotal requests: "), F.col("total_requests"), F.lit("\nOptimized: "), F.col("optimized_requests"), F.lit(" ("),
            _rate(F.col("optimized_requests"), F.col("total_requests")), F.lit("%)\n\nTokens before: "), n("tokens_before"), F.lit("\nTokens after: "),
            n("tokens_after"), F.lit("\nTotal savings: "), n("total_savings"), F.lit(" ("), F.format_string("%.1f", F.col("average_savings_percentage")),
            F.lit("%)"), F.when((F.col("cache_hits") > 0) | (F.col("cache_misses") > 0), cache).otherwise(""),
            F.lit("\n\nCost savings at $3 a million input tokens: $"), F.format_string("%.2f", cost_savings(F.col("total_savings") + F.col("cache_savings"))),
        ),
    )


def status(stats: DataFrame) -> DataFrame:
    """Adds status, a short text, to rows of token_stats."""
    last = F.when(
        F.col("last_was_optimized"),
        F.concat(
            F.lit("\nLast optimized: "), F.coalesce("last_tool_name", F.lit("unknown")), F.lit(" as "), F.coalesce("last_format", F.lit("unknown")),
            F.lit("\nSaved: "), F.format_number("last_savings", 0), F.lit(" tokens ("), F.format_string("%.1f", F.col("last_savings_percentage")), F.lit("%)"),
        ),
    ).otherwise(
        F.concat(F.lit("\nLast skipped: "), F.coalesce("last_tool_name", F.lit("unknown")), F.lit("\nReason: "), F.coalesce("last_reason", F.lit("no reason recorded")))
    )
    active = F.when(F.col("optimized_requests") > 0, "active").otherwise("waiting for a large payload")
    text = F.concat(
        F.lit("Health: "), active, F.lit("\nRequests: "), F.col("total_requests"), F.lit("\nOptimized: "), F.col("optimized_requests"), F.lit(" ("),
        _rate(F.col("optimized_requests"), F.col("total_requests")), F.lit("%)\nSkipped: "), F.col("skipped_requests"), F.lit("\nTokens saved: "),
        F.format_number("total_savings", 0), last, F.lit("\nLast update: "), F.col("last_updated_at"),
    )
    return stats.withColumn("status", F.when(F.col("total_requests") == 0, "No optimization activity yet.").otherwise(text))


def savings_summary(rows: DataFrame, category: str = "category", value: str = "savings_pct", seq: str = "seq") -> DataFrame:
    """Count, mean, min, max, true and upper median by category and over all
    (a null category), in the order in which categories first appear."""
    # from the top, the discrete median is the upper one; both medians keep a count for each distinct value, not the rows
    upper = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}` DESC)")
    return rows.rollup(category).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("lowest"), F.max(value).alias("highest"),
        F.percentile(value, 0.5).alias("median"), upper.alias("upper_median"), F.min(seq).alias("first_seen"),
    )


def success(data: Column, message: Column | None = None) -> Column:
    parts = [F.lit(True).alias("success"), data.alias("data")] + ([message.alias("message")] if message is not None else [])
    return F.to_json(F.struct(*parts), {"pretty": "true"})


def failure(code: str, message: Column) -> Column:
    return F.to_json(F.struct(F.lit(False).alias("success"), F.struct(F.lit(code).alias("code"), message.alias("message")).alias("error")), {"pretty": "true"})
