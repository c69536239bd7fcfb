"""Token counts, savings, and the admission rules that come before a rewrite."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..config import Config
from ..functions.text import units


def chars4(text: Column) -> Column:
    """A quarter of the length in UTF-16 units, rounded up."""
    return F.ceil(units(text) / 4).cast("long")


@functools.cache
def encoder():
    """The byte-level encoder, made once a worker process."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("payload", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _bpe(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([None if t is None else len(encoder().encode_ordinary(t)) for t in texts], dtype="Int64")


def bpe(text: Column) -> Column:
    """Tokens of a byte-level vocabulary; the encoder is made once a worker.
    Marked nondeterministic, so that filters stay above it and it runs once a row."""
    return F.pandas_udf(_bpe, LongType()).asNondeterministic()(text)


def tokens(text: Column, tokenizer: str) -> Column:
    return bpe(text) if tokenizer == "bpe" else chars4(text)


def savings_pct(original: Column, optimized: Column) -> Column:
    return F.when(original > 0, (original - optimized) / original * 100).otherwise(F.lit(0.0))


def evaluate(df: DataFrame, original: Column, optimized: Column, threshold: float | Column) -> DataFrame:
    """Adds savings_tokens, savings_pct and worth; a saving of exactly the threshold is worth it."""
    pct = savings_pct(original, optimized)
    return df.withColumn("savings_tokens", original - optimized).withColumn("savings_pct", pct).withColumn("worth", pct >= threshold)


def valid_patterns(patterns: tuple[str, ...]) -> list[str]:
    good = []
    for p in patterns:
        try:
            re.compile(p)
        except re.error:
            continue
        good.append(p)
    return good


def skipped_tool(tool: Column, patterns: tuple[str, ...], literal_fallback: bool = False) -> Column:
    """Whether any pattern is found in the tool's name. An invalid pattern is
    left out, or, with literal_fallback, compared as it stands."""
    good = valid_patterns(patterns)
    out = F.lit(False)
    for p in patterns:
        if p in good:
            out = out | tool.rlike(p)
        elif literal_fallback:
            out = out | (tool == p)
    return F.coalesce(out, F.lit(False))


def admission(cfg: Config) -> Column:
    """The reason why a payload isn't looked at, or null. Reads content and
    tool_name; a payload without a tool's name is never skipped by it."""
    text, tool = F.col("content"), F.when(F.col("tool_name") != "", F.col("tool_name"))
    size = units(text)
    reason = F.when(text.isNull(), "Invalid input: content must be a string").when(
        size > cfg.max_units, F.concat(F.lit("Content too large: "), F.format_string("%.1f", size / 1048576.0), F.lit("MB exceeds 10MB limit"))
    )
    if not cfg.enabled:
        return reason.otherwise("Optimizer disabled")
    hook = cfg.profile == "hook"
    if cfg.skip_tools:
        reason = reason.when(skipped_tool(tool, cfg.skip_tools, hook), F.concat(F.lit("Tool "), tool, F.lit(" in skip list")))
    if hook:
        reason = reason.when((size < 50) | (chars4(text) < cfg.min_tokens), "Too small")
    return reason
