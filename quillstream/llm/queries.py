"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_extract, langid, line_dedup, media_tiff, packing, quality, simhash, token_count, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_html_extract": html_extract.op2_html_extract,
        "op3_simhash": simhash.op3_simhash,
        "op4_langid": langid.op4_langid,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_quality": quality.op6_quality,
        "op7_token_count": token_count.op7_token_count,
        "op8_packing": packing.op8_packing,
        "op9_media_tiff": media_tiff.op9_media_tiff,
        "op10_toxicity": toxicity.op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": line_dedup.OP5_SQL}
