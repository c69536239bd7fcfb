"""Payload classification: native gates for text formats, one parser UDF for structured ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, blank, js, let, lines, test, trim
from .structured import read_structured

FORMATS = ("json", "csv", "yaml", "debug-output", "code-ts", "code-py", "code-go", "code-php", "code-generic", "unknown")
STRUCTURED = ("json", "yaml", "csv")
CODE = ("code-ts", "code-py", "code-go", "code-php", "code-generic")

# The patterns that mark each format.
KEY_LINE = r"^\s*[\w][\w\s.-]*:\s*.+"
LIST_ITEM = r"^\s*-\s+"
INDENTED = r"^\s{2,}\S"
TS = (
    r"\bimport\s+.*\bfrom\s+['\"]", r"\bexport\s+(default\s+)?(class|function|const|interface|type)\b",
    r":\s*(string|number|boolean|void)\b", r"=>\s*[{(]", r"\binterface\s+\w+", r"\bconst\s+\w+\s*:\s*\w+",
)
PY = (r"(?m)^def\s+\w+\s*\(", r"(?m)^class\s+\w+.*:", r"(?m)^from\s+\w+\s+import\b", r"(?m)^import\s+\w+", r"(?m)^\s+self\.", r"(?m):\s*$\n\s+")
PHP = (
    r"(?m)^<\?php\b", r"\bnamespace\s+[\w\\]+;", r"\buse\s+[\w\\]+;", r"\bfunction\s+\w+\s*\(", r"\$this->",
    r"\bpublic\s+(static\s+)?(function|readonly)\b",
)
GO = (r"(?m)^package\s+\w+", r"(?m)^func\s+(\(\w+\s+\*?\w+\)\s+)?\w+\s*\(", r"\bfmt\.\w+", r"\b:=\s", r"(?m)^import\s+\(", r"\berr\s*!=\s*nil\b")
GO_LOOSE = (r"(?m)^package\s+\w+", r"(?m)^func\s+", r"\bfmt\.\w+", r"\b:=\s", r"\berr\s*!=\s*nil\b")
GENERIC = (r"[{}\[\]();]", r"\b(function|class|return|if|else|for|while)\b", r"(?m)//.+$", r"(?m)^\s{2,}\S")
DEBUG = (
    (2, (r"(?m)\b(FAIL|FAILURES?|AssertionError|Traceback|Caused by:|UnhandledPromiseRejection)\b",)),
    (2, (r"(?m)\berror TS\d+:", r"(?mi)^\s*error(\[[^\]]+\])?:")),
    (2, (r'(?m)^\s*File\s+"[^"]+",\s+line\s+\d+', r"(?m)^\w+(Error|Exception):\s+")),
    (2, (r"(?m)^\s*at\s+.+:\d+:\d+", r"(?m)^\s*at\s+.+\(.+:\d+:\d+\)")),
    (2, (r"(?m)^\s*\d+:\d+\s+error\s{2,}.+", r"(?m)^\s*\d+:\d+\s+warning\s{2,}.+")),
    (1, (r"(?m)^\s*(Test Suites:|Tests:|Snapshots:|Time:|Ran all test suites)",)),
    (1, (r"(?m)^\s*[×✕]\s+", r"(?m)^\s*>\s+.+$")),
    (1, (r"(?m)^\s*npm ERR!", r"(?m)^\s*error Command failed")),
)
LOCATION = r"\b[\w./-]+\.(ts|tsx|js|jsx|py|go|php):\d+:\d+\b"
TRACEBACK = r'(?m)^\s*File\s+"[^"]+",\s+line\s+\d+'


def _multiline(pattern: str) -> str:
    """In multi-line mode the end of a line is $ itself."""
    return js(pattern).replace("\\z", "$") if "(?m" in pattern else js(pattern)


def hits(text: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for p in patterns:
        out = out + text.rlike(_multiline(p)).cast("int")
    return out


def full_lines(text: Column) -> Column:
    return F.filter(lines(text), lambda x: ~blank(x))


def looks_like_yaml(text: Column) -> Column:
    def body(rows: Column) -> Column:
        head = F.slice(rows, 1, 20)
        count = lambda p: F.size(F.filter(head, lambda x: test(x, p)))
        keys, items, n = count(KEY_LINE), count(LIST_ITEM), F.size(rows)
        shape = (keys >= 3) | ((items >= 2) & (count(INDENTED) >= 2))
        return (n >= 3) & shape & ((keys + items) / F.least(n, F.lit(20)) >= 0.3)

    return let(full_lines(text), body)


def looks_like_csv(text: Column, min_lines: int = 2, most: int = 7) -> Column:
    commas = lambda x: F.length(x) - F.length(F.replace(x, F.lit(","), F.lit("")))

    def body(rows: Column) -> Column:
        n, first = F.size(rows), commas(rows[0])
        same = F.size(F.filter(F.slice(rows, 2, 9), lambda x: commas(x) == first))
        return (n >= min_lines) & F.coalesce((first > 0) & (same >= F.least(n - 1, F.lit(most))), F.lit(False))

    return let(full_lines(text), body)


def hook_yaml_gate(text: Column) -> Column:
    return text.rlike(_multiline(r"(?m)^\s*[\w-]+\s*:")) & text.contains("\n")


def head_sample(text: Column, n: int = 50) -> Column:
    return F.array_join(F.slice(lines(text), 1, n), "\n")


def code_type(text: Column, min_lines: int = 3, go: tuple[str, ...] = GO) -> Column:
    """Type of the source code a text looks like, or null."""

    def body(s: Column) -> Column:
        return (
            F.when(hits(s, TS) >= 2, "code-ts").when(hits(s, PY) >= 2, "code-py").when(hits(s, PHP) >= 2, "code-php")
            .when(hits(s, go) >= 2, "code-go").when(hits(s, GENERIC) >= 3, "code-generic")
        )

    return F.when(F.size(lines(text)) >= min_lines, let(head_sample(text), body))


def has_repeated_lines(text: Column) -> Column:
    normal = lambda x: F.regexp_replace(F.regexp_replace(trim(x), r"\d+", "#"), js(r"\s+"), " ")
    return let(
        F.filter(F.transform(full_lines(text), normal), lambda x: F.length(x) >= 12),
        lambda rows: F.size(rows) > F.size(F.array_distinct(rows)),
    )


def has_many_locations(text: Column) -> Column:
    return (F.regexp_count(text, F.lit(js(LOCATION))) >= 2) | (F.regexp_count(text, F.lit(_multiline(TRACEBACK))) >= 2)


def debug_score(text: Column) -> Column:
    """Score of the signs of tool diagnostics; 0 for texts of fewer than four full lines."""
    score = has_repeated_lines(text).cast("int") + has_many_locations(text).cast("int")
    for points, patterns in DEBUG:
        score = score + F.when(hits(text, patterns) > 0, points).otherwise(0)
    return F.when(F.size(full_lines(text)) >= 4, score).otherwise(0)


def debug_confidence(score: Column) -> Column:
    return F.least(F.lit(0.92), F.lit(0.55) + 0.05 * score)


def confidence(fmt: Column, score: Column) -> Column:
    return (
        F.when(fmt == "json", 1.0).when(fmt == "yaml", 0.9).when(fmt == "csv", 0.8)
        .when(fmt.isin("code-ts", "code-py", "code-php", "code-go"), 0.85).when(fmt == "code-generic", 0.6)
        .when(fmt == "debug-output", debug_confidence(score)).otherwise(0.0)
    )


def detect(df: DataFrame, profile: str = "core") -> DataFrame:
    """Adds format, confidence, toon (the structured rewrite, null for other
    formats) and parsed_error (why a reader or the rewrite failed). The parser sees only texts that pass a cheap gate."""
    text, hook = F.col("content"), profile == "hook"
    gates = (
        text.rlike(f"\\A[{WS}]*[\\[{{]"),
        hook_yaml_gate(text) if hook else looks_like_yaml(text),
        looks_like_csv(text, 3, 5) if hook else looks_like_csv(text),
    )
    gate = F.concat(*(F.coalesce(g, F.lit(False)).cast("int").cast("string") for g in gates))
    out = read_structured(df.withColumn("_gate", gate), "content", "_gate", profile)
    # the costly scores are made only where no reader took the text
    rest = lambda c: F.when(F.col("parsed_format").isNull(), c)
    out = out.withColumn("_score", rest(debug_score(text))).withColumn("_code", rest(code_type(text, 5, GO_LOOSE) if hook else code_type(text)))
    debug = F.when(F.col("_score") >= 3, "debug-output")
    order = (debug, F.col("_code")) if hook else (F.col("_code"), debug)
    out = out.withColumn("format", F.coalesce(F.col("parsed_format"), *order, F.lit("unknown")))
    out = out.withColumn("confidence", confidence(F.col("format"), F.col("_score")))
    return out.drop("_gate", "_score", "_code", "parsed_format")
