"""Source-code compressor. Line layers are native; the two comment layers keep
state inside a line or between lines and run as one Arrow UDF."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import BLANKS, let, lines, ltrim, replace_all, trim, units
from .debug import cleanup, merge_blank_lines
from .runs import collapse_lines

# Remarks and addresses that keep a comment, the start of a heredoc.
MARKED = re.compile(r"\b(?:TODO|FIXME|HACK|XXX)\b", re.I | re.A)
URL = re.compile(r"https?://")
HEREDOC = re.compile(r"<<<[ \t]*(['\"]?)([A-Za-z_][A-Za-z0-9_]*)\1[ \t]*\Z")
# One string, or the start of a comment; a backslash before a quote keeps the string open.
SLASHES = re.compile(r"(?P<s>[\"'`])(?:.*?(?<!\\)(?P=s)|.*)|(?P<c>//)", re.S)
HASHES = re.compile(r"(?P<t>\"\"\"|''')|(?P<s>[\"'])(?:.*?(?<!\\)(?P=s)|.*)|(?P<c>#)", re.S)
PHP_HASHES = re.compile(r"(?P<t>\"\"\"|''')|(?P<s>[\"'`])(?:.*?(?<!\\)(?P=s)|.*)|(?P<c>#(?!\[))", re.S)


def cut_comment(line: str, pattern: re.Pattern) -> str:
    """The line up to a comment outside strings; as it is if that leaves nothing or a triple quote opens."""
    for m in pattern.finditer(line):
        if m.groupdict().get("t"):
            return line
        if m["c"]:
            before = line[: m.start()].rstrip(BLANKS)
            return before or line
    return line


def without_inline(line: str, kind: str, hook: bool) -> str:
    if MARKED.search(line) or line.lstrip(BLANKS).startswith(("//", "#", "/*")):
        return line
    if (hook or kind != "code-py") and URL.search(line):
        return line
    if kind == "code-py":
        return cut_comment(line, HASHES)
    short = cut_comment(line, SLASHES)
    return cut_comment(line, PHP_HASHES) if kind == "code-php" and short == line else short


def strip_inline(text: str, kind: str, hook: bool = False) -> str:
    out, ends = [], None
    for line in text.split("\n"):
        if ends or (kind == "code-php" and HEREDOC.search(line)):
            ends = _heredoc(line, ends)
            out.append(line)
        else:
            out.append(without_inline(line, kind, hook))
    return "\n".join(out)


def _heredoc(line: str, ends: str | None) -> str | None:
    """The terminator that is awaited after this line."""
    if ends:
        return None if re.fullmatch(rf"\s*{re.escape(ends)};?\s*", line) else ends
    return HEREDOC.search(line)[2]


def strip_comment_lines(text: str, kind: str, hook: bool = False) -> str:
    out: list[str] = []
    ends, block, doc = None, False, False
    marks = {"code-py": ("#",), "code-php": ("//", "#")}.get(kind, ("//",))
    for line in text.split("\n"):
        t = line.lstrip(BLANKS)
        if ends or (kind == "code-php" and HEREDOC.search(line)):
            ends = _heredoc(line, ends)
            out.append(line)
        elif MARKED.search(t):
            out.append(line)
        elif block:
            block = "*/" not in t
        elif not hook and t.startswith("/*"):
            if t.startswith("/**"):
                out.append(line)
            block = "*/" not in t
        elif not hook and kind == "code-py" and doc:
            doc = '"""' not in t and "'''" not in t
        elif not hook and kind == "code-py" and t[:3] in ('"""', "'''"):
            out.append(line)
            doc = t[:3] not in t[3:]
        elif not t.startswith(marks) or (kind == "code-php" and t.startswith("#[")):
            out.append(line)
    return "\n".join(out)


def _strip(text: pd.Series, kind: pd.Series, hook: pd.Series) -> pd.DataFrame:
    rows = []
    for t, k, h in zip(text, kind, hook):
        try:
            first = None if t is None else strip_inline(t, k, bool(h))
            rows.append((first, None if t is None else strip_comment_lines(first, k, bool(h)), None))
        except Exception as e:  # noqa: BLE001
            rows.append((None, None, str(e) or type(e).__name__))
    return pd.DataFrame(rows, columns=["inline", "lines", "error"])


def strip_comments(text: Column, kind: Column, hook: bool = False) -> Column:
    """The text after each of the two comment layers, or the error of a text that one fails on. Marked nondeterministic,
    so that filters stay above it and it runs once a row."""
    shape = StructType([StructField("inline", StringType()), StructField("lines", StringType()), StructField("error", StringType())])
    return F.pandas_udf(_strip, shape).asNondeterministic()(text, kind, F.lit(hook))


def shorten_imports(text: Column) -> Column:
    return replace_all(text, r"(from\s+['\"])(\.\.\/){2,}[^'\"]*\/([^'\"]+)(['\"])", "$1…/$3$4")


def is_import(line: Column, kind: Column) -> Column:
    t = ltrim(line)
    return (
        F.when(kind.isin("code-ts", "code-generic"), t.startswith("import "))
        .when(kind == "code-py", t.startswith("import ") | t.startswith("from "))
        .when(kind == "code-go", t.startswith("import ") | (t == "import ("))
        .otherwise(False)
    )


def summarise_imports(rows: Column, kind: Column) -> Column:
    note = lambda n: F.concat(F.lit("// ... "), (n - 3).cast("string"), F.lit(" more imports"))
    return collapse_lines(rows, lambda x: F.when(is_import(x, kind), F.lit("import")), 6, 3, 0, note)


def structure_key(line: Column) -> Column:
    """The line with literals, numbers and numbered names replaced; null if that is short."""
    s = replace_all(line, r"['\"][^'\"]*['\"]", '"…"')
    s = replace_all(s, r"\b\d+\b", "N")
    s = trim(replace_all(s, r"\b[a-z][a-zA-Z0-9]*\d+\b", "ID"))
    return let(s, lambda k: F.when(F.length(k) > 10, k))


def similar_note(n: Column) -> Column:
    return F.concat(F.lit("// ... "), (n - 2).cast("string"), F.lit(" more similar lines"))


def collapse_repetitive(rows: Column) -> Column:
    return collapse_lines(rows, structure_key, 5, 3, 0, similar_note)


LAYERS = ("merge-blank-lines", "remove-inline-comments", "remove-comment-lines", "shorten-imports", "summarize-imports", "collapse-repetitive")


def compress_code(text: Column, kind: Column, profile: str = "core") -> Column:
    """The compressed text, the names of the layers that changed it, and the error of a text that can't be compressed."""
    merged = merge_blank_lines(text)
    stripped = strip_comments(merged, kind, profile == "hook")
    long_ = (units(text) / 4 > 500) & F.lit(profile == "core")

    def body(s: Column) -> Column:
        short = F.when(kind.isin("code-ts", "code-generic"), shorten_imports(s["lines"])).otherwise(s["lines"])

        def rest(short: Column) -> Column:
            summed = F.when(long_, F.array_join(summarise_imports(lines(short), kind), "\n")).otherwise(short)

            def end(summed: Column) -> Column:
                folded = F.when(long_, F.array_join(collapse_repetitive(lines(summed)), "\n")).otherwise(summed)

                def out(folded: Column) -> Column:
                    states = [text, merged, s["inline"], s["lines"], short, summed, folded]
                    names = [F.when(a != b, F.lit(n)) for a, b, n in zip(states, states[1:], LAYERS)]
                    return F.struct(cleanup(folded).alias("text"), F.array_compact(F.array(*names)).alias("layers"), s["error"].alias("error"))

                return let(folded, out)

            return let(summed, end)

        return let(short, rest)

    return let(stripped, body)


