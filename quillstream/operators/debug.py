"""Debug-output compressor: noise of test runners, compilers and linters, all native."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import WS_IN_LINE, at, blank, js, let, lines, ltrim, replace_all, trim
from .runs import collapse_lines

NOTE_TAG = "[compact]"
# What pointer lines, excerpts, diagnostics and stack frames look like.
POINTER = r"^\s*[|]?\s*(\^+|~+)\s*$"
TSC = r"^[\w./-]+\.[A-Za-z0-9]+:\d+:\d+\s+-\s+(error|warning)\s+([A-Z]+\d+):\s+(.+)$"
LINT = r"^\d+:\d+\s+(error|warning)\s+(.+?)\s{2,}(@[^\s]+\/[^\s]+|[^\s]+)$"
FRAME = r'^at\s+.+|^File\s+"[^"]+",\s+line\s+\d+'


def merge_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def cleanup(text: Column) -> Column:
    """Line ends trimmed, blank runs merged, the whole trimmed and ended by a line feed."""
    return F.concat(trim(merge_blank_lines(F.regexp_replace(text, f"[{WS_IN_LINE}]+(?=\n|\\z)", ""))), F.lit("\n"))


def is_pointer(line: Column) -> Column:
    return line.rlike(js(POINTER))


def drop_excerpts(rows: Column) -> Column:
    numbered = lambda x: ltrim(x).rlike(js(r"^\d+\s+\|"))
    plain = lambda x: ltrim(x).rlike(js(r"^\d+\s{2,}\S"))
    return F.filter(
        rows, lambda x, i: ~(numbered(x) | (plain(x) & F.coalesce(is_pointer(ltrim(at(rows, i + 1))), F.lit(False))))
    )


def drop_pointers(rows: Column) -> Column:
    return F.filter(rows, lambda x: ~is_pointer(x))


def diagnostic_key(line: Column) -> Column:
    """Severity, code and message of a compiler or linter diagnostic, white space
    in the message folded; null for other lines."""
    t = trim(line)
    tsc, lint = js(TSC), js(LINT)
    part = lambda p, k: F.regexp_extract(t, p, k)
    fold = lambda c: replace_all(c, r"\s+", " ")
    return F.when(
        t.rlike(tsc), F.concat_ws(":", F.lit("tsc"), part(tsc, 1), part(tsc, 2), fold(part(tsc, 3)))
    ).when(t.rlike(lint), F.concat_ws(":", F.lit("lint"), part(lint, 1), fold(part(lint, 2)), part(lint, 3)))


def _times(n: Column) -> Column:
    return F.concat(n.cast("string"), F.when(n > 1, " more times").otherwise(" more time"))


def collapse_similar(rows: Column, tag: str = NOTE_TAG) -> Column:
    """Neighbouring diagnostics of one key, with up to two blank lines between,
    become the first and a note; the blank lines after become one."""

    def body(all_: Column) -> Column:
        full = F.filter(all_, lambda r: ~r["blank"])

        def islands(full: Column) -> Column:
            numbered = F.transform(full, lambda r, j: F.struct(r["i"].alias("i"), r["x"].alias("x"), r["k"].alias("k"), j.alias("j")))

            def first(r: Column) -> Column:
                before = at(full, r["j"] - 1)
                return (r["j"] == 0) | r["k"].isNull() | ~r["k"].eqNullSafe(before["k"]) | (r["i"] - before["i"] > 3)

            def emit(starts: Column) -> Column:
                def one(s: Column, j: Column) -> Column:
                    nxt = at(starts, j + 1)
                    count = F.coalesce(nxt["j"], F.size(full)) - s["j"]
                    end = F.coalesce(nxt["i"], F.size(all_))
                    last = at(full, s["j"] + count - 1)["i"]
                    note = F.concat(F.lit(f"{tag} similar diagnostic repeated "), _times(count - 1))
                    keyed = F.concat(
                        F.array(s["x"]),
                        F.when(count > 1, F.array(note)).otherwise(F.array().cast("array<string>")),
                        F.when(nxt.isNotNull() & (end - last > 1), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")),
                    )
                    plain = F.transform(F.slice(all_, s["i"] + 1, end - s["i"]), lambda r: r["x"])
                    return F.when(s["k"].isNotNull(), keyed).otherwise(plain)

                lead = F.coalesce(at(starts, F.lit(0))["i"], F.size(all_))
                return F.concat(F.transform(F.slice(all_, 1, lead), lambda r: r["x"]), F.flatten(F.transform(starts, one)))

            return let(F.filter(numbered, first), emit)

        return let(full, islands)

    keyed = F.transform(rows, lambda x, i: F.struct(x.alias("x"), i.alias("i"), diagnostic_key(x).alias("k"), blank(x).alias("blank")))
    return let(keyed, body)


def collapse_duplicates(rows: Column, tag: str = NOTE_TAG) -> Column:
    return collapse_lines(rows, lambda x: x, 2, 1, 0, lambda n: F.concat(F.lit(f"{tag} repeated "), _times(n - 1)))


def is_frame(line: Column) -> Column:
    return ltrim(line).rlike(js(FRAME))


def frames_note(n: Column, tag: str = NOTE_TAG) -> Column:
    more = n - 5
    return F.concat(F.lit(f"{tag} "), more.cast("string"), F.when(more > 1, " more stack frames").otherwise(" more stack frame"), F.lit(" omitted"))


def collapse_frames(rows: Column, tag: str = NOTE_TAG) -> Column:
    return collapse_lines(rows, lambda x: F.when(is_frame(x), F.lit("frame")), 6, 4, 1, lambda n: frames_note(n, tag))


LAYERS = (
    ("merge-blank-lines", merge_blank_lines),
    ("collapse-source-excerpts", lambda t: F.array_join(let(lines(t), drop_excerpts), "\n")),
    ("remove-pointer-lines", lambda t: F.array_join(drop_pointers(lines(t)), "\n")),
    ("collapse-similar-diagnostics", lambda t: F.array_join(collapse_similar(lines(t)), "\n")),
    ("collapse-duplicate-lines", lambda t: F.array_join(collapse_duplicates(lines(t)), "\n")),
    ("collapse-stack-traces", lambda t: F.array_join(collapse_frames(lines(t)), "\n")),
)


def _step(name: str, layer: Callable[[Column], Column]) -> Callable[[Column], Column]:
    def changed(s: Column, new: Column) -> Column:
        layers = F.when(new == s["text"], s["layers"]).otherwise(F.array_append(s["layers"], F.lit(name)))
        return F.struct(new.alias("text"), layers.alias("layers"))

    return lambda s: let(layer(s["text"]), lambda new: changed(s, new))


def compress_debug(text: Column) -> Column:
    """The compressed text and the names of the layers that changed it."""
    state = F.struct(text.alias("text"), F.array().cast("array<string>").alias("layers"))
    for name, layer in LAYERS:
        state = let(state, _step(name, layer))
    return let(state, lambda s: F.struct(cleanup(s["text"]).alias("text"), s["layers"].alias("layers")))
