"""Text functions with ECMAScript semantics, as Columns.

Regular expressions are written as in JavaScript and translated for Java's
engine: \\s is the wide white-space class, \\b knows ASCII words only.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and line ends of ECMAScript, for use inside a character class.
WS = "\\t\\n\\x0B\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
WS_IN_LINE = WS.replace("\\n", "")
BOUNDARY = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: The same characters for Python's strip().
BLANKS = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WORD_NEXT, WORD_BEFORE = "(?![A-Za-z0-9_])", "(?<![A-Za-z0-9_])"
GROUP = r"\((?:\?:)?([^()]*)\)"


def _boundary(before: str, after: str) -> str:
    """The shortest test that is a word boundary between two parts of a pattern:
    where a word character must follow (or come before), one look is enough."""
    word = lambda c: re.fullmatch(r"[A-Za-z0-9_]", c, re.A) is not None
    group = re.match(GROUP + r"(?![?*{])", after)
    if (
        re.match(r"(?:[A-Za-z0-9_]|\\[wd]|\[[a-zA-Z0-9-]+\])(?![?*{])", after, re.A)
        or (group and all(word(x[:1]) and x[1:2] not in ("?", "*", "{") for x in group[1].split("|")))
    ):
        return WORD_BEFORE
    group = re.search(GROUP + r"\Z", before)
    if re.search(r"\\[wd]\+?\Z", before) or (group and all(word(x[-1:]) and x[-2:-1] != "\\" for x in group[1].split("|"))):
        return WORD_NEXT
    return BOUNDARY


def js(pattern: str) -> str:
    """A JavaScript regular expression for Java: \\s, \\S and \\b outside and inside classes."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == "\\s":
            out.append(WS if inside else f"[{WS}]")
        elif two == "\\S":
            out.append(f"[^{WS}]")
        elif two == "\\b" and not inside:
            out.append(_boundary(pattern[:i], pattern[i + 2 :]))
        elif two[:1] == "\\":
            out.append(two)
        else:
            inside = {"[": True, "]": False}.get(two[0], inside)
            out.append("\\z" if two == "$" and not inside else two[0])
            i -= 1
        i += 2
    return "".join(out)


def test(text: Column, pattern: str) -> Column:
    return text.rlike(js(pattern))


def replace_all(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, js(pattern), by)


def ltrim(text: Column) -> Column:
    return F.regexp_replace(text, f"\\A[{WS}]+", "")


def rtrim(text: Column) -> Column:
    return F.regexp_replace(text, f"[{WS}]+\\z", "")


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"\\A[{WS}]+|[{WS}]+\\z", "")


def blank(text: Column) -> Column:
    return ~text.rlike(f"[^{WS}]")


def units(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def at(array: Column, index: Column) -> Column:
    """0-based element, null outside."""
    return F.get(array, index)
