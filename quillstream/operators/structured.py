"""Structured payloads: strict readers and the tabular object notation (TOON) encoder.

The encoder follows the public notation: two-space indent, comma delimiter,
uniform records as a header and rows, other lists as items.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import BLANKS

try:
    import yaml
except ImportError:  # YAML payloads then count as text
    yaml = None

BARE_KEY = re.compile(r"[A-Za-z_][\w.]*", re.A)
NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?:e[+-]?\d+)?|0\d+", re.I)
UNSAFE = re.compile(r"[:\"\\\[\]{},\x00-\x1f]")
ESCAPES = str.maketrans({"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"})


def js_order(pairs: list[tuple]) -> dict:
    """Object members in JavaScript's order: array indexes first by value, then
    the others as written; the last of equal names counts, at the first's place."""
    seen = dict(pairs)
    whole = sorted((k for k in seen if isinstance(k, str) and re.fullmatch(r"0|[1-9]\d{0,9}", k) and int(k) < 2**32 - 1), key=int)
    return {k: seen[k] for k in whole} | seen


def _refuse(name: str):
    raise ValueError(name)


def read_json(text: str):
    """The object or list of a strict JSON text, else None."""
    try:
        data = json.loads(text, object_pairs_hook=js_order, parse_constant=_refuse, parse_int=float_or_int)
    except (ValueError, RecursionError):
        return None
    return data if isinstance(data, (dict, list)) else None


def float_or_int(digits: str):
    """Integers that a double can't hold lose their last digits, as in JavaScript."""
    n = int(digits)
    return n if abs(n) <= 1 << 53 else float(digits)


if yaml is not None:

    class CoreLoader(yaml.SafeLoader):
        """YAML 1.2 core schema: only true/false/null words and plain numbers resolve; equal keys are errors."""

    CoreLoader.yaml_implicit_resolvers = {}
    for tag, pattern, first in (
        ("bool", r"true|True|TRUE|false|False|FALSE", "tTfF"),
        ("null", r"~|null|Null|NULL|", ["~", "n", "N", ""]),
        ("int", r"[-+]?\d+|0o[0-7]+|0x[0-9a-fA-F]+", "-+0123456789"),
        ("float", r"[-+]?(?:\.\d+|\d+(?:\.\d*)?)(?:[eE][-+]?\d+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)", "-+.0123456789"),
    ):
        CoreLoader.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(rf"^(?:{pattern})$"), list(first))

    def _int(loader, node):
        text = node.value
        base = {"0o": 8, "0x": 16}.get(text[:2])
        return int(text[2:], base) if base else float_or_int(text)

    def _float(loader, node):
        text = node.value.lower()
        return math.nan if "nan" in text else math.copysign(math.inf, -1 if text[0] == "-" else 1) if "inf" in text else float(text)

    def _map(loader, node, deep=True):
        pairs = [(loader.construct_object(k, deep=True), loader.construct_object(v, deep=True)) for k, v in node.value]
        names = [_key_text(k) for k, _ in pairs]
        if len(set(names)) < len(names):
            raise yaml.YAMLError("equal keys")
        return js_order([(n, v) for n, (_, v) in zip(names, pairs)])

    CoreLoader.add_constructor("tag:yaml.org,2002:int", _int)
    CoreLoader.add_constructor("tag:yaml.org,2002:float", _float)
    CoreLoader.add_constructor("tag:yaml.org,2002:map", _map)


def _key_text(key) -> str:
    if isinstance(key, str):
        return key
    return scalar(key) if not isinstance(key, (dict, list)) else json.dumps(key)


def read_yaml(text: str):
    """The mapping or list of a YAML text, else None."""
    if yaml is None:
        return None
    try:
        data = yaml.load(text, Loader=CoreLoader)
    except (yaml.YAMLError, ValueError, TypeError, RecursionError):
        return None
    return data if isinstance(data, (dict, list)) else None


FIELD = re.compile(r'((?:[^",]|"(?:[^"]|"")*(?:"|\Z))*)(,|\Z)')
QUOTED = re.compile(r'"((?:[^"]|"")*)(?:"|\Z)')


def csv_fields(line: str, quoted: bool = True) -> list[str]:
    """Trimmed fields of a line; quotes may hold commas, and two are one."""
    if not quoted:
        return [f.strip(BLANKS) for f in line.split(",")]
    out, at = [], 0
    while True:
        m = FIELD.match(line, at)
        out.append(QUOTED.sub(lambda q: q[1].replace('""', '"'), m[1]).strip(BLANKS))
        at = m.end()
        if not m[2]:
            return out


def read_csv(text: str, quoted: bool = True) -> list[dict]:
    rows = [line for line in text.split("\n") if line.strip(BLANKS)]
    names = csv_fields(rows[0], quoted)
    out = []
    for line in rows[1:]:
        values = csv_fields(line, quoted)
        out.append(js_order([(n, values[i] if i < len(values) else "") for i, n in enumerate(names)]))
    return out


def scalar(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        if isinstance(value, float):
            if not math.isfinite(value):
                return "null"
            if value == int(value):
                return str(int(value))
            return format(Decimal(repr(value)), "f")
        return str(value)
    return quoted(str(value))


def quoted(text: str) -> str:
    plain = (
        text != "" and text == text.strip(BLANKS) and text not in ("true", "false", "null") and not NUMBER.fullmatch(text)
        and not UNSAFE.search(text) and not text.startswith("-")
    )
    return text if plain else f'"{text.translate(ESCAPES)}"'


def key(name: str) -> str:
    return name if BARE_KEY.fullmatch(name) else f'"{name.translate(ESCAPES)}"'


def _simple(value) -> bool:
    return not isinstance(value, (dict, list))


def _table(rows: list) -> list[str] | None:
    """Field names if all rows are records of the same fields with scalar values."""
    if not rows or not all(isinstance(r, dict) and r for r in rows):
        return None
    names = list(rows[0])
    same = set(names)
    return names if all(set(r) == same and all(map(_simple, r.values())) for r in rows) else None


def _list(head: str, items: list, depth: int) -> list[str]:
    pad = "  " * depth
    if all(map(_simple, items)):
        return [f"{pad}{head}[{len(items)}]:" + (" " + ",".join(map(scalar, items)) if items else "")]
    if names := _table(items):
        top = f"{pad}{head}[{len(items)}]{{{','.join(map(key, names))}}}:"
        return [top, *("  " * (depth + 1) + ",".join(scalar(r[n]) for n in names) for r in items)]
    out = [f"{pad}{head}[{len(items)}]:"]
    for item in items:
        if isinstance(item, dict):
            inner = _members(item, depth + 2)
            first = inner[0][2 * (depth + 2) :] if inner else ""
            out += [f"{pad}  - {first}" if first else f"{pad}  -", *inner[1:]]
        elif isinstance(item, list):
            inner = _list("", item, depth + 2)
            out += [f"{pad}  - {inner[0].lstrip()}", *inner[1:]]
        else:
            out.append(f"{pad}  - {scalar(item)}")
    return out


def _members(data: dict, depth: int) -> list[str]:
    out, pad = [], "  " * depth
    for name, value in data.items():
        if isinstance(value, dict):
            out += [f"{pad}{key(name)}:", *_members(value, depth + 1)]
        elif isinstance(value, list):
            out += _list(key(name), value, depth)
        else:
            out.append(f"{pad}{key(name)}: {scalar(value)}")
    return out


def toon_encode(data) -> str:
    if isinstance(data, dict):
        return "\n".join(_members(data, 0))
    return "\n".join(_list("", data, 0)) if isinstance(data, list) else scalar(data)


def parse(text: str, gate: str, profile: str):
    """Format and tree of a text: JSON, then YAML, then CSV, each behind its gate."""
    if gate[0] == "1" and (data := read_json(text)) is not None:
        return "json", data
    if gate[1] == "1" and (data := read_yaml(text)) is not None and (profile != "hook" or len(data) > 1):
        return "yaml", data
    if gate[2] == "1":
        return "csv", read_csv(text, profile != "hook")
    return None, None


def read_structured(gated: DataFrame, text: str, gate: str, profile: str) -> DataFrame:
    """Adds parsed_format, toon and parsed_error to the rows whose gate isn't 000.
    One Arrow pass over the rows; the plan's filters stay on their own side of
    it. No text makes it fail: what goes wrong is that row's parsed_error."""
    names = gated.columns
    added = ["parsed_format", "toon", "parsed_error"]
    schema = StructType([*gated.schema.fields, *(StructField(c, StringType()) for c in added)])

    def one(t: str | None, g: str) -> tuple:
        fmt = None
        try:
            fmt, data = (None, None) if t is None or g == "000" else parse(t, g, profile)
            return fmt, None if fmt is None else toon_encode(data), None
        except Exception as e:  # noqa: BLE001
            return fmt, None, str(e) or type(e).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, by = names.index(text), names.index(gate)
        for batch in batches:
            found = [one(t, g) for t, g in zip(batch.column(at).to_pylist(), batch.column(by).to_pylist())]
            new = [pa.array([f[k] for f in found], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*names, *added])

    return gated.mapInArrow(run, schema)


def toon_table(name: str, rows: Column, fields: list[str]) -> Column:
    """A native encoder for an array of structs whose values need no quotes."""
    head = F.concat(F.lit(f"{name}["), F.size(rows).cast("string"), F.lit("]{" + ",".join(fields) + "}:"))
    body = F.transform(rows, lambda r: F.concat(F.lit("  "), F.concat_ws(",", *(F.coalesce(r[f].cast("string"), F.lit("null")) for f in fields))))
    return F.array_join(F.concat(F.array(head), body), "\n")
