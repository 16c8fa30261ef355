"""Filters as Columns, with the typing rules of the stored tables: text fields, two numeric fields, JSON metadata."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CHUNK_FIELDS, DOC_FIELDS, NUMERIC_FIELDS, QueryError
from .syntax import Among, Both, Compare, Either, Expr, Field, Not

_KEY = re.compile(r"[A-Za-z0-9_-]+\Z")
_NUMBER = re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\Z")


def number_text(x: float) -> str:
    """A floating-point number as text compares: 15 digits, always with a point."""
    s = f"{x:.15g}"
    if "e" in s:
        mantissa, exponent = s.split("e")
        return f"{mantissa if '.' in mantissa else mantissa + '.0'}e{exponent}"
    return s if "." in s or "n" in s else s + ".0"


def _quoted(c: str) -> str:
    return c if c.isalnum() or not c.isascii() else "\\" + c if c.isprintable() else f"\\x{ord(c):02x}"


def like_pattern(pattern: str) -> str:
    """Regular expression of a LIKE pattern: % and _, letters A-Z in any case, no escapes."""
    return r"(?si)\A" + "".join(".*" if c == "%" else "." if c == "_" else _quoted(c) for c in pattern) + r"\z"


def glob_pattern(pattern: str) -> str:
    """Regular expression of a GLOB pattern in a filter: * crosses slashes, ? and [sets], with ^ for all others."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            j = i + 1
            inverse = pattern[j : j + 1] == "^"
            j += inverse
            close = pattern.find("]", j + 1)
            if close < 0:
                return r"(?!)"  # an open set matches nothing
            body, part = pattern[j:close], ""
            k = 0
            while k < len(body):
                if k + 2 < len(body) and body[k + 1] == "-":
                    part += f"{_quoted(body[k])}-{_quoted(body[k + 2])}" if body[k] <= body[k + 2] else ""
                    k += 3
                else:
                    part += _quoted(body[k])
                    k += 1
            out.append(f"[{'^' * inverse}{part}]" if part else "." if inverse else r"(?!)")
            i = close
        else:
            out.append(_quoted(c))
        i += 1
    return r"(?s)\A" + "".join(out) + r"\z"


def path_glob(pattern: str) -> str:
    """Regular expression of an include or exclude glob over paths: ** spans folders, also none; {a,b} are choices."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 2
        elif pattern.startswith("/**", i) and i + 3 == len(pattern):
            out.append("/.*")
            i += 2
        elif c == "*":
            out.append(".*")
            while pattern[i + 1 : i + 2] == "*":
                i += 1
        elif c == "?":
            out.append(".")
        elif c == "[" and (close := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : close]
            inverse = body[0] in "!^"
            out.append(f"[{'^' * inverse}{''.join(x if x == '-' else _quoted(x) for x in body[inverse:])}]")
            i = close
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(_quoted(pattern[i]))
        else:
            out.append(_quoted(c))
        i += 1
    if depth:
        raise QueryError(f"open brace in glob: {pattern}")
    return r"(?s)\A" + "".join(out) + r"\z"


_OPS: dict[str, Callable] = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def _always(x: Column, sign: int, op: str) -> Column:
    """A comparison whose outcome types alone decide (sign: -1 less, 1 greater); null stays null."""
    return F.when(x.isNotNull(), F.lit(bool(_OPS[op](sign, 0))))


def meta_key(name: str) -> str:
    key = name.removeprefix("meta.")
    if not _KEY.match(key):
        raise QueryError(f"bad metadata key: {key!r}")
    return key


def meta_value(meta: Column, key: str) -> Column:
    return F.get_json_object(meta, f"$['{key}']")


def meta_is_number(meta: Column, key: str) -> Column:
    """Whether a metadata value is a JSON number or boolean, which only imported rows have."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(meta), f"$['{key}']", "variant"))
    return F.coalesce(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)"), F.lit(False))


class Filters:
    """Compiles filters over columns that ``column`` finds by table and field name."""

    def __init__(self, column: Callable[[str, str], Column]) -> None:
        self.column = column

    def resolve(self, f: Field) -> tuple[str, str]:
        if f.table is None:
            raise QueryError(f"a field needs its table: doc.{f.name} or chunk.{f.name}")
        if f.table == "doc" and f.name.startswith("meta."):
            meta_key(f.name)
        elif f.name not in (DOC_FIELDS if f.table == "doc" else CHUNK_FIELDS):
            raise QueryError(f"no such field: {f.table}.{f.name}")
        return f.table, f.name

    def compile(self, e: Expr) -> Column:
        if isinstance(e, Not):
            return ~self.compile(e.inner)
        if isinstance(e, Both):
            return self.compile(e.left) & self.compile(e.right)
        if isinstance(e, Either):
            return self.compile(e.left) | self.compile(e.right)
        if isinstance(e, Among):
            if not e.values:
                raise QueryError("IN needs a value")
            return self._among(e)
        return self._compare(e)

    def _among(self, e: Among) -> Column:
        table, name = self.resolve(e.field)
        if not name.startswith("meta.") and (table, name) not in NUMERIC_FIELDS:
            return self.column(table, name).isin([v if isinstance(v, str) else number_text(v) for v in e.values])
        out = self._compare(Compare(e.field, "=", e.values[0]))
        for v in e.values[1:]:
            out = out | self._compare(Compare(e.field, "=", v))
        return out

    def _compare(self, e: Compare) -> Column:
        table, name = self.resolve(e.field)
        text = e.value if isinstance(e.value, str) else number_text(e.value)
        if name.startswith("meta."):
            meta, key = self.column("doc", "meta"), meta_key(name)
            value = meta_value(meta, key)
            if e.op in ("LIKE", "GLOB"):
                return value.rlike(like_pattern(text) if e.op == "LIKE" else glob_pattern(text))
            is_number = meta_is_number(meta, key)
            if isinstance(e.value, str):
                return F.when(is_number, _always(value, -1, e.op)).otherwise(_OPS[e.op](value, F.lit(text)))
            number = F.when(value == "true", 1.0).when(value == "false", 0.0).otherwise(value.try_cast("double"))
            return F.when(is_number, _OPS[e.op](number, F.lit(e.value))).otherwise(_always(value, 1, e.op))
        x = self.column(table, name)
        if e.op in ("LIKE", "GLOB"):
            return x.cast("string").rlike(like_pattern(text) if e.op == "LIKE" else glob_pattern(text))
        if (table, name) not in NUMERIC_FIELDS:
            return _OPS[e.op](x, F.lit(text))
        if isinstance(e.value, str):
            if not _NUMBER.match(e.value):
                return _always(x, -1, e.op)
            return _OPS[e.op](x.cast("double"), F.lit(float(e.value)))
        return _OPS[e.op](x.cast("double"), F.lit(float(e.value)))
