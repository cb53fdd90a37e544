"""Templates with ``{{path}}`` and ``{{helper arg ...}}``, turned into one Column.

The template text is known when the job is written, so it becomes an ordinary
concatenation that Spark generates code for; no row is rendered in Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import MapType, StructType

from . import text, times
from .maps import literal_map, merge_maps
from .status import col

_EXPRESSION = re.compile(r"\{\{\{?\s*(.*?)\s*\}?\}\}", re.S)
_WORD = re.compile(r"\"([^\"]*)\"|'([^']*)'|(\S+)")

HELPERS: dict[str, Callable[..., Column]] = {}


def register_helper(name: str, fn: Callable[..., Column]) -> None:
    """Add a helper: a function from Columns to a Column."""
    HELPERS[name] = fn


def _literal(c: Column | str) -> Column:
    return c if isinstance(c, Column) else F.lit(c)


register_helper("upper", lambda c: F.upper(_literal(c)))
register_helper("lower", lambda c: F.lower(_literal(c)))
register_helper("base64_encode", lambda c: text.base64_encode(_literal(c)))
register_helper("base64_decode", lambda c: text.base64_decode(_literal(c)))
register_helper("join", lambda sep, array: text.join_array(array, sep))
register_helper("default", lambda c, other: text.default_if_empty(_literal(c), other))
register_helper("format_time", lambda c, fmt=times.CLOCK_FORMAT: times.format_time(_literal(c), fmt))
register_helper("timestamp", lambda fmt=times.CLOCK_FORMAT: times.now_text(fmt))
register_helper("uuid", lambda: F.uuid())


def lookup(df: DataFrame, path: str, context: Mapping[str, Column] | None = None) -> Column:
    """Value of a dotted path in the context, the struct columns or the map columns; null if absent."""
    first, *rest = path.split(".")
    if context and path in context:
        return context[path]
    if context and first in context:
        value, dtype = context[first], None
    elif first in df.columns:
        value, dtype = F.col(f"`{first}`"), df.schema[first].dataType
    else:
        return F.lit(None).cast("string")
    for part in rest:
        if isinstance(dtype, MapType):
            value, dtype = F.try_element_at(value, F.lit(part)), dtype.valueType
        elif isinstance(dtype, StructType):
            if part not in dtype.names:
                return F.lit(None).cast("string")
            value, dtype = value[part], dtype[part].dataType
        elif dtype is None:
            value = F.try_element_at(value, F.lit(part))
        else:
            return F.lit(None).cast("string")
    return value


def _words(body: str) -> list[tuple[str, bool]]:
    return [(m.group(3), False) if m.group(3) else (m.group(1) or m.group(2) or "", True) for m in _WORD.finditer(body)]


def render(df: DataFrame, template: str, context: Mapping[str, Column] | None = None) -> Column:
    """The template with every expression filled from the row; a missing value is empty text."""
    pieces: list[Column] = []
    end = 0
    for found in _EXPRESSION.finditer(template):
        if found.start() > end:
            pieces.append(F.lit(template[end : found.start()]))
        end = found.end()
        (name, quoted), *rest = _words(found.group(1)) or [("", True)]
        if not quoted and name in HELPERS and (rest or name not in df.columns):
            args = [word if is_text else lookup(df, word, context) for word, is_text in rest]
            value = HELPERS[name](*args)
        elif rest:
            raise ValueError(f"unknown template helper {name!r}")
        else:
            value = F.lit(name) if quoted else lookup(df, name, context)
        pieces.append(F.coalesce(value.cast("string"), F.lit("")))
    if end < len(template):
        pieces.append(F.lit(template[end:]))
    return F.concat(*pieces) if pieces else F.lit("")


def render_rows(df: DataFrame, template: str, *keys: str) -> DataFrame:
    """One text per row, next to its keys."""
    return df.select(*keys, render(df, template).alias("content"))


def build_variables(*sources: Mapping[str, str] | Column) -> Column:
    """One variable map from several, a later source winning: global, then template, then data."""
    columns = [s if isinstance(s, Column) else literal_map(s) for s in sources]
    return merge_maps(columns[0], *columns[1:])


def fill(template: str, **values: Column | str) -> Column:
    """Short form for fixed layouts: ``{{name}}`` only, values given by keyword."""
    pieces = [
        F.lit(part) if i % 2 == 0 else F.coalesce(col(values[part]).cast("string"), F.lit(""))
        for i, part in enumerate(re.split(r"\{\{(\w+)\}\}", template))
        if part or i % 2
    ]
    return F.concat(*pieces)


def _filled(template: Column | str, variables: Column | str, expression: str) -> Column:
    t, names_to_values = col(template), col(variables)
    between = F.split(t, expression)
    names = F.regexp_extract_all(t, F.lit(expression), F.lit(1))
    filled = F.zip_with(
        between, names,
        lambda part, name: F.concat(part, F.coalesce(F.try_element_at(names_to_values, name), F.lit(""))),
    )
    return F.array_join(filled, "")


def render_data(template: Column | str, variables: Column | str) -> Column:
    """Templates that are data: ``{{name}}`` filled from a map column in one pass.

    Values are not scanned again, so a value that looks like a template stays as it is.
    """
    return _filled(template, variables, r"\{\{\s*([^{}]*?)\s*\}\}")


def render_json(document: Column | str, variables: Column | str) -> Column:
    """Fill the templates in all keys and texts of a JSON document, however deep; other values stay as they are.

    In JSON two opening braces stand side by side only inside a text, so the document is filled as it is written, with
    the values escaped as JSON texts. Text that isn't JSON is filled alike; null stays null.
    """
    escaped = F.transform_values(col(variables), lambda _, v: F.regexp_extract(F.to_json(F.array(v)), r'(?s)^\["(.*)"\]$', 1))
    return _filled(document, escaped, r'\{\{\s*([^{}"\\]*?)\s*\}\}')


def render_map(config: Column | str, variables: Column | str) -> Column:
    """Fill the templates in all keys and values of a map."""
    values = F.transform_values(col(config), lambda _, v: render_data(v, variables))
    return F.transform_keys(values, lambda k, _: render_data(k, variables))


def render_array(values: Column | str, variables: Column | str) -> Column:
    return F.transform(col(values), lambda v: render_data(v, variables))
