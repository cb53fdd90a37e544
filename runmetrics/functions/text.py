"""Text helpers: case, base64, joins, truncation, file names, globs, key=value lists."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from .status import col

# Truncation limits and markers of the outputs.
TASK_OUTPUT_LIMIT, TASK_OUTPUT_MARKER = 200, "..."
LISTING_MARKER = "... [truncated]"
MESSAGE_LIMIT, TEMPLATE_MESSAGE_LIMIT = 1500, 1000
MESSAGE_MARKER = "...\n\n_(Content truncated)_"

# Labels and messages.
STDOUT_LABEL, STDERR_LABEL = "STDOUT:\n", "STDERR:\n"
BAD_PAIR = "Invalid variable format '%s'. Expected 'key=value'"
NESTED_BRACES = "nested template expressions not allowed"
EXTRA_BRACE = "unmatched closing brace"
OPEN_BRACES = "unmatched template braces"

upper = F.upper
lower = F.lower


def base64_encode(c: Column | str) -> Column:
    """Standard base64 on a single line."""
    return F.regexp_replace(F.base64(col(c).cast("binary")), "[\r\n]", "")


def base64_decode(c: Column | str, strict: bool = True) -> Column:
    """Decode base64 text. Bad input raises, or gives null with ``strict=False``."""
    if strict:
        return F.unbase64(col(c)).cast("string")
    return F.try_to_binary(col(c), F.lit("base64")).cast("string")


def join_array(array: Column | str, separator: str = ",") -> Column:
    return F.array_join(col(array), separator)


def default_if_empty(c: Column | str, fallback: Column | str) -> Column:
    other = fallback if isinstance(fallback, Column) else F.lit(fallback)
    return F.coalesce(F.nullif(col(c), F.lit("")), other)


def truncate_text(c: Column | str, limit: int, marker: str = TASK_OUTPUT_MARKER) -> Column:
    """Cut to ``limit`` characters and append the marker; shorter text stays as it is."""
    return F.when(F.length(col(c)) > limit, F.concat(F.substring(col(c), 1, limit), F.lit(marker))).otherwise(col(c))


def combine_streams(out: Column | str, err: Column | str) -> Column:
    """Merge standard output and error into one labelled text; null when both are empty."""
    o, e = F.nullif(col(out), F.lit("")), F.nullif(col(err), F.lit(""))
    return (
        F.when(o.isNotNull() & e.isNotNull(), F.concat(F.lit(STDOUT_LABEL), o, F.lit("\n" + STDERR_LABEL), e))
        .when(o.isNotNull(), o)
        .when(e.isNotNull(), F.concat(F.lit(STDERR_LABEL), e))
    )


def sanitize_filename(c: Column | str) -> Column:
    """Letters, digits, ``-``, ``_`` and ``.`` stay; everything else becomes ``_``."""
    return F.regexp_replace(col(c), r"[^\p{L}\p{N}._-]", "_")


def fill_placeholders(template: Column | str, values: Mapping[str, Column]) -> Column:
    """Replace ``{name}`` by the value of that name, one name after the other."""
    text = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return text


def key_value_map(array: Column | str) -> Column:
    """``["a=1", "b=x=y"]`` to a map; the last value of a repeated key wins.

    An entry without ``=`` is an error, as it is on a command line.
    """
    bad = F.filter(col(array), lambda e: ~F.contains(e, F.lit("=")))
    checked = F.when(
        F.size(bad) > 0,
        F.raise_error(F.format_string(BAD_PAIR, F.element_at(bad, 1))),
    ).otherwise(col(array))

    def key(e: Column) -> Column:
        return F.substring_index(e, "=", 1)

    keys = F.transform(checked, key)
    last = F.filter(
        checked, lambda e, i: F.size(F.filter(keys, lambda k, j: (j > i) & (k == key(e)))) == 0
    )
    return F.map_from_entries(
        F.transform(last, lambda e: F.struct(key(e), F.substr(e, F.instr(e, "=") + F.lit(1))))
    )


def has_template(c: Column | str) -> Column:
    return F.contains(col(c), F.lit("{{")) & F.contains(col(c), F.lit("}}"))


def brace_error(c: Column | str) -> Column:
    """What is wrong with the ``{{ }}`` braces of a template; null when nothing is.

    Only the braces are folded over, so long texts without templates cost one scan.
    """
    braces = F.regexp_replace(col(c), "[^{}]", "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("string").alias("error"))

    def step(acc: Column, ch: Column) -> Column:
        depth = acc["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)
        error = F.coalesce(acc["error"], F.when(depth > 2, NESTED_BRACES).when(depth < 0, EXTRA_BRACE))
        return F.struct(depth.alias("depth"), error.alias("error"))

    folded = F.aggregate(F.split(braces, ""), start, step)
    return F.when(col(c).isNotNull(), F.coalesce(folded["error"], F.when(folded["depth"] != 0, OPEN_BRACES)))


def checksum_line(digest: Column | str, path: Column | str) -> Column:
    return F.concat_ws("  ", col(digest), col(path))


def parse_checksum_line(line: Column | str) -> tuple[Column, Column]:
    """(digest, path) of a ``digest  path`` line."""
    parts = F.split(col(line), "  ", 2)
    return parts[0], parts[1]


def glob_regex(pattern: str) -> str:
    """Regular expression of a glob: ``*`` and ``?`` stay within a path part, ``**`` does not."""
    tokens = re.findall(r"\*\*/|\*\*|\*|\?|\[[!^]?\]?[^\]]*\]|\{[^{}]*\}|\\.|.", pattern, re.S)
    out = []
    for token in tokens:
        if token == "**/":
            out.append("(?:.*/)?")
        elif token == "**":
            out.append(".*")
        elif token == "*":
            out.append("[^/]*")
        elif token == "?":
            out.append("[^/]")
        elif token[0] == "[" and len(token) > 2:
            body = token[1:-1]
            negated = body[0] in "!^"
            body = (body[1:] if negated else body).replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]")
            out.append(f"[{'^' if negated else ''}{body}]")
        elif token[0] == "{" and len(token) > 1:
            out.append("(?:" + "|".join(glob_regex(p)[1:-1] for p in token[1:-1].split(",")) + ")")
        else:
            out.append(re.escape(token[-1]))
    return "^" + "".join(out) + "$"


def glob_match(path: Column | str, patterns: Sequence[str]) -> Column:
    """A path matches when it, or its last part, matches any of the patterns."""
    full, name = col(path), F.element_at(F.split(col(path), "/"), -1)
    hit = F.lit(False)
    for pattern in patterns:
        regex = glob_regex(pattern)
        hit = hit | full.rlike(regex) | name.rlike(regex)
    return hit


def destination_parts(url: Column | str) -> tuple[Column, Column]:
    """(scheme, host) of a destination URL; empty text where a part is missing."""
    lowered = F.regexp_extract(col(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    return F.lower(lowered), F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
