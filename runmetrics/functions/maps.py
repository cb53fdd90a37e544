"""Map columns: merging variables and looking up tags."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from .status import col


def merge_maps(first: Column | str, *others: Column | str) -> Column:
    """Merge maps; a later map wins over an earlier one for the same key."""
    merged = col(first)
    for other in others:
        merged = F.map_concat(_without_keys(merged, col(other)), col(other))
    return merged


def _without_keys(kept: Column, later: Column) -> Column:
    return F.map_filter(kept, lambda k, v: ~F.map_contains_key(later, k))


def literal_map(values: Mapping[str, str]) -> Column:
    if not values:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def tag(metadata: Column | str, name: str) -> Column:
    return F.try_element_at(col(metadata), F.lit(name))


def tags_match(metadata: Column | str, required: Mapping[str, str]) -> Column:
    hit = F.lit(True)
    for name, value in required.items():
        hit = hit & F.coalesce(tag(metadata, name) == value, F.lit(False))
    return hit
