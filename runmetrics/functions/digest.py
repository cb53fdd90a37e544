"""Content digests."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .status import col

# Algorithm names as written to manifests.
ALGORITHMS = ("MD5", "SHA256", "SHA512")


def digest(content: Column | str, algorithm: str = "SHA256", as_base64: bool = False) -> Column:
    """Digest of text or bytes, as hex or as base64 of the raw digest."""
    name = algorithm.upper()
    if name not in ALGORITHMS:
        raise ValueError(f"unknown digest algorithm {algorithm!r}, expected one of {ALGORITHMS}")
    data = col(content)
    hexed = F.md5(data) if name == "MD5" else F.sha2(data, int(name[3:]))
    return F.regexp_replace(F.base64(F.unhex(hexed)), "[\r\n]", "") if as_base64 else hexed


def reduction_percent(before: Column | str, after: Column | str) -> Column:
    """Size reduction in percent; 0 for empty input."""
    b, a = col(before), col(after)
    return F.when(b > 0, (b.cast("double") - a.cast("double")) / b.cast("double") * F.lit(100.0)).otherwise(F.lit(0.0))
