"""File inventories, digests, manifests and rotation."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.digest import digest, reduction_percent
from ..functions.text import checksum_line, glob_match
from ..session import stored
from .windows import top_n_per_key

LARGE_FILE = 1 << 30
CHUNK = 8 << 20
LISTED = 10_000  # rows of a listing in a batch
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:/")


def _files(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def _opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path as Spark writes it, the path in it, and what stands before it in Spark's form.

    Raises for a scheme that pyarrow doesn't know.
    """
    scheme, _, rest = path.partition(":")
    if not _SCHEME.match(path):
        scheme, rest = "file", path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/"), "file:"
    uri = f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}"
    filesystem, name = fs.FileSystem.from_uri(quote(uri, safe="/:@?=&"))
    name = unquote(name)
    return filesystem, name, path[: len(path) - len(name)] if path.endswith(name) else f"{scheme}://"


def _hidden(name: str) -> bool:
    """Names that a scan passes over."""
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name and name not in ("_metadata", "_common_metadata"))


def _folder_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            filesystem, name, before = _opened(path)
            here = filesystem.get_file_info(name)
            if here.type == fs.FileType.NotFound:
                raise FileNotFoundError(path)
            found = [here] if here.type == fs.FileType.File else filesystem.get_file_info(fs.FileSelector(name))
            found = [info for info in found if not _hidden(info.base_name)]
            for at in range(0, len(found), LISTED):
                part = found[at:at + LISTED]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([before + info.path for info in part], pa.string()), pa.array([info.size or 0 for info in part], pa.int64()),
                     pa.array([info.mtime for info in part], pa.timestamp("us", "UTC")), pa.array([info.type == fs.FileType.Directory for info in part], pa.bool_())],
                    ["path", "length", "modificationTime", "is_folder"])


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """All files below a folder, empty ones too: level by level, each folder listed by the task that owns it."""
    folders, files = spark.createDataFrame([(path,)], "path string"), None
    while True:
        level = stored(folders.repartition("path").mapInArrow(_folder_entries, "path string, length long, modificationTime timestamp, is_folder boolean"), "listing")
        # to the millisecond, as a scan tells it
        found = level.filter("not is_folder").select("path", "length", F.timestamp_millis(F.unix_millis("modificationTime")).alias("modificationTime"))
        files = found if files is None else files.unionByName(found)
        folders = level.filter("is_folder").select("path")
        if folders.isEmpty():
            return files


def file_inventory(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Path, length and modification time of every file below a folder; contents are not read.

    Folders are listed by the executors, level by level, and each level is written to the shared folder.
    """
    files = _listed(spark, path)
    return files.filter(glob_match("path", [glob])) if glob else files


def file_contents(spark: SparkSession, path: str, glob: str | None = None, max_length: int = LARGE_FILE) -> DataFrame:
    """Files with their bytes. A file is one value, so larger ones are listed without content."""
    files = _files(spark, path, glob)
    small = files.filter(F.col("length") <= max_length).select("path", "length", "content")
    large = files.filter(F.col("length") > max_length).select("path", "length", F.lit(None).cast("binary").alias("content"))
    # a scan passes over empty files
    empty = file_inventory(spark, path, glob).filter("length = 0").select("path", "length", F.lit("").cast("binary").alias("content"))
    return small.unionByName(large).unionByName(empty)


def manifest(files: DataFrame, algorithm: str = "SHA256", as_base64: bool = False) -> DataFrame:
    """Digest of every file row (path, length, content)."""
    return files.select(
        "path",
        F.lit(algorithm.upper()).alias("algorithm"),
        digest("content", algorithm, as_base64).alias("checksum"),
        F.col("length").alias("file_size"),
        F.lit(as_base64).alias("base64_encoded"),
    )


def _chunked_digests(batches: Iterator[pd.DataFrame], algorithm: str, as_base64: bool) -> Iterator[pd.DataFrame]:
    """Digest files piece by piece, whatever their size."""

    def one(path: str) -> str:
        filesystem, name, _ = _opened(path)
        state = hashlib.new(algorithm.lower())
        with filesystem.open_input_stream(name) as stream:
            while piece := stream.read(CHUNK):
                state.update(piece)
        return base64.b64encode(state.digest()).decode() if as_base64 else state.hexdigest()

    for batch in batches:
        yield batch.assign(checksum=[one(p) for p in batch["path"]])


def file_manifest(
    spark: SparkSession, path: str, algorithm: str = "SHA256", as_base64: bool = False, glob: str | None = None,
    max_length: int = LARGE_FILE,
) -> DataFrame:
    """Digests of all files below a folder.

    Files up to ``max_length`` are one value each and digested by Spark. Larger ones are
    read in pieces by the task that owns them, spread one by one over the tasks.
    """
    whole = manifest(file_contents(spark, path, glob, max_length).filter("content is not null"), algorithm, as_base64)
    large = _files(spark, path, glob).filter(F.col("length") > max_length)
    spread = large.select("path", F.col("length").alias("file_size")).repartition("path")
    in_pieces = spread.mapInPandas(
        lambda batches: _chunked_digests(batches, algorithm, as_base64), "path string, file_size long, checksum string"
    )
    return whole.unionByName(
        in_pieces.withColumns({"algorithm": F.lit(algorithm.upper()), "base64_encoded": F.lit(as_base64)})
    )


def checksum_lines(manifest_rows: DataFrame) -> DataFrame:
    return manifest_rows.select(checksum_line("checksum", "path").alias("value"))


def verify_manifest(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Compare two manifests (path, checksum) path by path."""
    a = actual.select("path", F.col("checksum").alias("actual"))
    e = expected.select("path", F.col("checksum").alias("expected"))
    return e.join(a, "path", "full_outer").select(
        "path", "expected", "actual",
        F.when(F.col("actual").isNull(), "missing")
        .when(F.col("expected").isNull(), "extra")
        .when(F.col("actual") == F.col("expected"), "match")
        .otherwise("mismatch")
        .alias("result"),
    )


def exclude_globs(inventory: DataFrame, patterns: Sequence[str]) -> DataFrame:
    return inventory.filter(~glob_match("path", patterns)) if patterns else inventory


def archive_stats(inventory: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return inventory.groupBy(*keys).agg(
        F.count("*").alias("files_compressed"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes_processed")
    )


def compression_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """Sizes (path, length) before and after, with the reduction in percent."""
    b = before.select("path", F.col("length").alias("original_size"))
    a = after.select("path", F.col("length").alias("compressed_size"))
    return b.join(a, "path").withColumn("compression_ratio", reduction_percent("original_size", "compressed_size"))


def compression_totals(stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return stats.groupBy(*keys).agg(
        F.sum("original_size").alias("original_size"), F.sum("compressed_size").alias("compressed_size")
    ).withColumn("compression_ratio", reduction_percent("original_size", "compressed_size"))


def mark_existing(df: DataFrame, inventory: DataFrame, path: str = "path") -> DataFrame:
    """Add ``exists``: is the path of the row in the inventory?"""
    known = inventory.select(F.col("path").alias(path)).distinct().withColumn("__known", F.lit(True))
    return df.join(known, path, "left").withColumn("exists", F.col("__known").isNotNull()).drop("__known")


@dataclass(frozen=True)
class Rotation:
    max_size_bytes: int | None = None
    max_age_days: int | None = None
    max_files: int | None = None


def rotation_plan(inventory: DataFrame, rule: Rotation, as_of: Column, key: str = "folder") -> DataFrame:
    """Which files to rotate: too large, too old, or beyond the newest ``max_files`` of a folder.

    ``inventory`` has (key, path, length, modificationTime). The age rank is not computed
    for every file: the oldest file still kept is found per folder, from at most
    ``max_files`` rows, and the rest is compared with it.
    """
    no = F.lit(False)
    out = inventory
    too_many = no
    if rule.max_files is not None:
        newest = [F.desc("modificationTime"), F.desc("path")]
        kept = top_n_per_key(inventory.select(key, "path", "modificationTime"), [key], newest, rule.max_files)
        edge = kept.groupBy(key).agg(F.min(F.struct("modificationTime", "path")).alias("__edge"))
        out = out.join(edge, key, "left")
        too_many = F.coalesce(F.struct("modificationTime", "path") < F.col("__edge"), F.lit(rule.max_files == 0))
    too_large = no if rule.max_size_bytes is None else F.col("length") > rule.max_size_bytes
    too_old = no if rule.max_age_days is None else (
        F.col("modificationTime") < as_of - F.expr(f"interval {int(rule.max_age_days)} day")
    )
    return out.select(
        key, "path", "length", "modificationTime",
        too_large.alias("too_large"), too_old.alias("too_old"), too_many.alias("too_many"),
        (too_large | too_old | too_many).alias("rotate"),
    )
