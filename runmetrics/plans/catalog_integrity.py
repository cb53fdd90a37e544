"""Catalog: inventories, digests, manifests, archives, rotation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import digest as dg
from ..functions.times import utc
from ..operators import integrity
from . import tables as t
from .oracle import add, rounded


def _path():
    return F.concat_ws("/", "source", F.col("doc_id").cast("string"))


def _documents(spark, sf):
    """Documents as files: their text is the content."""
    return t.load(spark, sf, "documents").select(
        _path().alias("path"), F.octet_length("text").cast("long").alias("length"), F.col("text").alias("content"), "source", "doc_id"
    )


_PATH = "concat(source, '/', cast(doc_id as varchar))"

add(
    "S5_file_inventory",
    lambda spark, sf: integrity.file_inventory(spark, sf, "*.parquet").select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "length"
    ),
)
add(
    "S5_file_digests",
    lambda spark, sf: integrity.file_manifest(spark, sf, "sha256", glob="*.parquet").select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "algorithm", "checksum", "file_size"
    ),
)
add(
    "D26_manifest",
    lambda spark, sf: integrity.manifest(_documents(spark, sf), "sha256"),
    f"""select {_PATH} as path, 'SHA256' as algorithm, sha256(text) as checksum,
              cast(octet_length(encode(text)) as bigint) as file_size, false as base64_encoded from documents""",
)


def _verified(spark, sf):
    expected = integrity.manifest(_documents(spark, sf), "md5")
    labelled = _documents(spark, sf).join(t.load(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    again = labelled.withColumn("content", F.trim("content"))
    pages = t.load(spark, sf, "pages").select(
        F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("path"),
        F.octet_length("html").cast("long").alias("length"), F.col("html").alias("content"),
    )
    actual = integrity.manifest(again.select("path", "length", "content").unionByName(pages), "md5")
    return integrity.verify_manifest(actual, expected)


add(
    "J7_verify_manifest", _verified,
    f"""select coalesce(e.path, a.path) as path, expected, actual,
              case when actual is null then 'missing' when expected is null then 'extra'
                   when actual = expected then 'match' else 'mismatch' end as result
       from (select {_PATH} as path, md5(text) as expected from documents) e
       full join (select {_PATH} as path, md5(trim(text, ' ')) as actual from documents where doc_id in (select doc_id from labels)
                  union all select concat('pages/', cast(page_id as varchar)), md5(html) from pages) a on a.path = e.path""",
)
add(
    "J9_mark_existing",
    lambda spark, sf: integrity.mark_existing(
        t.load(spark, sf, "documents").select("doc_id", _path().alias("path")),
        t.load(spark, sf, "labels").join(t.load(spark, sf, "documents"), "doc_id").select(_path().alias("path")),
    ).select("doc_id", "exists"),
    'select doc_id, doc_id in (select doc_id from labels) as "exists" from documents',
)
add(
    "A11_archive_stats",
    lambda spark, sf: integrity.archive_stats(
        integrity.exclude_globs(_documents(spark, sf), ["src1/*", "*00"]), ["source"]
    ),
    f"""select source, count(*) as files_compressed, cast(sum(octet_length(encode(text))) as bigint) as bytes_processed
       from documents where source <> 'src1' and not ends_with({_PATH}, '00') group by source""",
)


def _compressed(spark, sf):
    files = _documents(spark, sf)
    # Dropping white space stands in for a codec, so that SQL can redo it.
    smaller = files.select("path", F.octet_length(F.regexp_replace("content", r"[ \n]", "")).cast("long").alias("length"))
    return integrity.compression_stats(files, smaller).withColumn("source", F.split("path", "/")[0])


_SIZES = f"""select {_PATH} as path, source, cast(octet_length(encode(text)) as bigint) as original_size,
       cast(octet_length(encode(regexp_replace(text, '[ \\n]', '', 'g'))) as bigint) as compressed_size from documents"""
add(
    "A12_compression_stats",
    lambda spark, sf: _compressed(spark, sf).select("path", "original_size", "compressed_size", *rounded("compression_ratio")),
    f"""select path, original_size, compressed_size, case when original_size > 0 then
              round((original_size::double - compressed_size::double) / original_size::double * 100, 6) else 0.0 end as compression_ratio
       from ({_SIZES}) x""",
)
add(
    "A12_compression_totals",
    lambda spark, sf: integrity.compression_totals(_compressed(spark, sf), ["source"]).select(
        "source", "original_size", "compressed_size", *rounded("compression_ratio")
    ),
    f"""select source, cast(sum(original_size) as bigint) as original_size, cast(sum(compressed_size) as bigint) as compressed_size,
              round((sum(original_size)::double - sum(compressed_size)::double) / sum(original_size)::double * 100, 6) as compression_ratio
       from ({_SIZES}) x group by source""",
)


def _rotated(spark, sf):
    files = t.load(spark, sf, "events").select(
        F.col("event_type").alias("folder"), F.col("event_id").cast("string").alias("path"),
        F.round(F.col("value") * 1000).cast("long").alias("length"), F.col("ts").alias("modificationTime"),
    )
    rule = integrity.Rotation(max_size_bytes=40_000, max_age_days=20, max_files=1200)
    plan = integrity.rotation_plan(files, rule, utc("2024-02-01"))
    return plan.select("folder", "path", "too_large", "too_old", "too_many", "rotate")


add(
    "W8_rotation_plan", _rotated,
    """select *, too_large or too_old or too_many as rotate from (
         select event_type as folder, cast(event_id as varchar) as path, cast(round(value * 1000) as bigint) > 40000 as too_large,
                ts < timestamp '2024-02-01' - interval 20 day as too_old,
                row_number() over (partition by event_type order by ts desc, cast(event_id as varchar) desc) > 1200 as too_many
         from events) x""",
)
