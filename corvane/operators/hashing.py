"""Chunked SHA-256 manifests and the checks of what is read back. All of it is JVM-side, one narrow pass per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_count(content: Column, chunk: int) -> Column:
    return F.ceil(F.octet_length(content) / float(chunk)).cast("int")


def chunk_hashes(content: Column, chunk: int) -> Column:
    """SHA-256 of every fixed-size chunk, in order; none for empty content."""
    n = chunk_count(content, chunk)
    at = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda k: F.sha2(F.substring(content, k * chunk + 1, F.lit(chunk)), 256))


def chunk_manifest(files: DataFrame, key: str, content: str, chunk: int) -> DataFrame:
    """(key, chunk_no from 1, chunk_len, sha256), a row per chunk."""
    c = F.col(content)
    each = files.select(key, F.octet_length(c).alias("_n"), F.posexplode(chunk_hashes(c, chunk)).alias("_at", "sha256"))
    return each.select(key, (F.col("_at") + 1).alias("chunk_no"), F.least(F.lit(chunk), F.col("_n") - F.col("_at") * chunk).alias("chunk_len"), "sha256")


def file_manifest(files: DataFrame, key: str, content: str, chunk: int) -> DataFrame:
    """(key, length, chunk_count, sha256), a row per file."""
    c = F.col(content)
    return files.select(key, F.octet_length(c).cast("long").alias("length"), chunk_count(c, chunk).alias("chunk_count"), F.sha2(c, 256).alias("sha256"))


def verify_chunks(files: DataFrame, key: str, written: str, found: str, chunk: int) -> DataFrame:
    """(key, failure, chunk_no): a length mismatch first, else the first chunk that differs, else nothing.

    Written and found content of a file stand in one row, so the check needs no join.
    """
    a, b = chunk_hashes(F.col(written), chunk), chunk_hashes(F.col(found), chunk)
    bad = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True).cast("int")
    longer = F.octet_length(written) != F.octet_length(found)
    rows = files.select(key, longer.alias("_longer"), bad.alias("_bad"))
    failure = F.when(F.col("_longer"), "LengthMismatch").when(F.col("_bad") > 0, "ChunkMismatch")
    return rows.select(key, failure.alias("failure"), F.when(~F.col("_longer") & (F.col("_bad") > 0), F.col("_bad")).alias("chunk_no"))


def verify_manifest(manifest: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, chunk_no of the first mismatch or null), from a stored manifest and the hashes of what is read back."""
    both = manifest.alias("m").join(found.alias("f"), [key, "chunk_no"], "full_outer")
    differs = ~F.col("m.sha256").eqNullSafe(F.col("f.sha256"))
    return both.groupBy(key).agg(F.min(F.when(differs, F.col("chunk_no"))).alias("chunk_no"))


def verify_file(files: DataFrame, key: str, written: str, found: str) -> DataFrame:
    """(key, intact): length and SHA-256 of the whole agree."""
    same = (F.octet_length(written) == F.octet_length(found)) & (F.sha2(F.col(written), 256) == F.sha2(F.col(found), 256))
    return files.select(key, same.alias("intact"))


def failure_kind(length_ok: Column, bad_chunk: Column, hash_ok: Column, valid: Column) -> Column:
    """The first failure in the order in which the checks run, or null."""
    return F.when(~length_ok, "LengthMismatch").when(bad_chunk.isNotNull(), F.concat(F.lit("ChunkMismatch:"), bad_chunk.cast("string"))).when(~hash_ok, "FileHashMismatch").when(~valid, "InvalidOutput")
