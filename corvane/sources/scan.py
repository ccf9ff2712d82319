"""Whole-file scans, the checks before a job, tool and temporary names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIX = ".corvane-tmp"


def scan(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of whole files, split over tasks by size."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def job_status(source: Column, dest: Column, present: Column, folder: Column) -> Column:
    """What stops a job before any output exists; paths are compared without case."""
    return F.when(~present, "SourceMissing").when(~folder, "FolderMissing").when(F.lower(source) == F.lower(dest), "SameFile").otherwise("Ready")


def first_existing(candidates: list[tuple[Column, Column]]) -> Column:
    return F.coalesce(*[F.when(exists, path) for path, exists in candidates])


def office_arguments(source: Column, target: Column, import_filter: Column) -> Column:
    """The words of an office conversion's command line."""
    return F.array_compact(F.array(
        F.lit("--headless"), F.lit("--norestore"), F.concat(F.lit("--infilter="), import_filter), F.lit("--convert-to"), F.substring(target, F.lit(2), F.length(target)),
        F.lit("--outdir"), F.lit("out"), F.concat(F.lit("in/file"), source),
    ))


def free_temp_names(wanted: DataFrame, taken: DataFrame, key: str, dest: str, most: int) -> DataFrame:
    """(key, name): the first of dest.tmp, dest.2.tmp, ... that isn't taken (key, n)."""
    tries = wanted.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(most)))).join(taken, [key, "n"], "left_anti")
    first = tries.groupBy(key, dest).agg(F.min("n").alias("n"))
    return first.select(key, F.concat(F.col(dest), F.when(F.col("n") == 1, "").otherwise(F.concat(F.lit("."), F.col("n").cast("string"))), F.lit(SUFFIX)).alias("name"))
