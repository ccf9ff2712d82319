"""Drawings as text: (code, value) pairs of lines, versions, and what can be written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims


def read_drawings(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, code, value) of text drawings; a binary one is read as Latin-1 and relabelled like the others."""
    files = spark.read.format("binaryFile").load(path).select("path", as_old_version(F.decode("content", "ISO-8859-1")).alias("body"))
    return pairs(files, "path", "body")


def pairs(files: DataFrame, key: str, body: str) -> DataFrame:
    """(key, ord, code, value): odd lines are codes, even ones values; a last lone line is dropped."""
    lines = F.split(F.col(body), "\r?\n")
    n = F.floor(F.size(lines) / 2).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    each = files.select(key, F.posexplode(F.transform(at, lambda k: F.struct(F.trim(F.get(lines, 2 * k)).alias("code"), F.get(lines, 2 * k + 1).alias("value")))).alias("ord", "p"))
    return each.select(key, "ord", "p.code", "p.value")


def rendered(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, body, pairs): the pairs (code, value) of a drawing as its text."""
    line = F.struct(order, F.concat("code", F.lit("\n"), "value").alias("line"))
    out = rows.groupBy(key).agg(F.array_sort(F.collect_list(line)).alias("all"))
    return out.select(key, F.array_join("all.line", "\n").alias("body"), F.size("all").cast("long").alias("pairs"))


def writable_version(version: Column, target: str) -> Column:
    if target == ".dwg":
        return F.when(version.isin(*dims.DWG_VERSIONS), version).when(version == "AC1021", "AC1024").otherwise("AC1015")
    return F.when(version.isin(*dims.DXF_VERSIONS), version).otherwise("AC1015")


def as_old_version(body: Column) -> Column:
    """Versions before R12, named in the first 64 KiB, are relabelled R12; the length stays."""
    at = F.regexp_instr(F.substring(body, F.lit(1), F.lit(65536)), F.lit(r"\$ACADVER\s+1\s+AC10(0[0-8])"))
    label = F.regexp_extract(body, r"(\$ACADVER\s+1\s+AC10)0[0-8]", 1)
    return F.when(at > 0, F.overlay(body, F.lit("09"), (at + F.length(label)).cast("int"), F.lit(2))).otherwise(body)


def drop_unwritable(entities: DataFrame, block: str, kind: str) -> DataFrame:
    """(block, kept, dropped): sequence ends and placeholders can't be written."""
    bad = (F.col(kind) == "Seqend") | F.col(kind).endswith("Placeholder")
    return entities.groupBy(block).agg(F.count_if(~bad).alias("kept"), F.count_if(bad).alias("dropped"))
