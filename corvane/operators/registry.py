"""Which converter and validator serve a pair of formats. Lookups over small ordered dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.text import extension_code, fill


def converters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(dims.CONVERTERS), "ord int, name string, available boolean, reason string")


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(o, s, t, k) for k, (o, s, t) in enumerate(dims.EDGES)], "ord int, source string, target string, pos int")


def validators(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(dims.VALIDATORS), "ord int, target string")


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *row) for k, row in enumerate(dims.CATALOG)], "ord int, ext string, label string, kind string, argument string")


def target_options(converters: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target, position, enabled, reason): a target stands where it was first offered; the first available offer
    takes the place of unavailable ones before it."""
    offers = edges.where("source <> target").join(F.broadcast(converters), "ord")  # converters: a registered handful
    found = offers.groupBy("source", "target").agg(
        F.min(F.struct("ord", "pos")).alias("place"), F.min_by(F.struct("available", "reason"), F.struct((~F.col("available")).alias("off"), "ord", "pos")).alias("best")
    )
    place = F.row_number().over(Window.partitionBy("source").orderBy("place"))
    return found.select("source", "target", place.alias("position"), F.col("best.available").alias("enabled"), F.when(~F.col("best.available"), F.col("best.reason")).alias("reason"))


def find_converter(requests: DataFrame, converters: DataFrame, edges: DataFrame) -> DataFrame:
    """Requests (source, target, ...) with the name of the first available converter, or null."""
    able = edges.join(F.broadcast(converters.where("available")), "ord").groupBy("source", "target").agg(F.min_by("name", F.struct("ord", "pos")).alias("converter"))
    return requests.join(F.broadcast(able), ["source", "target"], "left")  # a row per registered pair of formats


def find_validator(requests: DataFrame, validators: DataFrame) -> DataFrame:
    """Requests with the number of the first validator of their target, or null; a null refuses the job."""
    first = validators.groupBy("target").agg(F.min("ord").alias("validator"))
    return requests.join(F.broadcast(first), "target", "left")  # a row per registered target


def source_extensions(catalog: DataFrame, options: DataFrame) -> DataFrame:
    """Catalog extensions with at least one target, in catalog order (ord)."""
    return catalog.join(options, catalog["ext"] == options["source"], "left_semi").select("ord", "ext")


def families(spark: SparkSession) -> DataFrame:
    """(source, targets, filters): targets of all families of a source, each once in first order, with import filters."""
    rows = [(k, s, t, j, f) for k, (sources, targets, f) in enumerate(dims.FAMILIES) for s in sources for j, t in enumerate(targets)]
    pairs = spark.createDataFrame(rows, "family int, source string, target string, pos int, filter string")
    first = pairs.groupBy("source", "target").agg(F.min(F.struct("family", "pos")).alias("place"), F.min_by("filter", F.struct("family", "pos")).alias("filter"))
    listed = first.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("place", "target", "filter"))).alias("all"))
    return listed.select("source", F.col("all.target").alias("targets"), F.col("all.filter").alias("filters"))


def describe_format(rows: DataFrame, ext: str, catalog: DataFrame, strings: DataFrame, lang: str) -> DataFrame:
    """`rows` with label and kind of the extension; unknown extensions show their code."""
    own = strings.where(F.col("lang") == lang).select(F.col("key").alias("_key"), F.col("template").alias("_own"))
    base = strings.where("lang = 'en'").select(F.col("key").alias("_key"), F.col("template").alias("_base"))
    known = catalog.select(F.col("ext").alias(ext), F.col("label").alias("_label"), F.col("kind").alias("_kind"), F.col("argument").alias("_argument"))
    out = rows.join(F.broadcast(known), ext, "left").withColumn("_key", F.concat(F.lit("Kind."), F.coalesce("_kind", F.lit("Unknown"))))
    out = out.join(F.broadcast(base), "_key", "left").join(F.broadcast(own), "_key", "left")  # dimensions of the library, tens of rows
    code = extension_code(F.col(ext))
    kind = fill(F.coalesce("_own", "_base"), F.when(F.col("_kind").isNull(), code).otherwise(F.col("_argument")))
    return out.select(*rows.columns, F.coalesce("_label", code).alias("label"), kind.alias("kind"))


def lookup_text(requests: DataFrame, strings: DataFrame) -> DataFrame:
    """Requests (lang, key, ...) with the template in their language, or the neutral one."""
    own = strings.select("lang", "key", F.col("template").alias("_own"))
    base = strings.where("lang = 'en'").select("key", F.col("template").alias("_base"))
    out = requests.join(F.broadcast(own), ["lang", "key"], "left").join(F.broadcast(base), "key", "left")
    return out.withColumn("template", F.coalesce("_own", "_base")).drop("_own", "_base")


def key_parity(strings: DataFrame, a: str, b: str) -> DataFrame:
    """(key, side, problem): keys that one language lacks, different placeholders, blank texts."""
    one = lambda lang, name: strings.where(F.col("lang") == lang).select("key", F.col("template").alias(name))
    both = one(a, "x").join(one(b, "y"), "key", "full_outer")
    marks = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\{\d+\})"), 1)))
    problem = F.when(F.col("y").isNull(), f"missing in {b}").when(F.col("x").isNull(), f"missing in {a}").when(marks(F.col("x")) != marks(F.col("y")), "placeholders").when((F.trim("x") == "") | (F.trim("y") == ""), "blank")
    return both.select("key", problem.alias("problem")).where("problem is not null")
