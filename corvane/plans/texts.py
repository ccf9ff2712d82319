"""Display texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import text as tx
from ..operators import registry
from .files import _STRINGS
from .registry import query, table

_SIZE = "(n_chars * list_value(1, 331, 104729, 1073741824, 1099511627776)[doc_id % 5 + 1])"


def _size_sql(dot: str, unit: str) -> str:
    case = f"CASE WHEN b < 1024 THEN b || ' {unit}'"
    for k, name in enumerate(("KB", "MB", "GB", "TB"), 1):
        v = f"(b::DOUBLE / {1024**k}.0::DOUBLE)"
        shown = f"(CASE WHEN {v} < 100 THEN floor({v} * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE ELSE floor({v} + 0.5::DOUBLE) END)"
        text = f"CASE WHEN {shown} < 100 THEN replace(printf('%.1f', {shown}), '.', '{dot}') ELSE printf('%.0f', {shown}) END || ' {name}'"
        case += f" ELSE {text} END" if name == "TB" else f" WHEN {shown} < 1024 THEN {text}"
    return case


@query("op75_file_size", f"WITH x AS (SELECT doc_id, {_SIZE} AS b FROM documents) SELECT doc_id, {_size_sql('.', 'bytes')} AS en, {_size_sql(',', 'byte')} AS local FROM x")
def op75_file_size(spark, d):
    b = F.expr(_SIZE.replace("list_value", "array").replace("[doc_id % 5 + 1]", "[cast(doc_id % 5 as int)]"))
    return table(spark, d, "documents").select("doc_id", tx.file_size_text(b, "en").alias("en"), tx.file_size_text(b, "id").alias("local"))


_NOW = "TIMESTAMP '1995-06-17 12:00:30'"


def _time_sql(lang: str) -> str:
    months = "list_value(" + ", ".join(f"'{m}'" for m in dims.MONTHS[lang]) + ")[month(t)]"
    if lang == "en":
        clock, words, day, year = "strftime(t, '%-I:%M %p')", ("Just now", "Today", "Yesterday"), f"{months} || ' ' || day(t)", f"{months} || ' ' || day(t) || ', ' || year(t)"
    else:
        clock, words, day, year = "strftime(t, '%H.%M')", ("Baru saja", "Hari ini", "Kemarin"), f"day(t) || ' ' || {months}", f"day(t) || ' ' || {months} || ' ' || year(t)"
    return f"""CASE WHEN abs(epoch_us(t) - epoch_us(now)) < 60000000 THEN '{words[0]}' WHEN t::DATE = now::DATE THEN '{words[1]}, ' || {clock} WHEN t::DATE = now::DATE - 1 THEN '{words[2]}, ' || {clock}
      WHEN year(t) = year(now) THEN {day} || ', ' || {clock} ELSE {year} || ', ' || {clock} END"""


_TIMES = f"SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN {_NOW} - o_orderkey % 100 * INTERVAL 1 SECOND WHEN o_orderkey % 9 < 3 THEN {_NOW} - o_orderkey % 3000 * INTERVAL 1 MINUTE ELSE o_orderdate + o_orderkey % 86400 * INTERVAL 1 SECOND END AS t, {_NOW} AS now FROM orders"


@query("op74_timestamp", f"WITH x AS ({_TIMES}) SELECT o_orderkey, {_time_sql('en')} AS en, {_time_sql('id')} AS local FROM x")
def op74_timestamp(spark, d):
    k = F.col("o_orderkey")
    now = F.lit("1995-06-17 12:00:30").cast("timestamp_ntz")
    back = lambda **u: now - F.make_dt_interval(**u)
    t = F.when(k % 9 == 0, back(secs=(k % 100).cast("decimal(18,6)"))).when(k % 9 < 3, back(mins=(k % 3000).cast("int"))).otherwise(F.col("o_orderdate") + F.make_dt_interval(secs=(k % 86400).cast("decimal(18,6)")))
    x = table(spark, d, "orders").select("o_orderkey", t.alias("t")).withColumn("now", now)
    return x.select("o_orderkey", tx.timestamp_text(F.col("t"), F.col("now"), "en").alias("en"), tx.timestamp_text(F.col("t"), F.col("now"), "id").alias("local"))


@query("op76_scale_text", """
WITH e AS (SELECT event_id, CAST(floor(abs(value) * 100) AS BIGINT) / 1600.0::DOUBLE AS s, user_id * 97 % 5000 AS w, event_id * 31 % 4000 AS h FROM events),
f AS (SELECT *, floor(s * 10.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS t, floor((w * h)::DOUBLE / 1e6 * 10.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS m FROM e)
SELECT event_id, CASE WHEN t % 10 = 0 THEN (t // 10) || '' ELSE (t // 10) || '.' || (t % 10) END || '×' AS scale, floor(s * 100.0::DOUBLE + 0.5::DOUBLE)::BIGINT || '%' AS percent, w || ' × ' || h AS size, (m // 10) || ',' || (m % 10) || ' MP' AS megapixels FROM f
""")
def op76_scale_text(spark, d):
    e = table(spark, d, "events").select("event_id", (F.floor(F.abs("value") * 100) / 1600.0).alias("s"), (F.col("user_id") * 97 % 5000).alias("w"), (F.col("event_id") * 31 % 4000).alias("h"))
    return e.select("event_id", tx.scale_text(F.col("s")).alias("scale"), tx.percent_text(F.col("s")).alias("percent"), tx.dimensions_text(F.col("w"), F.col("h")).alias("size"), tx.megapixels_text(F.col("w") * F.col("h"), ",").alias("megapixels"))


@query("op76_duration", """
WITH e AS (SELECT event_id, event_id * 7919 % 8000000 / 1000.0::DOUBLE AS s FROM events), f AS (SELECT *, floor(s + 0.5::DOUBLE)::BIGINT AS t FROM e)
SELECT event_id, CASE WHEN s < 1 THEN '< 1 second' WHEN t < 60 THEN t || ' seconds' WHEN t < 3600 THEN (t // 60) || ' min ' || (t % 60) || ' sec' ELSE (t // 3600) || ' h ' || (t % 3600 // 60) || ' min' END AS text FROM f
""")
def op76_duration(spark, d):
    return table(spark, d, "events").select("event_id", tx.duration_text(F.col("event_id") * 7919 % 8000000 / 1000.0).alias("text"))


_TAGS = "list_value('fr-FR', 'in_ID', ' EN-us', 'de', 'ID', '')"


@query("op54_language", f"""
WITH x AS (SELECT doc_id, list_value(lang, {_TAGS}[doc_id % 6 + 1], {_TAGS}[doc_id % 5 + 1]) AS tags FROM documents),
p AS (SELECT doc_id, list_filter(list_transform(tags, lambda t: CASE WHEN lower(split_part(replace(trim(t), '_', '-'), '-', 1)) = 'in' THEN 'id' ELSE lower(split_part(replace(trim(t), '_', '-'), '-', 1)) END), lambda t: t IN ('en', 'id')) AS known FROM x)
SELECT doc_id, coalesce(known[1], 'en') AS picked FROM p
""")
def op54_language(spark, d):
    tags = _TAGS.replace("list_value", "array")
    x = table(spark, d, "documents").select("doc_id", F.array(F.col("lang"), F.expr(f"{tags}[cast(doc_id % 6 as int)]"), F.expr(f"{tags}[cast(doc_id % 5 as int)]")).alias("tags"))
    return x.select("doc_id", tx.pick_language(F.col("tags")).alias("picked"))


@query("op52_resource", f"""
WITH q AS (SELECT doc_id, list_value('en', 'id', 'fr')[doc_id % 3 + 1] AS lang, list_value('Kind.Image', 'Time.Today', 'Size.Bytes', 'Nothing')[doc_id % 4 + 1] AS key FROM documents)
SELECT doc_id, replace(coalesce(o.template, b.template), '{{0}}', '' || doc_id) AS text FROM q LEFT JOIN {_STRINGS} ON false LEFT JOIN (SELECT * FROM {_STRINGS}) o ON o.lang = q.lang AND o.key = q.key LEFT JOIN (SELECT * FROM {_STRINGS} WHERE lang = 'en') b ON b.key = q.key
""".replace(f" LEFT JOIN {_STRINGS} ON false", ""))
def op52_resource(spark, d):
    q = table(spark, d, "documents").selectExpr("doc_id", "array('en', 'id', 'fr')[cast(doc_id % 3 as int)] AS lang", "array('Kind.Image', 'Time.Today', 'Size.Bytes', 'Nothing')[cast(doc_id % 4 as int)] AS key")
    strings = spark.createDataFrame(list(dims.STRINGS), "lang string, key string, template string")
    return registry.lookup_text(q, strings).select("doc_id", tx.fill(F.col("template"), F.col("doc_id").cast("string")).alias("text"))


_PART_TEXT = "CASE p_partkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN '{0} of {1}' WHEN 2 THEN p_name ELSE '{0} ' || p_name END"


@query("op61_parity", f"""
WITH a AS (SELECT p_partkey AS key, {_PART_TEXT} AS x FROM part WHERE p_partkey % 7 <> 0), b AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 11 = 0 THEN '{{1}}' ELSE {_PART_TEXT} END AS y FROM part WHERE p_partkey % 13 <> 0),
j AS (SELECT coalesce(a.key, b.key) AS key, x, y FROM a FULL JOIN b ON a.key = b.key),
p AS (SELECT key, CASE WHEN y IS NULL THEN 'missing in id' WHEN x IS NULL THEN 'missing in en' WHEN list_sort(list_distinct(regexp_extract_all(x, '\\{{\\d+\\}}'))) <> list_sort(list_distinct(regexp_extract_all(y, '\\{{\\d+\\}}'))) THEN 'placeholders' WHEN trim(x) = '' OR trim(y) = '' THEN 'blank' END AS problem FROM j)
SELECT CAST(key AS VARCHAR) AS key, problem FROM p WHERE problem IS NOT NULL
""")
def op61_parity(spark, d):
    part = table(spark, d, "part").selectExpr("p_partkey", f"{_PART_TEXT} AS t")
    k = F.col("p_partkey")
    en = part.where(k % 7 != 0).select(F.lit("en").alias("lang"), k.cast("string").alias("key"), F.col("t").alias("template"))
    other = part.where(k % 13 != 0).select(F.lit("id").alias("lang"), k.cast("string").alias("key"), F.when(k % 11 == 0, "{1}").otherwise(F.col("t")).alias("template"))
    return registry.key_parity(en.unionByName(other), "en", "id")


@query("op96_device_name", r"SELECT c_custkey, coalesce(nullif(trim(regexp_replace(CASE WHEN c_custkey % 4 = 0 THEN '   ' WHEN c_custkey % 4 = 1 THEN NULL ELSE '  ' || c_name || '   CPU ' END, '\s+', ' ', 'g')), ''), 'x64') AS name, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 1024 END, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END, 0) AS ram FROM customer")
def op96_device_name(spark, d):
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, "   ").when(k % 4 == 1, None).otherwise(F.concat(F.lit("  "), F.col("c_name"), F.lit("   CPU ")))
    ram = F.coalesce(F.when(k % 3 == 0, k * 1024), F.when(k % 2 == 0, k), F.lit(0))
    return table(spark, d, "customer").select("c_custkey", tx.clean_device_name(name, F.lit("x64")).alias("name"), ram.cast("long").alias("ram"))


@query("op97_summary", f"""
WITH x AS (SELECT doc_id, source, n_chars AS b, doc_id % 4 AS pages FROM documents)
SELECT doc_id, upper(source) || ' → PDF' AS title, 'PDF document · ' || CASE WHEN pages = 1 THEN '1 page · ' WHEN pages > 1 THEN pages || ' pages · ' ELSE '' END || {_size_sql('.', 'bytes')} AS description FROM x
""")
def op97_summary(spark, d):
    n = F.col("doc_id") % 4
    pages = F.when(n == 1, "1 page · ").when(n > 1, F.concat(n.cast("string"), F.lit(" pages · "))).otherwise("")
    return table(spark, d, "documents").select("doc_id", F.concat(F.upper("source"), F.lit(" → PDF")).alias("title"), F.concat(F.lit("PDF document · "), pages, tx.file_size_text(F.col("n_chars"))).alias("description"))


_ERRORS = ("ChunkMismatch", "LengthMismatch", "FileHashMismatch", "InvalidOutput", "FileNotFound", "DirectoryNotFound", "UnauthorizedAccess", "SameFile", "LockedPdf", "NothingToTrace", "NothingToConvert", "UnsupportedCad", "ExternalTool", "Io", "Other")
_KEYS = ("ChunkMismatch", "LengthMismatch", "HashMismatch", "CannotReopen", "SourceMissing", "FolderMissing", "NoWriteAccess", "SameFile", "LockedPdf", "NothingToTraceImage", "NothingToConvertPdf", "UnsupportedCad", "ExternalTool")


@query("op78_error_class", f"""
WITH e AS (SELECT event_id, list_value({', '.join(map(repr, _ERRORS))})[event_id % 15 + 1] AS kind, event_id % 4 AS stage FROM events)
SELECT event_id, 'Error.' || CASE kind {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in zip(_ERRORS, _KEYS, strict=False))} ELSE CASE WHEN stage = 0 THEN 'Decode' WHEN kind = 'Io' THEN 'Io' ELSE 'Unexpected' END END AS key FROM e
""")
def op78_error_class(spark, d):
    from ..operators.states import error_key

    e = table(spark, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, _ERRORS)), (F.col("event_id") % 15 + 1).cast("int")).alias("kind"), (F.col("event_id") % 4).alias("stage"))
    return e.select("event_id", error_key(F.col("kind"), F.col("stage") == 0).alias("key"))
