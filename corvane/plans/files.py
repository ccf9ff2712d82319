"""Hashing, verification, formats, drawings as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import text as tx
from ..operators import hashing, registry, validate
from ..sources import drawing, scan
from .registry import query, table

CHUNK = 1024


def _payloads(spark, d):
    """documents with the content as written and as read back: a byte overwritten in every 7th, the last one lost in every 11th."""
    docs = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    n = F.octet_length("content")
    at = (F.col("doc_id") % n + 1).cast("int")
    hit = F.overlay("content", F.lit("~").cast("binary"), at, F.lit(1))
    found = F.when(F.col("doc_id") % 7 == 0, hit).when(F.col("doc_id") % 11 == 0, F.substring("content", F.lit(1), n - 1)).otherwise(F.col("content"))
    return docs.withColumn("found", found)


_PAYLOADS = """
p AS (SELECT doc_id, encode(text) AS content, octet_length(encode(text)) AS n FROM documents),
q AS (SELECT doc_id, content, n, CASE WHEN doc_id % 7 = 0 THEN array_slice(content, 1, doc_id % n) || encode('~') || array_slice(content, doc_id % n + 2, n)
  WHEN doc_id % 11 = 0 THEN array_slice(content, 1, n - 1) ELSE content END AS found FROM p)
"""


@query("op18_chunk_manifest", f"""
WITH p AS (SELECT doc_id, encode(text) AS content, octet_length(encode(text)) AS n FROM documents),
c AS (SELECT doc_id, content, n, unnest(range(0, (n + {CHUNK - 1}) // {CHUNK})) AS k FROM p)
SELECT doc_id, CAST(k + 1 AS INTEGER) AS chunk_no, CAST(least({CHUNK}, n - k * {CHUNK}) AS INTEGER) AS chunk_len, sha256(array_slice(content, k * {CHUNK} + 1, (k + 1) * {CHUNK})) AS sha256 FROM c
""")
def op18_chunk_manifest(spark, d):
    return hashing.chunk_manifest(_payloads(spark, d), "doc_id", "content", CHUNK)


@query("op18_file_manifest", f"""
WITH p AS (SELECT doc_id, encode(text) AS content FROM documents)
SELECT doc_id, CAST(octet_length(content) AS BIGINT) AS length, CAST((octet_length(content) + {CHUNK - 1}) // {CHUNK} AS INTEGER) AS chunk_count, sha256(content) AS sha256 FROM p
""")
def op18_file_manifest(spark, d):
    return hashing.file_manifest(_payloads(spark, d), "doc_id", "content", CHUNK)


@query("op17_hashing_sink", """
SELECT source, CAST(count(*) AS BIGINT) AS files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, max(sha256(encode(text))) AS last_sha256 FROM documents GROUP BY source
""")
def op17_hashing_sink(spark, d):
    """Hash in the projection that produces the bytes, then what a sink would report per folder."""
    docs = table(spark, d, "documents").withColumn("content", F.col("text").cast("binary"))
    hashed = docs.select("source", F.octet_length("content").cast("long").alias("n"), F.sha2("content", 256).alias("h"))
    return hashed.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("bytes"), F.max("h").alias("last_sha256"))


@query("op19_verify_chunks", f"""
WITH {_PAYLOADS},
c AS (SELECT doc_id, content, found, n, octet_length(found) AS m, unnest(range(0, (n + {CHUNK - 1}) // {CHUNK})) AS k FROM q),
b AS (SELECT doc_id, any_value(n) <> any_value(m) AS longer, min(k + 1) FILTER (WHERE sha256(array_slice(content, k * {CHUNK} + 1, (k + 1) * {CHUNK})) <> sha256(array_slice(found, k * {CHUNK} + 1, (k + 1) * {CHUNK}))) AS bad FROM c GROUP BY doc_id)
SELECT doc_id, CASE WHEN longer THEN 'LengthMismatch' WHEN bad IS NOT NULL THEN 'ChunkMismatch' END AS failure, CASE WHEN NOT longer THEN CAST(bad AS INTEGER) END AS chunk_no FROM b
""")
def op19_verify_chunks(spark, d):
    return hashing.verify_chunks(_payloads(spark, d), "doc_id", "content", "found", CHUNK)


@query("op19b_verify_file", f"WITH {_PAYLOADS} SELECT doc_id, n = octet_length(found) AND sha256(content) = sha256(found) AS intact FROM q")
def op19b_verify_file(spark, d):
    return hashing.verify_file(_payloads(spark, d), "doc_id", "content", "found")


@query("op80_failure_kind", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN 'LengthMismatch' WHEN doc_id % 5 = 0 THEN 'ChunkMismatch:' || (doc_id % 9 + 1) WHEN doc_id % 7 = 0 THEN 'FileHashMismatch' WHEN doc_id % 11 = 0 THEN 'InvalidOutput' END AS failure FROM documents
""")
def op80_failure_kind(spark, d):
    i = F.col("doc_id")
    bad = F.when(i % 5 == 0, i % 9 + 1)
    return table(spark, d, "documents").select("doc_id", hashing.failure_kind(~((i % 2 == 0) & (i % 3 == 0)), bad, i % 7 != 0, i % 11 != 0).alias("failure"))


@query("op99_pinned_hash", "SELECT doc_id, sha256(encode(text)) IN (SELECT sha256(encode(text)) FROM documents WHERE doc_id < 5) AS trusted FROM documents")
def op99_pinned_hash(spark, d):
    """A file may be used only if its hash is one of the pinned ones (those of five documents)."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    pinned = docs.where("doc_id < 5").select("h").distinct().withColumn("_ok", F.lit(True))
    return docs.join(F.broadcast(pinned), "h", "left").select("doc_id", F.coalesce("_ok", F.lit(False)).alias("trusted"))  # five hashes at most


@query("op01_job_checks", """
WITH j AS (SELECT page_id, url, CASE WHEN page_id % 4 = 0 THEN upper(url) ELSE url || '.pdf' END AS dest, page_id % 5 <> 0 AS present, page_id % 6 <> 0 AS folder FROM pages)
SELECT page_id, CASE WHEN NOT present THEN 'SourceMissing' WHEN NOT folder THEN 'FolderMissing' WHEN lower(url) = lower(dest) THEN 'SameFile' ELSE 'Ready' END AS status FROM j
""")
def op01_job_checks(spark, d):
    i = F.col("page_id")
    jobs = table(spark, d, "pages").select("page_id", "url", F.when(i % 4 == 0, F.upper("url")).otherwise(F.concat("url", F.lit(".pdf"))).alias("dest"), (i % 5 != 0).alias("present"), (i % 6 != 0).alias("folder"))
    return jobs.select("page_id", scan.job_status(F.col("url"), F.col("dest"), F.col("present"), F.col("folder")).alias("status"))


_EXT = "CASE page_id % 7 WHEN 0 THEN ' .Png ' WHEN 1 THEN 'PDF' WHEN 2 THEN '' WHEN 3 THEN '.' WHEN 4 THEN 'dwg' WHEN 5 THEN '.TXT' ELSE '.x' || page_id END"


@query("op02_extension", f"WITH p AS (SELECT page_id, lower(trim({_EXT})) AS e FROM pages) SELECT page_id, CASE WHEN e IN ('', '.') THEN NULL WHEN starts_with(e, '.') THEN e ELSE '.' || e END AS ext FROM p")
def op02_extension(spark, d):
    return table(spark, d, "pages").select("page_id", tx.normalize_extension(F.expr(_EXT)).alias("ext"))


@query("op02b_extension_of_path", r"SELECT page_id, lower(regexp_extract(url, '(\.[^./\\]+)$', 1)) AS ext, upper(regexp_replace(regexp_extract(url, '(\.[^./\\]+)$', 1), '^\.', '')) AS code FROM pages")
def op02b_extension_of_path(spark, d):
    ext = tx.extension_of_path(F.col("url"))
    return table(spark, d, "pages").select("page_id", ext.alias("ext"), tx.extension_code(ext).alias("code"))


_CONVERTERS = dims.values_sql(dims.CONVERTERS, "c(ord, name, available, reason)")
_EDGES = dims.values_sql([(o, s, t, k) for k, (o, s, t) in enumerate(dims.EDGES)], "e(ord, source, target, pos)")
_CATALOG = dims.values_sql([(k, *row) for k, row in enumerate(dims.CATALOG)], "c(ord, ext, label, kind, argument)")
_STRINGS = dims.values_sql(dims.STRINGS, "s(lang, key, template)")
_OPTIONS = f"""
o AS (SELECT e.source, e.target, e.ord, e.pos, c.available, c.reason FROM {_EDGES} JOIN {_CONVERTERS} ON e.ord = c.ord WHERE e.source <> e.target),
r AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY NOT available, ord, pos) AS best, min(ord * 1000 + pos) OVER (PARTITION BY source, target) AS place FROM o),
t AS (SELECT source, target, CAST(row_number() OVER (PARTITION BY source ORDER BY place) AS INTEGER) AS position, available AS enabled, CASE WHEN NOT available THEN reason END AS reason FROM r WHERE best = 1)
"""


@query("op03_target_options", f"WITH {_OPTIONS} SELECT source, target, position, enabled, reason FROM t")
def op03_target_options(spark, d):
    return registry.target_options(registry.converters(spark), registry.edges(spark))


_REQUEST = "list_value('.jpg', '.png', '.pdf', '.docx', '.dxf', '.dwg', '.mp3')[doc_id % 7 + 1] AS source, list_value('.png', '.pdf', '.dxf', '.dwg', '.odt')[doc_id % 5 + 1] AS target"
_REQUEST_SPARK = _REQUEST.replace("list_value", "array").replace("[doc_id % 7 + 1]", "[cast(doc_id % 7 as int)]").replace("[doc_id % 5 + 1]", "[cast(doc_id % 5 as int)]")


def _requests(spark, d):
    return table(spark, d, "documents").selectExpr("doc_id", *_REQUEST_SPARK.replace(" AS target", " AS target@").replace(" AS source, ", " AS source@").split("@")[:2])


@query("op04_find_converter", f"""
WITH q AS (SELECT doc_id, {_REQUEST} FROM documents), a AS (SELECT e.source, e.target, arg_min(c.name, (c.ord, e.pos)) AS converter FROM {_EDGES} JOIN {_CONVERTERS} ON e.ord = c.ord WHERE c.available GROUP BY ALL)
SELECT q.doc_id, q.source, q.target, a.converter FROM q LEFT JOIN a ON q.source = a.source AND q.target = a.target
""")
def op04_find_converter(spark, d):
    return registry.find_converter(_requests(spark, d), registry.converters(spark), registry.edges(spark))


@query("op04b_find_validator", f"""
WITH q AS (SELECT doc_id, {_REQUEST} FROM documents), v AS (SELECT target, min(ord) AS validator FROM {dims.values_sql(dims.VALIDATORS, 'v(ord, target)')} GROUP BY target)
SELECT q.target, v.validator, CAST(count(*) AS BIGINT) AS jobs FROM q LEFT JOIN v ON q.target = v.target GROUP BY ALL
""")
def op04b_find_validator(spark, d):
    return registry.find_validator(_requests(spark, d), registry.validators(spark)).groupBy("target", "validator").agg(F.count(F.lit(1)).alias("jobs"))


@query("op05_source_extensions", f"WITH {_OPTIONS} SELECT c.ord, c.ext FROM {_CATALOG} WHERE c.ext IN (SELECT source FROM t)")
def op05_source_extensions(spark, d):
    options = registry.target_options(registry.converters(spark), registry.edges(spark))
    return registry.source_extensions(registry.catalog(spark), options)


_FAMILY_ROWS = dims.values_sql([(k, s, t, j, f) for k, (ss, ts, f) in enumerate(dims.FAMILIES) for s in ss for j, t in enumerate(ts)], "f(family, source, target, pos, filter)")


@query("op05b_families", f"""
WITH p AS (SELECT source, target, min(family * 100 + pos) AS place, arg_min(coalesce(filter, '-'), family * 100 + pos) AS filter FROM {_FAMILY_ROWS} GROUP BY ALL)
SELECT source, string_agg(target, ',' ORDER BY place) AS targets, string_agg(filter, ',' ORDER BY place) AS filters FROM p GROUP BY source
""")
def op05b_families(spark, d):
    found = registry.families(spark)
    return found.select("source", F.array_join("targets", ",").alias("targets"), F.array_join("filters", ",", "-").alias("filters"))


@query("op53_format_catalog", f"""
WITH x AS (SELECT doc_id, coalesce(list_value('.jpg', '.pdf', '.dwg', '.md', '.xyz', '.odp')[doc_id % 6 + 1], '') AS ext FROM documents),
j AS (SELECT x.*, c.label, c.kind, c.argument, upper(regexp_replace(x.ext, '^\\.', '')) AS code FROM x LEFT JOIN {_CATALOG} ON x.ext = c.ext)
SELECT doc_id, ext, coalesce(label, code) AS label, replace(coalesce(o.template, b.template), '{{0}}', coalesce(CASE WHEN kind IS NULL THEN code ELSE argument END, '')) AS kind
FROM j LEFT JOIN (SELECT * FROM {_STRINGS} WHERE lang = 'id') o ON o.key = 'Kind.' || coalesce(kind, 'Unknown') LEFT JOIN (SELECT * FROM {_STRINGS} WHERE lang = 'en') b ON b.key = 'Kind.' || coalesce(kind, 'Unknown')
""")
def op53_format_catalog(spark, d):
    rows = table(spark, d, "documents").selectExpr("doc_id", "array('.jpg', '.pdf', '.dwg', '.md', '.xyz', '.odp')[cast(doc_id % 6 as int)] AS ext")
    strings = spark.createDataFrame(list(dims.STRINGS), "lang string, key string, template string")
    return registry.describe_format(rows, "ext", registry.catalog(spark), strings, "id")


@query("op93_keep_target", f"""
WITH {_OPTIONS}, q AS (SELECT doc_id, {_REQUEST} FROM documents)
SELECT q.doc_id, CASE WHEN t.enabled THEN q.target END AS kept, (SELECT arg_min(x.reason, x.position) FROM t x WHERE x.source = q.source AND NOT x.enabled) AS reason FROM q LEFT JOIN t ON t.source = q.source AND t.target = q.target
""")
def op93_keep_target(spark, d):
    options = registry.target_options(registry.converters(spark), registry.edges(spark))
    first = options.where("not enabled").groupBy("source").agg(F.min_by("reason", "position").alias("_why"))
    out = _requests(spark, d).join(F.broadcast(options.select("source", "target", "enabled")), ["source", "target"], "left").join(F.broadcast(first), "source", "left")
    return out.select("doc_id", F.when(F.col("enabled"), F.col("target")).alias("kept"), F.col("_why").alias("reason"))


@query("op55_option_count", f"WITH {_OPTIONS} SELECT source, CAST(count(*) FILTER (WHERE enabled) AS BIGINT) AS n, CASE WHEN count(*) FILTER (WHERE enabled) = 1 THEN 'one' ELSE 'many' END AS word FROM t GROUP BY source")
def op55_option_count(spark, d):
    n = registry.target_options(registry.converters(spark), registry.edges(spark)).groupBy("source").agg(F.count_if("enabled").alias("n"))
    return n.withColumn("word", F.when(F.col("n") == 1, "one").otherwise("many"))


@query("op98_image_extension", "SELECT page_id, regexp_extract(url, '[^/]*$') AS name, list_value('.jpg', '.doc', '.webp', '.svg')[page_id % 4 + 1] IN ('.jpg', '.jpeg', '.png', '.bmp', '.gif', '.tif', '.tiff', '.heic', '.heif', '.webp') AS is_image FROM pages")
def op98_image_extension(spark, d):
    ext = F.expr("array('.jpg', '.doc', '.webp', '.svg')[cast(page_id % 4 as int)]")
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "[^/]*$", 0).alias("name"), ext.isin(*[e for e, _, k, _ in dims.CATALOG if k == "Image"]).alias("is_image"))


_VERSION = "list_value('AC1006', 'AC1009', 'AC1012', 'AC1014', 'AC1015', 'AC1018', 'AC1021', 'AC1032')[doc_id % 8 + 1]"


@query("op37_writable_version", f"""
WITH v AS (SELECT doc_id, {_VERSION} AS v FROM documents)
SELECT doc_id, CASE WHEN v IN {dims.DWG_VERSIONS} THEN v WHEN v = 'AC1021' THEN 'AC1024' ELSE 'AC1015' END AS dwg, CASE WHEN v IN {dims.DXF_VERSIONS} THEN v ELSE 'AC1015' END AS dxf FROM v
""")
def op37_writable_version(spark, d):
    v = F.expr(_VERSION.replace("list_value", "array").replace("[doc_id % 8 + 1]", "[cast(doc_id % 8 as int)]"))
    return table(spark, d, "documents").select("doc_id", drawing.writable_version(v, ".dwg").alias("dwg"), drawing.writable_version(v, ".dxf").alias("dxf"))


_HEAD = r"concat('  9', chr(10), '$ACADVER', chr(10), '  1', chr(10), 'AC100', CAST(doc_id % 11 AS VARCHAR), chr(10), 'AC1004 ', CAST(doc_id AS VARCHAR))"


@query("op36_relabel", rf"SELECT doc_id, regexp_replace({_HEAD}, '(\$ACADVER\s+1\s+)AC100[0-8]', '\1AC1009') AS head FROM documents")
def op36_relabel(spark, d):
    return table(spark, d, "documents").select("doc_id", drawing.as_old_version(F.expr(_HEAD.replace("VARCHAR", "STRING"))).alias("head"))


@query("op12_pairs", """
WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), k AS (SELECT doc_id, lines, unnest(range(0, len(lines) // 2)) AS ord FROM x)
SELECT doc_id, CAST(ord AS INTEGER) AS ord, trim(lines[2 * ord + 1]) AS code, lines[2 * ord + 2] AS value FROM k
""")
def op12_pairs(spark, d):
    docs = table(spark, d, "documents")
    return drawing.pairs(docs, "doc_id", "text")


@query("op13_write", "SELECT l_orderkey, string_agg('  10' || chr(10) || CAST(l_quantity AS INTEGER), chr(10) ORDER BY l_linenumber, l_partkey, l_quantity) AS body, CAST(count(*) AS BIGINT) AS pairs FROM lineitem GROUP BY l_orderkey")
def op13_write(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_quantity").alias("ord"), F.lit("  10").alias("code"), F.col("l_quantity").cast("int").cast("string").alias("value"))
    return drawing.rendered(rows, "l_orderkey", "ord")


@query("op38_drop_unwritable", "SELECT l_orderkey, CAST(count(*) FILTER (WHERE l_returnflag <> 'R') AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS dropped FROM lineitem GROUP BY l_orderkey")
def op38_drop_unwritable(spark, d):
    kind = F.when(F.col("l_returnflag") == "R", "ImagePlaceholder").otherwise("Line")
    return drawing.drop_unwritable(table(spark, d, "lineitem").select("l_orderkey", kind.alias("kind")), "l_orderkey", "kind")


@query("op84_drawing_check", "SELECT o.o_orderkey, count(l.l_orderkey) > 0 AS valid FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey")
def op84_drawing_check(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", (F.coalesce("n", F.lit(0)) > 0).alias("valid"))


_RTF = r"CASE doc_id % 4 WHEN 0 THEN '{\rtf1 ' || text || '}' || chr(10) WHEN 1 THEN '{\rtf1 ' || text WHEN 2 THEN text || '}' ELSE ' {\rtf}' END"


@query("op83_rtf_check", rf"SELECT doc_id, starts_with({_RTF}, '{{\rtf') AND ends_with(rtrim({_RTF}, chr(10) || chr(13) || ' '), '}}') AS valid FROM documents")
def op83_rtf_check(spark, d):
    return table(spark, d, "documents").select("doc_id", validate.rtf_ok(F.expr(_RTF.replace("\\", "\\\\"))).alias("valid"))


@query("op82_ole_check", "SELECT doc_id, doc_id % 3 = 0 AND octet_length(encode(text)) + 8 >= 1536 AS valid FROM documents")
def op82_ole_check(spark, d):
    head = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("D0CF11E0A1B11AE1"))).otherwise(F.unhex(F.lit("504B030400000000")))
    return table(spark, d, "documents").select("doc_id", validate.compound_ok(F.concat(head, F.col("text").cast("binary"))).alias("valid"))


@query("op81_office_check")
def op81_office_check(spark, d):
    """Packages made of pages: whole ones, one cut short, one without its main part."""
    return validate.office_check(validate.sample_packages(table(spark, d, "pages")), "page_id", "ext", "content")


@query("op16_tool_locator", "SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 7 = 0 THEN 'registry64' END, CASE WHEN s_suppkey % 5 = 0 THEN 'registry32' END, CASE WHEN s_suppkey % 3 = 0 THEN 'programs' END, CASE WHEN s_suppkey % 2 = 0 THEN 'bundled' END) AS found FROM supplier")
def op16_tool_locator(spark, d):
    i = F.col("s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", scan.first_existing([(F.lit(n), i % k == 0) for n, k in (("registry64", 7), ("registry32", 5), ("programs", 3), ("bundled", 2))]).alias("found"))


@query("op15_arguments", f"""
WITH q AS (SELECT doc_id, {_REQUEST} FROM documents), f AS (SELECT source, target, arg_min(filter, family) AS filter FROM {_FAMILY_ROWS} WHERE filter IS NOT NULL GROUP BY ALL)
SELECT doc_id, '--headless --norestore' || coalesce(' --infilter=' || f.filter, '') || ' --convert-to ' || substr(q.target, 2) || ' --outdir out in/file' || q.source AS arguments FROM q LEFT JOIN f ON q.source = f.source AND q.target = f.target
""")
def op15_arguments(spark, d):
    rows = [(s, t, f) for ss, ts, f in dims.FAMILIES if f for s in ss for t in ts]
    filters = spark.createDataFrame(rows, "source string, target string, filter string")
    out = _requests(spark, d).join(F.broadcast(filters), ["source", "target"], "left")
    return out.select("doc_id", F.array_join(scan.office_arguments(F.col("source"), F.col("target"), F.col("filter")), " ").alias("arguments"))


@query("op92_temp_name", """
WITH t AS (SELECT p_partkey, unnest([1, 2, 3, 4]) AS n FROM part), x AS (SELECT p_partkey, min(n) AS n FROM t WHERE NOT (n <= p_partkey % 4) GROUP BY p_partkey)
SELECT p_partkey, 'file' || p_partkey || CASE WHEN n = 1 THEN '' ELSE '.' || n END || '.corvane-tmp' AS name FROM x
""")
def op92_temp_name(spark, d):
    taken = table(spark, d, "part").select("p_partkey", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("n")).where("n <= p_partkey % 4")
    want = table(spark, d, "part").select("p_partkey", F.concat(F.lit("file"), F.col("p_partkey").cast("string")).alias("dest"))
    return scan.free_temp_names(want, taken, "p_partkey", "dest", 4)


@query("op14_drawing_roundtrip", "SELECT l_orderkey, CAST(count(*) AS BIGINT) AS pairs, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS total FROM lineitem GROUP BY l_orderkey")
def op14_drawing_roundtrip(spark, d):
    """Drawings written as text and read again."""
    rows = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey").alias("ord"), F.lit("  10").alias("code"), F.col("l_quantity").cast("int").cast("string").alias("value"))
    back = drawing.pairs(drawing.rendered(rows, "l_orderkey", "ord"), "l_orderkey", "body").where("code = '10'")
    return back.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("value").cast("long")).alias("total"))


_TRIM = ("%/a%", "%.html", "%7%")


@query("op100_folder_trim", f"""
SELECT page_id % 10 AS folder, CAST(sum(octet_length(encode(html))) AS BIGINT) AS before, CAST(coalesce(sum(octet_length(encode(html))) FILTER (WHERE NOT ({' OR '.join(f"url LIKE '{p}'" for p in _TRIM)}) OR page_id % 4 = 0), 0) AS BIGINT) AS after FROM pages GROUP BY ALL
""")
def op100_folder_trim(spark, d):
    """Sizes of folders before and after files that match a list of patterns go; those of kept languages stay."""
    hit = F.lit(False)
    for p in _TRIM:
        hit = hit | F.col("url").like(p)
    files = table(spark, d, "pages").select((F.col("page_id") % 10).alias("folder"), F.octet_length(F.col("html").cast("binary")).cast("long").alias("n"), (hit & (F.col("page_id") % 4 != 0)).alias("gone"))
    return files.groupBy("folder").agg(F.sum("n").alias("before"), F.coalesce(F.sum(F.when(~F.col("gone"), F.col("n"))), F.lit(0)).alias("after"))
