"""Histories, journals, settings, progress, screen rules; plain set and window shapes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import states
from .registry import query, table

_ACTION = "CASE WHEN event_id % 97 = 0 THEN 'clear' WHEN event_id % 53 = 0 THEN 'disable' WHEN event_id % 53 = 3 THEN 'enable' ELSE 'add' END"


@query("op47_history", f"""
WITH l AS (SELECT event_id, user_id, event_type, {_ACTION} AS action FROM events),
w AS (SELECT *, coalesce(last_value(CASE WHEN action IN ('enable', 'disable') THEN action END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'enable') AS is_on,
  count(*) FILTER (WHERE action = 'clear') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS late FROM l)
SELECT user_id, event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS INTEGER) AS rank FROM w WHERE action = 'add' AND is_on = 'enable' AND late = 0
""")
def op47_history(spark, d):
    log = table(spark, d, "events").selectExpr("event_id", "user_id", "event_type", f"{_ACTION} AS action")
    return states.recorded(log, "user_id", "event_id", "action").select("user_id", "event_id", "event_type", "rank")


@query("op58_newest", "SELECT user_id, max(event_id) AS newest, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def op58_newest(spark, d):
    e = table(spark, d, "events")
    top = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
    return e.withColumn("_at", top).where("_at = 1").select("user_id", F.col("event_id").alias("newest"), "event_type")


@query("op87_latest", "SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def op87_latest(spark, d):
    return states.latest(table(spark, d, "events"), ["user_id", "event_type"], "value", "event_id")


@query("op49_settings", """
WITH l AS (SELECT user_id, event_id, event_type AS key, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'v' || event_id % 100 END AS v FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, key ORDER BY event_id DESC) AS n FROM l)
SELECT user_id, key, v FROM r WHERE n = 1 AND v IS NOT NULL
""")
def op49_settings(spark, d):
    log = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("key"), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("v"), (F.col("event_id") % 100).cast("string"))).alias("v"))
    return states.settings(log, "user_id", "key", "v", "event_id")


@query("op48_cleanup", """
WITH p AS (SELECT event_id AS entry, CASE event_id % 4 WHEN 0 THEN '/tmp/a' || event_id || '.Corvane-TMP' WHEN 1 THEN 'b.corvane-tmp' WHEN 2 THEN '/home/thesis.docx' ELSE 'C:\\x.corvane-tmp' END AS path, event_id % 3 <> 0 AS present, event_id % 7 = 0 AS refused FROM events),
f AS (SELECT *, (starts_with(path, '/') OR regexp_matches(path, '^[A-Za-z]:\\\\')) AND ends_with(lower(path), '.corvane-tmp') AND present AS gone FROM p WHERE entry % 5 <> 0)
SELECT entry, gone AS delete_file, NOT (gone AND refused) AS drop_entry FROM f
""".replace("'C:\\\\x", "'C:\\x"))
def op48_cleanup(spark, d):
    i = F.col("event_id")
    path = F.when(i % 4 == 0, F.concat(F.lit("/tmp/a"), i.cast("string"), F.lit(".Corvane-TMP"))).when(i % 4 == 1, "b.corvane-tmp").when(i % 4 == 2, "/home/thesis.docx").otherwise("C:\\x.corvane-tmp")
    pending = table(spark, d, "events").select(i.alias("entry"), path.alias("path"), (i % 3 != 0).alias("present"), (i % 7 == 0).alias("refused"))
    running = table(spark, d, "events").where(i % 5 == 0).select(i.alias("entry"))
    return states.stale_files(pending, running, "entry", ".corvane-tmp")


@query("op56_progress", """
WITH e AS (SELECT event_id, CAST(event_id % 4 AS INTEGER) AS stage, CASE WHEN event_id % 11 = 0 THEN 'nan'::DOUBLE ELSE (event_id * 37 % 160 - 20) / 100.0::DOUBLE END AS f FROM events),
b AS (SELECT event_id, stage, CASE WHEN isnan(f) THEN 0.0::DOUBLE ELSE least(greatest(f, 0.0::DOUBLE), 1.0::DOUBLE) END AS f, list_value(0.0::DOUBLE, 0.35::DOUBLE, 0.7::DOUBLE, 0.9::DOUBLE, 1.0::DOUBLE) AS x FROM e)
SELECT event_id, floor((x[stage + 1] + (x[stage + 2] - x[stage + 1]) * f) * 1e6::DOUBLE + 0.5::DOUBLE)::BIGINT AS micro FROM b
""")
def op56_progress(spark, d):
    i = F.col("event_id")
    f = F.when(i % 11 == 0, float("nan")).otherwise((i * 37 % 160 - 20) / 100.0)
    return table(spark, d, "events").select("event_id", F.floor(states.overall((i % 4).cast("int"), f) * 1e6 + 0.5).alias("micro"))


@query("op57_steps", """
SELECT event_id, CAST(s AS INTEGER) AS step, CASE WHEN s < event_id % 5 OR event_id % 13 = 0 THEN 'Done' WHEN s = event_id % 5 THEN 'Active' ELSE 'Waiting' END AS state, floor((event_id % 101) / 100.0::DOUBLE * 100.0::DOUBLE)::BIGINT AS percent FROM events, (SELECT unnest([0, 1, 2, 3]) AS s)
""")
def op57_steps(spark, d):
    i = F.col("event_id")
    e = table(spark, d, "events").select("event_id", F.explode(F.array(*map(F.lit, range(4)))).alias("step"))
    return e.select("event_id", "step", states.step_state(F.col("step"), i % 5, i % 13 == 0).alias("state"), F.floor(i % 101 / 100.0 * 100.0).alias("percent"))


@query("op88_drop", """
SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 4 > 0 THEN 'Folder' WHEN event_id % 3 + event_id % 4 > 1 THEN 'Many' WHEN event_id % 3 = 0 THEN 'Nothing' WHEN CASE WHEN event_id % 5 = 0 THEN '' ELSE 'x' END = '' THEN 'Unreadable' ELSE 'Select' END AS result FROM events
""")
def op88_drop(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", states.dropped(i % 3, i % 4, F.when(i % 5 != 0, "x")).alias("result"))


@query("op89_gate", """
WITH e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'Input' ELSE 'Busy' END AS state, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'f' END AS source, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 5 < 4 END AS enabled, event_id % 3 = 0 AS drawing, list_value('Vector', 'Empty', NULL)[event_id % 3 + 1] AS kind, list_value(1.0::DOUBLE, 0.5::DOUBLE, 'nan'::DOUBLE, 50.0::DOUBLE)[event_id % 4 + 1] AS scale FROM events)
SELECT event_id, state = 'Input' AND source IS NOT NULL AND coalesce(enabled, false) AND (NOT drawing OR coalesce(kind <> 'Empty' AND scale >= 1 AND NOT isnan(scale), false)) AS ok FROM e
""")
def op89_gate(spark, d):
    i = F.col("event_id")
    e = table(spark, d, "events").select(
        "event_id", F.when(i % 2 == 0, "Input").otherwise("Busy").alias("state"), F.when(i % 7 != 0, "f").alias("source"), F.when(i % 5 != 0, i % 5 < 4).alias("enabled"), (i % 3 == 0).alias("drawing"),
        F.expr("array('Vector', 'Empty', NULL)[cast(event_id % 3 as int)]").alias("kind"), F.expr("array(1D, 0.5D, double('NaN'), 50D)[cast(event_id % 4 as int)]").alias("scale"),
    )
    return e.select("event_id", states.can_convert(*[F.col(c) for c in ("state", "source", "enabled", "drawing", "kind", "scale")]).alias("ok"))


@query("op90_options", """
WITH e AS (SELECT event_id, list_value('.dxf', '.dwg', '.png', '.heic', '.pdf')[event_id % 5 + 1] AS target, event_id % 9 + 1 AS page, event_id % 2 = 0 AS keep, event_id % 3 = 0 AS scan FROM events)
SELECT event_id, CASE WHEN target IN ('.dxf', '.dwg') THEN page || ';mm;100;' || (keep AND NOT scan) || ';true' WHEN target IN ('.png', '.jpg', '.heic') THEN '' || page END AS options FROM e
""")
def op90_options(spark, d):
    i = F.col("event_id")
    target = F.expr("array('.dxf', '.dwg', '.png', '.heic', '.pdf')[cast(event_id % 5 as int)]")
    return table(spark, d, "events").select("event_id", states.options(target, i % 9 + 1, F.lit("mm"), F.lit(100), i % 2 == 0, i % 3 == 0, F.lit(True)).alias("options"))


@query("op91_destination", r"SELECT page_id, CASE WHEN lower(regexp_extract(n, '(\.[^./\\]+)$', 1)) = '.pdf' THEN n ELSE n || '.pdf' END AS name FROM (SELECT page_id, 'out' || page_id || list_value('', '.PDF', '.txt', '.')[page_id % 4 + 1] AS n FROM pages)")
def op91_destination(spark, d):
    name = F.expr("concat('out', cast(page_id as string), array('', '.PDF', '.txt', '.')[cast(page_id % 4 as int)])")
    return table(spark, d, "pages").select("page_id", states.with_extension(name, F.lit(".pdf")).alias("name"))


@query("op101_missing_file", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'ShowFile' WHEN event_id % 2 = 0 THEN 'ShowFolder' ELSE 'Message' END AS action FROM events")
def op101_missing_file(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", states.missing_file(i % 3 == 0, i % 2 == 0).alias("action"))


@query("op60_visible_union", """
WITH v AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), h AS (SELECT conv_id, turn, text FROM conversations WHERE role <> 'user' AND conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system'))
SELECT conv_id, CAST(count(*) AS BIGINT) AS lines, CAST(sum(length(text)) AS BIGINT) AS points FROM (SELECT * FROM v UNION ALL SELECT * FROM h) GROUP BY conv_id
""")
def op60_visible_union(spark, d):
    """Visible lines and the hidden ones that are backed, as a bag."""
    c = table(spark, d, "conversations")
    backed = c.where("role = 'system'").select("conv_id")
    both = c.where("role = 'user'").unionByName(c.where("role <> 'user'").join(backed, "conv_id", "left_semi"))
    return both.groupBy("conv_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.char_length("text")).alias("points"))


@query("op59_line_order", "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY floor(value), event_id) AS INTEGER) AS place FROM events")
def op59_line_order(spark, d):
    """A stable sort: equal starts keep their order."""
    w = Window.partitionBy("user_id").orderBy(F.floor("value"), "event_id")
    return table(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).alias("place"))


@query("op11_page_range", "SELECT page_id, page_id % 7 BETWEEN 1 AND 5 AS valid, greatest(1, round_even((page_id % 7 * 120.5::DOUBLE + 10) * 3 * 72 / 96, 0))::INTEGER AS width FROM pages")
def op11_page_range(spark, d):
    """Whether a page exists, and the width in pixels of its picture at 3 pixels a point, halves to even."""
    i = F.col("page_id")
    return table(spark, d, "pages").select("page_id", (i % 7).between(1, 5).alias("valid"), F.greatest(F.lit(1), F.rint((i % 7 * 120.5 + 10) * 3 * 72 / 96).cast("int")).alias("width"))
