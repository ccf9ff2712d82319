"""Page shapes: visibility, dedupe, backing, colours, chains, text lines, clips."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..operators import entities, kernels, shapes
from .registry import query, table

_SHAPES = """SELECT l_orderkey AS page, l_linenumber * 1000 + l_partkey % 1000 AS shape_no, l_partkey % 10 = 9 AS is_clip, l_partkey % 3 > 0 AS filled, l_suppkey % 2 = 0 AS stroked,
  CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE (l_partkey % 34) / 33.0{D} END AS fill_r, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE (l_partkey % 34) / 33.0{D} END AS fill_g, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE (l_partkey % 34) / 33.0{D} END AS fill_b,
  (l_partkey % 35) / 33.0{D} AS stroke_r, (l_partkey % 34) / 33.0{D} AS stroke_g, (l_partkey % 34) / 33.0{D} AS stroke_b,
  CAST(l_suppkey % 40 * 5 AS DOUBLE) AS min_x, CAST(l_partkey % 20 * 5 AS DOUBLE) AS min_y, CAST(l_suppkey % 40 * 5 + l_quantity AS DOUBLE) AS max_x, CAST(l_partkey % 20 * 5 + l_quantity / 2 AS DOUBLE) AS max_y,
  10.0{D} AS clip_min_x, 10.0{D} AS clip_min_y, 150.0{D} AS clip_max_x, 90.0{D} AS clip_max_y FROM lineitem"""


def _shapes(spark, d):
    table(spark, d, "lineitem").createOrReplaceTempView("corvane_lineitem")
    return spark.sql(_SHAPES.replace(".0{D}", "D").replace("FROM lineitem", "FROM corvane_lineitem"))


_SAME = "CASE WHEN fill_r IS NULL AND stroke_r IS NULL THEN true ELSE coalesce(abs(fill_r - stroke_r) <= 0.02 AND abs(fill_g - stroke_g) <= 0.02 AND abs(fill_b - stroke_b) <= 0.02, false) END"


@query("op20_visible", f"""
WITH s AS ({_SHAPES.replace('{D}', '::DOUBLE')}), v AS (SELECT *, filled AND (NOT stroked OR {_SAME}) AS solid FROM s WHERE NOT is_clip AND (filled OR stroked)
  AND NOT ((NOT filled OR coalesce(fill_r >= 0.97 AND fill_g >= 0.97 AND fill_b >= 0.97, false)) AND (NOT stroked OR coalesce(stroke_r >= 0.97 AND stroke_g >= 0.97 AND stroke_b >= 0.97, false))))
SELECT page, shape_no, solid FROM v WHERE NOT (solid AND (max_x - min_x) * (max_y - min_y) >= 0.95 * 1000) AND min_x <= clip_max_x AND max_x >= clip_min_x AND min_y <= clip_max_y AND max_y >= clip_min_y
""")
def op20_visible(spark, d):
    return shapes.visible_paths(_shapes(spark, d), 1000.0).select("page", "shape_no", "solid")


@query("op21_dedupe", """
WITH e AS (SELECT event_id, user_id, event_type, round_even(value, 0) AS v FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, v ORDER BY event_id) AS n FROM e)
SELECT event_id FROM r WHERE n = 1
""")
def op21_dedupe(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.rint("value").alias("v"))
    return shapes.first_occurrences(e, "user_id", "event_type", "v", order="event_id").select("event_id")


@query("op22b_rings", """
WITH g AS (SELECT l_orderkey, l_linenumber % 2 AS sub, count(*) AS n, bool_or(l_partkey % 13 = 0) AS curved FROM lineitem GROUP BY ALL)
SELECT l_orderkey, CAST(count(*) AS BIGINT) AS rings, CAST(sum(n) AS BIGINT) AS points FROM g WHERE n >= 3 AND l_orderkey NOT IN (SELECT l_orderkey FROM g WHERE curved) GROUP BY l_orderkey
""")
def op22b_rings(spark, d):
    """Straight subpaths of three points or more; a path with any curve has no rings."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey", (F.col("l_linenumber") % 2).alias("sub")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("l_partkey") % 13 == 0).alias("curved"))
    out = g.groupBy("l_orderkey").agg(F.count_if(F.col("n") >= 3).alias("rings"), F.sum(F.when(F.col("n") >= 3, F.col("n"))).alias("points"), F.bool_or("curved").alias("curved"))
    return out.where("not curved and rings > 0").select("l_orderkey", "rings", "points")


_LINES = "SELECT o_orderkey AS page, 0 AS line_no, CAST(o_orderkey % 40 * 5 AS DOUBLE) AS min_x, CAST(o_orderkey % 20 * 5 AS DOUBLE) AS min_y, CAST(o_orderkey % 40 * 5 + 120 AS DOUBLE) AS max_x, CAST(o_orderkey % 20 * 5 + 40 AS DOUBLE) AS max_y, CAST(o_custkey % 12 AS DOUBLE) AS size FROM orders UNION ALL SELECT o_orderkey, 1, 0, 0, 90, 90, 4 FROM orders WHERE o_custkey % 3 = 0"
_HITS = f"""s AS ({_SHAPES.replace('{D}', '::DOUBLE')}), l AS ({_LINES}),
h AS (SELECT s.page, s.shape_no, min(l.line_no) AS line_no FROM s JOIN l ON s.page = l.page WHERE s.filled AND s.min_x >= l.min_x - l.size / 2 AND s.min_y >= l.min_y - l.size / 2 AND s.max_x <= l.max_x + l.size / 2 AND s.max_y <= l.max_y + l.size / 2 GROUP BY ALL)"""


def _backed(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("corvane_orders")
    return shapes.backing(_shapes(spark, d).withColumn("solid", F.col("filled")), spark.sql(_LINES.replace("FROM orders", "FROM corvane_orders")), "page")


@query("op25_backing_shapes", f"WITH {_HITS} SELECT page, shape_no FROM s WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.page = s.page AND h.shape_no = s.shape_no)")
def op25_backing_shapes(spark, d):
    return _backed(spark, d)[0].select("page", "shape_no")


@query("op25_backed_lines", f"WITH {_HITS} SELECT page, CAST(line_no AS INTEGER) AS line_no FROM l WHERE EXISTS (SELECT 1 FROM h WHERE h.page = l.page AND h.line_no = l.line_no)")
def op25_backed_lines(spark, d):
    return _backed(spark, d)[1].select("page", F.col("line_no").cast("int").alias("line_no"))


_PALETTE = dims.values_sql([(k, *c) for k, c in enumerate(dims.PALETTE)], "c(k, i, r, g, b)")


@query("op35_nearest_colour", f"""
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE p_partkey % 256 END AS r, p_partkey * 7 % 256 AS g, p_partkey * 13 % 256 AS b FROM part),
d AS (SELECT p.p_partkey, arg_min(c.i, ((p.r - c.r) * (p.r - c.r) + (p.g - c.g) * (p.g - c.g) + (p.b - c.b) * (p.b - c.b), c.k)) AS i FROM p, {_PALETTE} WHERE p.r IS NOT NULL GROUP BY p.p_partkey)
SELECT p.p_partkey, CAST(coalesce(d.i, 7) AS INTEGER) AS colour FROM p LEFT JOIN d ON p.p_partkey = d.p_partkey
""")
def op35_nearest_colour(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", shapes.nearest_colour(F.when(k % 50 != 0, k % 256), k * 7 % 256, k * 13 % 256).alias("colour"))


@query("op40_page_kind", """
WITH p AS (SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_orderkey % 40 END) AS segments, sum(CASE WHEN o_orderstatus = 'O' THEN 0 ELSE o_orderkey % 3 END) AS letters, max(CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice END) AS image FROM orders GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN segments < 50 AND coalesce(image, 0) / 200000.0::DOUBLE >= 0.7 THEN 'Scan' WHEN segments = 0 AND letters = 0 AND coalesce(image, 0) = 0 THEN 'Empty' ELSE 'Vector' END AS kind FROM p
""")
def op40_page_kind(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.sum(F.when(F.col("o_orderstatus") == "F", 0).otherwise(F.col("o_orderkey") % 40)).alias("segments"), F.sum(F.when(F.col("o_orderstatus") == "O", 0).otherwise(F.col("o_orderkey") % 3)).alias("letters"),
        F.max(F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice"))).alias("image"),
    )
    return o.select("o_custkey", shapes.page_kind(F.col("segments"), F.col("letters"), F.col("image"), F.lit(200000.0)).alias("kind"))


_RUNS = "l_suppkey % 8 AS colour, CAST(l_quantity % 9 AS DOUBLE) AS x0, CAST(l_partkey % 7 AS DOUBLE) AS y0, CAST(l_suppkey % 9 AS DOUBLE) AS x1, CAST(l_orderkey % 7 AS DOUBLE) AS y1"


@query("op23_end_degrees", f"""
WITH r AS (SELECT {_RUNS} FROM lineitem), e AS (SELECT colour, x0 AS x, y0 AS y FROM r UNION ALL SELECT colour, x1, y1 FROM r)
SELECT colour, CAST(round_even(x / 2.0::DOUBLE, 0) AS BIGINT) AS kx, CAST(round_even(y / 2.0::DOUBLE, 0) AS BIGINT) AS ky, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY ALL
""")
def op23_end_degrees(spark, d):
    return shapes.end_degrees(table(spark, d, "lineitem").selectExpr(*_RUNS.split(", ")), "colour", 2.0)


@query("op23_join_runs")
def op23_join_runs(spark, d):
    """Runs of an order's items on a grid, joined into chains: (points, closed) per chain."""
    runs = table(spark, d, "lineitem").selectExpr("l_orderkey", "struct(l_linenumber, l_partkey) AS ord", "l_suppkey % 2 AS colour", "CAST(l_linenumber % 4 AS DOUBLE) AS x0", "CAST(l_quantity % 2 AS DOUBLE) AS y0", "CAST((l_linenumber + 1) % 4 AS DOUBLE) AS x1", "CAST(l_partkey % 2 AS DOUBLE) AS y1")
    runs = runs.withColumn("ord", F.col("ord.l_linenumber") * 1_000_000 + F.col("ord.l_partkey"))

    def kernel(f):
        found = kernels.join_runs([([(a, b), (c, e)], g) for a, b, c, e, g in zip(f["x0"], f["y0"], f["x1"], f["y1"], f["colour"], strict=True)], 1e-6)
        return [(k, g, len(p), closed) for k, (p, g, closed) in enumerate(found)]

    return kernels.per_group(runs, "l_orderkey", "ord", "l_orderkey long, chain int, colour long, points int, closed boolean", kernel)


@query("op43b_finish", """
SELECT l_orderkey, CASE WHEN count(*) = 2 THEN 'LINE' ELSE 'POLYLINE' END AS kind, CAST(count(*) AS BIGINT) AS points, CAST(dense_rank() OVER (ORDER BY l_orderkey % 5) AS INTEGER) AS colour_group FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 2
""")
def op43b_finish(spark, d):
    """Chains of two points are lines, longer ones polylines; groups number the few colours in order."""
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("points")).where("points >= 2")
    colours = n.select((F.col("l_orderkey") % 5).alias("c")).distinct().groupBy().agg(F.array_sort(F.collect_set("c")).alias("all"))
    out = n.crossJoin(F.broadcast(colours))  # one row: the set of five residues
    return out.select("l_orderkey", F.when(F.col("points") == 2, "LINE").otherwise("POLYLINE").alias("kind"), "points", F.array_position("all", F.col("l_orderkey") % 5).cast("int").alias("colour_group"))


@query("op33_gap_lines", """
WITH e AS (SELECT user_id, event_id, datediff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) AS s FROM events),
l AS (SELECT *, lag(s + 60) OVER (PARTITION BY user_id ORDER BY s, event_id) AS before FROM e)
SELECT user_id, event_id, CAST(sum(CASE WHEN s - before > 36000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id) AS BIGINT) AS line_no FROM l
""")
def op33_gap_lines(spark, d):
    """Words on one baseline: a gap of more than ten hours begins a line."""
    s = F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.date_trunc("second", "ts").cast("timestamp_ntz"))
    words = table(spark, d, "events").select("user_id", "event_id", F.col("event_id").alias("ord"), s.alias("s")).withColumn("e", F.col("s") + 60)
    return shapes.gap_lines(words, "user_id", "s", "e", 36000).select("user_id", "event_id", "line_no")


@query("op33_text_lines")
def op33_text_lines(spark, d):
    """Turns of a conversation as words on a page: (line, words, first word) per line."""
    c = table(spark, d, "conversations").selectExpr("conv_id", "turn", "text", "CAST(turn % 3 * 40 AS DOUBLE) AS x0", "CAST(length(text) % 4 * 12 AS DOUBLE) AS y0")

    def kernel(f):
        words = [(t, x, y, x + 35, y, 10.0) for t, x, y in zip(f["text"], f["x0"], f["y0"], strict=True)]
        return [(k, len(w), w[0]) for k, (w, _) in enumerate(kernels.text_lines(words))]

    return kernels.per_group(c, "conv_id", "turn", "conv_id long, line_no int, words int, first_word int", kernel)


_TAGS = "regexp_extract_all(html, '</?[a-z0-9]+')"


@query("op28_depth", f"""
WITH t AS (SELECT page_id, {_TAGS} AS tags FROM pages), x AS (SELECT page_id, tags, unnest(range(0, len(tags))) AS k FROM t),
d AS (SELECT page_id, k, sum(CASE WHEN starts_with(tags[k + 1], '</') THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY k) AS depth FROM x)
SELECT page_id, CAST(count(*) AS BIGINT) AS tags, CAST(max(depth) AS BIGINT) AS deepest, CAST(arg_max(depth, k) AS BIGINT) AS last FROM d GROUP BY page_id
""")
def op28_depth(spark, d):
    from pyspark.sql import Window

    tags = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(</?[a-z0-9]+)"), 1)).alias("k", "tag"))
    depth = F.sum(F.when(F.col("tag").startswith("</"), -1).otherwise(1)).over(Window.partitionBy("page_id").orderBy("k"))
    return tags.withColumn("depth", depth).groupBy("page_id").agg(F.count(F.lit(1)).alias("tags"), F.max("depth").alias("deepest"), F.max_by("depth", "k").alias("last"))


@query("op28_clip_replay")
def op28_clip_replay(spark, d):
    """Tags as page operators: an opening one saves, draws and clips, a closing one restores; (path, box) per path."""
    tags = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(</?[a-z0-9]+)"), 1)).alias("k", "tag"))

    def kernel(f):
        ops, paths = [], []
        for tag in f["tag"]:
            if tag.startswith("</"):
                ops.append("Q")
            else:
                n = len(paths)
                ops += ["q", "re", "W", "n"]
                paths.append((True, (float(n % 5), float(n % 3), 200.0 - n % 11, 100.0 - n % 7)))
        clips = kernels.replay_clips(ops, paths, (0.0, 0.0, 200.0, 100.0))
        return [] if clips is None else [(k, *map(float, c)) for k, c in enumerate(clips)]

    return kernels.per_group(tags, "page_id", "k", "page_id long, path int, min_x double, min_y double, max_x double, max_y double", kernel)


@query("op42_merge_rings")
def op42_merge_rings(spark, d):
    """Unit squares of an order's items, merged along shared edges: (ring, corners) per ring."""
    cells = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber * 1000000 + l_partkey AS ord", "CAST(l_linenumber AS DOUBLE) AS x", "CAST(l_suppkey % 2 AS DOUBLE) AS y")

    def kernel(f):
        squares = [[(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)] for x, y in dict.fromkeys(zip(f["x"], f["y"], strict=True))]
        return [(k, len(r)) for k, r in enumerate(kernels.merge_rings(squares, 1e-6))]

    return kernels.per_group(cells, "l_orderkey", "ord", "l_orderkey long, ring int, corners int", kernel)


@query("op79_cad_text", """
WITH c AS (SELECT conv_id, turn, trim(text) AS text, (turn % 4) * 6.0::DOUBLE AS size, turn % 5 AS mode FROM conversations)
SELECT conv_id, turn, CAST(floor(size * 0.7::DOUBLE * (25.4::DOUBLE / 72.0::DOUBLE) * 1000000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS height, CASE WHEN mode IN (1, 2) THEN 'stroke' ELSE 'fill' END AS paint FROM c WHERE text <> '' AND size > 0
""")
def op79_cad_text(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.trim("text").alias("text"), (F.col("turn") % 4 * 6.0).alias("size"), (F.col("turn") % 5).alias("mode"))
    height = F.floor(F.col("size") * 0.7 * (25.4 / 72.0) * 1e6 + 0.5)
    return c.where("text <> '' and size > 0").select("conv_id", "turn", height.alias("height"), F.when(F.col("mode").isin(1, 2), "stroke").otherwise("fill").alias("paint"))


@query("op43_entities")
def op43_entities(spark, d):
    """Every order as a page of one subpath per supplier parity: (entity, kind, points, closed) in drawing order."""
    items = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber * 1000000 + l_partkey AS ord", "l_suppkey % 2 AS sub", "l_partkey % 3 AS op", "l_quantity * 3 AS x", "CAST(l_partkey % 90 AS DOUBLE) AS y")

    def kernel(f):
        found = []
        for sub in (0, 1):
            part = f[f["sub"] == sub]
            commands, now = [], None
            for op, x, y in zip(part["op"], part["x"], part["y"], strict=True):
                p = complex(x, y)
                commands.append(("move", p) if now is None else ("line", p) if op < 2 else ("curve", now + 5j, p + 5j, p))
                now = p
            if len(part) % 2:
                commands.append(("close",))
            found += [(e, sub) for e in entities.entities(commands, (10.0, 10.0, 140.0, 80.0), 0.01)]
        return [(k, *e) for k, e in enumerate(entities.finished(found, 0.01))]

    return kernels.per_group(items, "l_orderkey", "ord", "l_orderkey long, entity int, kind string, colour int, points int, closed boolean", kernel)
