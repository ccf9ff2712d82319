"""Curves, arcs, clipping and distances on coordinates made of line items. Doubles are floor-rounded to 6 digits."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import shapes
from .registry import query, table

#: Coordinates of four points per line item, the same text for both engines.
_POINTS = {
    "x0": "l_quantity", "y0": "l_discount * 100", "x1": "l_quantity + l_tax * 200 + 1", "y1": "l_discount * 100 + (l_orderkey % 17) - 8",
    "x2": "l_quantity + l_tax * 300 + 3", "y2": "l_discount * 50 + (l_partkey % 23) - 5", "x3": "l_quantity + (l_suppkey % 40) - 10", "y3": "l_tax * 100 + (l_partkey % 31)",
}
_KEY = ("l_orderkey", "l_linenumber", "l_partkey")
_FROM = f"p AS (SELECT {', '.join(_KEY)}, l_suppkey, {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for n, e in _POINTS.items())} FROM lineitem)"


def _points(spark, d):
    return table(spark, d, "lineitem").selectExpr(*_KEY, "l_suppkey", *[f"CAST({e} AS DOUBLE) AS {n}" for n, e in _POINTS.items()])


def _p():
    return [(F.col(f"x{k}"), F.col(f"y{k}")) for k in range(4)]


def micro(c):
    """A double as a whole number of millionths."""
    return F.floor(c * 1000000.0 + 0.5).cast("long")


def micro_sql(e: str) -> str:
    return f"CAST(floor(({e}) * 1000000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)"


_K = ", ".join(_KEY)
_D = "::DOUBLE"


@query("op24_clip", f"""
WITH {_FROM}, d AS (SELECT *, x3 - x0 AS dx, y3 - y0 AS dy FROM p),
e AS (SELECT *, greatest(0.0{_D}, CASE WHEN -dx < 0 THEN (x0 - 10.0{_D}) / -dx END, CASE WHEN dx < 0 THEN (30.0{_D} - x0) / dx END, CASE WHEN -dy < 0 THEN (y0 - 2.0{_D}) / -dy END, CASE WHEN dy < 0 THEN (8.0{_D} - y0) / dy END) AS t0,
  least(1.0{_D}, CASE WHEN -dx > 0 THEN (x0 - 10.0{_D}) / -dx END, CASE WHEN dx > 0 THEN (30.0{_D} - x0) / dx END, CASE WHEN -dy > 0 THEN (y0 - 2.0{_D}) / -dy END, CASE WHEN dy > 0 THEN (8.0{_D} - y0) / dy END) AS t1,
  (dx = 0 AND (x0 < 10 OR x0 > 30)) OR (dy = 0 AND (y0 < 2 OR y0 > 8)) AS outside FROM d)
SELECT {_K}, {micro_sql('x0 + t0 * dx')} AS ax, {micro_sql('y0 + t0 * dy')} AS ay, {micro_sql('x0 + t1 * dx')} AS bx, {micro_sql('y0 + t1 * dy')} AS by_ FROM e WHERE NOT outside AND t0 <= t1
""")
def op24_clip(spark, d):
    (x0, y0), *_, (x3, y3) = _p()
    rect = tuple(F.lit(v) for v in (10.0, 2.0, 30.0, 8.0))
    out = _points(spark, d).withColumn("s", g.clip_segment(x0, y0, x3, y3, rect)).where("s is not null")
    return out.select(*_KEY, micro(F.col("s.x0")).alias("ax"), micro(F.col("s.y0")).alias("ay"), micro(F.col("s.x1")).alias("bx"), micro(F.col("s.y1")).alias("by_"))


@query("op24b_rects", f"""
WITH {_FROM}, r AS (SELECT *, least(x0, x3) AS ax, least(y0, y3) AS ay, greatest(x0, x3) AS bx, greatest(y0, y3) AS by_ FROM p)
SELECT {_K}, greatest(ax, 10) <= least(bx, 30) AND greatest(ay, 2) <= least(by_, 8) AS meets, ax >= 10 AND bx <= 30 AND ay >= 2 AND by_ <= 8 AS inside, {micro_sql('greatest(least(bx, 30) - greatest(ax, 10), 0)')} AS width FROM r
""")
def op24b_rects(spark, d):
    r = _points(spark, d).withColumns({"ax": F.least("x0", "x3"), "ay": F.least("y0", "y3"), "bx": F.greatest("x0", "x3"), "by_": F.greatest("y0", "y3")})
    c, lit = F.col, lambda v: F.lit(float(v))
    lx, hx, ly, hy = F.greatest(c("ax"), lit(10)), F.least(c("bx"), lit(30)), F.greatest(c("ay"), lit(2)), F.least(c("by_"), lit(8))
    inside = (c("ax") >= 10) & (c("bx") <= 30) & (c("ay") >= 2) & (c("by_") <= 8)
    return r.select(*_KEY, ((lx <= hx) & (ly <= hy)).alias("meets"), inside.alias("inside"), micro(F.greatest(hx - lx, lit(0))).alias("width"))


def _bez(k: str, t: float) -> str:
    u = 1.0 - t
    return f"({u * u * u!r}{_D} * {k}0 + {3.0 * u * u * t!r}{_D} * {k}1 + {3.0 * u * t * t!r}{_D} * {k}2 + {t * t * t!r}{_D} * {k}3)"


@query("op63_bezier", f"WITH {_FROM} SELECT {_K}, {micro_sql(_bez('x', 0.25))} AS qx, {micro_sql(_bez('y', 0.25))} AS qy, {micro_sql(_bez('x', 0.5))} AS hx, {micro_sql(_bez('y', 0.5))} AS hy FROM p")
def op63_bezier(spark, d):
    p = _p()
    at = lambda i, t: g.bezier(p[0][i], p[1][i], p[2][i], p[3][i], t)
    return _points(spark, d).select(*_KEY, micro(at(0, 0.25)).alias("qx"), micro(at(1, 0.25)).alias("qy"), micro(at(0, 0.5)).alias("hx"), micro(at(1, 0.5)).alias("hy"))


#: Curves that are arcs of a quarter circle or nearly so.
_QUARTER = 0.5522847498307936
_ARC = f"""a AS (SELECT {_K}, x0 AS cx, y0 AS cy, 1.0{_D} + l_partkey % 9 AS r, CASE WHEN l_orderkey % 3 = 0 THEN 0.5{_D} ELSE {_QUARTER!r}{_D} END AS k FROM p),
c AS (SELECT {_K}, cx + r AS x0, cy AS y0, cx + r AS x1, cy + k * r AS y1, cx + k * r AS x2, cy + r AS y2, cx AS x3, cy + r AS y3 FROM a)"""


def _dist(ax: str, ay: str, bx: str, by: str) -> str:
    return f"sqrt(({ax} - {bx}) * ({ax} - {bx}) + ({ay} - {by}) * ({ay} - {by}))"


@query("op64_arc_fit", f"""
WITH {_FROM}, {_ARC}, m AS (SELECT *, {_bez('x', 0.5)} AS mx, {_bez('y', 0.5)} AS my FROM c),
d AS (SELECT *, 2.0{_D} * (x0 * (my - y3) + mx * (y3 - y0) + x3 * (y0 - my)) AS den, x0 * x0 + y0 * y0 AS a2, mx * mx + my * my AS b2, x3 * x3 + y3 * y3 AS c2 FROM m),
o AS (SELECT *, (a2 * (my - y3) + b2 * (y3 - y0) + c2 * (y0 - my)) / den AS ox, (a2 * (x3 - mx) + b2 * (x0 - x3) + c2 * (mx - x0)) / den AS oy FROM d WHERE abs(den) >= 1e-9),
r AS (SELECT *, {_dist('ox', 'oy', 'x0', 'y0')} AS rad FROM o)
SELECT {_K}, {micro_sql('ox')} AS cx, {micro_sql('oy')} AS cy, {micro_sql('rad')} AS r FROM r WHERE {' AND '.join(f"abs({_dist('ox', 'oy', _bez('x', t), _bez('y', t))} - rad) <= 0.002{_D} * rad" for t in (0.125, 0.25, 0.375, 0.625, 0.75, 0.875))}
""")
def op64_arc_fit(spark, d):
    a = _points(spark, d).selectExpr(*_KEY, "x0 AS cx", "y0 AS cy", "1D + l_partkey % 9 AS r", f"CASE WHEN l_orderkey % 3 = 0 THEN 0.5D ELSE {_QUARTER!r}D END AS k")
    c = a.selectExpr(*_KEY, "cx + r AS x0", "cy AS y0", "cx + r AS x1", "cy + k * r AS y1", "cx + k * r AS x2", "cy + r AS y2", "cx AS x3", "cy + r AS y3")
    out = c.withColumn("arc", g.fit_arc(_p())).where("arc is not null")
    return out.select(*_KEY, micro(F.col("arc.cx")).alias("cx"), micro(F.col("arc.cy")).alias("cy"), micro(F.col("arc.r")).alias("r"))


_FLAT = " AND ".join(f"abs(dx * ({y} - y0) - dy * ({x} - x0)) / chord <= 0.001{_D} * chord AND (dx * ({x} - x0) + dy * ({y} - y0)) / (chord * chord) BETWEEN -0.001{_D} AND 1.001{_D}" for x, y in (("x1", "y1"), ("x2", "y2")))


@query("op65_flat", f"""
WITH {_FROM}, s AS (SELECT {_K}, x0, y0, x0 + (x3 - x0) / 4 AS x1, y0 + (y3 - y0) / 4 + CASE WHEN l_partkey % 2 = 0 THEN 0 ELSE 1 END AS y1, x0 + (x3 - x0) / 2 AS x2, y0 + (y3 - y0) / 2 AS y2, x3, y3 FROM p),
c AS (SELECT *, x3 - x0 AS dx, y3 - y0 AS dy, {_dist('x0', 'y0', 'x3', 'y3')} AS chord FROM s)
SELECT {_K}, CASE WHEN chord > 0 THEN {_FLAT} ELSE false END AS flat FROM c
""")
def op65_flat(spark, d):
    s = _points(spark, d).selectExpr(*_KEY, "x0", "y0", "x0 + (x3 - x0) / 4 AS x1", "y0 + (y3 - y0) / 4 + CASE WHEN l_partkey % 2 = 0 THEN 0 ELSE 1 END AS y1", "x0 + (x3 - x0) / 2 AS x2", "y0 + (y3 - y0) / 2 AS y2", "x3", "y3")
    return s.select(*_KEY, g.is_flat(_p()).alias("flat"))


_T = repr(2 * math.pi) + _D


@query("op66_angles", f"""
WITH {_FROM}, a AS (SELECT {_K}, x0 / 7.0{_D} AS a, y3 / 3.0{_D} AS b FROM p), s AS (SELECT *, fmod(b - a, {_T}) AS m FROM a)
SELECT {_K}, {micro_sql(f'CASE WHEN m <= 0 THEN m + {_T} ELSE m END')} AS sweep, {micro_sql(f'CASE WHEN m > {math.pi!r}{_D} THEN m - {_T} WHEN m <= -{math.pi!r}{_D} THEN m + {_T} ELSE m END')} AS turn FROM s
""")
def op66_angles(spark, d):
    a, b = F.col("x0") / 7.0, F.col("y3") / 3.0
    return _points(spark, d).select(*_KEY, micro(g.sweep(a, b)).alias("sweep"), micro(g.angle_between(a, b)).alias("turn"))


@query("op67_arc_bounds", f"""
WITH {_FROM}, a AS (SELECT {_K}, x0, y0, 1.0{_D} + l_partkey % 9 AS r, x1 / 7.0{_D} AS a, y3 / 3.0{_D} AS b FROM p), s AS (SELECT *, CASE WHEN fmod(b - a, {_T}) <= 0 THEN fmod(b - a, {_T}) + {_T} ELSE fmod(b - a, {_T}) END AS w FROM a),
e AS (SELECT s.*, x0 + r * cos(a + w * k / 16.0{_D}) AS x, y0 + r * sin(a + w * k / 16.0{_D}) AS y FROM s, (SELECT unnest(range(0, 17)) AS k))
SELECT {_K}, {micro_sql('min(x)')} AS min_x, {micro_sql('min(y)')} AS min_y, {micro_sql('max(x)')} AS max_x, {micro_sql('max(y)')} AS max_y FROM e GROUP BY ALL
""".replace("FROM e GROUP BY ALL", f"FROM e GROUP BY {_K}, x0, y0, r, a, b"))
def op67_arc_bounds(spark, d):
    p = _points(spark, d).withColumn("box", g.arc_bounds(F.col("x0"), F.col("y0"), 1.0 + F.col("l_partkey") % 9, F.col("x1") / 7.0, F.col("y3") / 3.0))
    return p.select(*_KEY, *[micro(F.col(f"box.{k}")).alias(k) for k in ("min_x", "min_y", "max_x", "max_y")])


@query("op68_segment_distance", f"""
WITH {_FROM}, v AS (SELECT *, CASE WHEN l_partkey % 5 = 0 THEN 0.0{_D} ELSE x3 - x0 END AS dx, CASE WHEN l_partkey % 5 = 0 THEN 0.0{_D} ELSE y3 - y0 END AS dy FROM p),
t AS (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0.0{_D} ELSE least(greatest(((x1 - x0) * dx + (y1 - y0) * dy) / (dx * dx + dy * dy), 0.0{_D}), 1.0{_D}) END AS t FROM v)
SELECT {_K}, {micro_sql('sqrt((x0 + t * dx - x1) * (x0 + t * dx - x1) + (y0 + t * dy - y1) * (y0 + t * dy - y1))')} AS off FROM t
""")
def op68_segment_distance(spark, d):
    lone = F.col("l_partkey") % 5 == 0
    p = _points(spark, d).withColumns({"x3": F.when(lone, F.col("x0")).otherwise(F.col("x3")), "y3": F.when(lone, F.col("y0")).otherwise(F.col("y3"))})
    return p.select(*_KEY, micro(g.segment_distance(*[F.col(c) for c in ("x1", "y1", "x0", "y0", "x3", "y3")])).alias("off"))


@query("op50_units", f"SELECT p_partkey, {micro_sql(f'(p_size + 1)::DOUBLE / 72.0{_D} * list_value(25.4{_D}, 2.54{_D}, 0.0254{_D}, 1.0{_D})[p_partkey % 4 + 1] * 1000.0{_D}')} AS nano FROM part")
def op50_units(spark, d):
    unit = F.expr("array('mm', 'cm', 'm', 'in')[cast(p_partkey % 4 as int)]")
    return table(spark, d, "part").select("p_partkey", micro(g.units_per_point(unit, (F.col("p_size") + 1).cast("double")) * 1000.0).alias("nano"))


@query("op51_dpi", f"""
WITH d AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN -5.0{_D} WHEN 2 THEN 1.0{_D} WHEN 3 THEN 1e5{_D} ELSE c_acctbal END AS dpi FROM customer),
u AS (SELECT c_custkey, CASE WHEN isnan(dpi) OR dpi <= 0 THEN 96.0{_D} ELSE least(greatest(dpi, 10.0{_D}), 2400.0{_D}) END AS dpi FROM d)
SELECT c_custkey, {micro_sql('dpi')} AS dpi, {micro_sql(f'25.4{_D} / dpi * 2.0{_D}')} AS mm FROM u
""")
def op51_dpi(spark, d):
    dpi = F.expr("CASE c_custkey % 5 WHEN 0 THEN double('NaN') WHEN 1 THEN -5D WHEN 2 THEN 1D WHEN 3 THEN 1e5D ELSE c_acctbal END")
    out = table(spark, d, "customer").select("c_custkey", g.usable_dpi(dpi).alias("dpi"))
    return out.select("c_custkey", micro(F.col("dpi")).alias("dpi"), micro(F.lit(25.4) / F.col("dpi") * 2.0).alias("mm"))


@query("op94_page_map", f"WITH {_FROM} SELECT {_K}, {micro_sql(f'x0 * (25.4{_D} / 72.0{_D})')} AS x, {micro_sql(f'(100.0{_D} - y0) * (25.4{_D} / 72.0{_D})')} AS y FROM p")
def op94_page_map(spark, d):
    by = 25.4 / 72.0
    return _points(spark, d).select(*_KEY, micro(F.col("x0") * by).alias("x"), micro((100.0 - F.col("y0")) * by).alias("y"))


@query("op22_sliver", f"""
WITH {_FROM}, b AS (SELECT *, (l_partkey % 30) / 10.0{_D} AS h, 1.0{_D} + l_suppkey % 20 AS w FROM p)
SELECT {_K}, {micro_sql(f'CASE WHEN w <= h THEN x0 + w / 2.0{_D} ELSE x0 END')} AS ax, {micro_sql(f'CASE WHEN w <= h THEN y0 ELSE y0 + h / 2.0{_D} END')} AS ay, {micro_sql(f'CASE WHEN w <= h THEN x0 + w / 2.0{_D} ELSE x0 + w END')} AS bx, {micro_sql(f'CASE WHEN w <= h THEN y0 + h ELSE y0 + h / 2.0{_D} END')} AS by_
FROM b WHERE least(w, h) <= 1.5 AND greatest(w, h) >= 4 * greatest(least(w, h), 1e-9) AND l_orderkey % 4 <> 1
""")
def op22_sliver(spark, d):
    """Bars as four or five corners; every fourth is askew."""
    x, y = F.col("x0"), F.col("y0")
    h, w = F.col("l_partkey") % 30 / 10.0, 1.0 + F.col("l_suppkey") % 20
    skew = F.when(F.col("l_orderkey") % 4 == 1, 3.0 + 10 * w).otherwise(0.0)
    corners = [g.xy(x, y), g.xy(x, y + h), g.xy(x + w + skew, y + h), g.xy(x + w, y)]
    ring = F.when(F.col("l_orderkey") % 2 == 0, F.array(*corners)).otherwise(F.array(*corners, corners[0]))
    out = _points(spark, d).withColumn("s", g.sliver(ring)).where("s is not null").select(*_KEY, "s.*")
    # A centre line has no direction: the lower left end comes first.
    first = F.struct("x0", "y0") <= F.struct("x1", "y1")
    pick = lambda a, b: micro(F.when(first, F.col(a)).otherwise(F.col(b)))
    return out.select(*_KEY, pick("x0", "x1").alias("ax"), pick("y0", "y1").alias("ay"), pick("x1", "x0").alias("bx"), pick("y1", "y0").alias("by_"))


@query("op44_spline", """
WITH n AS (SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, 3 * n + 1 AS points, array_to_string(list_concat([0, 0, 0, 0], flatten(list_transform(range(1, n), lambda k: [k, k, k])), [n, n, n, n]), ' ') AS knots FROM n
""")
def op44_spline(spark, d):
    c = F.struct(*[g.xy(F.lit(k), F.lit(0)).alias(f"p{k}") for k in range(4)])
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("int").alias("n"), F.collect_list(c).alias("chain"))
    knots = F.array_join(F.transform(g.spline_knots(F.col("n")), lambda k: k.cast("string")), " ")
    return n.select("l_orderkey", F.size(g.spline_points(F.col("chain"))).alias("points"), knots.alias("knots"))


_ARCS = f"arcs AS (SELECT l_orderkey, l_linenumber, l_partkey, 10.0{_D} + CASE WHEN l_orderkey % 5 = 0 THEN l_linenumber ELSE 0 END AS cx, 5.0{_D} AS cy, 3.0{_D} AS r, (l_linenumber - 1) * 0.9{_D} AS a0, l_linenumber * 0.9{_D} + CASE WHEN l_partkey % 6 = 0 THEN 0.1{_D} ELSE 0.0{_D} END AS a1 FROM lineitem)"


def _arcs(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "10D + CASE WHEN l_orderkey % 5 = 0 THEN l_linenumber ELSE 0 END AS cx", "5D AS cy", "3D AS r", "(l_linenumber - 1) * 0.9D AS a0", "l_linenumber * 0.9D + CASE WHEN l_partkey % 6 = 0 THEN 0.1D ELSE 0D END AS a1")


@query("op26_circle", f"""
WITH {_ARCS}, s AS (SELECT *, CASE WHEN fmod(a1 - a0, {_T}) <= 0 THEN fmod(a1 - a0, {_T}) + {_T} ELSE fmod(a1 - a0, {_T}) END AS w FROM arcs),
m AS (SELECT l_orderkey, sum(cx * w) / sum(w) AS mx, sum(w) AS total FROM s GROUP BY l_orderkey)
SELECT l_orderkey, CAST(floor(any_value(mx) * 1000.0{_D} + 0.5{_D}) AS BIGINT) AS cx, bool_and(abs(cx - mx) <= 0.03{_D} + 1e-12) AND abs(any_value(total) - {_T}) <= 0.06{_D} * {math.pi!r}{_D} AS is_circle FROM s JOIN m USING (l_orderkey) GROUP BY l_orderkey
""")
def op26_circle(spark, d):
    out = shapes.merged_circle(_arcs(spark, d), "l_orderkey")
    return out.select("l_orderkey", F.floor(F.col("cx") * 1000.0 + 0.5).alias("cx"), "is_circle")


@query("op27_arc_join")
def op27_arc_join(spark, d):
    """Arcs of an order folded from the left; a fold has no plain SQL form."""
    arc = F.struct("cx", "cy", "r", "a0", "a1")
    lists = _arcs(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", arc.alias("arc")))).alias("all"))
    return lists.select("l_orderkey", F.size("all").alias("before"), F.size(g.join_arcs(F.col("all.arc"))).alias("after"))


@query("op39_extents", f"WITH {_FROM} SELECT l_orderkey, {micro_sql('min(least(x0, x3))')} AS min_x, {micro_sql('min(least(y0, y3))')} AS min_y, {micro_sql('max(greatest(x0, x3))')} AS max_x, {micro_sql('max(greatest(y0, y3))')} AS max_y FROM p GROUP BY l_orderkey")
def op39_extents(spark, d):
    boxes = _points(spark, d).select("l_orderkey", F.least("x0", "x3").alias("min_x"), F.least("y0", "y3").alias("min_y"), F.greatest("x0", "x3").alias("max_x"), F.greatest("y0", "y3").alias("max_y"))
    out = shapes.extents(boxes, "l_orderkey")
    return out.select("l_orderkey", *[micro(F.col(c)).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])


@query("op43_segment_kind", f"""
WITH {_FROM}, s AS (SELECT {_K}, CASE WHEN l_partkey % 3 = 0 THEN 'line' WHEN l_partkey % 3 = 1 THEN 'arc' ELSE 'curve' END AS kind FROM p) SELECT l_orderkey, kind, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY ALL
""")
def op43_segment_kind(spark, d):
    """Cubics that are lines, quarter circles or neither, told apart by flatness and arc fit."""
    p, m, r = _points(spark, d), F.col("l_partkey") % 3, 2.0
    x, y = F.col("x0"), F.col("y0")
    pick = lambda line, arc, curve: F.when(m == 0, line).when(m == 1, arc).otherwise(curve)
    k = _QUARTER * r
    pts = [(x, y), (pick(x + 1.0, x, x + 5.0), pick(y + 1.0, y + k, y - 9.0)), (pick(x + 2.0, x + r - k, x - 7.0), pick(y + 2.0, y + r, y + 4.0)), (pick(x + 3.0, x + r, x + 1.0), pick(y + 3.0, y + r, y + 2.0))]
    p = p.select("l_orderkey", *[c.alias(f"{a}{i}") for i, pt in enumerate(pts) for a, c in zip("xy", pt, strict=True)])
    kind = F.when(g.is_flat(_p()), "line").when(g.fit_arc(_p()).isNotNull(), "arc").otherwise("curve")
    return p.select("l_orderkey", kind.alias("kind")).groupBy("l_orderkey", "kind").agg(F.count(F.lit(1)).alias("n"))
