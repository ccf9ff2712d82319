"""Plane geometry on structs (x, y): curves, arcs, clipping, distances. Guards keep ANSI division safe."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ARC_TOLERANCE, FLAT_TOLERANCE, CIRCLE_TOLERANCE, JOIN_ANGLE = 0.002, 0.001, 0.01, 0.02
TURN = 2 * math.pi


def xy(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: a lambda over one element keeps nested formulas small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def bezier(p0: Column, p1: Column, p2: Column, p3: Column, t: Column | float) -> Column:
    """One coordinate of a cubic curve."""
    t = F.lit(t) if isinstance(t, float) else t
    u = 1.0 - t
    return u * u * u * p0 + 3.0 * u * u * t * p1 + 3.0 * u * t * t * p2 + t * t * t * p3


def _clip_t(a: Column, d: Column, low: Column, high: Column) -> list[tuple[Column, Column]]:
    return [(-d, a - low), (d, high - a)]


def clip_segment(ax: Column, ay: Column, bx: Column, by: Column, rect: tuple[Column, Column, Column, Column]) -> Column:
    """struct(x0, y0, x1, y1) of the part inside (min x, min y, max x, max y), or null. Liang and Barsky's half-planes."""
    dx, dy = bx - ax, by - ay
    edges = _clip_t(ax, dx, rect[0], rect[2]) + _clip_t(ay, dy, rect[1], rect[3])
    enter = F.greatest(F.lit(0.0), *[F.when(p < 0, F.try_divide(q, p)) for p, q in edges])
    leave = F.least(F.lit(1.0), *[F.when(p > 0, F.try_divide(q, p)) for p, q in edges])
    outside = F.lit(False)
    for p, q in edges:
        outside = outside | ((p == 0) & (q < 0))
    found = F.struct((ax + enter * dx).alias("x0"), (ay + enter * dy).alias("y0"), (ax + leave * dx).alias("x1"), (ay + leave * dy).alias("y1"))
    return F.when(~outside & (enter <= leave), found)


def is_flat(p: list[tuple[Column, Column]]) -> Column:
    """Whether a cubic's control points lie on its chord, between the ends."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = p
    dx, dy = x3 - x0, y3 - y0
    chord = distance(x0, y0, x3, y3)
    ok = F.lit(True)
    for x, y in ((x1, y1), (x2, y2)):
        offset = F.try_divide(F.abs(dx * (y - y0) - dy * (x - x0)), chord)
        along = F.try_divide(dx * (x - x0) + dy * (y - y0), chord * chord)
        ok = ok & (offset <= FLAT_TOLERANCE * chord) & (along >= -FLAT_TOLERANCE) & (along <= 1.0 + FLAT_TOLERANCE)
    return F.coalesce((chord > 0) & ok, F.lit(False))


def circumcenter(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column]) -> tuple[Column, Column]:
    """Both coordinates; null when the three points are nearly on a line."""
    d = 2.0 * (a[0] * (b[1] - c[1]) + b[0] * (c[1] - a[1]) + c[0] * (a[1] - b[1]))
    scale = F.greatest(distance(*a, *c), distance(*a, *b))
    ok = F.abs(d) >= 1e-9 * scale * scale
    a2, b2, c2 = (p[0] * p[0] + p[1] * p[1] for p in (a, b, c))
    x = F.try_divide(a2 * (b[1] - c[1]) + b2 * (c[1] - a[1]) + c2 * (a[1] - b[1]), d)
    y = F.try_divide(a2 * (c[0] - b[0]) + b2 * (a[0] - c[0]) + c2 * (b[0] - a[0]), d)
    return F.when(ok, x), F.when(ok, y)


def fit_arc(p: list[tuple[Column, Column]]) -> Column:
    """struct(cx, cy, r, a0, a1), counter-clockwise, of the arc a cubic draws, or null."""
    names = [f"{axis}{k}" for k in range(4) for axis in "xy"]
    cross = lambda ax, ay, bx, by: ax * by - ay * bx

    def centred(q: Column) -> Column:
        at = lambda t: [bezier(*[q[f"{axis}{k}"] for k in range(4)], t) for axis in "xy"]
        a, b = (q["x0"], q["y0"]), (q["x3"], q["y3"])

        def fitted(c: Column) -> Column:
            r = c["r"]
            ts = F.array(*[F.lit(t) for t in (0.125, 0.25, 0.375, 0.625, 0.75, 0.875)])
            on = F.forall(ts, lambda t: F.abs(distance(c["cx"], c["cy"], *at(t)) - r) <= ARC_TOLERANCE * r)
            dx, dy = c["mx"] - c["cx"], c["my"] - c["cy"]
            turn = cross(a[0] - c["cx"], a[1] - c["cy"], dx, dy) + cross(dx, dy, b[0] - c["cx"], b[1] - c["cy"])
            first, last = F.atan2(a[1] - c["cy"], a[0] - c["cx"]), F.atan2(b[1] - c["cy"], b[0] - c["cx"])
            arc = F.struct(c["cx"], c["cy"], r.alias("r"), F.when(turn > 0, first).otherwise(last).alias("a0"), F.when(turn > 0, last).otherwise(first).alias("a1"))
            return F.when((r > 0) & on, arc)

        def through(m: Column) -> Column:
            cx, cy = circumcenter(a, (m["mx"], m["my"]), b)
            one = F.struct(cx.alias("cx"), cy.alias("cy"), m["mx"], m["my"])
            return let(one, lambda o: let(F.struct(o["cx"], o["cy"], o["mx"], o["my"], distance(o["cx"], o["cy"], *a).alias("r")), fitted))

        mid = at(0.5)
        return let(F.struct(mid[0].alias("mx"), mid[1].alias("my")), through)

    return let(F.struct(*[c.alias(n) for n, c in zip(names, [c for pt in p for c in pt], strict=True)]), centred)


def sweep(a0: Column, a1: Column) -> Column:
    """The counter-clockwise sweep, in (0, 2 pi]."""
    s = (a1 - a0) % TURN
    return F.when(s <= 0, s + TURN).otherwise(s)


def angle_between(a: Column, b: Column) -> Column:
    """b - a, in (-pi, pi]."""
    d = (b - a) % TURN
    return F.when(d > math.pi, d - TURN).when(d <= -math.pi, d + TURN).otherwise(d)


def arc_bounds(cx: Column, cy: Column, r: Column, a0: Column, a1: Column) -> Column:
    """struct(min_x, min_y, max_x, max_y) of 17 points spread along the arc."""
    s = sweep(a0, a1)
    steps = F.sequence(F.lit(0), F.lit(16))
    xs = F.transform(steps, lambda k: cx + r * F.cos(a0 + s * k / 16.0))
    ys = F.transform(steps, lambda k: cy + r * F.sin(a0 + s * k / 16.0))
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From a point to a segment; to its start when it has no length."""
    dx, dy = bx - ax, by - ay
    t = F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy)
    t = F.coalesce(F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return distance(ax + t * dx, ay + t * dy, px, py)


def units_per_point(unit: Column, denominator: Column) -> Column:
    return denominator / 72.0 * F.when(unit == "mm", 25.4).when(unit == "cm", 2.54).when(unit == "m", 0.0254).when(unit == "in", 1.0)


def usable_dpi(dpi: Column) -> Column:
    """10 to 2400; 96 where it isn't a positive number."""
    good = dpi.isNotNull() & ~F.isnan(dpi) & (dpi > 0) & (dpi < float("inf"))
    return F.when(good, F.least(F.greatest(dpi, F.lit(10.0)), F.lit(2400.0))).otherwise(96.0)


def sliver(corners: Column) -> Column:
    """struct(x0, y0, x1, y1): the centre line of a thin four-cornered bar, or null.

    A fifth corner may repeat the first; opposite sides agree within 5 %; at most 1.5 wide and at least 4 times as long.
    """

    def measured(ring: Column) -> Column:
        c = [F.get(ring, F.lit(k)) for k in range(5)]
        side = [distance(c[k]["x"], c[k]["y"], c[(k + 1) % 4]["x"], c[(k + 1) % 4]["y"]).alias(f"s{k}") for k in range(4)]
        four = (F.size(ring) == 4) | ((F.size(ring) == 5) & (distance(c[4]["x"], c[4]["y"], c[0]["x"], c[0]["y"]) <= 1e-6))
        return F.struct(*[c[k].alias(f"c{k}") for k in range(4)], *side, four.alias("four"))

    def centred(m: Column) -> Column:
        alike = lambda a, b: F.abs(a - b) <= 0.05 * F.greatest(a, b)
        first, second = (m["s0"] + m["s2"]) / 2.0, (m["s1"] + m["s3"]) / 2.0
        wide, long = F.least(first, second), F.greatest(first, second)
        half = lambda a, b: ((m[a]["x"] + m[b]["x"]) / 2.0, (m[a]["y"] + m[b]["y"]) / 2.0)
        # The short sides are 0-1 and 2-3 when the first pair is the shorter one.
        short = first <= second
        ends = [F.when(short, a).otherwise(b) for a, b in zip((*half("c0", "c1"), *half("c2", "c3")), (*half("c1", "c2"), *half("c3", "c0")), strict=True)]
        good = m["four"] & alike(m["s0"], m["s2"]) & alike(m["s1"], m["s3"]) & (wide <= 1.5) & (long >= 4.0 * F.greatest(wide, F.lit(1e-9)))
        return F.when(good, F.struct(*[e.alias(k) for e, k in zip(ends, ("x0", "y0", "x1", "y1"), strict=True)]))

    return let(corners, lambda ring: let(measured(ring), centred))


def spline_knots(curves: Column) -> Column:
    """Knots of a chain of cubic curves: 0 four times, every inner joint three times, the last four times."""
    inner = F.when(curves > 1, F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(curves - 1, F.lit(1))), lambda k: F.array(k, k, k)))).otherwise(F.array().cast("array<int>"))
    return F.concat(F.array_repeat(F.lit(0), 4), inner, F.array_repeat(curves, 4))


def spline_points(chain: Column) -> Column:
    """Control points of a chain of curves (p0, p1, p2, p3): the first start, then three per curve."""
    first = F.element_at(chain, 1)["p0"]
    return F.concat(F.array(first), F.flatten(F.transform(chain, lambda c: F.array(c["p1"], c["p2"], c["p3"]))))


def join_arcs(arcs: Column) -> Column:
    """Left fold: neighbouring arcs of one circle become one arc, which is the next left neighbour.

    `arcs` is an array of struct(cx, cy, r, a0, a1); the fold stays in the JVM as a higher-order function.
    """

    def joined(a: Column, b: Column) -> Column:
        wa, wb = sweep(a["a0"], a["a1"]), sweep(b["a0"], b["a1"])
        mean = lambda k: (a[k] * wa + b[k] * wb) / (wa + wb)
        cx, cy, r = mean("cx"), mean("cy"), mean("r")
        on = lambda p: (distance(p["cx"], p["cy"], cx, cy) <= CIRCLE_TOLERANCE * r) & (F.abs(p["r"] - r) <= CIRCLE_TOLERANCE * r)
        arc = lambda s, e: F.struct(cx.alias("cx"), cy.alias("cy"), r.alias("r"), s.alias("a0"), e.alias("a1"))
        meets = F.when(F.abs(angle_between(a["a1"], b["a0"])) <= JOIN_ANGLE, arc(a["a0"], b["a1"])).when(F.abs(angle_between(b["a1"], a["a0"])) <= JOIN_ANGLE, arc(b["a0"], a["a1"]))
        return F.when(on(a) & on(b) & (wa + wb < TURN - JOIN_ANGLE), meets)

    def step(done: Column, b: Column) -> Column:
        one = joined(F.element_at(done, -1), b)
        return F.when(F.size(done) == 0, F.array(b)).when(one.isNotNull(), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(one))).otherwise(F.array_append(done, b))

    kind = "array<struct<cx:double,cy:double,r:double,a0:double,a1:double>>"
    return F.aggregate(arcs.cast(kind), F.array().cast(kind), lambda done, b: step(done, b).cast(kind))
