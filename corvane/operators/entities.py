"""From drawn subpaths to drawing entities. Points are complex numbers, so turns and offsets are products and quotients."""

from __future__ import annotations

import cmath
import math
from collections.abc import Iterator

from ..functions import geometry as g
from . import kernels

Box = tuple[float, float, float, float]


def cross(a: complex, b: complex) -> float:
    return (a.conjugate() * b).imag


def curve_at(p: tuple[complex, ...], t: float) -> complex:
    u = 1 - t
    return u**3 * p[0] + 3 * u * u * t * p[1] + 3 * u * t * t * p[2] + t**3 * p[3]


def flat(p: tuple[complex, ...]) -> bool:
    """In units of the chord, control points have no height and lie between its ends."""
    chord = p[3] - p[0]
    at = [(q - p[0]) / chord for q in p[1:3]] if chord else []
    return bool(at) and all(abs(z.imag) <= g.FLAT_TOLERANCE and -g.FLAT_TOLERANCE <= z.real <= 1 + g.FLAT_TOLERANCE for z in at)


def arc_of(p: tuple[complex, ...]) -> tuple[complex, float, float, float] | None:
    """(centre, radius, start, end), counter-clockwise, or None when the curve is no arc."""
    mid = curve_at(p, 0.5)
    b, c = mid - p[0], p[3] - p[0]
    turn = cross(b, c)
    if abs(2 * turn) < 1e-9 * max(abs(b), abs(c)) ** 2 or not turn:
        return None
    centre = p[0] + 1j * (b * abs(c) ** 2 - c * abs(b) ** 2) / (2 * turn)
    r = abs(centre - p[0])
    if any(abs(abs(curve_at(p, t) - centre) - r) > g.ARC_TOLERANCE * r for t in (0.125, 0.25, 0.375, 0.625, 0.75, 0.875)):
        return None
    ends = [cmath.phase(q - centre) for q in (p[0], p[3])]
    forward = cross(p[0] - centre, mid - centre) + cross(mid - centre, p[3] - centre) > 0
    return (centre, r, *(ends if forward else ends[::-1]))


def sweep(arc: tuple) -> float:
    s = math.fmod(arc[3] - arc[2], g.TURN)
    return s + g.TURN if s <= 0 else s


def _mean(arcs: list[tuple]) -> tuple[complex, float] | None:
    """Centre and radius weighted by sweep, if all arcs lie on that circle."""
    w = [sweep(a) for a in arcs]
    centre, r = (sum(a[k] * x for a, x in zip(arcs, w, strict=True)) / sum(w) for k in (0, 1))
    return (centre, r) if all(abs(a[0] - centre) <= g.CIRCLE_TOLERANCE * r and abs(a[1] - r) <= g.CIRCLE_TOLERANCE * r for a in arcs) else None


def joined_arcs(segments: list[tuple]) -> list[tuple]:
    """Neighbouring arcs of one circle as one, folded from the left."""
    out: list[tuple] = []
    for s in segments:
        if out and s[0] == out[-1][0] == "arc":
            a, b = out[-1][1], s[1]
            circle = _mean([a, b]) if sweep(a) + sweep(b) < g.TURN - g.JOIN_ANGLE else None
            meets = [(x[2], y[3]) for x, y in ((a, b), (b, a)) if abs(math.remainder(y[2] - x[3], g.TURN)) <= g.JOIN_ANGLE]
            if circle and meets:
                out[-1] = ("arc", (*circle, *meets[0]))
                continue
        out.append(s)
    return out


def segments_of(commands: list[tuple], near: float) -> tuple[list[tuple], bool]:
    """Segments ("line", a, b), ("arc", arc) or ("curve", p0..p3) of move, line, curve and close commands; whether it closes."""
    out, start, now, closed = [], None, None, False
    for op, *points in commands:
        if op == "move":
            start = now = points[0]
            continue
        if op == "close":
            if start is not None and now is not None and abs(start - now) > near:
                out.append(("line", now, start))
            closed, now = True, start
            continue
        p = (now, *points)
        start = now if start is None else start
        if op == "line" or flat(p):
            out.append(("line", p[0], p[-1]))
        else:
            arc = arc_of(p)
            out.append(("arc", arc) if arc else ("curve", p))
        now = p[-1]
    out = [s for s in out if s[0] != "line" or abs(s[1] - s[2]) > near]
    return out, closed or (start is not None and now is not None and abs(start - now) <= near)


def clipped(a: complex, b: complex, box: Box) -> tuple[complex, complex] | None:
    t0, t1 = 0.0, 1.0
    for at, d, low, high in ((a.real, (b - a).real, box[0], box[2]), (a.imag, (b - a).imag, box[1], box[3])):
        if d == 0:
            if not low <= at <= high:
                return None
            continue
        enter, leave = sorted(((low - at) / d, (high - at) / d))
        t0, t1 = max(t0, enter), min(t1, leave)
    return (a + t0 * (b - a), a + t1 * (b - a)) if t0 <= t1 else None


def inside(p: complex, box: Box) -> bool:
    return box[0] <= p.real <= box[2] and box[1] <= p.imag <= box[3]


def meets(points: list[complex], box: Box) -> bool:
    xs, ys = [p.real for p in points], [p.imag for p in points]
    return min(xs) <= box[2] and max(xs) >= box[0] and min(ys) <= box[3] and max(ys) >= box[1]


def _pieces(segments: list[tuple], box: Box, near: float) -> Iterator[tuple]:
    """What shows of each segment; a gap where nothing does."""
    for s in segments:
        if s[0] == "line":
            seen = clipped(s[1], s[2], box)
            yield ("run", list(seen)) if seen and abs(seen[0] - seen[1]) > near else ("gap", [])
        elif s[0] == "arc":
            yield "arc", s[1]
        else:
            yield "spline", list(s[1])


def entities(commands: list[tuple], box: Box, near: float, join: bool = True) -> list[tuple]:
    """("circle", centre, r), ("polyline", corners) closed, ("run", points) open, ("arc", arc) or ("spline", control points)."""
    segments, closed = segments_of(commands, near)
    arcs = [s[1] for s in segments if s[0] == "arc"]
    if closed and len(segments) >= 2 and len(arcs) == len(segments):
        circle = _mean(arcs)
        if circle and abs(sum(map(sweep, arcs)) - g.TURN) <= 0.03 * g.TURN:
            (c, r) = circle
            return [("circle", c, r)] if meets([c - r - 1j * r, c + r + 1j * r], box) else []
    segments = joined_arcs(segments)
    corners = [s[1] for s in segments if s[0] == "line"]
    if join and closed and len(segments) >= 3 and len(corners) == len(segments) and all(inside(p, box) for p in corners):
        return [("polyline", corners)]
    out: list[tuple] = []
    for kind, what in _pieces(segments, box, near):
        last = out[-1] if out else None
        if kind in ("run", "spline") and last and last[0] == kind and abs(last[1][-1] - what[0]) <= near:
            last[1].extend(what[1:])
        else:
            out.append((kind, what))
    arc_points = lambda a: [a[0] + a[1] * cmath.exp(1j * (a[2] + sweep(a) * k / 16)) for k in range(17)]
    shown = {"run": lambda w: True, "gap": lambda w: False, "arc": lambda w: meets(arc_points(w), box), "spline": lambda w: meets(w, box)}
    return [e for e in out if shown[e[0]](e[1])]


def finished(found: list[tuple[tuple, int]], near: float, join: bool = True) -> list[tuple[str, int, int, bool]]:
    """(kind, colour, points, closed) of all entities of a page: first those that stand alone, then the joined runs."""
    out, runs = [], []
    for (kind, *what), colour in found:
        if kind != "run":
            n = {"circle": 1, "arc": 1}.get(kind) or len(what[0])
            out.append((kind.upper(), colour, n, kind in ("circle", "polyline")))
        elif join:
            runs.append(([(p.real, p.imag) for p in what[0]], colour))
        else:
            out += [("LINE", colour, 2, False)] * (len(what[0]) - 1)
    for points, colour, closed in kernels.join_runs(runs, near):
        out.append(("LINE" if len(points) == 2 and not closed else "POLYLINE", colour, len(points), closed))
    return out
