import pytest

from corvane.operators import entities as e

BOX = (0.0, 0.0, 200.0, 100.0)
K = 0.5522847498307936


def round_path(c, rx, ry, close=True):
    q = [c + rx, c + 1j * ry, c - rx, c - 1j * ry, c + rx]
    out = [("move", q[0])]
    for a, b in zip(q, q[1:], strict=False):
        pa, pb = a - c, b - c
        out.append(("curve", a + K * pb, b + K * pa, b))
    return [*out, ("close",)] if close else out


@pytest.mark.parametrize("close", [True, False])
def test_circles(close):
    (found,) = e.entities(round_path(100 + 50j, 20, 20, close), BOX, 0.01)
    assert found[0] == "circle" and abs(found[1] - (100 + 50j)) < 0.01 and abs(found[2] - 20) < 0.01


def test_ellipse_is_one_spline():
    (found,) = e.entities(round_path(100 + 50j, 40, 20), BOX, 0.01)
    assert found[0] == "spline" and len(found[1]) == 13


def test_half_circle_is_one_arc():
    (found,) = e.entities(round_path(100 + 50j, 20, 20, False)[:3], BOX, 0.01)
    assert found[0] == "arc" and abs(e.sweep(found[1]) - 3.14159265) < 0.01


def test_closed_outline_and_its_clipping():
    square = [("move", 10 + 10j), ("line", 50 + 10j), ("line", 50 + 50j), ("line", 10 + 50j), ("close",)]
    assert [(k, len(p)) for k, p in e.entities(square, BOX, 0.01)] == [("polyline", 4)]
    cut = e.entities(square, (0.0, 0.0, 30.0, 100.0), 0.01)
    assert [(k, len(p)) for k, p in cut] == [("run", 2), ("run", 3)]
    assert e.finished([(x, 1) for x in cut], 0.01) == [("POLYLINE", 1, 4, False)]


def test_chain_line_and_loop():
    paths = [[("move", 0j), ("line", 10 + 0j)], [("move", 10 + 0j), ("line", 20 + 10j)], [("move", 30 + 10j), ("line", 20 + 10j)], [("move", 90 + 0j), ("line", 99 + 9j)], [("move", 0j + 50j), ("line", 10 + 50j)]]
    found = [(x, 0) for p in paths for x in e.entities(p, BOX, 0.01)]
    assert e.finished(found, 0.01) == [("POLYLINE", 0, 4, False), ("LINE", 0, 2, False), ("LINE", 0, 2, False)]
    assert [k for k, *_ in e.finished(found, 0.01, join=False)] == ["LINE"] * 5


def test_flat_curve_is_a_line_and_outside_is_nothing():
    assert e.entities([("move", 0j), ("curve", 3 + 0j, 6 + 0j, 9 + 0j)], BOX, 0.01) == [("run", [0j, 9 + 0j])]
    assert e.entities([("move", 300 + 300j), ("line", 400 + 400j)], BOX, 0.01) == []
    (line,) = e.entities([("move", -50 + 50j), ("line", 250 + 50j)], BOX, 0.01)
    assert line[1] == [0 + 50j, 200 + 50j]
