"""Page shapes: visibility, first-occurrence dedupe, text backing, colours, page kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims


def is_white(r: Column, g: Column, b: Column) -> Column:
    """A colour close to paper; no colour is not white."""
    return F.coalesce((r >= 0.97) & (g >= 0.97) & (b >= 0.97), F.lit(False))


def same_colour(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Within 0.02 a channel; two missing colours are the same."""
    close = F.lit(True)
    for x, y in zip(a, b, strict=True):
        close = close & (F.abs(x - y) <= 0.02)
    return F.when(a[0].isNull() & b[0].isNull(), True).otherwise(F.coalesce(close, F.lit(False)))


def visible_paths(paths: DataFrame, page_area: float) -> DataFrame:
    """Paths (filled, stroked, fill_*, stroke_*, is_clip, min_x .. max_y, clip_*) that leave a mark, with `solid`."""
    c = F.col
    fill, stroke = tuple(c(f"fill_{k}") for k in "rgb"), tuple(c(f"stroke_{k}") for k in "rgb")
    solid = c("filled") & (~c("stroked") | same_colour(fill, stroke))
    paper = (~c("filled") | is_white(*fill)) & (~c("stroked") | is_white(*stroke))
    area = (c("max_x") - c("min_x")) * (c("max_y") - c("min_y"))
    inside = (c("min_x") <= c("clip_max_x")) & (c("max_x") >= c("clip_min_x")) & (c("min_y") <= c("clip_max_y")) & (c("max_y") >= c("clip_min_y"))
    drawn = paths.where(~c("is_clip") & (c("filled") | c("stroked"))).where(~paper).withColumn("solid", solid)
    return drawn.where(~(c("solid") & (area >= 0.95 * page_area)) & inside)


def signature(points: Column) -> Column:
    """The text of a list of (command, x, y), coordinates to two digits (banker's rounding)."""
    return F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["cmd"], F.bround(p["x"], 2).cast("string"), F.bround(p["y"], 2).cast("string"))), ";")


def first_occurrences(rows: DataFrame, *key: str, order: str) -> DataFrame:
    """The first row of every key in the order of `order`; the key is hashed once, the window never holds more than a key."""
    w = Window.partitionBy(*key).orderBy(order)
    return rows.withColumn("_at", F.row_number().over(w)).where("_at = 1").drop("_at")


def backing(shapes: DataFrame, lines: DataFrame, page: str, cell: float = 64.0) -> tuple[DataFrame, DataFrame]:
    """(shapes that back no hidden line, hidden lines that some shape backs).

    A solid shape wholly inside the box of a line, grown by half its size, backs the first such line. The containment join is
    an equi-join on the page and grid cells of the shape's lower left corner, so pages of any length stay balanced.
    """
    at = lambda c: F.floor(c / cell).cast("long")
    grown = lines.select(
        F.col(page), F.col("line_no"), (F.col("min_x") - F.col("size") / 2).alias("x0"), (F.col("min_y") - F.col("size") / 2).alias("y0"), (F.col("max_x") + F.col("size") / 2).alias("x1"), (F.col("max_y") + F.col("size") / 2).alias("y1")
    )
    grown = grown.withColumn("_i", F.explode(F.sequence(at(F.col("x0")), at(F.col("x1"))))).withColumn("_j", F.explode(F.sequence(at(F.col("y0")), at(F.col("y1")))))
    keyed = shapes.withColumn("_i", at(F.col("min_x"))).withColumn("_j", at(F.col("min_y")))
    inside = "min_x >= x0 and min_y >= y0 and max_x <= x1 and max_y <= y1"
    hits = keyed.where("solid").join(grown, [page, "_i", "_j"]).where(inside).groupBy(page, "shape_no").agg(F.min("line_no").alias("line_no"))
    return shapes.join(hits, [page, "shape_no"], "left_anti"), lines.join(hits, [page, "line_no"], "left_semi")


def nearest_colour(r: Column, g: Column, b: Column) -> Column:
    """The index of the nearest palette colour, the first of equals: a fold over 31 constants, no join."""
    best = None
    for k, (index, pr, pg, pb) in enumerate(dims.PALETTE):
        d = (r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb)
        one = F.struct(d.alias("d"), F.lit(k).alias("k"), F.lit(index).alias("i"))
        best = one if best is None else [*(best if isinstance(best, list) else [best]), one]
    return F.when(r.isNull() | g.isNull() | b.isNull(), 7).otherwise(F.least(*best)["i"])


def channel(v: Column) -> Column:
    """0 to 255 of a channel between 0 and 1, halves to even."""
    return F.least(F.greatest(F.rint(v * 255.0), F.lit(0.0)), F.lit(255.0)).cast("int")


def page_kind(segments: Column, letters: Column, image_area: Column, page_area: Column) -> Column:
    image = F.coalesce(image_area, F.lit(0.0))
    scan = (segments < 50) & (page_area > 0) & (F.try_divide(image, page_area) >= 0.7)
    return F.when(scan, "Scan").when((segments == 0) & (letters == 0) & (image == 0), "Empty").otherwise("Vector")


def extents(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))


def merged_circle(arcs: DataFrame, key: str) -> DataFrame:
    """(key, cx, cy, r, is_circle): sweep-weighted means; a circle if all arcs lie on it and their sweeps make a full turn."""
    import math

    from ..functions.geometry import CIRCLE_TOLERANCE, TURN, distance, sweep

    w = arcs.withColumn("w", sweep(F.col("a0"), F.col("a1")))
    mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col("w")), F.sum("w"))
    means = w.groupBy(key).agg(mean("cx").alias("mx"), mean("cy").alias("my"), mean("r").alias("mr"), F.sum("w").alias("total"))
    on = (distance(F.col("cx"), F.col("cy"), F.col("mx"), F.col("my")) <= CIRCLE_TOLERANCE * F.col("mr")) & (F.abs(F.col("r") - F.col("mr")) <= CIRCLE_TOLERANCE * F.col("mr"))
    full = F.abs(F.first("total") - TURN) <= 0.03 * 2 * math.pi
    return w.join(means, key).groupBy(key).agg(F.first("mx").alias("cx"), F.first("my").alias("cy"), F.first("mr").alias("r"), (F.bool_and(on) & full).alias("is_circle"))


def end_degrees(runs: DataFrame, group: str, tolerance: float) -> DataFrame:
    """(group, kx, ky, n): how many run ends share a cell. Cells are halves-to-even multiples of the tolerance."""
    ends = runs.select(group, F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("e"))
    cell = lambda c: F.rint(F.col(c) / tolerance).cast("long")
    return ends.groupBy(group, cell("e.x").alias("kx"), cell("e.y").alias("ky")).agg(F.count(F.lit(1)).alias("n"))


def gap_lines(words: DataFrame, key: str, start: str, end: str, gap: float) -> DataFrame:
    """Words on one baseline, numbered by line: a new line begins where the gap to the word before is too wide."""
    w = Window.partitionBy(key).orderBy(start, "ord")
    fresh = F.when(F.col(start) - F.lag(end).over(w) > gap, 1).otherwise(0)
    return words.withColumn("_new", fresh).withColumn("line_no", F.sum("_new").over(w).cast("long")).drop("_new")
