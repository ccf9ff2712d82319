"""Gray pictures of 8 x 8 pixels made of the embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import kernels, raster
from .registry import query, table

_V = "px AS (SELECT vec_id, k % 8 AS x, k // 8 AS y, CAST(least(255, greatest(0, round_even((CAST(embedding[k + 1] AS DOUBLE) + 1) * 127.5::DOUBLE, 0))) AS INTEGER) AS v FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS k FROM embeddings))"
_OTSU = """
n AS (SELECT vec_id, v, count(*) AS n FROM px GROUP BY ALL),
u AS (SELECT vec_id, v, sum(n) OVER b AS wb, sum(n * v) OVER b AS sb, sum(n) OVER w AS w, sum(n * v) OVER w AS s FROM n WINDOW b AS (PARTITION BY vec_id ORDER BY v), w AS (PARTITION BY vec_id)),
g AS (SELECT *, wb::DOUBLE * (w - wb)::DOUBLE * (sb::DOUBLE / wb - (s - sb)::DOUBLE / (w - wb)) * (sb::DOUBLE / wb - (s - sb)::DOUBLE / (w - wb)) AS var FROM u WHERE w > wb),
o AS (SELECT p.vec_id, CAST(least(255, coalesce(q.best, 0) + 1) AS INTEGER) AS threshold FROM (SELECT DISTINCT vec_id FROM px) p LEFT JOIN (SELECT vec_id, arg_max(v, (var, -v)) AS best FROM g WHERE var > 0 GROUP BY vec_id) q ON p.vec_id = q.vec_id)
"""


def _pixels(spark, d):
    value = lambda e: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.rint((e.cast("double") + 1.0) * 127.5))).cast("int")
    return raster.pixels(table(spark, d, "embeddings").select("vec_id", F.transform("embedding", value).alias("values")), "vec_id", "values", 8)


def _matrix(f, value="v"):
    out = np.zeros((int(f["y"].max()) + 1, int(f["x"].max()) + 1), int)
    out[f["y"], f["x"]] = f[value]
    return out


@query("op30_otsu", f"WITH {_V}, {_OTSU} SELECT vec_id, threshold FROM o")
def op30_otsu(spark, d):
    return raster.otsu(_pixels(spark, d), "vec_id")


@query("op31_reduce", f"WITH {_V} SELECT vec_id, CAST(x // 3 AS INTEGER) AS x, CAST(y // 3 AS INTEGER) AS y, CAST((sum(v) + count(*) // 2) // count(*) AS INTEGER) AS v FROM px GROUP BY vec_id, x // 3, y // 3")
def op31_reduce(spark, d):
    return raster.reduce_by(_pixels(spark, d), "vec_id", 3)


@query("op32_dark_on_light", f"WITH {_V}, {_OTSU}, f AS (SELECT px.vec_id, count(*) FILTER (WHERE v < threshold) * 2 > count(*) AS flip FROM px JOIN o ON px.vec_id = o.vec_id GROUP BY px.vec_id) SELECT px.vec_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CASE WHEN flip THEN 255 - v ELSE v END AS v FROM px JOIN f ON px.vec_id = f.vec_id")
def op32_dark_on_light(spark, d):
    return raster.dark_on_light(_pixels(spark, d), "vec_id")


@query("op69_gray", f"WITH {_V} SELECT vec_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST((299 * v + 587 * (255 - v) + 114 * (v * 7 % 256) + 500) // 1000 AS INTEGER) AS gray, CAST((v * (x * 32) + 255 * (255 - x * 32) + 127) // 255 AS INTEGER) AS flat FROM px")
def op69_gray(spark, d):
    v = F.col("v")
    return _pixels(spark, d).select("vec_id", F.col("x").cast("int").alias("x"), "y", raster.gray(v, 255 - v, v * 7 % 256).alias("gray"), raster.flatten_on_white(v, F.col("x") * 32).alias("flat"))


_INK = f"{_V}, {_OTSU}, ink AS (SELECT px.vec_id, x, y FROM px JOIN o ON px.vec_id = o.vec_id WHERE v < threshold)"


def _ink(spark, d):
    px = _pixels(spark, d)
    return px.join(raster.otsu(px, "vec_id"), "vec_id").where("v < threshold").select("vec_id", "x", "y")


@query("op29_cells", f"WITH {_INK}, c AS (SELECT vec_id, x + dx AS x, y + dy AS y, sum(w) AS code FROM ink, (VALUES (0, 0, 8), (-1, 0, 4), (-1, -1, 2), (0, -1, 1)) AS k(dx, dy, w) GROUP BY vec_id, x + dx, y + dy) SELECT vec_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(code AS INTEGER) AS code FROM c WHERE code <> 15")
def op29_cells(spark, d):
    return raster.cells(_ink(spark, d), "vec_id").select("vec_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "code")


@query("op29_contours")
def op29_contours(spark, d):
    """(loop, points, first point) of the outlines of each picture; squares come from the aggregation, loops from the kernel."""
    codes = raster.cells(_ink(spark, d), "vec_id").withColumn("ord", F.col("y") * 100 + F.col("x"))

    def kernel(f):
        m = np.zeros((9, 9), int)
        m[f["y"] + 1, f["x"] + 1] = f["code"]
        return [(k, len(loop), *loop[0]) for k, loop in enumerate(kernels.contours(m))]

    return kernels.per_group(codes, "vec_id", "ord", "vec_id long, loop int, points int, x double, y double", kernel)


@query("op29b_trace")
def op29b_trace(spark, d):
    rows = _pixels(spark, d).withColumn("ord", F.col("y") * 8 + F.col("x"))
    return kernels.per_group(rows, "vec_id", "ord", "vec_id long, outline int, corners int", lambda f: [(k, len(r)) for k, r in enumerate(kernels.trace(_matrix(f)))])


@query("op34_simplify")
def op34_simplify(spark, d):
    """Corners before and after simplifying every outline by half a pixel."""
    rows = _pixels(spark, d).withColumn("ord", F.col("y") * 8 + F.col("x"))

    def kernel(f):
        m = _matrix(f)
        loops = kernels.contours(kernels.cell_codes(m < kernels.otsu_threshold(m)))
        return [(k, len(p), len(kernels.simplify_closed(p, 0.5))) for k, p in enumerate(loops)]

    return kernels.per_group(rows, "vec_id", "ord", "vec_id long, loop int, before int, after int", kernel)
