"""Gray pictures as rows (image, x, y, v), v from 0 (black) to 255. Aggregations only; loops of outlines are in kernels.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pixels(images: DataFrame, key: str, values: str, width: int) -> DataFrame:
    """Rows of an array column of gray values, row by row from the top."""
    each = images.select(F.col(key), F.posexplode(values).alias("_at", "v"))
    return each.select(key, (F.col("_at") % width).alias("x"), F.floor(F.col("_at") / width).cast("int").alias("y"), "v")


def gray(r: Column, g: Column, b: Column) -> Column:
    return F.floor((299 * r + 587 * g + 114 * b + 500) / 1000).cast("int")


def flatten_on_white(c: Column, alpha: Column) -> Column:
    return F.floor((c * alpha + 255 * (255 - alpha) + 127) / 255).cast("int")


def otsu(rows: DataFrame, key: str) -> DataFrame:
    """(key, threshold): ink is what is darker. The first of equal variances wins; a flat picture has threshold 1.

    One shuffle: counts per value are summed map-side, and the running window works on 256 rows a picture at most.
    """
    counts = rows.groupBy(key, "v").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(key)
    upto = whole.orderBy("v")
    steps = counts.select(
        key, "v", F.sum("n").over(upto).alias("wb"), F.sum(F.col("n") * F.col("v")).over(upto).alias("sb"), F.sum("n").over(whole).alias("w"), F.sum(F.col("n") * F.col("v")).over(whole).alias("s")
    )
    wf = F.col("w") - F.col("wb")
    gap = F.try_divide(F.col("sb").cast("double"), F.col("wb")) - F.try_divide((F.col("s") - F.col("sb")).cast("double"), wf)
    steps = steps.withColumn("var", F.when(wf > 0, F.col("wb").cast("double") * wf.cast("double") * gap * gap))
    best = steps.groupBy(key).agg(F.max_by("v", F.when(F.col("var") > 0, F.struct("var", (-F.col("v")).alias("o")))).alias("best"))
    return best.select(key, F.least(F.lit(255), F.coalesce("best", F.lit(0)) + 1).cast("int").alias("threshold"))


def reduce_by(rows: DataFrame, key: str, factor: int) -> DataFrame:
    """Blocks of factor x factor become their rounded mean; blocks at the edge may be smaller."""
    block = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    sums = rows.select(key, block("x"), block("y"), "v").groupBy(key, "x", "y").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.select(key, "x", "y", F.expr("(s + n div 2) div n").cast("int").alias("v"))


def reduction_factor(w: int, h: int, most: int) -> int:
    return max(1, -(-max(w, h) // most))


def dark_on_light(rows: DataFrame, key: str) -> DataFrame:
    """Pictures that are mostly ink are inverted."""
    limit = otsu(rows, key)
    dark = rows.join(limit, key).groupBy(key).agg((F.count_if(F.col("v") < F.col("threshold")) * 2 > F.count(F.lit(1))).alias("_flip"))
    return rows.join(dark, key).select(key, "x", "y", F.when(F.col("_flip"), 255 - F.col("v")).otherwise(F.col("v")).alias("v"))


def cells(ink: DataFrame, key: str) -> DataFrame:
    """(key, x, y, code) of the marching squares that the outline crosses. Each ink pixel adds 8, 4, 2 and 1 to the squares
    whose top left, top right, bottom right and bottom left corner it is; what lies outside is paper by itself."""
    corner = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(w).alias("w")) for dx, dy, w in ((0, 0, 8), (-1, 0, 4), (-1, -1, 2), (0, -1, 1))])
    each = ink.select(key, "x", "y", F.explode(corner).alias("c"))
    sums = each.groupBy(key, (F.col("x") + F.col("c.dx")).alias("x"), (F.col("y") + F.col("c.dy")).alias("y")).agg(F.sum("c.w").cast("int").alias("code"))
    return sums.where("code <> 15")
