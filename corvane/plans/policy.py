"""Device limits, estimates, settings, choices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import policy as po
from .registry import query, table

_GB = "(CAST(p_size AS BIGINT) % 9 * 8)"
_PX = "(p_partkey * 7919 % 60000000 + 1)"
_TIERS = dims.values_sql(dims.RAM_TIERS, "t(gb, most)")


@query("op41_ram_tier", f"""
WITH p AS (SELECT p_partkey, {_GB} AS gb, {_PX} AS px FROM part)
SELECT p_partkey, (SELECT max(t.gb) FROM {_TIERS} WHERE t.gb <= p.gb) AS tier, (SELECT min(t.gb) FROM {_TIERS} WHERE t.most IS NULL OR p.px <= t.most) AS needed FROM p
""")
def op41_ram_tier(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey", f"{_GB} AS gb", f"{_PX} AS px")
    return p.select("p_partkey", po.tier_of_ram(F.col("gb")).alias("tier"), po.ram_for_pixels(F.col("px")).alias("needed"))


_SCALE = f"""
p AS (SELECT p_partkey, p_partkey % 3000 + 200 AS w, p_partkey * 13 % 2000 + 150 AS h, {_GB} AS gb, list_value(2, 4, 8, 16)[p_partkey % 4 + 1] AS gpu, list_value(2, 4, 8, 16)[p_size % 4 + 1] AS settings FROM part),
m AS (SELECT *, CASE WHEN gb >= 64 THEN 16.0::DOUBLE WHEN gb >= 32 THEN sqrt(33177600.0::DOUBLE / (w::DOUBLE * h::DOUBLE)) WHEN gb >= 16 THEN sqrt(8294400.0::DOUBLE / (w::DOUBLE * h::DOUBLE)) WHEN gb >= 8 THEN sqrt(3686400.0::DOUBLE / (w::DOUBLE * h::DOUBLE)) ELSE 0.0::DOUBLE END AS ram FROM p),
r AS (SELECT *, least(gpu::DOUBLE, settings::DOUBLE, ram, 16.0::DOUBLE) AS raw FROM m),
e AS (SELECT *, floor(raw * 2.0::DOUBLE) / 2.0::DOUBLE AS eff FROM r)
"""


def _scales(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey", "p_partkey % 3000 + 200 AS w", "p_partkey * 13 % 2000 + 150 AS h", f"{_GB} AS gb", "array(2, 4, 8, 16)[cast(p_partkey % 4 as int)] AS gpu", "array(2, 4, 8, 16)[p_size % 4] AS settings")
    p = p.withColumn("ram", po.ram_max_scale(F.col("w"), F.col("h"), F.col("gb")))
    p = p.withColumn("raw", po.raw_scale(F.col("gpu"), F.col("settings"), F.col("ram")))
    return p.withColumn("eff", po.effective_scale(F.col("raw")))


@query("op70_scale", f"WITH {_SCALE} SELECT p_partkey, floor(ram * 1000000.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS ram_micro, eff, eff >= 1.5 AS available, least(4.0::DOUBLE, eff) AS dflt, eff >= 2 AS suggests_two FROM e")
def op70_scale(spark, d):
    e = F.col("eff")
    return _scales(spark, d).select("p_partkey", F.floor(F.col("ram") * 1e6 + 0.5).alias("ram_micro"), "eff", (e >= 1.5).alias("available"), F.least(F.lit(4.0), e).alias("dflt"), (e >= 2).alias("suggests_two"))


@query("op71_reasons", f"""
WITH {_SCALE} SELECT p_partkey, CASE WHEN raw >= 16 THEN '' ELSE concat_ws(' · ', CASE WHEN abs(gpu - raw) < 1e-9 THEN 'Device' END, CASE WHEN settings < gpu AND abs(settings - raw) < 1e-9 THEN 'Settings' END,
  CASE WHEN abs(ram - raw) < 1e-9 THEN CASE WHEN gb < 8 THEN 'RamTooLow' ELSE 'Ram' END END) END AS reasons FROM e
""")
def op71_reasons(spark, d):
    c = F.col
    return _scales(spark, d).select("p_partkey", po.limit_reasons(c("raw"), c("gpu"), c("settings"), c("ram"), po.tier_of_ram(c("gb"))).alias("reasons"))


@query("op62_presets", f"""
WITH {_SCALE} SELECT p_partkey, array_to_string(list_filter([2, 4, 8, 16], lambda p: p > eff), ',') AS locked, p_size / 4.0::DOUBLE >= 1.5 AND p_size / 4.0::DOUBLE <= eff AS allowed FROM e JOIN (SELECT p_partkey AS k, p_size FROM part) ON k = p_partkey
""")
def op62_presets(spark, d):
    wanted = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 4.0).alias("wanted"))
    out = _scales(spark, d).join(wanted, "p_partkey")
    return out.select("p_partkey", F.array_join(F.transform(po.locked_presets(F.col("eff")), lambda x: x.cast("string")), ",").alias("locked"), po.scale_allowed(F.col("wanted"), F.col("eff")).alias("allowed"))


_MEMORY = "(c_custkey * 104729 % 24 * 1073741824 + c_custkey * 7919 % 1073741824)"


@query("op72_gpu_limit", f"""
WITH g AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE {_MEMORY} END AS memory, c_custkey % 7 = 0 AS integrated FROM customer)
SELECT c_custkey, floor(memory / 1073741824.0::DOUBLE + 0.5::DOUBLE)::INTEGER AS gb, CASE WHEN memory IS NULL OR integrated THEN 2 WHEN floor(memory / 1073741824.0::DOUBLE + 0.5::DOUBLE) < 6 THEN 2
  WHEN floor(memory / 1073741824.0::DOUBLE + 0.5::DOUBLE) < 12 THEN 4 WHEN floor(memory / 1073741824.0::DOUBLE + 0.5::DOUBLE) < 16 THEN 8 ELSE 16 END AS most FROM g
""")
def op72_gpu_limit(spark, d):
    g = table(spark, d, "customer").selectExpr("c_custkey", f"CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE {_MEMORY} END AS memory", "c_custkey % 7 = 0 AS integrated")
    return g.select("c_custkey", po.whole_gb(F.col("memory")).alias("gb"), po.gpu_limit(F.col("memory"), F.col("integrated")).alias("most"))


@query("op73_estimates", """
WITH p AS (SELECT p_partkey, p_partkey % 3000 + 200 AS w, p_partkey * 13 % 2000 + 150 AS h, p_size / 8.0::DOUBLE + 1 AS s, (p_partkey % 10 - 1) / 4.0::DOUBLE AS speed, p_size % 20 AS gb FROM part),
o AS (SELECT *, floor(w * s + 0.5::DOUBLE)::BIGINT AS ow, floor(h * s + 0.5::DOUBLE)::BIGINT AS oh FROM p)
SELECT p_partkey, ow, oh, floor(ow * oh * 1.7::DOUBLE + 0.5::DOUBLE)::BIGINT AS png_bytes, floor(ow * oh * 0.4::DOUBLE + 0.5::DOUBLE)::BIGINT AS jpg_bytes,
  floor(CASE WHEN speed > 0 THEN (ow * oh)::DOUBLE / 1e6 / speed * CASE WHEN gb >= 12 THEN 1.0::DOUBLE WHEN gb >= 8 THEN 1.3::DOUBLE ELSE 1.8::DOUBLE END END * 1000.0::DOUBLE)::BIGINT AS ms FROM o
""")
def op73_estimates(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey", "p_partkey % 3000 + 200 AS w", "p_partkey * 13 % 2000 + 150 AS h", "p_size / 8D + 1 AS s", "(p_partkey % 10 - 1) / 4D AS speed", "p_size % 20 AS gb")
    p = p.withColumn("ow", po.output_side(F.col("w"), F.col("s"))).withColumn("oh", po.output_side(F.col("h"), F.col("s")))
    px = F.col("ow") * F.col("oh")
    return p.select("p_partkey", "ow", "oh", po.estimated_bytes(px, F.lit(True)).alias("png_bytes"), po.estimated_bytes(px, F.lit(False)).alias("jpg_bytes"), F.floor(po.estimated_seconds(px, F.col("speed"), F.col("gb")) * 1000.0).alias("ms"))


@query("op95_engine", """
WITH c AS (SELECT c_custkey, list_value('Gpu', 'Npu', 'Cpu', 'Tpu', NULL)[c_custkey % 5 + 1] AS stored, c_custkey % 3 <> 0 AS gpu, c_custkey % 4 = 0 AS npu FROM customer)
SELECT c_custkey, CASE WHEN stored = 'Cpu' THEN 'Cpu' WHEN stored = 'Gpu' AND gpu THEN 'Gpu' WHEN stored = 'Npu' AND npu THEN 'Npu' WHEN gpu THEN 'Gpu' ELSE 'Cpu' END AS engine FROM c
""")
def op95_engine(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey", "array('Gpu', 'Npu', 'Cpu', 'Tpu', NULL)[cast(c_custkey % 5 as int)] AS stored", "c_custkey % 3 <> 0 AS gpu", "c_custkey % 4 = 0 AS npu")
    return c.select("c_custkey", po.engine_in_use(F.col("stored"), F.col("gpu"), F.col("npu")).alias("engine"))


@query("op77_settings", """
WITH c AS (SELECT c_custkey, list_value(2, 4, 8, 16)[c_custkey % 4 + 1] AS device, CAST(c_custkey % 40 AS INTEGER) AS installed,
  list_value('1', '64', 'x', NULL, '8')[c_custkey % 5 + 1] AS scale, list_value('1', '64', 'x', NULL, '6')[c_custkey % 5 + 1] AS memory, list_value('2.5|a', '2.5|b', '-1|a', NULL, 'x|a', '3')[c_custkey % 6 + 1] AS speed, list_value('false', 'False', 'no', NULL)[c_custkey % 4 + 1] AS flag FROM customer)
SELECT c_custkey, coalesce(least(greatest(TRY_CAST(scale AS INTEGER), CASE WHEN TRY_CAST(scale AS INTEGER) IS NULL THEN NULL ELSE 2 END), CASE WHEN TRY_CAST(scale AS INTEGER) IS NULL THEN NULL ELSE device END), device) AS scale,
  least(greatest(coalesce(TRY_CAST(memory AS INTEGER), floor(installed * 0.75::DOUBLE + 0.5::DOUBLE)::INTEGER), least(4, installed)), greatest(least(4, installed), installed)) AS memory,
  CASE WHEN contains(speed, '|') AND split_part(speed, '|', 2) = 'a' AND TRY_CAST(split_part(speed, '|', 1) AS DOUBLE) > 0 THEN TRY_CAST(split_part(speed, '|', 1) AS DOUBLE) END AS speed,
  lower(coalesce(flag, '')) <> 'false' AS flag FROM c
""")
def op77_settings(spark, d):
    c = table(spark, d, "customer").selectExpr(
        "c_custkey", "array(2, 4, 8, 16)[cast(c_custkey % 4 as int)] AS device", "cast(c_custkey % 40 as int) AS installed", "array('1', '64', 'x', NULL, '8')[cast(c_custkey % 5 as int)] AS scale",
        "array('1', '64', 'x', NULL, '6')[cast(c_custkey % 5 as int)] AS memory", "array('2.5|a', '2.5|b', '-1|a', NULL, 'x|a', '3')[cast(c_custkey % 6 as int)] AS speed", "array('false', 'False', 'no', NULL)[cast(c_custkey % 4 as int)] AS flag",
    )
    return c.select(
        "c_custkey", po.stored_scale_limit(F.col("scale"), F.col("device")).alias("scale"), po.stored_memory_gb(F.col("memory"), F.col("installed")).alias("memory"),
        po.stored_speed(F.col("speed"), F.lit("a")).alias("speed"), po.stored_flag(F.col("flag")).alias("flag"),
    )


@query("op45_gpu_choice", """
WITH s AS (SELECT s_nationkey, s_suppkey, CAST(floor(s_acctbal) AS BIGINT) AS memory, s_suppkey % 5 = 0 AS software FROM supplier)
SELECT s_nationkey, arg_min(s_suppkey, (memory <= 0, -memory, s_suppkey)) AS chosen FROM s WHERE NOT software GROUP BY s_nationkey
""")
def op45_gpu_choice(spark, d):
    """The first of a device's adapters: discrete ones first, then the most memory; one aggregation, no sort."""
    s = table(spark, d, "supplier").selectExpr("s_nationkey", "s_suppkey", "cast(floor(s_acctbal) as bigint) AS memory", "s_suppkey % 5 = 0 AS software")
    key = F.struct((F.col("memory") <= 0).alias("integrated"), (-F.col("memory")).alias("m"), "s_suppkey")
    return s.where("not software").groupBy("s_nationkey").agg(F.min_by("s_suppkey", key).alias("chosen"))


@query("op46_engine_speed", """
WITH r AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events)
SELECT user_id, event_type, floor(count(*) * 4.0::DOUBLE / greatest(sum(CAST(floor(value * 1000) AS BIGINT)) / 1000.0::DOUBLE, 1e-6) * 1000.0::DOUBLE)::BIGINT AS milli_speed FROM r WHERE n BETWEEN 2 AND 4 GROUP BY ALL
""")
def op46_engine_speed(spark, d):
    """Three timed tiles of 4 megapixels after one warm-up run, per engine and device."""
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    r = table(spark, d, "events").select("user_id", "event_type", F.floor(F.col("value") * 1000).alias("ms"), F.row_number().over(w).alias("n")).where("n between 2 and 4")
    speed = F.count(F.lit(1)) * 4.0 / F.greatest(F.sum("ms") / 1000.0, F.lit(1e-6))
    return r.groupBy("user_id", "event_type").agg(F.floor(speed * 1000.0).alias("milli_speed"))
