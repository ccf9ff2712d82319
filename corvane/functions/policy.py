"""How far a picture can be enlarged on a device, and what it will cost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import MAX_SCALE, MIN_SCALE, PRESETS, RAM_TIERS


def whole_gb(size: Column) -> Column:
    return F.floor(size.cast("double") / float(1 << 30) + 0.5).cast("int")


def gpu_limit(memory: Column, integrated: Column) -> Column:
    """2, 4, 8 or 16 by dedicated memory; 2 without a GPU or with an integrated one."""
    gb = whole_gb(memory)
    return F.when(memory.isNull() | integrated, 2).when(gb < 6, 2).when(gb < 12, 4).when(gb < 16, 8).otherwise(16)


def tier_of_ram(gb: Column) -> Column:
    """The largest tier not above the installed memory (a backward as-of lookup), or null."""
    out = F.lit(None).cast("int")
    for t, _ in RAM_TIERS:
        out = F.when(gb >= t, t).otherwise(out)
    return out


def ram_for_pixels(pixels: Column) -> Column:
    """The first tier that allows so many pixels (a forward as-of lookup); the last one otherwise."""
    out = F.lit(RAM_TIERS[-1][0])
    for t, most in reversed(RAM_TIERS[:-1]):
        out = F.when(pixels <= most, t).otherwise(out)
    return out


def ram_max_scale(w: Column, h: Column, gb: Column) -> Column:
    out = F.lit(0.0)
    for t, most in RAM_TIERS:
        scale = F.lit(MAX_SCALE) if most is None else F.sqrt(F.try_divide(F.lit(float(most)), w.cast("double") * h.cast("double")))
        out = F.when(gb >= t, scale).otherwise(out)
    return out


def raw_scale(gpu: Column, settings: Column, ram: Column) -> Column:
    return F.least(gpu.cast("double"), settings.cast("double"), ram, F.lit(MAX_SCALE))


def effective_scale(raw: Column) -> Column:
    return F.floor(raw * 2.0) / 2.0


def limit_reasons(raw: Column, gpu: Column, settings: Column, ram: Column, tier: Column) -> Column:
    """The limits that bind, joined by " · "; empty from the largest scale on."""
    same = lambda a: F.abs(a.cast("double") - raw) < 1e-9
    found = F.array_compact(F.array(
        F.when(same(gpu), "Device"), F.when((settings < gpu) & same(settings), "Settings"), F.when(same(ram), F.when(tier.isNull(), "RamTooLow").otherwise("Ram")),
    ))
    return F.when(raw >= MAX_SCALE, "").otherwise(F.array_join(found, " · "))


def locked_presets(effective: Column) -> Column:
    return F.filter(F.array(*map(F.lit, PRESETS)), lambda p: p > effective)


def scale_allowed(scale: Column, effective: Column) -> Column:
    return (scale >= MIN_SCALE) & (scale <= effective)


def output_side(side: Column, scale: Column) -> Column:
    return F.floor(side * scale + 0.5).cast("long")


def estimated_bytes(pixels: Column, png: Column) -> Column:
    return F.floor(pixels * F.when(png, 1.7).otherwise(0.4) + 0.5).cast("long")


def estimated_seconds(pixels: Column, speed: Column, memory_gb: Column) -> Column:
    """Null without a positive speed in megapixels a second."""
    factor = F.when(memory_gb >= 12, 1.0).when(memory_gb >= 8, 1.3).otherwise(1.8)
    return F.when(speed > 0, F.try_divide(pixels.cast("double") / 1e6, speed) * factor)


def engine_in_use(stored: Column, has_gpu: Column, has_npu: Column) -> Column:
    """The stored engine if the device has it, else its default: the GPU, or the CPU."""
    default = F.when(has_gpu, "Gpu").otherwise("Cpu")
    return F.when(stored == "Cpu", "Cpu").when((stored == "Gpu") & has_gpu, "Gpu").when((stored == "Npu") & has_npu, "Npu").otherwise(default)


def stored_scale_limit(stored: Column, device: Column) -> Column:
    wanted = stored.try_cast("int")
    return F.when(wanted.isNull(), device).otherwise(F.least(F.greatest(wanted, F.lit(2)), device))


def stored_memory_gb(stored: Column, installed: Column) -> Column:
    low = F.least(F.lit(4), installed)
    wanted = F.coalesce(stored.try_cast("int"), F.floor(installed * 0.75 + 0.5).cast("int"))
    return F.least(F.greatest(wanted, low), F.greatest(low, installed))


def stored_speed(stored: Column, device: Column) -> Column:
    """"2.5|name" is 2.5 on the device of that name, else null."""
    at = F.instr(stored, "|")
    speed = F.substring(stored, F.lit(1), at - 1).try_cast("double")
    return F.when((at > 0) & (F.substring(stored, at + 1, F.length(stored)) == device) & (speed > 0), speed)


def stored_flag(stored: Column) -> Column:
    """True unless it says false."""
    return F.lower(F.trim(F.coalesce(stored, F.lit("")))) != "false"
