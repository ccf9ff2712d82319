"""File names, sizes, times, scales and durations as display texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import MONTHS


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize_extension(c: Column) -> Column:
    """".png" for "PNG", " .Png "; null for blank or "."."""
    low = F.lower(trimmed(c))
    return F.when(~low.isin("", "."), F.when(low.startswith("."), low).otherwise(F.concat(F.lit("."), low)))


def extension_of_path(c: Column) -> Column:
    """The last extension, lower-cased, or empty."""
    return F.lower(F.regexp_extract(c, r"(\.[^./\\]+)$", 1))


def extension_code(ext: Column) -> Column:
    return F.upper(F.regexp_replace(ext, r"^\.", ""))


def half_away(c: Column, digits: int = 0) -> Column:
    """Rounds a non-negative double half away from zero by scaling."""
    by = float(10**digits)
    return F.floor(c * by + 0.5) / by


def file_size_text(size: Column, lang: str = "en") -> Column:
    """"1.0 KB": one decimal below 100, whole numbers above; a rounded 1024 moves up a unit. Null for negatives."""
    dot, unit = (".", "bytes") if lang == "en" else (",", "byte")
    out = F.lit(None).cast("string")
    for k, name in reversed([*enumerate(("KB", "MB", "GB", "TB"), 1)]):
        v = size.cast("double") / float(1024**k)
        shown = F.when(v < 100, half_away(v, 1)).otherwise(half_away(v))
        text = F.when(shown < 100, F.replace(F.format_string("%.1f", shown), F.lit("."), F.lit(dot))).otherwise(F.format_string("%.0f", shown))
        text = F.concat(text, F.lit(f" {name}"))
        # A value belongs to the first unit whose rounded figure stays below 1024; the last unit takes the rest.
        out = text if name == "TB" else F.when(shown < 1024, text).otherwise(out)
    return F.when(size < 0, None).when(size < 1024, F.concat(size.cast("string"), F.lit(f" {unit}"))).otherwise(out)


def timestamp_text(ts: Column, now: Column, lang: str = "en") -> Column:
    """"Just now", "Today, 8:05 AM", "Yesterday, ...", "Sep 22, 3:12 PM", with the year when it isn't now's."""
    seconds = F.abs(F.timestamp_diff("MICROSECOND", ts, now)) / 1e6
    names = F.array(*map(F.lit, MONTHS[lang]))
    month = F.element_at(names, F.month(ts))
    day = F.dayofmonth(ts).cast("string")
    if lang == "en":
        hour = F.when(F.hour(ts) % 12 == 0, 12).otherwise(F.hour(ts) % 12).cast("string")
        clock = F.concat(hour, F.lit(":"), F.lpad(F.minute(ts).cast("string"), 2, "0"), F.when(F.hour(ts) < 12, " AM").otherwise(" PM"))
        words, date, dated = ("Just now", "Today, ", "Yesterday, "), F.concat(month, F.lit(" "), day), F.concat(month, F.lit(" "), day, F.lit(", "), F.year(ts).cast("string"))
    else:
        clock = F.concat(F.lpad(F.hour(ts).cast("string"), 2, "0"), F.lit("."), F.lpad(F.minute(ts).cast("string"), 2, "0"))
        words, date, dated = ("Baru saja", "Hari ini, ", "Kemarin, "), F.concat(day, F.lit(" "), month), F.concat(day, F.lit(" "), month, F.lit(" "), F.year(ts).cast("string"))
    days = F.datediff(now, ts)
    return (
        F.when(seconds < 60, words[0]).when(days == 0, F.concat(F.lit(words[1]), clock)).when(days == 1, F.concat(F.lit(words[2]), clock))
        .when(F.year(ts) == F.year(now), F.concat(date, F.lit(", "), clock)).otherwise(F.concat(dated, F.lit(", "), clock))
    )


def short_number(v: Column, dot: str = ".") -> Column:
    """At most one decimal: "4", "3.5"."""
    tenths = F.floor(v * 10.0 + 0.5).cast("long")
    whole = F.floor(tenths / 10).cast("long")
    return F.when(tenths % 10 == 0, whole.cast("string")).otherwise(F.concat(whole.cast("string"), F.lit(dot), (tenths % 10).cast("string")))


def scale_text(v: Column, dot: str = ".") -> Column:
    return F.concat(short_number(v, dot), F.lit("×"))


def percent_text(v: Column) -> Column:
    return F.concat(F.floor(v * 100.0 + 0.5).cast("long").cast("string"), F.lit("%"))


def dimensions_text(w: Column, h: Column) -> Column:
    return F.concat(w.cast("string"), F.lit(" × "), h.cast("string"))


def megapixels_text(pixels: Column, dot: str = ".") -> Column:
    tenths = F.floor(pixels.cast("double") / 1e6 * 10.0 + 0.5).cast("long")
    return F.concat(F.floor(tenths / 10).cast("long").cast("string"), F.lit(dot), (tenths % 10).cast("string"), F.lit(" MP"))


def duration_text(seconds: Column) -> Column:
    """"< 1 second", "7 seconds", "2 min 5 sec", "1 h 20 min": rounded to whole seconds before the unit is chosen."""
    total = F.floor(seconds + 0.5).cast("long")
    part = lambda by, of: F.floor(total / by).cast("long") if of is None else F.floor((total % of) / by).cast("long")
    return (
        F.when(seconds < 1, "< 1 second").when(total < 60, F.concat(total.cast("string"), F.lit(" seconds")))
        .when(total < 3600, F.concat(part(60, None).cast("string"), F.lit(" min "), (total % 60).cast("string"), F.lit(" sec")))
        .otherwise(F.concat(part(3600, None).cast("string"), F.lit(" h "), part(60, 3600).cast("string"), F.lit(" min")))
    )


def pick_language(tags: Column, supported: tuple[str, ...] = ("en", "id"), default: str = "en") -> Column:
    """The first tag whose primary subtag is supported; "in" is the old name of "id"."""
    primary = F.transform(tags, lambda t: F.lower(F.split(F.trim(t), "[-_]")[0]))
    known = F.filter(F.transform(primary, lambda p: F.when(p == "in", "id").otherwise(p)), lambda p: p.isin(*supported))
    return F.coalesce(F.get(known, F.lit(0)), F.lit(default))


def fill(template: Column, *arguments: Column) -> Column:
    """{0}, {1}, ... replaced by the arguments."""
    for k, a in enumerate(arguments):
        template = F.replace(template, F.lit(f"{{{k}}}"), F.coalesce(a, F.lit("")))
    return template


def clean_device_name(name: Column, architecture: Column) -> Column:
    """A CPU's name with single blanks; the architecture where there is none."""
    tidy = F.trim(F.regexp_replace(name, r"\s+", " "))
    return F.coalesce(F.when(tidy != "", tidy), architecture)
