"""Histories, journals, settings, progress and the small rules of a screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Failure -> message; these come before any rule about the stage.
_MESSAGES = {
    "ChunkMismatch": "ChunkMismatch", "LengthMismatch": "LengthMismatch", "FileHashMismatch": "HashMismatch", "InvalidOutput": "CannotReopen",
    "FileNotFound": "SourceMissing", "DirectoryNotFound": "FolderMissing", "UnauthorizedAccess": "NoWriteAccess", "SameFile": "SameFile", "LockedPdf": "LockedPdf",
    "NothingToTrace": "NothingToTraceImage", "NothingToConvert": "NothingToConvertPdf", "UnsupportedCad": "UnsupportedCad", "ExternalTool": "ExternalTool",
}

# Bounds of a stage's share of the whole progress.
_BOUNDS = (0.0, 0.35, 0.70, 0.90, 1.0)


def error_key(kind: Column, decoding: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in _MESSAGES.items() for x in pair])
    return F.concat(F.lit("Error."), F.coalesce(F.try_element_at(known, kind), F.when(decoding, "Decode").when(kind == "Io", "Io").otherwise("Unexpected")))


def newest_first(history: DataFrame, seq: str) -> DataFrame:
    return history.orderBy(F.desc(seq))


def recorded(log: DataFrame, key: str, seq: str, action: str) -> DataFrame:
    """The entries a history holds: what was added while it was enabled and after its last clearing.

    `action` is add, clear, enable or disable, in the order of `seq`; the newest entry has rank 1.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(seq)
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    on = F.coalesce(F.last(F.when(F.col(action).isin("enable", "disable"), F.col(action)), ignorenulls=True).over(upto), F.lit("enable")) == "enable"
    cleared = F.count_if(F.col(action) == "clear").over(w.rowsBetween(1, Window.unboundedFollowing))
    kept = log.withColumn("_on", on).withColumn("_late", cleared).where((F.col(action) == "add") & F.col("_on") & (F.col("_late") == 0))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))).drop("_on", "_late")


def latest(rows: DataFrame, key: list[str], value: str, seq: str) -> DataFrame:
    """The value of the latest request per key; stale answers lose. One partial aggregation, no sort."""
    return rows.groupBy(*key).agg(F.max_by(value, seq).alias(value))


def settings(log: DataFrame, store: str, key: str, value: str, seq: str) -> DataFrame:
    """(store, key, value): the last write wins and a null write removes."""
    last = log.groupBy(store, key).agg(F.max_by(F.struct(F.col(value).alias("v")), seq).alias("_last"))
    return last.where("_last.v is not null").select(store, key, F.col("_last.v").alias(value))


def stale_files(pending: DataFrame, running: DataFrame, entry: str, suffix: str) -> DataFrame:
    """(entry, delete_file, drop_entry) of journal entries that nothing holds: only an absolute path with the suffix is deleted."""
    free = pending.join(running, entry, "left_anti")
    ours = F.col("path").rlike("^(/|[A-Za-z]:\\\\)") & F.lower("path").endswith(suffix)
    gone = ours & F.col("present")
    return free.select(entry, gone.alias("delete_file"), (~(gone & F.col("refused"))).alias("drop_entry"))


def overall(stage: Column, fraction: Column) -> Column:
    """Progress of the whole from a stage (0 to 3) and its fraction; a fraction that isn't a number counts as none."""
    f = F.when(F.isnan(fraction), 0.0).otherwise(F.least(F.greatest(fraction, F.lit(0.0)), F.lit(1.0)))
    bounds = F.array(*map(F.lit, _BOUNDS))
    low = F.element_at(bounds, stage + 1)
    return low + (F.element_at(bounds, stage + 2) - low) * f


def step_state(step: Column, current: Column, complete: Column) -> Column:
    return F.when((step < current) | complete, "Done").when(step == current, "Active").otherwise("Waiting")


def dropped(files: Column, folders: Column, path: Column) -> Column:
    """What a drop of files and folders means."""
    return F.when((files == 0) & (folders > 0), "Folder").when(files + folders > 1, "Many").when(files == 0, "Nothing").when(F.coalesce(path, F.lit("")) == "", "Unreadable").otherwise("Select")


def can_convert(state: Column, source: Column, enabled: Column, drawing: Column, kind: Column, scale: Column) -> Column:
    """Input state, a source, an enabled target and, for drawings, a page that holds something and a scale of 1 or more."""
    good = F.coalesce((kind != "Empty") & (scale >= 1) & ~F.isnan(scale) & (scale < float("inf")), F.lit(False))
    return (state == "Input") & source.isNotNull() & F.coalesce(enabled, F.lit(False)) & (~drawing | good)


def options(target: Column, page: Column, unit: Column, scale: Column, keep_text: Column, scan: Column, join: Column) -> Column:
    """What a target takes of the options, as text: all for drawings, the page for pictures, null for others."""
    drawing = F.concat_ws(";", page.cast("string"), unit, scale.cast("string"), (keep_text & ~scan).cast("string"), join.cast("string"))
    return F.when(target.isin(".dxf", ".dwg"), drawing).when(target.isin(".png", ".jpg", ".heic"), page.cast("string"))


def with_extension(name: Column, target: Column) -> Column:
    """A typed name gets the target's extension unless it has it."""
    return F.when(F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1)) == target, name).otherwise(F.concat(name, target))


def missing_file(file_exists: Column, folder_exists: Column) -> Column:
    return F.when(file_exists, "ShowFile").when(folder_exists, "ShowFolder").otherwise("Message")
