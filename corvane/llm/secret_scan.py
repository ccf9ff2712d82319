"""Secret scans with corpus-wide ownership frequency.

A pass over whole texts finds the base spans (assign, access, hex) and looser candidates: long mixed tokens. Values leave
that pass only as SHA-256. Their distinct repositories and distinct owners are counted over the whole corpus, each in two
steps, so a value that a third of all rows share meets its counter as one row per repository or owner. Values of `min_owners` owners or more, or of
`min_repositories` repositories or more whatever their owners, are widely copied examples; other values of enough entropy
look live. A loose candidate becomes a span (kind live) only if it is no such example; base spans always stay.

Defined cases: a null text is empty; a null owner is an owner of its own; offsets are code points, ends exclusive; repeated
rows are scanned each for itself; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, stored

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LOOSE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
_HINTS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "live")

_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.binary()), ("bits", pa.float64())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("owner", pa.string()), ("repository", pa.string()), ("base", pa.list_(_SPAN)), ("loose", pa.list_(_SPAN))])
_DDL_SPAN = "array<struct<start int, kind int, end int, value binary, bits double>>"


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) by start, then kind."""
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def loose_spans(text: str, base: list[tuple], min_bits: float) -> list[tuple[int, int, int, str]]:
    """Long tokens with letters and at least two digits that no base span touches."""
    found = []
    for m in LOOSE.finditer(text):
        v = m[0]
        if sum(map(str.isdigit, v)) < 2 or v.isdigit() or entropy(v) < min_bits or any(a < m.end() and m.start() < b for a, _, b, _ in base):
            continue
        found.append((m.start(), 3, m.end(), v))
    return found


def _scan(min_bits: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = lambda spans: [{"start": a, "kind": k, "end": b, "value": hashlib.sha256(v.encode()).digest(), "bits": entropy(v)} for a, k, b, v in spans]
        for batch in batches:
            base, loose = [], []
            for value in batch.column(3):
                text = value.as_py() or ""
                found = base_spans(text)
                base.append(hashed(found))
                loose.append(hashed(loose_spans(text, found, min_bits)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(base, _SCHEMA.field("base").type), pa.array(loose, _SCHEMA.field("loose").type)], schema=_SCHEMA)

    return run


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str | None = None, min_owners: int = 3, min_bits: float = 3.0, min_repositories: int = 10) -> DataFrame:
    """(doc_id, base, added, n_live, n_example, repositories) per row; base and added are arrays of (start, kind, end, value, bits).

    `repositories` is the largest number of distinct repositories that any value of the row's base spans and candidates has.

    `repository_col` names the unit of copying; by default every document is its own.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), F.col(repository_col or id_col).cast("string").alias("repository"), F.col(text_col).cast("string").alias("text"))
    found = slim.mapInArrow(lean(_scan(min_bits)), f"doc_id long, owner string, repository string, base {_DDL_SPAN}, loose {_DDL_SPAN}")
    found = stored(found.withColumn("row_id", F.monotonically_increasing_id()), "secrets")
    each = found.select("row_id", "owner", "repository", F.explode(F.concat("base", "loose")).alias("s")).select("row_id", "owner", "repository", "s.*")
    # Distinct pairs first: a value copied into a third of all rows is a few rows per task from then on.
    count = lambda unit, name: each.groupBy("value", unit).agg(F.count(F.lit(1)).alias("n")).groupBy("value").agg(F.count(F.lit(1)).alias(name))
    owned = count("repository", "repositories").join(count("owner", "owners"), "value")
    copied = (F.col("owners") >= min_owners) | (F.col("repositories") >= min_repositories)
    live = ~copied & (F.col("bits") >= min_bits)
    span = F.struct("start", "kind", "end", "value", "bits")
    told = each.drop("owner", "repository").join(owned, "value").groupBy("row_id").agg(
        F.collect_list(F.when((F.col("kind") == 3) & live, span)).alias("added"),
        F.count_if((F.col("kind") < 3) & live).alias("n_live"), F.count_if((F.col("kind") < 3) & copied).alias("n_example"), F.max("repositories").alias("repositories"),
    )
    return found.join(told, "row_id", "left").select(
        "doc_id", "base", F.coalesce("added", F.array().cast(_DDL_SPAN)).alias("added"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"),
        F.coalesce("repositories", F.lit(0)).alias("repositories"),
    )


def secret_query(docs: DataFrame) -> DataFrame:
    out = secret_scan(docs)
    named = lambda c: F.array_join(F.transform(F.array_sort(c), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(named(F.col("base")), 256).alias("base_sha256"),
        named(F.concat("base", "added")).alias("spans"), "n_live", "n_example", "repositories",
    )
