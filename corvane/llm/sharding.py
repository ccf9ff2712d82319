"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get gapless numbers in the order of (doc_id, size, crc32); a keyed Feistel network over the next even power of two,
walked until it falls below the row count, permutes them; shard = permuted mod shards and slot = permuted div shards, so
shard counts differ by one at most and any row's place can be computed from its number, the count and the seed.

Defined cases: a null text has no bytes; null doc_ids come first; equal rows are interchangeable; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered

_ROUNDS = 6


def feistel(x: np.ndarray, half: int, seed: int) -> np.ndarray:
    """A permutation of [0, 4**half), elementwise."""
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for k in range(_ROUNDS):
        z = right + np.uint64((seed * 0x9E3779B97F4A7C15 + (k + 1) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        left, right = right, left ^ ((z ^ (z >> np.uint64(31))) & mask)
    return (left << np.uint64(half)) | right


def permute(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The permutation of [0, n) at `rows`: Feistel steps repeated until the value is below n."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    x = feistel(rows.astype(np.uint64), half, seed)
    while (out := x >= np.uint64(n)).any():
        x[out] = feistel(x[out], half, seed)
    return x.astype(np.int64)


def feistel_shards(docs: DataFrame, shards: int = 8, seed: int = 20240601, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, size, text_crc32, shard, slot, row_no. Only numbers are shuffled, never texts."""
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    rows, n = numbered(slim, "doc_id", "size", "text_crc32")

    @F.pandas_udf("long")
    def place(row_no: pd.Series) -> pd.Series:
        return pd.Series(permute(row_no.to_numpy(), n, seed))

    return rows.withColumn("_to", place("row_no")).select(
        "doc_id", "size", "text_crc32", (F.col("_to") % shards).cast("int").alias("shard"), F.expr(f"_to div {int(shards)}").alias("slot"), "row_no"
    )


def shard_query(docs: DataFrame) -> DataFrame:
    return feistel_shards(docs, 8).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
