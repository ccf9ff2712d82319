"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Two rotations are learned on a bounded sample of distinct unit vectors by alternating between the nearest binary codes and the
orthogonal map onto them; their signs give 128 bits. Eight tables of 16 bits hold every vector, keyed with one bit left out at
a time, so vectors meet that agree on some table up to one bit: by the pigeonhole principle all within 15 bits of each
other, and most beyond. A pair leaves only the first bucket in which it meets, if its codes are within `radius` bits, and
is reranked by the cosine of the original vectors in double precision. Nothing is capped.

Vectors with the same components are one weighted class before anything is indexed, so a group of copies is one vector.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do rows with a
null id; vectors of different lengths aren't compared; repeated rows are vectors of their own and link with each other; an
empty table gives an empty result; other columns (labels too) are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stored
from .linking import _runs

_U = np.uint64
_BITS, _CHUNK = 128, 16
_TABLES = _BITS // _CHUNK
_TILE = 512


def unit(values: list | None) -> np.ndarray | None:
    """The vector at length 1, or None if it links with nothing."""
    if not values or any(v is None for v in values):
        return None
    x = np.array(values, float)
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return None
    x = x / top + 0.0
    return x / np.sqrt((x * x).sum())


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("vec_id", pa.int64()), ("mark", pa.binary()), ("vector", pa.binary())])
    for batch in batches:
        ids, marks, vectors = batch.column(0).to_pylist(), [], []
        for i, v in zip(ids, batch.column(1).to_pylist(), strict=True):
            u = unit(v) if i is not None else None
            raw = None if u is None else (np.array(v, float) + 0.0).tobytes()
            marks.append(raw and hashlib.blake2b(raw, digest_size=16).digest())
            vectors.append(raw and u.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.binary()), pa.array(vectors, pa.binary())], schema=schema)


def learn_rotations(sample: np.ndarray, seed: int = 3, steps: int = 40) -> np.ndarray:
    """A matrix dims x 128 of independent rotations, each refined by iterative quantisation.

    Unit vectors are coded by direction, hence no centring: the angle of two vectors, which the cosine bounds, then sets the
    expected distance of their codes.
    """
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    _, _, axes = np.linalg.svd(sample, full_matrices=False)
    axes = axes[:64].T
    found, width = [], axes.shape[1]
    projected = sample @ axes
    while sum(x.shape[1] for x in found) < _BITS:
        turn, _ = np.linalg.qr(rng.standard_normal((width, width)))
        for _ in range(steps):
            codes = np.where(projected @ turn >= 0, 1.0, -1.0)
            a, _, b = np.linalg.svd(codes.T @ projected)
            turn = (a @ b).T
        found.append(axes @ turn)
    return np.concatenate(found, axis=1)[:, :_BITS].reshape(dims, _BITS)


def codes_of(vectors: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """Codes as rows of 8 uint16."""
    return np.packbits(vectors @ rotations >= 0, axis=1, bitorder="little").view(np.uint16)


def _indexed(models: dict[int, np.ndarray]):
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("code", pa.binary())])
    masks = ~(np.uint16(1) << np.arange(_CHUNK, dtype=np.uint16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for size, model in models.items():
                at = [k for k, v in enumerate(vectors) if len(v) == 8 * size]
                for lo in range(0, len(at), 2000):
                    part = at[lo : lo + 2000]
                    codes = codes_of(np.stack([np.frombuffer(vectors[k]) for k in part]), model)
                    slot = np.arange(_TABLES * _CHUNK, dtype=np.int64).reshape(_TABLES, _CHUNK) << 16
                    keys = (codes[:, :, None] & masks).astype(np.int64) + slot + (np.int64(size) << 32)
                    n = _TABLES * _CHUNK
                    raw = [c.tobytes() for c in codes]
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids[part], n)), pa.array([r for r in raw for _ in range(n)], pa.binary())], schema=schema)

    return run


def _met(radius: int):
    """Pairs of a bucket for which it is the first that they share."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches):
            key, ids = t.column(0).to_numpy(), t.column(1).to_numpy()
            codes = np.frombuffer(b"".join(t.column(2).to_pylist()), np.uint16).reshape(-1, _TABLES)
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            last = np.append(first[1:], len(key))
            out: list[list[np.ndarray]] = [[], []]
            size = 0
            for lo, hi in zip(first[last - first > 1].tolist(), last[last - first > 1].tolist(), strict=True):
                slot = (int(key[lo]) >> 16) & 0xFFFF
                table, bit = divmod(slot, _CHUNK)
                for x in range(lo, hi, _TILE):
                    for y in range(x, hi, _TILE):
                        a, b = codes[x : min(x + _TILE, hi)], codes[y : min(y + _TILE, hi)]
                        mine = a[:, None, table] ^ b[None, :, table]
                        ok = mine == (1 << bit) if bit else mine <= 1  # equal chunks meet at bit 0
                        if x == y:
                            ok &= np.triu(np.ones(ok.shape, bool), 1)
                        p, q = np.nonzero(ok)
                        for k in range(0, len(p), 1 << 18):
                            i, j = p[k : k + (1 << 18)], q[k : k + (1 << 18)]
                            apart = np.bitwise_count(a[i] ^ b[j])
                            near = (apart[:, :table] > 1).all(1) & (apart.sum(1, dtype=np.int64) <= radius)
                            u, v = ids[x + i[near]], ids[y + j[near]]
                            out[0].append(np.minimum(u, v))
                            out[1].append(np.maximum(u, v))
                            size += len(u)
                            if size > 100_000:
                                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], schema=schema)
                                out, size = [[], []], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], schema=schema)

    return run


def _reranked(least: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("wa", pa.int64()), ("wb", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            keep = np.zeros(batch.num_rows, bool)
            size = np.array([len(v) for v in x])
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                left, right = (np.frombuffer(b"".join([v[k] for k in at])).reshape(len(at), -1) for v in (x, y))
                keep[at] = np.einsum("ij,ij->i", left, right) >= least
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(4)], schema=schema).filter(pa.array(keep))

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, radius: int = 40, max_sample: int = 20_000) -> DataFrame:
    """One row per row of `vectors`: vec_id, n_links, component_id, kept.

    The rotations are fitted on at most `max_sample` distinct vectors, those with the smallest hashes of their components.
    """
    rows = vectors.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>"))
    rows = stored(rows.mapInArrow(_marked, "vec_id long, mark binary, vector binary"), "vectors")
    classes = rows.where("mark is not null").groupBy("mark").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("w"), F.first("vector").alias("vector"))
    classes = stored(classes, "classes")
    models = {}
    sizes = [r[0] for r in classes.select(F.octet_length("vector")).distinct().limit(65).collect()]
    if len(sizes) > 64:
        raise ValueError("more than 64 lengths of vectors")
    for n in sizes:
        got = classes.where(F.octet_length("vector") == n).orderBy(F.xxhash64("mark"), "mark").limit(max_sample).select("vector").collect()
        models[n // 8] = learn_rotations(np.stack([np.frombuffer(r[0]) for r in got]))
    keys = classes.select("id", "vector").mapInArrow(_indexed(models), "key long, id long, code binary")
    met = keys.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_met(radius), "a long, b long").distinct()
    one = met.join(classes.select(F.col("id").alias("a"), F.col("w").alias("wa"), F.col("vector").alias("x")), "a")
    both = one.join(classes.select(F.col("id").alias("b"), F.col("w").alias("wb"), F.col("vector").alias("y")), "b").select("a", "b", "wa", "wb", "x", "y")
    links = stored(both.mapInArrow(_reranked(least), "a long, b long, wa long, wb long"), "links")
    counts = links.select(F.col("a").alias("id"), F.col("wb").alias("w")).unionByName(links.select(F.col("b").alias("id"), F.col("wa").alias("w"))).groupBy("id").agg(F.sum("w").alias("others"))
    told = classes.select("mark", "id", "w").join(counts, "id", "left").join(components(links), "id", "left")
    told = told.select("mark", (F.col("w") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    out = rows.select("vec_id", "mark").join(told, "mark", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
