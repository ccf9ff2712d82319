"""Fuzzy line deduplication by MinHash.

Lines are split at line feeds and stripped of white space at their ends; blank ones are left alone. Equal lines share a content
id. Every distinct line's set of character shingles (six code points) gives a one-permutation MinHash signature, empty bins
filled by rotation, in 14 bands of 4; lines that agree on a band meet, and the Jaccard similarity of their shingle sets is
verified exactly (3/4 or more). Distributed union-find joins the links; of each component one line stays, its first in the order of
(doc_id, line number). See linking.py for how bands become components without the pairs of a group.

Two lines of similarity s meet with probability 1 - (1 - s^4)^14: 0.995 at 0.75, 0.9993 at 0.8, 0.99999 at 0.88.

Defined cases: a null text stays null and has no lines; rows that agree in doc_id and text share one decision; a null doc_id
comes after all others; an empty table gives an empty result; other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngram_join
from .common import stored
from .linking import Likeness, blocks, link_components, only
from .shingles import char_shingles, folded, mix64, sorted_set

_U = np.uint64
WIDTH, BANDS, ROWS = 6, 14, 4
_BINS = BANDS * ROWS
#: Code points of a block of lines; a line's row in it has 20 bits.
_BLOCK = 1 << 17
_SEEN = 250_000
#: Bytes of the lines of pairs that are compared at once.
_PAIRS = 1 << 17
#: Bits of the largest sketch of a line.
_MOST_BITS = 1 << 16
_STRIP = " \t\n\x0b\x0c\r"
#: The seed of Spark's xxhash64, so a line has one id in Python and in SQL.
_SEED = 42


def signatures(lines: list[str]) -> np.ndarray:
    """A row of bin minima for every line (one-permutation hashing); empty bins take the next full one's value."""
    return _signed(lines)[0]


def _signed(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The signatures, and the size of each line's set: 0 (not known) for lines with code points that are folded."""
    lines = [x.ljust(WIDTH, "\0") for x in lines]  # a shorter line is one shingle
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.array([len(x) for x in lines])
    ends = np.cumsum(length)
    high = np.maximum.reduceat(points, ends - length) > 1023
    # Ten bits a code point, exact below 1024: six of them are one number.
    points = ((points ^ (points >> np.uint32(10)) * np.uint32(37)) & np.uint32(1023)).astype(_U)
    two = points[:-1] | points[1:] << _U(10)
    inside = np.ones(len(points), bool)
    for k in range(1, WIDTH):
        inside[ends - k] = False
    packed = (two[:-4] | two[2:-2] << _U(20) | two[4:] << _U(40))[inside[: 1 - WIDTH]]
    packed *= _U(0x9E3779B97F4A7C15)
    packed ^= packed >> _U(32)
    packed *= _U(0xD6E8FEB86659FD93)
    packed ^= packed >> _U(29)
    slot = ((packed >> _U(32)) * _U(_BINS) >> _U(32)) << _U(38)
    packed &= _U((1 << 38) - 1)
    packed |= slot
    packed |= np.repeat(np.arange(len(lines), dtype=_U) << _U(44), length - WIDTH + 1)
    packed.sort()
    own = (packed[np.concatenate(([True], packed[1:] != packed[:-1]))] >> _U(44)).astype(np.int64)
    size = np.where(high, 0, np.bincount(own, minlength=len(lines)))
    at = packed >> _U(38)
    head = np.concatenate(([True], at[1:] != at[:-1]))
    at = ((at >> _U(6)) * _U(_BINS) + (at & _U(63)))[head].astype(np.int64)
    flat = np.zeros(len(lines) * _BINS, _U)
    full = np.zeros(len(lines) * _BINS, bool)
    flat[at], full[at] = (packed[head] & _U((1 << 38) - 1)) + _U(1), True
    # An empty bin takes the next full one's value, marked with the distance.
    full = full.reshape(-1, _BINS)
    nxt = np.where(np.concatenate([full, full], axis=1), np.arange(2 * _BINS, dtype=np.int32), np.int32(4 * _BINS))
    nxt = np.minimum.accumulate(nxt[:, ::-1], axis=1)[:, ::-1][:, :_BINS]
    step = nxt - np.arange(_BINS, dtype=np.int32)
    return np.take_along_axis(flat.reshape(-1, _BINS), nxt % _BINS, axis=1) + step.astype(_U) * _U(0x9E3779B97F4A7C15), size


def band_keys(sig: np.ndarray) -> np.ndarray:
    """Rows of BANDS keys."""
    x = sig.reshape(-1, BANDS, ROWS)
    out = np.zeros(x.shape[:2], _U)
    for k in range(ROWS):
        out = mix64(out + x[:, :, k])
    return mix64(out + np.arange(1, BANDS + 1, dtype=_U) * _U(0xC2B2AE3D27D4EB4F)).view(np.int64)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, size of the set or 0) of every line that this task hasn't keyed yet."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("n", pa.int32())])

    def keyed(lines: list[str], ids: list[int]) -> pa.RecordBatch:
        found, sizes = _signed(lines)
        ids = np.repeat(np.array(ids, _U).view(np.int64), BANDS)
        return pa.RecordBatch.from_arrays([pa.array(band_keys(found).ravel()), pa.array(ids), pa.array(np.repeat(sizes, BANDS).astype(np.int32))], schema=schema)

    seen: set[int] = set()
    lines, ids, size = [], [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            for text in batch.column(0).slice(k, 256).to_pylist():
                for line in (text or "").split("\n"):
                    line = line.strip(_STRIP)
                    if not line or (i := xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), _SEED)) in seen:
                        continue
                    if len(seen) >= _SEEN:
                        seen.clear()  # a line may then be keyed again, which changes nothing
                    seen.add(i)
                    lines.append(line)
                    ids.append(i)
                    size += max(len(line), WIDTH)
                    if size >= _BLOCK:
                        yield keyed(lines, ids)
                        lines, ids, size = [], [], 0
    if lines:
        yield keyed(lines, ids)


def _lines(docs: DataFrame, *columns: str) -> DataFrame:
    """(*columns, line_no, line) of the non-blank lines of `text`."""
    each = docs.select(*columns, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return each.withColumn("line", F.btrim("line", F.lit(_STRIP))).where("line <> ''")


@lru_cache(256)
def _set(line: bytes) -> frozenset:
    """A line's shingles themselves; pairs of one line come after one another."""
    text = line.decode("utf-8", "surrogatepass")
    return frozenset([text[k : k + WIDTH] for k in range(max(1, len(text) - WIDTH + 1))])


def linked(x: bytes, y: bytes) -> bool:
    a, b = _set(x), _set(y)
    both = len(a & b)
    return 4 * both >= 3 * (len(a) + len(b) - both) > 0


def _hashed(lines: list[str]) -> np.ndarray:
    """Of fewer than 2^20 lines the distinct shingles, sorted: the line's place and 44 bits of a hash; two shingles may collide."""
    lines = [z.ljust(WIDTH, "\0") for z in lines]
    length = np.array([len(z) for z in lines])
    inside, ends = np.ones(int(length.sum()), bool), np.cumsum(length)
    for at in range(1, WIDTH):
        inside[ends - at] = False
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    value = folded(mix64(points + _U(1)), WIDTH)[inside[: 1 - WIDTH]] >> _U(20)
    return sorted_set(value | np.repeat(np.arange(len(lines), dtype=_U) << _U(44), length - WIDTH + 1))


def sketched_rows(column: pa.Array) -> tuple[list[int], list[bytes]]:
    """The set sizes and parity sketches of lines, many at once: a power of two of bits, one to two a member, 64 at least."""
    sizes, sketches = [], []
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, side="right")))
        each = _hashed([z.decode("utf-8", "surrogatepass") for z in column.slice(at, to - at).to_pylist()])
        row = (each >> _U(44)).astype(np.int64)
        size = np.bincount(row, minlength=to - at)
        bits = np.array([min(_MOST_BITS, max(64, 1 << (n - 1).bit_length())) for n in size.tolist()])
        start = np.cumsum(bits) - bits
        odd = np.bincount(start[row] + (each.astype(np.int64) & (bits - 1)[row]), minlength=int(bits.sum())) & 1
        packed = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
        sizes += size.tolist()
        sketches += [packed[a : a + n] for a, n in zip((start >> 3).tolist(), (bits >> 3).tolist(), strict=True)]
        at = to
    return sizes, sketches


def slack(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The greatest symmetric difference of linked lines, and two more for a shingle that collides with another of its line."""
    return ngram_join.slack(n, m) + 2


def _maybe(x: list[str], y: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of lines hashes of their shingles don't rule out, and which they prove; two shingles may collide."""
    k = len(x)
    each = _hashed(x + y)
    row = (each >> _U(44)).astype(np.int64)
    size = np.bincount(row, minlength=2 * k)
    each = np.sort(each & _U((1 << 44) - 1) | (row % k).astype(_U) << _U(44))
    both = np.bincount((each[1:][each[1:] == each[:-1]] >> _U(44)).astype(np.int64), minlength=k)
    every = size[:k] + size[k:]
    return 4 * (both + 2) >= 3 * (every - both - 2), 4 * (both - 2) >= 3 * (every - both + 2)


def linked_rows(x: pa.Array, y: pa.Array) -> np.ndarray:
    """`linked` of every row: hashes decide on most pairs, the shingles themselves on those near the limit."""
    out = np.zeros(len(x), bool)
    ends = np.cumsum(pc.add(pc.binary_length(x), pc.binary_length(y)).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(x):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, side="right")))
        a, b = x.slice(at, to - at).to_pylist(), y.slice(at, to - at).to_pylist()
        may, sure = _maybe([z.decode("utf-8", "surrogatepass") for z in a], [z.decode("utf-8", "surrogatepass") for z in b])
        out[at:to] = sure
        for k in np.flatnonzero(may & ~sure).tolist():
            out[at + k] = linked(a[k], b[k])
        at = to
    return out


def fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether lines with sets of these sizes can be linked; 0 is a size that isn't known."""
    return ngram_join.fits(a, b) | (np.minimum(a, b) == 0)


LIKENESS = Likeness(fits, linked, lambda line: char_shingles(line, WIDTH), slack, linked_rows, sketched_rows)


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, line_no) of every line that goes; mark is xxhash64 of the text, line_no counts from 0."""
    text = F.col(text_col).cast("string")
    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    keys = blocks(slim.select("text"), _keyed)

    def bodies(ids: DataFrame) -> DataFrame:
        every = _lines(slim).select(F.xxhash64("line").alias("id"), F.col("line").cast("binary").alias("body"))
        # A line that very many rows have is one row per task from the first on.
        return only(every, ids).dropDuplicates(["id"])

    found = link_components(keys, LIKENESS, bodies)
    places = stored(_lines(slim, "doc_id", "mark").select("doc_id", "mark", "line_no", F.xxhash64("line").alias("id"), F.xxhash64(F.lit(7), "line").alias("id2")), "places")
    each = places.groupBy("id", "id2").agg(F.min(F.struct("doc_id", "line_no", "mark")).alias("first"), F.count(F.lit(1)).alias("n"))
    each = stored(each.join(found, "id", "left").where("n > 1 or component_id is not null").select("id", "id2", "first", "component_id"), "each")
    heads = each.where("component_id is not null").groupBy("component_id").agg(F.min("first").alias("head"))
    told = each.join(heads, "component_id", "left").select("id", "id2", F.coalesce("head", "first").alias("head"))
    return places.join(told, ["id", "id2"]).where("struct(doc_id, line_no, mark) <> head").select("doc_id", "mark", "line_no")


def _without(texts: pa.Array, gone: pa.Array) -> pa.Array:
    out = []
    for text, lines in zip(texts, gone, strict=True):
        if lines.as_py():
            drop = set(lines.as_py())
            out.append("\n".join([x for k, x in enumerate(text.as_py().split("\n")) if k not in drop]))
        else:
            out.append(text.as_py())
    return pa.array(out, pa.string())


def _marks(docs: DataFrame, id_col: str, text_col: str) -> tuple:
    return F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("_corvane_id"), F.xxhash64(F.col(text_col).cast("string")).alias("_corvane_mark")


def _told(marked: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`marked`, rows of `docs` with their _marks, with the numbers of the lines that go."""
    gone = duplicate_lines(docs, id_col, text_col).groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list("line_no")).alias("_corvane_gone"))
    gone = gone.select(F.col("doc_id").alias("_corvane_id"), F.col("mark").alias("_corvane_mark"), "_corvane_gone")
    return marked.join(gone, ["_corvane_id", "_corvane_mark"], "left").drop("_corvane_id", "_corvane_mark")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with only the kept lines in each text; the columns stay."""
    out = _told(docs.select("*", *_marks(docs, id_col, text_col)), docs, id_col, text_col)
    return out.withColumn(text_col, F.arrow_udf(_without, "string")(F.col(text_col).cast("string"), F.col("_corvane_gone"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def line_query(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the numbers of the lines that go, per row."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    n = F.coalesce(F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    marked = slim.select("doc_id", n.cast("long").alias("n_lines"), *_marks(slim, "doc_id", "text"))
    gone = F.coalesce("_corvane_gone", F.array().cast("array<int>"))
    return _told(marked, slim, "doc_id", "text").select("doc_id", "n_lines", F.size(gone).cast("long").alias("n_removed"), gone.alias("removed_lines"))
