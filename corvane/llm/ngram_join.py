"""N-gram Jaccard join by parity sketches.

Every shingle toggles one bit of a sparse bit sketch of p pieces of 2**20 bits, chosen by its hash, so the Hamming distance
of two sketches never exceeds the symmetric difference of their sets. Two sets of sizes a <= n with a Jaccard similarity of
3/4 or more differ in d <= (a + n) / 7 <= a / 3 shingles, hence in at most d pieces, and by the pigeonhole principle agree on any
d + 1 pieces but d. Sketches are joined per size band on the content of their first pieces, and agreeing pairs are verified on
the sets themselves.

Bands are [2^k, 2^(k+1)); a set within a third above its band's lower end is also keyed in the band below, so any two sizes that
can be linked meet in a band. A set of size s keys its first t(s) pieces, t rising with s, so a pair shares the keys of the
smaller one. Shingles that many sets share (counted over the whole corpus, the `max_common` most frequent) are left out of
the sketches: what remains still bounds the distance from below, and documents with a passage in common no longer meet. A
set that then lacks pieces with shingles for the pigeonhole, for any partner size below or above its own, is keyed once
more by its whole set, and if that lacks some too, by its empty pieces as well; of two linked sets either one has enough for
the other, or both are keyed so. Which shingles are left out changes the cost, never a result: the join is exact.

Documents with equal sets (64 bits of the sorted set) are one class: keys, buckets and links know classes only, so copies cost
nothing there. See linking.py for how buckets become components without the pairs of a group.

Defined cases: texts without words are empty and linked with nothing, null texts too; rows with a null doc_id are not compared
and have no component; every row is a document of its own, so rows of one doc_id share links only if their texts do; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, lean, stored
from .linking import Likeness, blocks, link_components, sketch
from .shingles import common, mix64, shingle_sets

_U = np.uint64
_SEEN = 1_000_000
#: Up to so many classes (16 bytes each) are broadcast to find their texts, more are shuffled.
_BROADCAST = 1_000_000
#: A shingle that so many different sets of a batch share is counted over the corpus.
_OFTEN = 4


def pieces_of(band: int) -> int:
    """Number of pieces of a band's sketch: a twelfth more than its largest distance needs."""
    return -(-(2 << band) * 28 // 75) + 4


def _needed(band: int, made: dict = {}) -> np.ndarray:  # noqa: B006  a table per band, kept
    """How many pieces each size of the band keys."""
    if band not in made:
        s = np.arange(1 << band, 2 << band)
        p = pieces_of(band)
        t = (s // 3 + 1) / (1 - np.exp(-s / p)) * 1.03
        made[band] = np.maximum.accumulate(np.minimum(p, np.ceil(t + np.sqrt(t) + 2)).astype(np.int64))
    return made[band]


def band_keys(found: np.ndarray, size: int, band: int, salt: int) -> tuple[np.ndarray, bool]:
    """The keys of what is sketched of a set of some size, in its own band or the one below, and whether they suffice.

    They do if, for every partner size, smaller or larger, more of the pieces that both key hold shingles than a link lets differ.
    """
    p, low = pieces_of(band), 1 << band
    t_of = _needed(band)
    most = 4 * size // 3 if size < 2 * low else 2 * low - 1  # larger partners of the next band are keyed here too
    partners = np.arange(max(low, -(-3 * size // 4)), most + 1)
    t = int(t_of[min(size, 2 * low - 1) - low])
    piece = ((found >> _U(32)) * _U(p) >> _U(32)).astype(np.int64)
    upto = int(np.searchsorted(piece, t))
    piece, mine = piece[:upto], found[:upto]
    full, codes = np.zeros(0, np.int64), np.zeros(0, _U)
    if upto:
        starts = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
        full = piece[starts]
        bit = (piece.astype(_U) << _U(20)) | (mine & _U(0xFFFFF))
        codes = np.bitwise_xor.reduceat(mix64(bit + _U(1)), starts)
    enough = bool((np.searchsorted(full, t_of[np.minimum(partners, size) - low]) >= (partners + size) // 7 + 1).all())
    if salt and not enough:  # of whole sets, then, empty pieces are keyed too
        empty = np.setdiff1d(np.arange(t), full)
        full, codes = np.append(full, empty), np.append(codes, np.zeros(len(empty), _U))
    mark = _U(((2 * band + salt + 1) * 0x165667B19E3779F9) & 0xFFFFFFFFFFFFFFFF)
    return mix64(codes + full.astype(_U) * _U(0xC2B2AE3D27D4EB4F) + mark).view(np.int64), enough


def keys_of(found: np.ndarray, common_ones: np.ndarray) -> np.ndarray:
    """All keys of a set. Sizes 1 and 2 are linked with equal sets only."""
    n = len(found)
    if n <= 2:
        return np.zeros(0, np.int64)
    rare = found[~_among(found, common_ones)]
    top = n.bit_length() - 1
    out = []
    for band in (top, top - 1) if 3 * n < 4 << top else (top,):
        keys, enough = band_keys(rare, n, band, 0)
        out.append(keys)
        if not enough:
            out.append(band_keys(found, n, band, 1)[0])
    return np.concatenate(out)


def _among(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(x), bool)
    at = np.searchsorted(of, x)
    at[at == len(of)] = 0
    return of[at] == x


def class_of(found: np.ndarray) -> int:
    """64 bits of the sorted set: documents with equal sets are one class."""
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


_OFTEN_TYPE = pa.list_(pa.struct([("shingle", pa.int64()), ("n", pa.int64())]))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, class and sketch of every text's set; on each batch's last row the batch's frequent shingles."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("class", pa.int64()), ("sketch", pa.binary()), ("mark", pa.int64()), ("often", _OFTEN_TYPE)])
    for batch in batches:
        n, classes, sketches, seen, sets, counted = [], [], [], set(), [], []
        held = 0

        def count() -> None:
            if sets:
                values, times = np.unique(np.concatenate(sets), return_counts=True)
                counted.append((values[times >= _OFTEN], times[times >= _OFTEN]))
                sets.clear()

        for found in shingle_sets(batch.column(1)):
            n.append(len(found))
            classes.append(class_of(found) if len(found) else None)
            sketches.append(sketch(found))
            if classes[-1] is not None and classes[-1] not in seen:
                seen.add(classes[-1])
                sets.append(found)
                held += len(found)
                if held > 1_000_000:
                    count()
                    held = 0
        count()
        none = np.zeros(0, _U)
        each = pa.StructArray.from_arrays([pa.array(np.concatenate([none, *(v for v, _ in counted)]).view(np.int64)), pa.array(np.concatenate([none, *(t for _, t in counted)]).astype(np.int64))], ["shingle", "n"])
        ends = np.zeros(len(n) + 1, np.int32)
        ends[-1] = len(each)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(classes, pa.int64()), pa.array(sketches, pa.binary()), batch.column(2), pa.ListArray.from_arrays(ends, each)], schema=schema)


def _keyed(common_ones: np.ndarray):
    """(key, class, n) of every class that this task hasn't keyed yet."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("n", pa.int32())])

    def rows(keys: list, owner: list, size: list) -> pa.RecordBatch:
        n = [len(k) for k in keys]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(np.array(owner, np.int64), n)), pa.array(np.repeat(np.array(size, np.int32), n))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, owner, size, held = [], [], [], 0
            for i, found in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1)), strict=True):
                if i is None or len(found) < 3 or (mark := class_of(found)) in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()  # a class may then be keyed again, which changes nothing
                seen.add(mark)
                keys.append(keys_of(found, common_ones))
                owner.append(mark)
                size.append(len(found))
                held += len(keys[-1])
                if held > 200_000:
                    yield rows(keys, owner, size)
                    keys, owner, size, held = [], [], [], 0
            if keys:
                yield rows(keys, owner, size)

    return run


def slack(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The greatest symmetric difference of linked sets of these sizes."""
    return (n.astype(np.int64) + m) // 7


def fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be linked."""
    return 4 * np.minimum(a, b).astype(np.int64) >= 3 * np.maximum(a, b).astype(np.int64)


def linked(x: bytes, y: bytes) -> bool:
    a, b = np.frombuffer(x, _U), np.frombuffer(y, _U)
    both = common(a, b)
    return 100 * both >= 75 * (len(a) + len(b) - both) > 0


LIKENESS = Likeness(fits, linked, lambda body: np.frombuffer(body, _U), slack)


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, set) of texts; of rows that share a doc_id but not a text only those of the class that is asked for."""
    schema = pa.schema([("id", pa.int64()), ("body", pa.binary())])
    for whole in batches:
        for k in range(0, whole.num_rows, 500):
            batch = whole.slice(k, 500)
            found = list(shingle_sets(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() if class_of(x) == c else None for x, c in zip(found, batch.column(0).to_pylist(), strict=True)], pa.binary())], schema=schema)


def _grouped(docs: DataFrame, id_col: str, text_col: str, max_common: int) -> DataFrame:
    """(id, mark, n, component_id, grp) of every row; mark is xxhash64 of the text, grp tells groups of linked rows apart."""
    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    sets = stored(slim.mapInArrow(lean(_measure), "id long, n long, class long, sketch binary, mark long, often array<struct<shingle:long,n:long>>"), "sets")
    often = sets.select(F.explode("often").alias("o")).groupBy("o.shingle").agg(F.sum("o.n").alias("n")).where(F.col("n") >= 4 * _OFTEN)
    often = often.orderBy(F.desc("n"), "shingle").limit(max_common).select("shingle").toArrow().column(0).to_numpy().astype(np.int64)
    named = sets.where("id is not null and n > 0")
    classes = named.groupBy("class").agg(F.min("id").alias("rep"), F.first("n").cast("int").alias("n"), F.first("sketch").alias("sketch"))
    classes = stored(classes, "classes")
    repeated = named.groupBy("class", "id").count().where("count > 1").limit(1).count() > 0

    def bodies(ids: DataFrame) -> DataFrame:
        asked = classes.select(F.col("class").alias("id"), "rep").join(ids, "id").select(F.col("rep").alias("id"), F.col("id").alias("class"))
        asked = F.broadcast(asked) if ids.count() <= _BROADCAST else asked
        found = slim.join(asked, "id").select("class", "text").mapInArrow(lean(_bodies), "id long, body binary").where("body is not null")
        return found.dropDuplicates(["id"]) if repeated else found

    keys = blocks(slim.select("id", "text"), _keyed(np.sort(often.view(_U))))
    found = link_components(keys, LIKENESS, bodies, classes.select(F.col("class").alias("id"), "n", "sketch"))
    told = classes.select("class", "rep").join(found.withColumnRenamed("id", "class"), "class", "left").withColumn("grp", F.coalesce("component_id", "class"))
    heads = told.groupBy("grp").agg(F.min("rep").alias("head"))
    told = told.join(heads, "grp").select("class", "grp", "head")
    return sets.join(told, "class", "left").select("id", "mark", "n", F.when(F.col("id").isNotNull(), F.coalesce("head", "id")).alias("component_id"), "grp")


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_common: int = 500_000) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id. `max_common` bounds the broadcast of common shingles."""
    return _grouped(docs, id_col, text_col, max_common).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_common: int = 500_000) -> DataFrame:
    """`docs` with one row of every group of linked rows, that with the smallest id (then the smallest hash of the text).

    Rows that agree in id and text are one; rows without words or without an id are linked with nothing and stay.
    """
    heads = _grouped(docs, id_col, text_col, max_common).where("grp is not null").groupBy("grp").agg(F.min(F.struct("id", "mark")).alias("h"))
    heads = heads.select(F.col("h.id").alias("_corvane_id"), F.col("h.mark").alias("_corvane_mark"))
    text = F.col(text_col).cast("string")
    marked = docs.select("*", F.col(id_col).cast("long").alias("_corvane_id"), F.xxhash64(text).alias("_corvane_mark"), F.coalesce(F.col("_corvane_id").isNotNull() & text.rlike(f"[^{SPACE}]"), F.lit(False)).alias("_corvane_set"))
    at = Window.partitionBy("_corvane_id", "_corvane_mark").orderBy("_corvane_mark")
    one = marked.where("_corvane_set").join(heads, ["_corvane_id", "_corvane_mark"], "left_semi").withColumn("_corvane_at", F.row_number().over(at)).where("_corvane_at = 1")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return one.select(*columns).unionByName(marked.where("not _corvane_set").select(*columns))
