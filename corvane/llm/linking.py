"""From buckets that candidates share to verified links and components, without emitting the pairs of a group.

Every true link shares at least one bucket (exactly or with high probability, as the operator's keys provide). All of them are
decided, up to connectivity, in rows that grow with the rows of the buckets:

1. a bucket of fewer than `SMALL` ids gives its pairs, at most (SMALL - 2) / 2 a row; these are made distinct and verified;
2. of larger buckets that hold several components, every member is verified against the centre, in another component, that
   it meets most often; twice, with other centres;
3. buckets that are still mixed are compared inside tasks: rows stay that are in a pair of different components which small
   parity sketches of the sets don't rule out; of these, a pair that fine sketches let pass is proposed only if it joins what
   the bucket has not joined yet (a spanning forest, so at most a row a member), and verified;
4. members of pairs that pass the fine sketches even now get their sets, and the same forest is built on exact similarities.

A pair inside one component needs no test; any other pair that shares a bucket has been tested. A group of near copies is
settled by its stars, in as many rows as it has members. Buckets beyond `TILE` rows are dealt in tiles, members of
the largest component against all others and others among themselves, so a task holds two blocks of TILE rows at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, lean, stored
from .shingles import buffers, mix64

#: Buckets of fewer ids are expanded into pairs: a constant number a row.
SMALL = 8
#: Rows of a block of a large bucket.
TILE = 1024
_STEP = 512
_TURNS = 2
_U = np.uint64


@dataclass(frozen=True)
class Likeness:
    """What an operator knows of its candidates. A body is the bytes from which the set of a candidate is made."""

    #: Whether two set sizes can be linked (arrays).
    fits: Callable[[np.ndarray, np.ndarray], np.ndarray]
    #: Whether two bodies are linked, exactly.
    linked: Callable[[bytes, bytes], bool]
    #: The sorted hash set of a body.
    members: Callable[[bytes], np.ndarray]
    #: Greatest symmetric difference that a link of two sizes allows (arrays).
    slack: Callable[[np.ndarray, np.ndarray], np.ndarray]
    #: `linked` of two columns of bodies at once, if there is a faster way than one pair after another.
    linked_rows: Callable[[pa.Array, pa.Array], np.ndarray] | None = None
    #: The set sizes and `sketch` (a bit a member) of a column of bodies at once, if there is a faster way; a rare collision of
    #: members may be allowed for by `slack`.
    sketched_rows: Callable[[pa.Array], tuple[list[int], list[bytes]]] | None = None


def sketch(found: np.ndarray, bits_each: int = 1, most: int = 1 << 16) -> bytes:
    """A dense parity sketch: every member toggles one bit of a power of two of bits, bits_each to twice that a member."""
    bits = min(most, max(64, 1 << (bits_each * max(len(found), 1) - 1).bit_length()))
    odd = np.bincount((found & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches as rows of `width` bytes; larger ones are folded by XOR, which keeps the bound."""
    out = np.zeros((len(sketches), width), np.uint8)
    for k, s in enumerate(sketches):
        x = np.frombuffer(s, np.uint8)
        out[k] = x if len(x) == width else np.bitwise_xor.reduce(x.reshape(-1, width), axis=0)
    return out.view(_U)


def _apart(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Hamming distances of rows p of x and rows q of y, in bounded memory."""
    out = np.zeros(len(p), np.int64)
    step = max(1, (1 << 19) // x.shape[1])
    for k in range(0, len(p), step):
        out[k : k + step] = np.bitwise_count(x[p[k : k + step]] ^ y[q[k : k + step]]).sum(1, dtype=np.int64)
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables whose rows are whole runs of the first column, which must be sorted."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        key = now.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1])) if key[0] != key[-1] else 0  # the last run may go on
        if held and held[-1].column(0)[-1].as_py() != key[0]:
            yield pa.concat_tables(held).combine_chunks()
            held = []
        if cut:
            yield pa.concat_tables([*held, now.slice(0, cut)]).combine_chunks()
            held = []
        held.append(now.slice(cut))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _heads(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)


_MET = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32())])
#: A row of a bucket in a block.
_RECORD = np.dtype([("key", "<i8"), ("id", "<i8"), ("n", "<i4")])
#: Rows that are dealt to blocks at once, and rows of one slot that are held before its large buckets go out.
_DEALT, _HELD = 1 << 15, 1 << 19
#: Bytes of input a slot, and the least and most slots.
_SLOT_BYTES, _SLOTS = 1 << 20, (1 << 9, 1 << 22)


def _packed(keyed: Callable, slots: int):
    """The rows (key, id, n) of `keyed` as blocks (slot, rows): a key's rows are all of one slot, a power of two of them."""
    bits = slots.bit_length() - 1
    schema = pa.schema([("slot", pa.int64()), ("rows", pa.binary())])

    def block(held: list) -> pa.RecordBatch:
        key, ids, n = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in range(3))
        slot = mix64(key.view(_U)) >> _U(64 - bits)
        order = np.argsort(slot, kind="stable")
        slot = slot[order].view(np.int64)
        rows = np.empty(len(key), _RECORD)
        rows["key"], rows["id"], rows["n"] = key[order], ids[order], n[order]
        first = _heads(slot)
        ends = (np.append(first, len(slot)) * _RECORD.itemsize).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(slot[first]), pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(rows)])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in keyed(batches):
            for k in range(0, whole.num_rows, _DEALT):
                held.append(whole.slice(k, _DEALT))
                size += held[-1].num_rows
                if size >= _DEALT:
                    yield block(held)
                    held, size = [], 0
        if size:
            yield block(held)

    return run


def blocks(rows: DataFrame, keyed: Callable) -> DataFrame:
    """(slot, rows): what `keyed` makes of the batches of `rows`, (key, id, n) with n the set size or 0, packed for a shuffle.

    Slots follow the size that the plan states for its input, so a slot's rows fit a task whatever the input; a wrong size
    changes cost only.
    """
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    slots = 1 << (min(max(size // _SLOT_BYTES, _SLOTS[0]), _SLOTS[1]) - 1).bit_length()
    return rows.mapInArrow(lean(_packed(keyed, slots)), "slot long, rows binary")


def _split(fits: Callable, small: int, most: int = _HELD):
    """Of blocks sorted by slot: pairs (null, a, b, null) of small buckets, rows (key, id, null, n) of larger ones; single ids go.

    Slots stream. Of one that holds more than `most` rows, buckets go out as soon as they are known to be large.
    """

    def pairs(ids: np.ndarray, n: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        left, right = [], []
        for m in np.unique(size):
            at = first[size == m][:, None]
            i, j = np.triu_indices(int(m), 1)
            left.append((at + i).ravel())
            right.append((at + j).ravel())
        p, q = np.concatenate(left), np.concatenate(right)
        ok = fits(n[p], n[q])
        a, b = ids[p[ok]], ids[q[ok]]
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([none, pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), none.cast(pa.int32())], schema=_MET)

    def rows(x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x["key"].copy()), pa.array(x["id"].copy()), pa.nulls(len(x), pa.int64()), pa.array(x["n"].copy())], schema=_MET)

    def distinct(x: np.ndarray, lone: bool) -> np.ndarray:
        """The records by key and id, equal ones once; without `lone` those of keys that no other record has go."""
        order = np.argsort(x["key"])
        if not lone:
            key = x["key"][order]
            same = key[1:] == key[:-1]
            order = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        x = x[order]
        x = x[np.lexsort((x["id"], x["key"]))]
        return x[np.concatenate(([True], (x["key"][1:] != x["key"][:-1]) | (x["id"][1:] != x["id"][:-1])))] if len(x) else x

    def sizes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = _heads(x["key"])
        return first, np.diff(np.append(first, len(x)))

    def decided(x: np.ndarray, large: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of the records of whole slots; buckets of the keys `large` have begun to go out."""
        begun = np.isin(x["key"], large) if len(large) else np.zeros(len(x), bool)
        if begun.any():
            yield rows(distinct(x[begun], True))  # an id may come twice, which changes nothing
            x = x[~begun]
        x = distinct(x, False)
        first, size = sizes(x)
        few, many = (size > 1) & (size < small), np.repeat(size >= small, size)
        if few.any():
            yield pairs(x["id"], x["n"], first[few], size[few])
        if many.any():
            yield rows(x[many])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        slot, held, size, large, limit = None, [], 0, none, most
        for batch in batches:
            if not batch.num_rows:
                continue
            slots = batch.column(0).to_numpy()
            data, bounds = buffers(batch.column(1))
            found = data.view(_RECORD)
            cut = int(np.searchsorted(slots, slots[-1]))  # the last slot may go on
            at = int(bounds[cut]) // _RECORD.itemsize
            if cut or slots[0] != slot:
                if size + at:
                    yield from decided(np.concatenate([*held, found[:at]]), large)
                slot, held, size, large, limit = slots[-1], [], 0, none, most
            held.append(found[at:].copy())
            size += len(held[-1])
            if size > limit:
                x = np.concatenate(held)
                begun = np.isin(x["key"], large) if len(large) else np.zeros(len(x), bool)
                if begun.any():
                    yield rows(distinct(x[begun], True))
                x = distinct(x[~begun], True)
                first, count = sizes(x)
                many = np.repeat(count >= small, count)
                if many.any():
                    yield rows(x[many])
                large = np.union1d(large, x["key"][first[count >= small]])
                held = [x[~many]]
                size = len(held[0])
                limit = max(most, 2 * size)
        if size:
            yield from decided(np.concatenate(held), large)

    return run


def _centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, center): of every bucket its first member, for the members of other components. Sorted by key."""
    schema = pa.schema([("id", pa.int64()), ("center", pa.int64())])
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, ids, comp = (batch.column(k).to_numpy() for k in range(3))
        if last is not None and last[0] == key[0]:
            key, ids, comp = (np.append(x, y) for x, y in zip(last, (key, ids, comp), strict=True))
        first = _heads(key)
        of = np.repeat(first, np.diff(np.append(first, len(key))))
        ok = comp != comp[of]
        last = tuple(x[first[-1]] for x in (key, ids, comp))
        yield pa.RecordBatch.from_arrays([pa.array(ids[ok]), pa.array(ids[of][ok])], schema=schema)


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verified(like: Likeness):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = like.linked_rows(x, y) if like.linked_rows else [like.linked(a.as_py(), b.as_py()) for a, b in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=_PAIR).filter(pa.array(keep, pa.bool_()))

    return run


def verify(pairs: DataFrame, bodies: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) whose bodies (id, body binary) are linked."""
    one = pairs.join(bodies.select(F.col("id").alias("a"), F.col("body").alias("_x")), "a")
    both = one.join(bodies.select(F.col("id").alias("b"), F.col("body").alias("_y")), "b")
    return both.select("a", "b", "_x", "_y").mapInArrow(lean(_verified(like)), "a long, b long")


def _close(slack: Callable):
    """Pairs (a, b, n, m, sketch, sketch) that the sketches don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            width = np.array([min(len(x), len(y)) for x, y in zip(left, right, strict=True)])
            keep = np.zeros(batch.num_rows, bool)
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                for k in range(0, len(at), 1000):
                    part = at[k : k + 1000]
                    same = np.arange(len(part))
                    keep[part] = _apart(folded([left[i] for i in part], int(w)), folded([right[i] for i in part], int(w)), same, same) <= slack(n[part], m[part])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=_PAIR).filter(pa.array(keep))

    return run


def close_pairs(pairs: DataFrame, sketches: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) that the sketches (id, n, sketch) don't rule out."""
    one = pairs.join(sketches.select(F.col("id").alias("a"), F.col("n").alias("_n"), F.col("sketch").alias("_x")), "a")
    both = one.join(sketches.select(F.col("id").alias("b"), F.col("n").alias("_m"), F.col("sketch").alias("_y")), "b")
    both = both.where("4 * least(_n, _m) >= 3 * greatest(_n, _m)")
    return both.select("a", "b", "_n", "_m", "_x", "_y").mapInArrow(lean(_close(like.slack)), "a long, b long")


def _passing(comp: np.ndarray, side: np.ndarray, n: np.ndarray, sketches: list[bytes], like: Likeness) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of different components, of sides that are to be compared, that sizes and sketches let pass; in tiles.

    `comp` may change between tiles: what the caller has joined meanwhile is left out.
    """
    width = np.array([len(s) for s in sketches])
    for w in np.unique(width).tolist():
        mine, twice = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        # Sketch widths double with the sizes, so sets of widths further apart differ too much in size.
        for a in range(0, len(mine), _STEP):
            i = mine[a : a + _STEP]
            x = folded([sketches[k] for k in i], w)
            for others in (mine[a:], twice):
                for b in range(0, len(others), _STEP):
                    j = others[b : b + _STEP]
                    ok = (comp[i][:, None] != comp[j][None]) & ((side[i][:, None] != side[j][None]) | (side[i] == 2)[:, None])
                    if not ok.any():
                        continue
                    ok &= like.fits(n[i][:, None], n[j][None])
                    if others is not twice and b == 0:
                        ok &= i[:, None] < j[None]
                    p, q = np.nonzero(ok)
                    if not len(p):
                        continue
                    near = _apart(x, folded([sketches[k] for k in j], w), p, q) <= like.slack(n[i[p]], n[j[q]])
                    if near.any():
                        yield i[p[near]], j[q[near]]


def _forest(comp: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of rows, those that join components (a spanning forest); comp is changed to what they join."""
    left, right = [], []
    while True:
        x, y = comp[p], comp[q]
        open_ = x != y
        if not open_.any():
            break
        p, q, x, y = p[open_], q[open_], x[open_], y[open_]
        # Every component hooks to one smaller component, so no cycle arises.
        _, at = np.unique(np.maximum(x, y), return_index=True)
        left.append(p[at])
        right.append(q[at])
        top, low = np.maximum(x, y)[at], np.minimum(x, y)[at]
        while True:
            k = np.searchsorted(top, low)
            k[k == len(top)] = 0
            again = top[k] == low
            if not again.any():
                break
            low = np.where(again, low[k], low)
        k = np.searchsorted(top, comp)
        k[k == len(top)] = 0
        comp[:] = np.where(top[k] == comp, low[k], comp)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _proposed(like: Likeness):
    """Of tiles (key, id, side, comp, n, sketch): the pairs (a, b) of a spanning forest of what the sketches let pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches):
            key, ids, side, comp, n = (t.column(k).to_numpy() for k in range(5))
            first = _heads(key)
            for lo, hi in zip(first.tolist(), np.append(first[1:], len(key)).tolist(), strict=True):
                now = comp[lo:hi].copy()
                if (now == now[0]).all():
                    continue
                for p, q in _passing(now, side[lo:hi], n[lo:hi], t.column(5).slice(lo, hi - lo).to_pylist(), like):
                    p, q = _forest(now, p, q)
                    if len(p):
                        a, b = ids[lo + p], ids[lo + q]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=_PAIR)

    return run


def _contested(like: Likeness):
    """Of the same tiles: the rows (key, id, side, comp) that are in a pair which the sketches let pass."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("side", pa.int32()), ("comp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches):
            key, ids, side, comp, n = (t.column(k).to_numpy() for k in range(5))
            first, hit = _heads(key), np.zeros(len(key), bool)
            for lo, hi in zip(first.tolist(), np.append(first[1:], len(key)).tolist(), strict=True):
                if (comp[lo:hi] != comp[lo]).any():
                    for p, q in _passing(comp[lo:hi], side[lo:hi], n[lo:hi], t.column(5).slice(lo, hi - lo).to_pylist(), like):
                        hit[lo + p] = hit[lo + q] = True
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[hit]), pa.array(ids[hit]), pa.array(side[hit].astype(np.int32)), pa.array(comp[hit])], schema=schema)

    return run


def _settled(like: Likeness, bits_each: int):
    """Of tiles (key, id, side, comp, body): the links (a, b) of a spanning forest of exact similarities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches):
            key, ids, side, comp = (t.column(k).to_numpy() for k in range(4))
            first = _heads(key)
            for lo, hi in zip(first.tolist(), np.append(first[1:], len(key)).tolist(), strict=True):
                bodies = t.column(4).slice(lo, hi - lo)
                n, sketches = [], []
                for b in bodies:
                    found = like.members(b.as_py())
                    n.append(len(found))
                    sketches.append(sketch(found, bits_each))
                now, out = comp[lo:hi].copy(), []
                for p, q in _passing(now, side[lo:hi], np.array(n), sketches, like):
                    for i, j in zip(p.tolist(), q.tolist(), strict=True):
                        if now[i] != now[j] and like.linked(bodies[i].as_py(), bodies[j].as_py()):
                            now[now == max(now[i], now[j])] = min(now[i], now[j])
                            out.append((min(ids[lo + i], ids[lo + j]), max(ids[lo + i], ids[lo + j])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema=_PAIR)

    return run


def _mixed(of: DataFrame, found: DataFrame | None) -> DataFrame:
    """(key, id, comp, main, n_main, n_all): the rows of buckets that hold several components; main is the largest."""
    now = of.select("key", "id")
    now = now.withColumn("comp", F.col("id")) if found is None else now.join(found, "id", "left").select("key", "id", F.coalesce("component_id", "id").alias("comp"))
    each = now.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    told = each.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("n_main"), F.sum("c").alias("n_all"))
    return stored(now.join(told.where("n_all > n_main"), "key"), "mixed")


def _tiles(mixed: DataFrame, tile: int) -> DataFrame:
    """(key, id, side, comp): rows of mixed buckets once for every tile in which they are compared.

    Pairs of a tile are compared whose sides differ, or both are 2. The largest component's blocks meet every block of
    the others; the others' blocks meet each other.
    """
    most = mixed.withColumn("nm", F.ceil(F.col("n_main") / tile).cast("int")).withColumn("no", F.ceil((F.col("n_all") - F.col("n_main")) / tile).cast("int"))
    at = most.withColumn("own", F.col("comp") == F.col("main")).withColumn("blk", F.expr("cast(pmod(xxhash64(id), if(own, nm, no)) as int)"))
    spots = F.expr(
        "if(own, transform(sequence(0, no - 1), j -> struct(xxhash64(key, blk, j) as k, 0 as side)),"
        " concat(transform(sequence(0, nm - 1), i -> struct(xxhash64(key, i, blk) as k, if(i = 0, 2, 1) as side)),"
        " transform(filter(sequence(0, no - 1), x -> x <> blk), x -> struct(xxhash64(key, nm + least(x, blk), greatest(x, blk)) as k, if(blk < x, 0, 1) as side))))"
    )
    return at.select("id", "comp", F.explode(spots).alias("s")).select(F.col("s.k").alias("key"), "id", F.col("s.side").alias("side"), "comp")


def only(rows: DataFrame, ids: DataFrame, max_broadcast: int = 1_000_000) -> DataFrame:
    """`rows` whose id is among `ids`, stored and distinct. Up to so many ids are broadcast, more are shuffled."""
    return rows.join(F.broadcast(ids) if ids.count() <= max_broadcast else ids, "id", "left_semi")


def _ids(pairs: DataFrame) -> DataFrame:
    return stored(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "ids")


def _fine(like: Likeness, bits_each: int):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("sketch", pa.binary())])

    def one_by_one(bodies: pa.Array) -> tuple[list[int], list[bytes]]:
        sets = (like.members(body.as_py()) for body in bodies)
        found = [(len(x), sketch(x, bits_each)) for x in sets]
        return [n for n, _ in found], [x for _, x in found]

    every = like.sketched_rows if bits_each == 1 and like.sketched_rows else one_by_one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sketches = every(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(sketches, pa.binary())], schema=schema)

    return run


def link_components(keys: DataFrame, like: Likeness, bodies: Callable[[DataFrame], DataFrame], coarse: DataFrame | None = None, small: int = SMALL, tile: int = TILE, bits_each: int = 16) -> DataFrame:
    """(id, component_id) of everything that is linked; component_id is the smallest id reachable.

    keys: (key, id, n) with n the set size, or 0 where it isn't known yet, or `blocks` of them. bodies: gives (id, body) for a
    stored frame of ids. coarse: stored (id, n, sketch), to rule out pairs before their bodies are read.
    """
    packed = keys if "slot" in keys.columns else blocks(keys, lambda rows: rows)
    dealt = packed.repartition("slot").sortWithinPartitions("slot")
    met = stored(dealt.mapInArrow(lean(_split(like.fits, small)), "key long, a long, b long, n int"), "met")
    links: list[DataFrame] = []
    if coarse is None:  # the bodies of all ids that met are read once, and their sketches rule out most pairs
        ids = met.select(F.col("a").alias("id")).unionByName(met.where("b is not null").select(F.col("b").alias("id"))).distinct()
        every = stored(bodies(stored(ids, "ids")), "bodies")
        bodies = lambda ids: only(every, ids)
        coarse = stored(every.mapInArrow(lean(_fine(like, 1)), "id long, n int, sketch binary"), "sketches")

    def check(pairs: DataFrame, sketches: DataFrame | None) -> None:
        if sketches is not None:
            pairs = close_pairs(pairs, sketches, like)
        pairs = stored(pairs, "pairs")
        named = _ids(pairs)
        read = stored(bodies(named), "bodies")
        links.append(stored(verify(pairs, read, like), "links"))
        discard(pairs, named, read)

    def joined() -> DataFrame:
        every = links[0]
        for more in links[1:]:
            every = every.unionByName(more)
        return stored(components(every), "comp")

    check(met.where("b is not null").select("a", "b").distinct(), coarse)
    found = joined()
    of = met.where("b is null").select("key", F.col("a").alias("id"))
    mixed = _mixed(of, found)
    discard(met)
    for turn in range(_TURNS):
        if mixed.limit(1).count() == 0:
            return found
        dealt = mixed.select("key", "id", "comp").repartition("key").sortWithinPartitions("key", F.xxhash64("id", F.lit(turn)))
        votes = dealt.mapInArrow(lean(_centred), "id long, center long").groupBy("id", "center").agg(F.count(F.lit(1)).alias("votes"))
        stars = votes.groupBy("id").agg(F.max_by("center", F.struct("votes", (-F.col("center")).alias("o"))).alias("b"))
        check(stars.select(F.col("id").alias("a"), "b"), coarse)
        was = found, mixed
        found = joined()
        mixed = _mixed(mixed, found)
        discard(*was)
    if mixed.limit(1).count() == 0:
        return found

    def compared(rows: DataFrame, sketches: DataFrame, kernel: Callable, ddl: str) -> DataFrame:
        rows = rows.join(sketches, "id").select("key", "id", "side", "comp", "n", "sketch")
        return rows.repartition("key").sortWithinPartitions("key", "comp").mapInArrow(lean(kernel(like)), ddl)

    def sketched(ids: DataFrame, bits: int) -> DataFrame:
        read = stored(bodies(ids), "bodies")  # a stage with one Python step needs half the workers of one with two
        out = stored(read.mapInArrow(lean(_fine(like, bits)), "id long, n int, sketch binary"), "sketches")
        discard(read)
        return out

    ddl = "key long, id long, side int, comp long"
    named = stored(mixed.select("id").distinct(), "ids")
    # Small sketches leave few rows; those get sketches that hardly let a pair pass that isn't linked.
    near = stored(compared(_tiles(mixed, tile), coarse, _contested, ddl), "near")
    discard(mixed, named)
    named = stored(near.select("id").distinct(), "ids")
    fine = sketched(named, bits_each)
    proposed = stored(compared(near, fine, _proposed, "a long, b long").distinct(), "proposed")
    check(proposed, None)
    was = found
    found = joined()
    discard(was)
    now = near.drop("comp").join(found, "id", "left").select("key", "id", "side", F.coalesce("component_id", "id").alias("comp"))
    rest = stored(compared(now, fine, _contested, ddl), "contested")
    discard(near, fine, named, proposed)
    if rest.limit(1).count() == 0:
        return found
    named = stored(rest.select("id").distinct(), "ids")
    sets = rest.join(stored(bodies(named), "bodies"), "id").select("key", "id", "side", "comp", "body")
    links.append(stored(sets.repartition("key").sortWithinPartitions("key", "comp").mapInArrow(lean(_settled(like, bits_each)), "a long, b long"), "links"))
    discard(named, rest)
    return joined()
