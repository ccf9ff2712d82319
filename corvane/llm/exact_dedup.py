"""Exact deduplication with Patricia-trie owners.

Texts are equal when they are the same after deleting white space. Rows get a number first. Every input partition folds its
own copies by the bytes of their texts, so a group that holds a third of all rows reaches its owner as a few rows. The folded
texts are dealt by length and content hash; each owner inserts the full byte strings into a compressed radix trie whose
terminal nodes hold the best row and the numbers of the folds that ended there: which rows are one group is told by the
terminal node that their bytes reach, not by a hash. A trie over its memory limit spills its heaviest subtree: those strings
go, whole, to the next round over more partitions.

Defined cases: a null text counts as empty; empty texts form one group; of equal texts the one with the most code points
stays, then the smallest doc_id, null ids last, then the smallest row number: exactly one row of a group stays, of repeated
rows too; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, stored

_BLANKS = b" \t\n\x0b\x0c\r"
_BEST = "n_bytes long, digest binary, body binary, points long, best_id long, best_row long, members long"
_FOLDED = f"row long, doc_id long, fold long, sha binary, {_BEST}"
_OWNED = f"{_BEST}, folds array<long>, spilled boolean"


class Node:
    __slots__ = ("entry", "kids", "label")

    def __init__(self, label: bytes):
        self.label, self.kids, self.entry = label, {}, None


def better(a: tuple, b: tuple) -> tuple:
    """Of (points, id, row) the one that stays."""
    key = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    return a if key(a) <= key(b) else b


class RadixTrie:
    """A Patricia trie over byte strings; entries are [best row (points, id, row), members, digest, folds]."""

    def __init__(self):
        self.root, self.held, self.size, self.weight = Node(b""), 0, 0, {}

    def insert(self, key: bytes, best: tuple, members: int, digest: bytes, folds: list[int]) -> None:
        node, at = self.root, 0
        while at < len(key):
            kid = node.kids.get(key[at])
            if kid is None:
                node.kids[key[at]] = kid = Node(key[at:])
                self._grow(key, len(key) - at)
                node, at = kid, len(key)
            elif key.startswith(kid.label, at):
                node, at = kid, at + len(kid.label)
            else:
                label = kid.label
                same = _common(label, key[at : at + len(label)])
                fork = Node(label[:same])
                kid.label = label[same:]
                fork.kids[kid.label[0]] = kid
                node.kids[key[at]] = fork
                node, at = fork, at + same
        if node.entry is None:
            node.entry = [best, members, digest, folds]
            self.size += 1
            self._grow(key, 200)
        else:
            e = node.entry
            e[0] = better(e[0], best)
            e[1] += members
            e[3] = e[3] + folds
            self._grow(key, 40 * len(folds))

    def _grow(self, key: bytes, n: int) -> None:
        self.held += n
        top = key[:1]
        self.weight[top] = self.weight.get(top, 0) + n

    def terminals(self, top: bytes | None = None) -> Iterator[tuple[bytes, list]]:
        """(full string, entry) below the root's edge that starts with `top`, or of the whole trie."""
        stack = [(self.root, b"")] if top is None else [(self.root.kids[top[0]], b"")] if top else []
        if top == b"" and self.root.entry:
            yield b"", self.root.entry
        while stack:
            node, before = stack.pop()
            full = before + node.label
            if node.entry:
                yield full, node.entry
            stack.extend((k, full) for k in node.kids.values())

    def spill(self) -> Iterator[tuple[bytes, list]]:
        """Takes the heaviest subtree out; its name is in `gone` afterwards."""
        self.gone = max(self.weight, key=lambda t: (self.weight[t], t))
        out = list(self.terminals(self.gone))
        if self.gone:
            del self.root.kids[self.gone[0]]
        else:
            self.root.entry = None
        self.held -= self.weight.pop(self.gone)
        self.size -= len(out)
        return iter(out)


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def _rows(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)


_BEST_ARROW = [("n_bytes", pa.int64()), ("digest", pa.binary()), ("body", pa.binary()), ("points", pa.int64()), ("best_id", pa.int64()), ("best_row", pa.int64()), ("members", pa.int64())]
_FOLDED_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("fold", pa.int64()), ("sha", pa.binary()), *_BEST_ARROW])
_OWNED_ARROW = pa.schema([*_BEST_ARROW, ("folds", pa.list_(pa.int64())), ("spilled", pa.bool_())])


def _fold(limit: int):
    """One row per row of an input partition, with its number and that of its fold: the first row that has its bytes since
    the fold table was last emptied. That row alone carries the bytes and what is best of the fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        folds, rows, size = {}, [], 0

        def out() -> Iterator[pa.RecordBatch]:
            part, held = [], 0
            for number, doc_id, (best, members, digest, first, body) in rows:
                part.append((number, doc_id, first, digest, len(body), digest, body, *best, members) if number == first else (number, doc_id, first, digest, *[None] * 7))
                held += len(body) if number == first else 0
                if held > 4 << 20 or len(part) == 5000:
                    yield _rows(part, _FOLDED_ARROW)
                    part, held = [], 0
            if part:
                yield _rows(part, _FOLDED_ARROW)

        for batch in batches:
            points = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
            bodies = batch.column(1).cast(pa.binary())
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                body = (bodies[i].as_py() or b"").translate(None, _BLANKS)
                if (e := folds.get(body)) is None:
                    folds[body] = e = [(points[i], doc_id, row), 0, hashlib.sha256(body).digest(), row, body]
                    size += len(body) + 300
                e[0], e[1] = better(e[0], (points[i], doc_id, row)), e[1] + 1
                rows.append((row, doc_id, e))
                size += 150
                row += 1
                if size > limit:
                    yield from out()
                    folds, rows, size = {}, [], 0
        yield from out()

    return run


def _own(limit: int):
    """Inserts the strings of one owner into its trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, gone = RadixTrie(), set()

        def out(found, spilled):
            rows = []
            size = 0
            for key, (best, members, digest, folds) in found:
                rows.append((len(key), digest, key if spilled else b"", *best, members, folds, spilled))
                size += 8 * len(folds) + (len(key) if spilled else 0)
                if len(rows) == 5000 or size > 4 << 20:
                    yield _rows(rows, _OWNED_ARROW)
                    rows, size = [], 0
            if rows:
                yield _rows(rows, _OWNED_ARROW)

        for batch in batches:
            late = []
            for body, points, best_id, best_row, members, folds, digest in zip(*(batch.column(n).to_pylist() for n in ("body", "points", "best_id", "best_row", "members", "folds", "digest")), strict=True):
                if body[:1] in gone:
                    late.append((body, [(points, best_id, best_row), members, digest, folds]))
                    continue
                trie.insert(body, (points, best_id, best_row), members, digest, folds)
                while trie.held > limit and trie.size > 1:
                    yield from out(trie.spill(), True)
                    gone.add(trie.gone)
            yield from out(late, True)
        yield from out(trie.terminals(), False)

    return run


def _owned(folded: DataFrame, max_trie_bytes: int) -> DataFrame:
    """One row per distinct normalised text: _OWNED."""
    parts = int(folded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    todo = folded.where("body is not null").select("n_bytes", "digest", "body", "points", "best_id", "best_row", "members", F.array("fold").alias("folds"))
    done, rounds = None, 0
    while True:
        owned = stored(todo.repartition(parts * 4**rounds, "n_bytes", "digest").mapInArrow(lean(_own(max_trie_bytes)), _OWNED), f"owned{rounds}")
        ready = owned.where("not spilled")
        done = ready if done is None else done.unionByName(ready)
        if owned.where("spilled").limit(1).count() == 0:
            return done
        todo, rounds = owned.where("spilled").drop("spilled"), rounds + 1


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_trie_bytes: int = 192 << 20, max_fold_bytes: int = 48 << 20) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256."""
    slim = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    # Stored before use, so a row's number and fold can't change when an executor is lost.
    folded = stored(slim.mapInArrow(lean(_fold(max_fold_bytes)), _FOLDED), "folded")
    told = _owned(folded, max_trie_bytes).select(F.explode("folds").alias("fold"), F.col("best_id").alias("keep_id"), "best_row", F.col("members").alias("group_size"))
    return folded.select("row", "doc_id", "fold", "sha").join(told, "fold").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("best_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
