"""Packing by Karmarkar-Karp multiway differencing.

Each text becomes token ids and an end id. Whole windows of it stand alone; what remains is cut into pieces of at most
`piece` ids. Pieces are numbered over the corpus, dealt into batches of fixed row count, and in each batch the largest
differencing method splits them into k windows: the two partial partitions with the largest imbalance are merged, the
fullest window of one on the emptiest of the other. k starts at what the sum needs and rises while a window overflows.

Defined cases: a null text has the end id alone; equal rows are packed each for itself; a text that holds one of the vocabulary
file's special strings gets the id that the file's tokenizer gives it; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, numbered, stored

#: Blanks beside the space and the line feed: texts with one are encoded as a whole.
_ODD_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


# Fixed value: the word pattern of the vocabulary's byte-level pre-tokenizer. Between ASCII characters and U+00C0 to U+027F (letters
# and two signs in every Unicode version since 5.0, so that no engine's age matters) every engine reads it alike.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Whether each byte is one that UTF-8 uses for those characters.
_ALIKE = np.isin(np.arange(256), [*range(0xC0), *range(0xC3, 0xCA)])
_LINE, _NONE = pa.scalar(b"\n", pa.large_binary()), pa.scalar(b"", pa.large_binary())


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Token bytes -> id of a vocabulary file, if its merges in order make the tokens in the order of their ids; then merging the
    pair of the lowest id and merging by the file's list are the same. None otherwise, or with any normalizer or other step."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
        return None
    # The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on.
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}
    added = {t["content"] for t in spec.get("added_tokens", ())}
    vocabulary = {t: k for t, k in model["vocab"].items() if t not in added}
    if any(c not in byte for t in vocabulary for c in t):
        return None
    made = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [vocabulary.get(a + b, -1) for a, b in made]
    single = sorted(k for t, k in vocabulary.items() if len(t) == 1)
    if len(single) != 256 or single[-1] >= min(ids) or any(a >= b for a, b in zip(ids, ids[1:], strict=False)) or len(ids) + 256 != len(vocabulary):
        return None
    return {bytes(byte[c] for c in t): k for t, k in vocabulary.items()}


def _engine(json_path: str):
    """A merge engine over the file's own tables, or None."""
    import tiktoken

    with open(json_path, encoding="utf-8") as f:
        ranks = _ranks(json.load(f))
    return ranks and tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _bytes_and_ends(words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words one after another, and where each word's end."""
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(words.buffers()[2], np.uint8)[at[0] : at[-1]], at[1:] - at[0]


class Encoder:
    """Ids of the vocabulary file as little-endian uint32 bytes, exactly those of its tokenizer's encode(text, add_special_tokens=False).

    The vocabulary's word pattern always breaks between a non-space and one space before a non-space, and on both sides of
    a run of line feeds between non-spaces. A text whose blanks are such is the sequence of its words, and every distinct
    word is encoded once and kept (`limit` words of under 40 bytes; words beyond that are encoded again). Words of
    characters beyond `_ALIKE` go to the tokenizer, as do whole texts with other blanks or with one of the file's added
    strings. The other words go to a merge engine that is given the file's own tables, after `_ranks` has proved that they say
    the same; where they don't, the tokenizer encodes these too.

    The words of many texts are cut, told apart and replaced by their ids as arrays: word k of `words` is ids[at[k]:at[k+1]].
    """

    def __init__(self, json_path: str, limit: int = 250_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.whole, self.limit, self.words = Tokenizer.from_file(json_path), limit, pa.array([], pa.large_binary())
        self.ids, self.at = np.zeros(0, "<u4"), np.zeros(1, np.int64)
        self.engine = _engine(json_path)
        added = {k: t.content for k, t in self.whole.get_added_tokens_decoder().items()}
        self.added = tuple(added.values())
        vocabulary = self.whole.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a byte-level token has a character for each byte
        for token, k in vocabulary.items():
            self.bytes_of[k] = len(token)

    def _slow(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def reference(self, text: str) -> bytes:
        return np.array(self._slow(text), "<u4").tobytes()

    def _by_words(self, text: str) -> bool:
        odd = "  " in text or "\n " in text or " \n" in text or text[:1] in " \n" or text[-1:].isspace() or any(c in text for c in _ODD_BLANKS)
        return not odd and not any(t in text for t in self.added)

    def _add(self, words: pa.LargeBinaryArray) -> np.ndarray:
        """Encodes words that aren't kept yet; their places. They are encoded in long runs: words that begin with their space as
        they are, others each before a line feed. Which tokens are a word's is told by their lengths in bytes."""
        data, ends = _bytes_and_ends(words)
        starts = np.concatenate(([0], ends[:-1]))
        beyond = np.concatenate(([0], np.cumsum(~_ALIKE[data])))
        quick = (beyond[ends] == beyond[starts]) & (self.engine is not None)
        head, place, n = data[starts], np.zeros(len(words), np.int64), len(self.at) - 1
        ids, counts = [self.ids], [np.zeros(0, np.int64)]
        for k in np.flatnonzero(head == 10).tolist():
            ids.append(np.array(self._slow(words[k].as_py().decode() + "x")[:-1], "<u4"))
            counts.append(np.array([len(ids[-1])]))
            place[k], n = n, n + 1
        for encode, its, spaced in [(e, q, s) for e, q in ((self.engine and self.engine.encode_ordinary, quick), (self._slow, ~quick)) for s in (True, False)]:
            group = np.flatnonzero(its & ((head == 32) == spaced) & (head != 10))
            place[group] = np.arange(n, n + len(group))
            n += len(group)
            for k in range(0, len(group), 4000):
                run = words.take(pa.array(group[k : k + 4000]))
                text, upto = _bytes_and_ends(run if spaced else pc.binary_join_element_wise(run, _LINE, _NONE))
                found = np.array(encode(text.tobytes().decode()), "<u4")
                at = np.cumsum(self.bytes_of[found]) - self.bytes_of[found]
                of = np.searchsorted(upto, at, "right")
                own = np.full(len(found), True) if spaced else at < upto[of] - 1
                ids.append(found[own])
                counts.append(np.bincount(of[own], minlength=len(run)))
        self.ids = np.concatenate(ids)
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(np.concatenate(counts))))
        return place

    def _spread(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of kept words one after another, and where each word's end."""
        n = self.at[which + 1] - self.at[which]
        ends = np.cumsum(n)
        return self.ids[np.repeat(self.at[which] - ends + n, n) + np.arange(n.sum())], ends

    def _joined(self, texts: list[bytes]) -> list[bytes]:
        """The ids of texts, none of them empty, that are the sequences of their words."""
        data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
        line, first = data == 10, data == 32
        first[1:] |= line[1:] != line[:-1]
        first[0] = True
        first[ends[:-1]] = True
        starts = np.flatnonzero(first).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)])
        told = pa.concat_arrays([self.words, words]).dictionary_encode()  # numbers in the order of first places: kept words first
        had, which, distinct = len(self.words), told.indices.to_numpy()[len(self.words) :], told.dictionary
        new = distinct.take(pa.array(np.arange(had, len(distinct))))
        place = np.concatenate((np.arange(had), self._add(new) if len(new) else np.zeros(0, np.int64)))
        ids, upto = self._spread(place[which])
        keep = pc.binary_length(distinct).to_numpy() < 40
        if keep.sum() > self.limit:
            used = np.zeros(len(distinct), bool)
            used[which] = True
            keep &= used
        self.words = distinct.filter(pa.array(keep))
        if len(new) or len(self.words) < had:
            self.ids, at = self._spread(place[keep])
            self.at = np.concatenate(([0], at))
        raw, cuts = ids.tobytes(), [0, *(4 * upto[np.searchsorted(starts, ends) - 1]).tolist()]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def batch(self, texts: list[str]) -> list[bytes]:
        split = [bool(text) and self._by_words(text) for text in texts]
        found = iter(self._joined([text.encode() for text, s in zip(texts, split, strict=True) if s]) if any(split) else ())
        return [next(found) if s else self.reference(text) if text else b"" for s, text in zip(split, texts, strict=True)]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of runs of at most 1024 rows."""
    for batch in batches:
        for k in range(0, batch.num_rows, 1024):
            part = batch.slice(k, 1024)
            yield part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]


def _cut(json_path: str, end_id: int, window: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(json_path)
        end = np.array([end_id], "<u4").tobytes()
        for doc_ids, texts in _texts(batches):
            rows: list[list] = [[], [], [], [], []]
            for doc_id, encoded in zip(doc_ids, encoder.batch(texts), strict=True):
                ids = memoryview(encoded + end)
                n = len(ids) // 4
                whole = n // window * window
                for a, b in [*((k, k + window) for k in range(0, whole, window)), *((k, min(k + piece, n)) for k in range(whole, n, piece))]:
                    for c, v in zip(rows, (doc_id, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), n), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(rows, _PIECES, strict=True)], schema=_PIECES)

    return run


def difference(sizes: list[int], k: int) -> list[int]:
    """The part (0 to k-1) of each size, by multiway largest differencing.

    A partial partition keeps only its used windows, fullest first; its unused ones are zeros.
    """
    heap = [(-s, i, [s], [(i,)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    nxt = len(sizes)
    while len(heap) > 1:
        _, _, a, ga = heapq.heappop(heap)
        _, _, b, gb = heapq.heappop(heap)
        if len(a) < len(b):
            a, ga, b, gb = b, gb, a, ga
        free = k - len(a)
        sums, groups = list(a), list(ga)
        over = len(b) - free
        # b's fullest windows stand in a's empty ones; the fullest of what is left meets a's emptiest used one, and so on.
        for j in range(over):
            at = len(a) - 1 - j
            sums[at] += b[free + j]
            groups[at] = (groups[at], gb[free + j])
        sums += b[:free] if over > 0 else b
        groups += gb[:free] if over > 0 else gb
        order = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
        sums = [sums[i] for i in order]
        groups = [groups[i] for i in order]
        low = sums[-1] if len(sums) == k else 0
        heapq.heappush(heap, (low - sums[0], nxt, sums, groups))
        nxt += 1
    part = [0] * len(sizes)
    if heap:
        for p, tree in enumerate(heap[0][3]):
            stack = [tree]
            while stack:
                x = stack.pop()
                if isinstance(x, int):
                    part[x] = p
                else:
                    stack.extend(x)
    return part


def windows(sizes: list[int], window: int) -> list[int]:
    """The window of each size: as few as differencing fits into the capacity."""
    k = max(1, -(-sum(sizes) // window))
    while True:
        part = difference(sizes, k)
        if max(np.bincount(part, sizes, k)) <= window:
            return part
        k += 1


def pack(docs: DataFrame, json_path: str, end_id: int = 1, window: int = 2048, piece: int = 512, batch: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    slim = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = stored(slim.mapInArrow(lean(_cut(json_path, end_id, window, piece)), ddl), "pieces")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole, n = numbered(pieces.where(F.col("length") == window), *names, name="sequence_id")
    rest, _ = numbered(pieces.where(F.col("length") < window), *names)

    def differ(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row_no")
        sizes = frame["length"].tolist()
        part = np.array(windows(sizes, window))
        order = np.argsort(part, kind="stable")
        frame, part = frame.iloc[order], part[order]
        before = frame["length"].cumsum() - frame["length"]
        first = np.searchsorted(part, part)
        return frame.assign(sequence_id=n + frame["row_no"].min() // batch * batch + part, offset=before.to_numpy() - before.to_numpy()[first])[[*names, "sequence_id", "offset"]]

    packed = rest.withColumn("_batch", F.expr(f"row_no div {int(batch)}")).groupBy("_batch").applyInPandas(differ, ddl + ", sequence_id long, offset long")
    return whole.select(*names, "sequence_id", F.lit(0).cast("long").alias("offset")).unionByName(packed)


def pack_query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
