"""Toxicity scores by a counterfactual-regularised classifier.

A logistic model over words and word beginnings, trained on a bounded, class-stratified sample of the labelled rows
(`max_toxic`, `max_clean`, smallest seeded hashes first) with the `max_features` features that tell the classes apart best, of
those in at least `min_documents` training rows. For every training row counterfactual copies are made: where it names
an identity group, the group's terms are swapped for every other of their set; where it names none, a mention of a term
is added, the set chosen by a hash of the row, for every term of the set, in neutral and toxic rows alike. The squared change of
the logit between a row and its copies is penalised (`swap_penalty`), so what the model holds against a mere mention
cancels out. Only the features that a swap changes are kept of a copy. Every whole text of the table is then scored.

Sets of terms are given for the languages of the corpus and are a parameter. model[-3] is the number of pairs, model[-4]
the mean absolute change of the logit over them.

Defined cases: a null text is scored as the empty text; null labels are ignored, of several labels of a document the highest
counts; of several rows of a doc_id that is in the sample at most `max_texts` are learnt from; without any usable label every
score is the prior (0 if there is none); repeated rows score alike; an empty table gives an empty result; other columns are
not read. Inputs of a score are the words of the text, nothing else.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean

# Sets of interchangeable identity terms, in English, German, French and Spanish.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "native", "refugee", "foreigner"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("old", "young", "elderly"),
    ("disabled", "deaf", "blind"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "araber", "afrikaner", "europäer"),
    ("schwule", "lesben", "bisexuelle", "heterosexuelle"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "arabes", "africains", "européens"),
    ("gays", "lesbiennes", "bisexuels", "hétérosexuels"),
    ("immigrés", "réfugiés", "étrangers", "autochtones"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "árabes", "africanos", "europeos"),
    ("homosexuales", "lesbianas", "bisexuales", "heterosexuales"),
    ("inmigrantes", "refugiados", "extranjeros", "nativos"),
)
_WORD = re.compile(r"\w+")
_BITS = 22
_PREFIXES = (5, 6, 7)


def word_features(word: str) -> list[int]:
    """Hashed features of a word: the word itself and its beginnings."""
    out = [zlib.crc32(b"=" + word.encode()) & ((1 << _BITS) - 1)]
    out += [zlib.crc32(word[:k].encode()) & ((1 << _BITS) - 1) for k in _PREFIXES if len(word) >= k]
    return out


def _counts(words: Counter) -> tuple[list[int], list[float]]:
    found: Counter = Counter()
    for w, n in words.items():
        for f in word_features(w):
            found[f] += n
    return list(found), [float(x) for x in found.values()]


def swaps(words: Counter, terms: tuple, seed: int) -> list[tuple[Counter, Counter]]:
    """(words that go, words that come) of every counterfactual copy: in copy k every term becomes the k-th other of its set, and
    a text without terms gets a mention, once for each term of the set that the seed chooses."""
    sets = [(set(group) & words.keys(), group) for group in terms]
    named = [(mine, group) for mine, group in sets if mine]
    if not named:
        group = terms[seed % len(terms)] if terms else ()
        return [(Counter(), Counter({w: 1})) for w in group]
    out = []
    for k in range(1, max(len(group) for _, group in named)):
        gone, come = Counter(), Counter()
        for mine, group in named:
            for w in mine:
                gone[w] = words[w]
                come[group[(group.index(w) + k) % len(group)]] += words[w]
        out.append((gone, come))
    return out


#: Documents whose features a worker holds at once.
_ROWS = 64


def _extract(terms: tuple):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in (f.iloc[k : k + _ROWS] for f in frames for k in range(0, len(f), _ROWS)):
            rows = []
            for doc_id, label, weight, text in zip(frame["doc_id"], frame["label"], frame["weight"], frame["text"], strict=True):
                words = Counter(_WORD.findall((text or "").lower()))
                features, counts = _counts(words)
                length = sum(words.values())
                rows.append((doc_id, 0, label, weight, math.log1p(length), np.array(features, np.int32), np.array(counts, float)))
                held = dict(zip(features, counts, strict=True))
                for k, (gone, come) in enumerate(swaps(words, terms, zlib.crc32(str(doc_id).encode())), 1):
                    # Of a copy, what changes: the step of every feature's value.
                    changed = Counter()
                    for some, sign in ((gone, -1), (come, 1)):
                        for f, n in zip(*_counts(some), strict=True):
                            changed[f] += sign * n
                    steps = [(f, math.log1p(held.get(f, 0.0) + n) - math.log1p(held.get(f, 0.0))) for f, n in changed.items() if n]
                    longer = math.log1p(length + sum(come.values()) - sum(gone.values())) - math.log1p(length)
                    rows.append((doc_id, k, label, weight, longer, np.array([f for f, _ in steps], np.int32), np.array([v for _, v in steps], float)))
            yield pd.DataFrame(rows, columns=["doc_id", "copy", "label", "weight", "length", "features", "counts"])

    return run


class _Sparse:
    """Rows of (feature, value) with products that need numpy alone."""

    def __init__(self, lists: list[tuple[np.ndarray, np.ndarray]], width: int):
        self.n, self.width = len(lists), width
        self.col = np.concatenate([a for a, _ in lists]) if lists else np.zeros(0, np.int64)
        self.val = np.concatenate([b for _, b in lists]) if lists else np.zeros(0)
        self.row = np.repeat(np.arange(self.n), [len(a) for a, _ in lists])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * g[self.row], self.width)


def fit(frame: pd.DataFrame, max_features: int, min_documents: int, l2: float, swap_penalty: float, steps: int) -> pd.DataFrame:
    """(feature, weight): -1 is the intercept, -2 the weight of the log length, -3 the number of pairs, -4 their mean gap."""
    frame = frame.sort_values(["doc_id", "copy"], kind="stable").reset_index(drop=True)
    plain = frame[frame["copy"] == 0]
    y, wt = plain["label"].to_numpy(float), plain["weight"].to_numpy(float)
    wt = wt / wt.sum()
    flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in plain["features"]] or [np.zeros(0, np.int64)])
    owner = np.repeat(np.arange(len(plain)), [len(x) for x in plain["features"]])
    df = np.bincount(flat, minlength=1 << _BITS)
    often = np.flatnonzero(df >= min_documents)  # arrays of every possible feature are held one at a time
    del df
    pos = np.bincount(flat, (wt * y)[owner], 1 << _BITS)[often]
    neg = np.bincount(flat, (wt * (1 - y))[owner], 1 << _BITS)[often]
    del flat, owner
    p1, p0 = max((wt * y).sum(), 1e-9), max((wt * (1 - y)).sum(), 1e-9)
    a, b = pos / p1, neg / p0
    rank = np.abs(a - b) / np.sqrt((a * (1 - a)).clip(0) / max(y.sum(), 1) + (b * (1 - b)).clip(0) / max((1 - y).sum(), 1) + 1e-4)
    best = np.sort(np.argsort(-rank, kind="stable")[:max_features])
    vocab = often[best[rank[best] > 0]]
    slot = np.full(1 << _BITS, -1, np.int32)
    slot[vocab] = np.arange(len(vocab))
    width = len(vocab) + 2

    def sparse(part: pd.DataFrame, one: float, value: Callable) -> _Sparse:
        lists = []
        for f, c, length in zip(part["features"], part["counts"], part["length"], strict=True):
            s = slot[np.asarray(f, dtype=np.int64)] if len(f) else np.zeros(0, np.int64)
            ok = s >= 0
            lists.append((np.append(s[ok], [width - 2, width - 1]), np.append(value(np.asarray(c, dtype=float)[ok]), [one, length / 5])))
        return _Sparse(lists, width)

    x = sparse(plain, 1.0, np.log1p)
    swap = sparse(frame[frame["copy"] > 0], 0.0, np.asarray)  # what a copy changes
    w = np.zeros(width)
    w[-2] = math.log(p1 / p0)
    m, v = np.zeros(width), np.zeros(width)
    decay = np.full(width, l2)
    decay[-2:] = 0
    for t in range(1, steps + 1):
        z = x.dot(w)
        g = wt * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = x.back(g) + decay * w
        if swap.n:
            grad += swap.back(swap.dot(w) * (2 * swap_penalty / swap.n))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= 0.08 * (0.5 + 0.5 * math.cos(math.pi * t / steps)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    gap = float(np.abs(swap.dot(w)).mean()) if swap.n else 0.0
    return pd.DataFrame({"feature": np.append(vocab, [-1, -2, -3, -4]), "weight": np.append(w[:-2], [w[-2], w[-1] / 5, swap.n, gap])})


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_toxic: int = 3000, max_clean: int = 6000, max_features: int = 3000, min_documents: int = 4, l2: float = 3e-5, swap_penalty: float = 1.0, steps: int = 300, identity_terms: tuple = IDENTITY_TERMS, max_texts: int = 2) -> dict[int, float]:
    """The model as feature -> weight, at most max_features + 4 entries. Callers pass only the labels to learn from.

    The sample is bounded by max_toxic + max_clean documents, so it is broadcast to meet the texts, and at most max_texts rows of each; class weights restore the
    proportions of all labels. The fit itself runs in one task over that bounded sample.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    n = {r["label"]: r["n"] for r in known.groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [known.where(c).withColumn("h", F.xxhash64(F.lit(5), "doc_id")).orderBy("h", "doc_id").limit(k).select("doc_id", F.lit(y).alias("label"), F.lit(n.get(y, 0) / max(1, min(k, n.get(y, 0)))).alias("weight")) for c, k, y in (("label > 0", max_toxic, 1), ("label <= 0", max_clean, 0))]
    if not n.get(0) or not n.get(1):
        return {-1: 30.0 if n.get(1) else -30.0, -2: 0.0}
    sample = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")
    at = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    sample = sample.withColumn("_at", F.row_number().over(at)).where(F.col("_at") <= max_texts).drop("_at")
    rows = sample.mapInPandas(lean(_extract(identity_terms)), "doc_id long, copy int, label int, weight double, length double, features array<int>, counts array<double>")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [f for f in frames if len(f)]
        if got:
            yield fit(pd.concat(got), max_features, min_documents, l2, swap_penalty, steps)

    fitted = rows.coalesce(1) if docs.sparkSession.sparkContext.defaultParallelism == 1 else rows.repartition(1)
    return {int(r["feature"]): float(r["weight"]) for r in fitted.mapInPandas(lean(run), "feature long, weight double").collect()} or {-1: -30.0, -2: 0.0}


class _Known(dict):
    """word -> the model's features that it carries; forgets when it grows large."""

    def __init__(self, model: dict[int, float]):
        self.model = model

    def __missing__(self, word: str) -> tuple:
        if len(self) > 100_000:
            self.clear()
        self[word] = out = tuple(f for f in word_features(word) if f in self.model)
        return out


def score_text(text: str, model: dict[int, float], known: _Known) -> float:
    words = _WORD.findall(text.lower())
    found: dict[int, int] = {}
    for w, n in Counter(words).items():
        for f in known[w]:
            found[f] = found.get(f, 0) + n
    z = model[-1] + model[-2] * math.log1p(len(words)) + sum(model[f] * math.log1p(n) for f, n in found.items())
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score(docs: DataFrame, model: dict[int, float], text_col: str = "text", out_col: str = "score") -> DataFrame:
    """`docs` with a score of 0 to 1 for every whole text."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _Known(model)  # kept for all batches of a task
        yield from lean(lambda parts: (pa.array([score_text(t.as_py() or "", model, known) for t in texts], pa.float64()) for texts in parts))(batches)

    return docs.withColumn(out_col, scored(F.col(text_col).cast("string")))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels.where(~held_out()))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
