"""Toxicity by a logistic classifier whose scores are held to stay when identity terms are swapped.

Features of a text are its distinct words and the first 4, 5 and 6 bytes of longer words, as 64-bit hashes. The model is
fitted on at most ``SAMPLE_PER_LABEL`` training rows of either label (all, if there are fewer), weighted back to the
true share of labels. Training minimises logistic loss + L1 norm + ``swap_penalty`` times the squared change of the
linear score when every identity term of a labelled text is swapped for another of its group, so weight that rests on a
neutral mention of a group is driven out. Scoring looks up whole texts in place; there is no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from turnloom.llm.arrow import mixed, splits, utf8
from turnloom.sources.sinks import staged

#: Bound of the training sample, rows of each label.
SAMPLE_PER_LABEL = 3000
MIN_ROWS = 5
#: Groups of identity terms; a term is swapped for the next one of its group.
IDENTITIES = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"), ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"), ("immigrants", "natives", "refugees"), ("immigrant", "native", "refugee"), ("african", "european", "american", "mexican", "chinese", "indian"),
    ("disabled", "deaf", "blind", "autistic"), ("old", "young"), ("frauen", "männer"), ("juden", "christen", "muslime"), ("femmes", "hommes"), ("juifs", "chrétiens", "musulmans"), ("mujeres", "hombres"), ("judíos", "cristianos", "musulmanes"),
)
_NEXT = {t: g[(i + 1) % len(g)] for g in IDENTITIES for i, t in enumerate(g)}
_TERM = re.compile(r"\b(?:" + "|".join(sorted(_NEXT, key=len, reverse=True)) + r")\b", re.I)
_RANDOM = np.random.default_rng(31337)
_STEP = np.uint64(int(_RANDOM.integers(1 << 61, 1 << 62)) * 2 + 1)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_WORD = np.ones(256, bool)
_WORD[: ord("0")] = False
_WORD[ord("9") + 1 : ord("A")] = False
_WORD[ord("Z") + 1 : ord("a")] = False
_WORD[ord("z") + 1 : 128] = False
PREFIXES = (4, 5, 6)


def swapped(text: str) -> str | None:
    """The text with its identity terms exchanged; None if it has none."""
    changed = _TERM.sub(lambda m: _NEXT[m[0].lower()], text)
    return changed if changed != text else None


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (not yet distinct) of words and prefixes, and the row of each."""
    base = int(offsets[0])
    data, offsets = data[base : int(offsets[-1])], offsets - base
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = _WORD[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = solid[heads]
    tails = heads[heads > 0] - 1
    last[tails] = solid[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    ahead = np.full(len(data) + 1, _STEP, np.uint64)
    ahead[0] = 1
    ahead = np.cumprod(ahead)
    back = np.full(len(data) + 1, _BACK, np.uint64)
    back[0] = 1
    back = np.cumprod(back)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * ahead[:-1])))
    row = np.searchsorted(offsets, starts, side="right") - 1
    hashes, rows = [mixed((sums[ends] - sums[starts]) * back[starts])], [row]
    for n in PREFIXES:
        at = np.flatnonzero(ends - starts > n)
        s = starts[at]
        hashes.append(mixed((sums[s + n] - sums[s]) * back[s] + np.uint64(n)))
        rows.append(row[at])
    return np.concatenate(hashes), np.concatenate(rows)


def _featured(texts: list[str]) -> list[bytes]:
    h, row = features(*utf8(pa.array(texts, pa.large_string())))
    return [np.unique(h[row == i]).tobytes() for i in range(len(texts))]


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows = len(offsets) - 1
        total = np.full(rows, self.bias)
        h, row = features(data, offsets)
        if len(h) and len(self.keys):
            slot = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[slot] == h
            pair = np.unique(row[hit] * len(self.keys) + slot[hit])
            total += np.bincount(pair // len(self.keys), self.weights[pair % len(self.keys)], rows)
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def sample(docs: DataFrame, labels: DataFrame, per_label: int) -> DataFrame:
    """(label, y, own, other): features of the training texts and of their swapped versions (null where nothing swaps).

    The rows of a label with the smallest hashes of their id; at most ``2 * per_label`` rows in all, so this side is
    small enough to broadcast.
    """
    train = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    chosen = None
    for y in (0, 1):
        part = train.where(F.col("toxic") == y).select("doc_id", F.lit(float(y)).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select("doc_id", "text").join(F.broadcast(staged(chosen, "sample")), "doc_id").select("y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in splits(batches, "text"):
            own = [t or "" for t in batch.column("text").to_pylist()]
            others = [swapped(t) for t in own]
            found = _featured([t or "" for t in others])
            yield pa.record_batch([batch.column("y"), pa.array(_featured(own), pa.binary()), pa.array([f if t else None for f, t in zip(found, others)], pa.binary())], ["y", "own", "other"])

    return texts.mapInArrow(run, "y double, own binary, other binary")


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, swap_penalty: float = 10.0, l1: float = 5e-5) -> Model:
    """A constant score if the training rows lack one of the labels."""
    counts = {r.toxic: r["count"] for r in labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("toxic").count().collect()}
    rows = sample(docs, labels, per_label).toArrow()
    y = rows.column("y").to_numpy()
    if not len(y) or y.min() == y.max():
        share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(share / (1 - share))))
    own = [np.frombuffer(b.as_py(), np.uint64) for b in rows.column("own")]
    other = [np.frombuffer(b.as_py(), np.uint64) if b.is_valid else None for b in rows.column("other")]
    weight = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
    weight = weight / weight.sum()
    keys = _screened(own, y)
    size = np.array([len(x) for x in own])
    x, at = _matrix(own, keys)
    has = [i for i, o in enumerate(other) if o is not None]
    a, a_at = _matrix([other[i] for i in has], keys)
    b, b_at = _matrix([own[i] for i in has], keys)
    del own, size
    swap = (np.concatenate([a, b]), np.concatenate([a_at, b_at]), np.concatenate([np.ones(len(a)), -np.ones(len(b))]))
    w, bias = np.zeros(len(keys)), float(np.log(counts[1] / counts[0]))
    pairs = max(1, len(has))

    def gradient(w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        z = np.bincount(at, w[x], len(y)) + bias
        r = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        change = np.bincount(swap[1], w[swap[0]] * swap[2], pairs)
        g = np.bincount(x, r[at], len(w)) + 2 * swap_penalty / pairs * np.bincount(swap[0], change[swap[1]] * swap[2], len(w))
        return g, float(r.sum())

    most = 0.25 * (1 + np.bincount(at, minlength=len(y)).max(initial=0)) + 2 * swap_penalty * max(1, np.bincount(swap[1], minlength=pairs).max(initial=0))
    rate, v, v_bias, t = 1 / most, w.copy(), bias, 1.0
    for _ in range(600):
        g, g_bias = gradient(v, v_bias)
        new = v - rate * g
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        new_bias, new_t = v_bias - rate * g_bias, (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, v_bias = new + (t - 1) / new_t * (new - w), new_bias + (t - 1) / new_t * (new_bias - bias)
        w, bias, t = new, new_bias, new_t
    kept = np.flatnonzero(w)
    return Model(keys[kept], w[kept], bias)


def _screened(own: list[np.ndarray], y: np.ndarray, z: float = 4.0) -> np.ndarray:
    """Features in at least MIN_ROWS rows whose share differs between the labels by ``z`` standard errors."""
    keys, inverse = np.unique(np.concatenate(own), return_inverse=True)
    row = np.repeat(np.arange(len(own)), [len(o) for o in own])
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    c1, c0 = np.bincount(inverse, y[row], len(keys)), np.bincount(inverse, 1 - y[row], len(keys))
    p = (c1 + c0) / (n1 + n0)
    gap = np.abs(c1 / n1 - c0 / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    return keys[(c1 + c0 >= MIN_ROWS) & (gap >= z)]


def _matrix(rows: list[np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column and row numbers of the entries among ``keys``."""
    if not rows or not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    values = np.concatenate(rows)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    slot = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    hit = keys[slot] == values
    return slot[hit], at[hit]


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text; a null or empty text has the score of no feature at all."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in splits(batches, text_col):
            yield batch.append_column(score_col, pa.array(shared.value.scores(*utf8(batch.column(text_col)))))

    return docs.select("*").mapInArrow(run, schema)


def classified(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; a null id is not held out. Labels are read by doc_id and toxic;
    rows of ``labels`` without an id or with another mark are not used, repeated ones count each."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = scored(rows, fit(rows, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
