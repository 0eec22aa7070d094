"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed where the texts lie; a bounded sample
of labelled rows goes to the driver, features only. Trees are grown there on
binned features (a histogram of gradients for each node and feature), and are
flattened into arrays: every tree is a complete binary tree of one depth, so a
batch walks all its rows down a tree with a few numpy look-ups a level.

Defined results: a null text has the statistics of the empty text; without any
labelled row every score is 0.5; equal labels of an id count once, and so do
rows equal in id and text; ids may be null or repeated.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import arrow_map, batch_of, field, held_out, session, stored, texts
from barloom.llm.quality_rules import Page

#: Labelled texts that training takes at most (in expectation, chosen by a hash of id, text and label).
TRAIN_ROWS = 16_000
BINS, DEPTH, TREES, RATE, SMOOTH, LEAST = 64, 4, 80, 0.15, 1.0, 5

_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:", b"!", b"?", b"#*$%&<>", b"|", b"\"'()[]{}-_=+/\\@~^`"), 1):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 12
N_CLASSES = 13
N_FEATURES = 12 + N_CLASSES


def statistics(text: str) -> list[float]:
    """The features of a text; all 0 for the empty one."""
    p = Page(text)
    n, size = max(p.n_words, 1), max(len(p.raw), 1)
    bytes_seen = np.bincount(np.frombuffer(p.raw, np.uint8), minlength=256) if p.raw else np.zeros(256)
    share = bytes_seen[bytes_seen > 0] / size
    often = Counter(p.words)
    top = [k for _, k in often.most_common(10)]
    classes = np.bincount(_CLASS, bytes_seen, N_CLASSES) / size
    lines = max(len(p.lines), 1)
    return [
        float(np.log1p(p.n_words)), p.word_chars / n, p.n_dup_lines / lines, p.n_repeat_words / n, n / lines if p.n_words else 0.0, len(often) / n,
        (top[0] if top else 0) / n, sum(top) / n, sum(k == 1 for k in often.values()) / n, float(-(share * np.log2(share)).sum()) if len(share) else 0.0,
        max(map(len, p.words), default=0) ** 0.5, sum(len(w) <= 3 for w in p.words) / n, *classes.tolist(),
    ]


@dataclass
class Trees:
    """cuts: bin borders of each feature; feature, at: the split of each inner node; value: of each leaf."""

    cuts: list[np.ndarray]
    feature: np.ndarray
    at: np.ndarray
    value: np.ndarray
    start: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], 1).astype(np.int16) if len(x) else np.zeros((0, len(self.cuts)), np.int16)

    def score(self, x: np.ndarray) -> np.ndarray:
        b, rows = self.bins(x), np.arange(len(x))
        z = np.full(len(x), self.start)
        for f, at, value in zip(self.feature, self.at, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (b[rows, f[node]] > at[node])
            z += value[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for logistic loss."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    none = Trees([np.zeros(0)] * x.shape[1], np.zeros((0, inner), np.int64), np.zeros((0, inner), np.int64), np.zeros((0, leaves)), 0.0)
    if not len(y):
        return none
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(cuts, *[[], [], []], start=float(np.log(p / (1 - p))))
    b = model.bins(x).astype(np.int64)
    z = np.full(len(y), model.start)
    for _ in range(TREES):
        q = 1 / (1 + np.exp(-z))
        g, h = q - y, q * (1 - q)
        feature, at = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            for j in range(x.shape[1]):
                key = (node - first) * BINS + b[:, j]
                sums = [np.bincount(key, w, width * BINS).reshape(width, BINS).cumsum(1) for w in (g, h, None)]
                (gl, hl, nl), (gt, ht, nt) = sums, [s[:, -1:] for s in sums]
                gain = gl**2 / (hl + SMOOTH) + (gt - gl) ** 2 / (ht - hl + SMOOTH) - gt**2 / (ht + SMOOTH)
                gain[(nl < LEAST) | (nt - nl < LEAST)] = 0
                k = gain.argmax(1)
                won = gain[np.arange(width), k] > best
                best[won] = gain[np.arange(width), k][won]
                feature[first : first + width][won] = j
                at[first : first + width][won] = k[won]
            node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > at[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + SMOOTH)
        z += value[leaf]
        model.feature.append(feature)
        model.at.append(at)
        model.value.append(value)
    return model


def _features(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    schema = T.StructType([*[field(docs, c) for c in keep], T.StructField("x", T.ArrayType(T.DoubleType()))])

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch_of(schema, [*batch.columns[:-1], [statistics(t) for t in texts(batch, len(keep))]])

    return arrow_map(docs.select(*keep, text_col), measure, schema)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Trees:
    """Learn from labelled rows that are not held out, ``rows`` of them in expectation at most."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    hashed = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    pairs = stored(docs.select(F.col(id_col).alias("id"), hashed.alias("hash")).join(known, "id").distinct(), "quality-labelled")
    total = pairs.count()
    if total > rows:
        pairs = pairs.where(F.pmod(F.xxhash64("id", "hash", "y"), F.lit(1 << 30)) < int((1 << 30) * rows / total))
    # Bounded by `rows`, so it may be broadcast; the texts stay where they are.
    chosen = docs.select(F.col(id_col).alias("id"), hashed.alias("hash"), F.col(text_col).alias("text_")).join(F.broadcast(pairs), ["id", "hash"]).dropDuplicates(["id", "hash", "y"])
    found = sorted((r[0], r[1], tuple(r[2])) for r in _features(chosen, ["id", "y"], "text_").collect())
    x = np.array([r[2] for r in found]) if found else np.zeros((0, N_FEATURES))
    return grow(x, np.array([r[1] for r in found], float))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = 0.7, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: id, held_out, score, predicted (1 from ``least`` on)."""
    spark = session(docs)
    model = spark.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, rows))
    schema = T.StructType([field(docs, id_col), T.StructField("score", T.DoubleType())])

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([statistics(t) for t in texts(batch)])
        return batch_of(schema, [batch.column(0), model.value.score(x)])

    scored = arrow_map(docs.select(id_col, text_col), judge, schema)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
