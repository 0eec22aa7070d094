"""Language identification: family first, then the languages within it.

A text is a vector of hashed letter trigrams (counts under a square root, of
length 1). One-versus-one linear support vector machines choose the family;
others, each trained on two languages of one family only, choose the language
among close relatives. Training rows are a bounded sample, the same number for
each language, chosen by a hash of id and text (rows equal in both count once,
so repeated rows cannot outgrow the bound); all texts are predicted, whole.

Defined results: ``und`` with score 0 for null texts, texts without a letter,
or where nothing could be learned; ids may be null or repeated.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import arrow_map, batch_of, field, held_out, session, texts

#: Families of close relatives; any other language is a family of its own.
FAMILIES = {
    "germanic": ("de", "en", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("pl", "cs", "sk", "ru", "uk", "bg", "sr", "hr", "sl"),
}
#: Rows for training: of all languages together, and of one.
TRAIN_ROWS, LANGUAGE_ROWS = 8000, 1500
DIMS = 2048
_SHIFT = 32 - 11

_MAYBE_LETTERS = re.compile(r"[^\W\d_]+")  # all letters, and numerals such as ½ and ²
_FOLD = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def has_letter(text: str) -> bool:
    """Some character of the Unicode category L."""
    return any(c.isalpha() for m in _MAYBE_LETTERS.finditer(text) for c in m[0])


def vector(text: str) -> np.ndarray:
    """The trigram vector of a whole text."""
    raw = np.frombuffer((b" " + text.lower().encode().translate(_FOLD) + b" "), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(DIMS, np.float32)
    code = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    code = code[(raw[:-2] != 32) | (raw[1:-1] != 32)]  # runs of white space say nothing
    x = np.sqrt(np.bincount((code * np.uint32(2654435761)) >> np.uint32(_SHIFT), minlength=DIMS)).astype(np.float32)
    return x / max(float(np.sqrt((x * x).sum())), 1e-9)


def support_vectors(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 150) -> np.ndarray:
    """A linear SVM (squared hinge, accelerated gradient); y is -1 or 1. The last weight is the bias."""
    x1 = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    w = v = np.zeros(x1.shape[1], np.float32)
    balance = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32) * cost * 10
    step, t = 1 / (1 + 4 * float(balance.sum())), 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x1 @ v))
        new = v - step * (v - 2 * (x1.T @ (balance * slack * y)))
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        v = new + ((before - 1) / t) * (new - w)
        w = new
    return w.astype(np.float32)


@dataclass
class Duels:
    """One-versus-one machines between classes: votes decide, then margins."""

    classes: list[str]
    weights: np.ndarray

    @classmethod
    def learn(cls, x: np.ndarray, names: np.ndarray) -> Duels:
        classes = sorted(set(names.tolist()))
        w = [support_vectors(x[m := np.isin(names, (a, b))], np.where(names[m] == a, 1.0, -1.0).astype(np.float32)) for a, b in combinations(classes, 2)]
        return cls(classes, np.array(w, np.float32).reshape(len(w), x.shape[1] + 1))

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winning class, and its lowest margin squashed to 0..1 (1 without rivals)."""
        n, k = len(x), len(self.classes)
        votes, margin, least = np.zeros((n, k)), np.zeros((n, k)), np.full((n, k), np.inf)
        z = x @ self.weights[:, :-1].T + self.weights[:, -1]
        for j, (a, b) in enumerate(combinations(range(k), 2)):
            for c, m in ((a, z[:, j]), (b, -z[:, j])):
                votes[:, c] += m > 0
                margin[:, c] += m
                least[:, c] = np.minimum(least[:, c], m)
        won = np.lexsort((margin, votes), axis=1)[:, -1] if k > 1 else np.zeros(n, np.int64)
        return won, 1 / (1 + np.exp(-3 * np.clip(least[np.arange(n), won], -10, 10)))


@dataclass
class Languages:
    families: Duels
    within: list[Duels]

    @classmethod
    def learn(cls, x: np.ndarray, langs: np.ndarray, families: dict[str, tuple[str, ...]]) -> Languages:
        of = {lang: f for f, several in families.items() for lang in several}
        family = np.array([of.get(lang, f"={lang}") for lang in langs.tolist()])
        top = Duels.learn(x, family)
        return cls(top, [Duels.learn(x[family == f], langs[family == f]) for f in top.classes])

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        family, score = self.families.decide(x)
        names = np.empty(len(x), object)
        for f, duels in enumerate(self.within):
            if (m := family == f).any():
                won, s = duels.decide(x[m])
                names[m] = np.array(duels.classes, object)[won]
                score[m] *= s
        return names.tolist(), score


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, families: dict[str, tuple[str, ...]], rows: int) -> Languages | None:
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    counts = usable.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(rows).collect()
    if not counts:
        return None
    each = min(LANGUAGE_ROWS, max(2, rows // len(counts)))
    rate = F.create_map(*[F.lit(v) for r in counts for v in (r[0], min(1.0, each / r[1]))])
    chosen = usable.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30)) < rate[F.col(lang_col)] * (1 << 30)).select(id_col, lang_col, text_col).distinct()
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("x", T.BinaryType())])

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(lang, vector(t).tobytes()) for lang, t in zip(batch.column(0).to_pylist(), texts(batch), strict=True) if has_letter(t)]
        return batch_of(schema, [[a for a, _ in found], [b for _, b in found]])

    found = sorted((r[0], bytes(r[1])) for r in arrow_map(chosen.select(lang_col, text_col), measure, schema).collect())
    if not found:
        return None
    x = np.frombuffer(b"".join(r[1] for r in found), np.float32).reshape(len(found), DIMS)
    return Languages.learn(x, np.array([r[0] for r in found]), families)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", families: dict[str, tuple[str, ...]] = FAMILIES, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score."""
    spark = session(docs)
    model = spark.sparkContext.broadcast(train(docs, id_col, text_col, lang_col, families, rows))
    schema = T.StructType([field(docs, id_col), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
        several = texts(batch)
        names, score = ["und"] * len(several), np.zeros(len(several))
        some = [i for i, t in enumerate(several) if has_letter(t)] if model.value else []
        for k in range(0, len(some), 256):
            part = some[k : k + 256]
            found, score[part] = model.value.predict(np.stack([vector(several[i]) for i in part]))
            for i, name in zip(part, found, strict=True):
                names[i] = name
        return batch_of(schema, [batch.column(0), names, score])

    found = arrow_map(docs.select(id_col, text_col), predict, schema)
    return found.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
