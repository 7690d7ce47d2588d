"""Language identification by sparse multinomial logistic regression.

Texts are TF-IDF vectors of hashed character n-grams of one to three code
points. Weights are trained with the follow-the-regularised-leader proximal
update under an elastic-net penalty (the L1 part makes them sparse), on a
bounded sample of labelled documents; document frequencies cover all training
documents. A temperature fitted on a part of the sample that training leaves out
calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larderflow.llm.gather import fold, gather, sample_ids
from larderflow.llm.scratch import Scratch, arrow_batches

BITS = 15
DIMS = 1 << BITS
#: Training documents of each language that training may look at.
PER_LANGUAGE = 512
UNKNOWN = "und"
_LETTER: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, with each run of what isn't a letter as one space, and one at either end."""
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = _LETTER[0][points]
    points = np.concatenate([[np.uint32(32)], np.where(is_letter, points, np.uint32(32)), [np.uint32(32)]]).astype(np.uint32)
    space = points == 32
    return points[~(space & np.append(False, space[:-1]))]


def features(raw: bytes) -> np.ndarray:
    """Counts of the text's hashed n-grams; all 0 if it has no letter."""
    p = letters(raw.decode("utf-8", "replace"))
    if len(p) < 2 or not (p != 32).any():
        return np.zeros(DIMS, dtype=np.int64)
    one = p * np.uint32(0x9E3779B1)
    two = one[:-1] * np.uint32(31) + p[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(33) + p[2:] * np.uint32(0xC2B2AE3D)
    grams = np.concatenate([one[p != 32], two, three])
    grams ^= grams >> np.uint32(15)
    return np.bincount((grams * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS), minlength=DIMS)


@dataclass
class Model:
    """Languages, and dense arrays for scoring: ``weights`` languages x features, already times idf."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    info: dict = field(default_factory=dict)

    def predict(self, counts: np.ndarray) -> tuple[str, float]:
        at = np.flatnonzero(counts)
        if not len(at) or not self.languages:
            return UNKNOWN, 0.0
        x = counts[at] * self.idf[at]
        z = (self.weights[:, at] @ (x / np.sqrt(x @ x)) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        best = int(np.argmax(p))
        return self.languages[best], float(p[best] / p.sum())


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(xs: list, ys: np.ndarray, classes: int, alpha=1.0, beta=1.0, l1=0.02, l2=0.01, epochs=4, seed=3):
    """(weights, bias) of the multinomial model; ``xs`` are pairs of feature numbers and values.

    A per-coordinate learning rate falls with the squares of past gradients; a
    weight is zero until the sum of its adjusted gradients exceeds ``l1``.
    """
    z, n = np.zeros((classes, DIMS + 1)), np.zeros((classes, DIMS + 1))

    def weights(at):
        zz = z[:, at]
        w = -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[:, at])) / alpha + l2)
        return np.where(np.abs(zz) <= l1, 0.0, w)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(xs)):
            at, x = np.append(xs[k][0], DIMS), np.append(xs[k][1], 1.0)  # the last is the bias
            w = weights(at)
            p = _softmax(w @ x)
            p[ys[k]] -= 1.0
            g = p[:, None] * x
            nn = n[:, at]
            z[:, at] += g - (np.sqrt(nn + g * g) - np.sqrt(nn)) / alpha * w
            n[:, at] = nn + g * g
    w = weights(np.arange(DIMS + 1))
    return w[:, :DIMS], w[:, DIMS]


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learns from the rows of ``docs`` (doc_id, text, lang) with a lang and an id.

    Document frequencies count every such row; weights come from at most
    ``per_language`` documents of each language, the temperature from a fifth of
    those. At most MOST_LABELS languages are learnt, the most frequent ones, so
    the model and what is broadcast are bounded. A doc_id that occurs under
    several languages has the least of them, and of its texts in that language
    the one with the least hash is looked at. A table without labels gives a
    model without languages, which answers ``und``.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    docs = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    sample = sample_ids(docs, "lang", per_language)
    count, frequency, found = gather(docs, features, DIMS, sample, Scratch(docs.sparkSession, "language-id"), label="lang")
    idf = np.log((1 + count) / (1 + frequency)) + 1
    languages = sorted(set(sample.values()))
    ids = sorted(i for i in found if len(found[i][0]))
    if not ids:
        return Model([], idf, np.zeros((0, DIMS)), np.zeros(0))

    def vector(i):
        at, n = found[i]
        x = n * idf[at]
        return at, x / np.sqrt(x @ x)

    xs, ys = [vector(i) for i in ids], np.array([languages.index(sample[i]) for i in ids])
    test = np.arange(len(ids)) % 5 == 4
    w, b = train_ftrl([x for x, t in zip(xs, test, strict=True) if not t], ys[~test], len(languages))
    temperature = 1.0
    if test.any():
        logits = np.array([w[:, xs[k][0]] @ xs[k][1] + b for k in np.flatnonzero(test)])
        losses = {t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(logits)), ys[test]], 1e-12)).mean() for t in np.geomspace(0.1, 10, 81)}
        temperature = float(min(losses, key=losses.get))
    return Model(languages, idf, w, b, temperature, {"sparsity": float((w == 0).mean()), "documents": count, "sample": len(ids)})


def identify(docs: DataFrame, model: Model, keep: float | None = None, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (doc_id by default) with ``lang_pred`` and ``score`` appended, or a filter.

    Null text and text without letters is ``und`` with score 0. With ``keep``
    the result is instead ``docs`` itself without rows that are ``und`` or whose
    score is below ``keep``. Ties go to the first language in order. An empty
    table gives no rows. The result reads a written table, so a later loss of an
    executor never scores a text twice.
    """
    spark = docs.sparkSession
    names = docs.columns if keep is not None else (columns or ["doc_id"])
    shared = spark.sparkContext.broadcast(model)
    kinds = [f for f in docs.schema.fields if f.name in names]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last = b.num_columns - 1
            said = [shared.value.predict(features(t.as_py() or b"")) for t in b.column(last).cast(pa.large_binary())]
            lang, score = pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())
            arrays = [b.column(i) for i in range(last)]
            if keep is None:
                yield pa.RecordBatch.from_arrays([*arrays, lang, score], [*names, "lang_pred", "score"])
            else:
                good = pa.array([s[0] != UNKNOWN and s[1] >= keep for s in said], pa.bool_())
                yield pa.RecordBatch.from_arrays(arrays, names).filter(good)

    more = [] if keep is not None else [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    picked = docs.select(*[F.col(f"`{k.name}`") for k in kinds], F.col("text").cast("string").alias("__text"))
    names = [k.name for k in kinds]
    with arrow_batches(spark):
        return Scratch(spark, "language-id").table(picked.mapInArrow(over, T.StructType([*kinds, *more])), "out")


def training_fold(docs: DataFrame) -> DataFrame:
    """The rows to learn from: crc32(doc_id as text) mod 4 is not 2."""
    return docs.filter(fold(F.col("doc_id"), 4) != 2)
