"""Quality classification by nearest-neighbour voting in a latent-semantic space.

Texts are TF-IDF vectors of hashed style features (shapes of characters, byte
trigrams, word repetition), projected on the leading singular vectors of a
bounded sample of labelled texts. The sample's projected vectors and labels are
broadcast; every document's cosine products with all of them are computed
exactly, block by block, and its nearest neighbours vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larderflow.llm.gather import fold, gather, sample_ids
from larderflow.llm.scratch import Scratch, arrow_batches

BITS = 13
#: Labelled documents of each label that the model may hold; what is broadcast is bounded by it.
PER_LABEL = 1024
RANK = 48
NEIGHBOURS = 32
#: Power of the similarity that weighs a vote.
SHARPNESS = 8
#: Score from which label 1 is predicted.
THRESHOLD = 0.3
#: Features of their own, after the hashed ones, for the share of words that repeat the word before from each of these on; several, to weigh more.
REPEAT_FROM = (0.02, 0.1, 0.4)
REPEAT_FEATURES = 16
HASHED = 1 << BITS
DIMS = HASHED + len(REPEAT_FROM) * REPEAT_FEATURES


def _shapes() -> np.ndarray:
    """A class for each byte: lower, upper, digit, space, line feed, not ASCII, and each other character its own."""
    out = np.arange(256, dtype=np.uint32)
    out[ord("a") : ord("z") + 1], out[ord("A") : ord("Z") + 1], out[ord("0") : ord("9") + 1] = 1, 2, 3
    out[128:] = 4
    return out


SHAPES = _shapes()


def features(raw: bytes) -> np.ndarray:
    """Counts of the text's style features."""
    if not raw:
        return np.zeros(DIMS, dtype=np.int64)
    points = np.frombuffer(b" " + raw + b" ", dtype=np.uint8)
    shape = SHAPES[points]
    two = shape[:-1] * np.uint32(256) + shape[1:]
    four = two[:-2] * np.uint32(0x10001) ^ two[2:] * np.uint32(0x9E3779B1)
    byte = points.astype(np.uint32)
    three = byte[:-2] << np.uint32(16) | byte[1:-1] << np.uint32(8) | byte[2:]
    grams = np.concatenate([two * np.uint32(0x85EBCA77), four, three * np.uint32(0xC2B2AE3D)])
    grams ^= grams >> np.uint32(15)
    counts = np.bincount((grams * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS), minlength=DIMS)
    words = raw.split()
    share = sum(map(bytes.__eq__, words[1:], words)) / max(1, len(words))
    for k, least in enumerate(REPEAT_FROM):
        counts[HASHED + k * REPEAT_FEATURES : HASHED + (k + 1) * REPEAT_FEATURES] = len(raw) if share >= least else 0
    return counts


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray  # features x rank
    vectors: np.ndarray  # rank x labelled documents, of length 1
    labels: np.ndarray
    votes: np.ndarray  # documents that each labelled vector stands for
    prior: float

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        return np.log1p(counts, dtype=np.float32) * self.idf

    def project(self, counts: np.ndarray) -> np.ndarray:
        """Latent vectors of length 1 for rows of counts; the zero vector for what has no features."""
        x = self.weigh(counts) @ self.axes
        return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the neighbours; the prior where none is similar."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        sims = self.project(counts) @ self.vectors
        k = min(NEIGHBOURS, sims.shape[1])
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(sims, near, axis=1), 0) ** SHARPNESS * self.votes[near]
        total = w.sum(axis=1)
        return np.where(total > 1e-9, (w * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-9), self.prior).astype(np.float64)


def _leading_axes(x: np.ndarray, rank: int, seed: int = 7) -> np.ndarray:
    """The leading right singular vectors by randomised subspace iteration."""
    rank = min(rank, *x.shape)
    y = x @ np.random.default_rng(seed).standard_normal((x.shape[1], rank + 8)).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(y)
        y = x @ (x.T @ q)
    q, _ = np.linalg.qr(y)
    return np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T.astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Learns from ``labels`` (doc_id, quality 0 or 1) of folds other than 0 and all texts of ``docs``.

    Document frequencies count every row of ``docs``. The labelled vectors are
    at most ``per_label`` documents of each label. Their shares do not follow
    the labels' if a bound is met, so votes are weighted back to them. A doc_id
    with both labels has label 0, and of its texts the one with the least hash is
    looked at. Rows without id or label teach nothing; without any, every score
    is 0.5.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    labels = labels.filter(F.col("quality").isin(0, 1) & (fold(F.col("doc_id"), 5) != 0))
    shares = {r["quality"]: r["n"] for r in labels.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = sample_ids(labels, "quality", per_label)
    count, frequency, found = gather(docs, features, DIMS, sample, Scratch(docs.sparkSession, "quality"))
    idf = (np.log((1 + count) / (1 + frequency)) + 1).astype(np.float32)
    ids = sorted(i for i in found if len(found[i][0]))
    prior = shares.get(1, 0) / max(1, sum(shares.values())) if shares else 0.5
    model = Model(idf, np.zeros((DIMS, 1), np.float32), np.zeros((1, 0), np.float32), np.zeros(0), np.zeros(0), prior)
    if ids:
        counts = np.zeros((len(ids), DIMS), dtype=np.float32)
        for row, i in enumerate(ids):
            counts[row, found[i][0]] = found[i][1]
        x = model.weigh(counts)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        model.axes = _leading_axes(x, RANK)
        model.vectors = np.ascontiguousarray(model.project(counts).T)
        model.labels = np.array([sample[i] for i in ids], dtype=np.float64)
        held = np.bincount(model.labels.astype(int), minlength=2)
        model.votes = np.array([shares[int(y)] / held[int(y)] for y in model.labels]) / sum(shares.values()) * len(ids)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, score, predicted``, from the text alone.

    Null text counts as empty; texts without features get the labels' mean. Rows
    need no distinct ids, and an empty table gives no rows. The result reads a
    written table.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.large_binary())
            counts = np.array([features(t.as_py() or b"") for t in texts]).reshape(-1, DIMS)
            said = shared.value.score(counts)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(said), pa.array((said >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with arrow_batches(spark):
        return Scratch(spark, "quality").table(picked.mapInArrow(over, "doc_id long, score double, predicted int"), "out")
