"""Similarity of texts as sets of word shingles: what SimHash links are checked against."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larderflow.llm.scratch import Scratch, arrow_batches

WIDTH = 5
#: Least Jaccard similarity of near-duplicates, as a fraction.
LEAST = (4, 5)
#: 64-bit words of a parity bitmap.
BITMAP = 8
B = [f"b{w}" for w in range(BITMAP)]
#: 64-bit words of a wide fingerprint. Sets of Jaccard similarity 0.8 are expected to differ in 19 of 128 bits (standard
#: deviation 4), the smallest ones in 24, and unlike sets in 64 (standard deviation 6).
WORDS = 2
P = [f"p{w}" for w in range(WORDS)]
#: Bands of a set, and least hashes in each. Sets of Jaccard similarity s share no band with probability (1 - s^4)^32, at 0.8 one in 20 million.
BANDS, BAND = 32, 4
K = [f"k{w}" for w in range(BANDS)]
#: One fixed order of the shingles for each least hash: by their product with an odd number, modulo 2^64.
ORDERS = np.random.Generator(np.random.PCG64(42)).integers(0, 2**64, (BANDS * BAND, 1), dtype=np.uint64) | np.uint64(1)


def shingles(raw: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the word shingles of a UTF-8 text; a shorter text is one shingle, one without words has none."""
    words = raw.lower().split()  # on bytes: A to Z, and exactly space and tab to carriage return
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, 42)], dtype=np.uint64)
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lens + 1) - 1
    first, last = (ends - lens)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(first, last, strict=True)), dtype=np.uint64, count=len(first)))


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Bit b is the parity of the hashes that are b modulo the bits; two bitmaps never differ in more bits than the sets in members."""
    odd = np.bincount((hashes % np.uint64(64 * BITMAP)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def bands(hashes: np.ndarray) -> np.ndarray:
    """Names of the bands of a set of shingles, zeros for an empty one; sets share one if they agree in all its least hashes."""
    out = np.zeros(BANDS, dtype=np.uint64)
    if len(hashes):
        parts = [hashes[None, at : at + 2048] for at in range(0, len(hashes), 2048)]
        least = functools.reduce(np.minimum, [(ORDERS * part).min(axis=1) for part in parts])
        out[:] = [xxhash.xxh64_intdigest(least[k * BAND : (k + 1) * BAND].tobytes(), k) for k in range(BANDS)]
    return out


def set_name(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a set of shingles."""
    h = xxhash.xxh64_intdigest(hashes.tobytes(), 42)
    return h - 2**64 if h >= 2**63 else h


def texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    return (t.as_py() or b"" for t in batch.column("text").cast(pa.large_binary()))


def _members(width: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, width) for t in texts(b)]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([pa.array([set_name(s) for s in sets], pa.int64()), lists], ["set", "hashes"])

    return over


def verified(pairs: DataFrame, nodes: DataFrame, slim: DataFrame, width: int, least: tuple[int, int], radius: int, scratch: Scratch, name: str) -> DataFrame:
    """Those of the pairs ``u, v`` (names of sets) whose fingerprints are within ``radius`` and whose similarity is ``least`` or more.

    ``nodes`` (set, key, n, words of fingerprint and bitmap) names for each set a
    row of ``slim`` (key, text) that has it, its size and bitmap. Fingerprints,
    sizes and bitmaps rule most pairs out; only the texts of sets in the rest are
    read into shingles again.
    """
    p, q = least
    side = lambda s: nodes.select(F.col("set").alias(s), F.col("n").alias(f"n_{s}"), *[F.col(b).alias(f"{b}_{s}") for b in (*P, *B)])
    near = pairs.distinct().join(side("u"), "u").filter("n_u > 0").join(side("v"), "v")
    small = q * F.least("n_u", "n_v") >= p * F.greatest("n_u", "n_v")
    bits = lambda words: functools.reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{b}_u").bitwiseXOR(F.col(f"{b}_v"))) for b in words])
    apart = bits(B)
    # members that are shared: (n_u + n_v - members that differ) / 2
    near = near.filter((bits(P) <= radius) & small & ((p + q) * (F.col("n_u") + F.col("n_v") - apart) >= 2 * p * (F.col("n_u") + F.col("n_v"))))
    pairs = scratch.table(near.select("u", "v"), f"{name}-pairs")
    n = pairs.count()
    ends = pairs.select(F.col("u").alias("set")).union(pairs.select(F.col("v").alias("set"))).distinct()
    keys = scratch.table(nodes.join(ends, "set").select("key").distinct(), f"{name}-keys", 2 * n)
    with arrow_batches(slim.sparkSession):
        sets = slim.join(keys, "key", "left_semi").select("text").mapInArrow(_members(width), "set long, hashes array<long>")
        sets = scratch.table(sets.groupBy("set").agg(F.first("hashes").alias("hashes")), f"{name}-sets")
    side = lambda s: sets.select(F.col("set").alias(s), F.col("hashes").alias(f"hashes_{s}"))
    shared, both = F.size(F.array_intersect("hashes_u", "hashes_v")), F.size("hashes_u") + F.size("hashes_v")
    out = pairs.join(side("u"), "u").join(side("v"), "v").filter((p + q) * shared >= p * both)
    out = scratch.table(out.select("u", "v"), name, n)
    scratch.drop(f"{name}-pairs", f"{name}-keys", f"{name}-sets")
    return out
