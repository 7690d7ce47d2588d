"""Uniform shuffle into shards of exact sizes (native).

The rows' partitions hold known counts and the shards get known counts; the
matrix of how many rows go from which partition to which shard is drawn from
the multivariate hypergeometric law, which is what a uniform permutation of all
rows would give. Rows are then permuted inside their partition, cut at the
matrix' counts, exchanged, and permuted again inside their shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larderflow.llm.ordering import key_block, running_total
from larderflow.llm.scratch import Scratch


#: Counts below which numpy draws (it refuses 10**9 and more), and how many standard deviations the sampler for greater ones looks at.
NUMPY_TOTAL, REACH = 10**9, 12


def hypergeometric(good: int, bad: int, draws: int, rng: np.random.Generator) -> int:
    """How many of ``draws`` without replacement are good, for counts of any size.

    Large counts are drawn by inversion: the probabilities relative to the mode's
    are running products of the law's own ratios, over all values within REACH
    standard deviations (beyond lies less than 1e-30).
    """
    total = good + bad
    if total < NUMPY_TOTAL:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    least, most = max(0, draws - bad), min(draws, good)
    mode = min(most, max(least, (draws + 1) * (good + 1) // (total + 2)))
    spread = draws / total * good * (bad / total) * (total - draws) / (total - 1)
    reach = int(REACH * spread**0.5) + 32
    low, high = max(least, mode - reach), min(most, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    # p(k + 1) / p(k)
    logs = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    p = np.concatenate([[0.0], np.cumsum(logs)])
    p = np.exp(p - p.max())
    sums = np.cumsum(p)
    return low + int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))


def _deal(sizes: list[int], draws: int, rng: np.random.Generator) -> list[int]:
    """How many of ``draws`` places taken without replacement fall in each shard with that many places left."""
    total = sum(sizes)
    if total < NUMPY_TOTAL:
        return rng.multivariate_hypergeometric(sizes, draws, method="marginals").tolist() if total else [0] * len(sizes)
    out = []
    for size in sizes:
        total -= size
        out.append(hypergeometric(size, total, draws, rng))
        draws -= out[-1]
    return out


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Partitions x shards, with row sums ``counts`` and column sums at most one apart.

    All places of all shards are dealt to the first and the second half of the
    partitions, each half's to its halves, and so on: each step draws without
    replacement, so the whole matrix has the multivariate hypergeometric law. The
    great counts are all in the first few steps.
    """
    rng, total = np.random.default_rng(seed), int(sum(counts))
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    out = np.zeros((len(counts), shards), dtype=np.int64)
    before = np.concatenate([[0], np.cumsum(np.array(counts, dtype=np.int64))])
    todo = [(0, len(counts), sizes)] if counts else []
    while todo:
        first, last, sizes = todo.pop()
        if last - first == 1:
            out[first] = sizes
            continue
        half = (first + last) // 2
        left = _deal(sizes, int(before[half] - before[first]), rng)
        todo += [(first, half, left), (half, last, [a - b for a, b in zip(sizes, left, strict=True)])]
    return out


def shard(docs: DataFrame, shards: int = 24, seed: int = 11) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    The law is ``rows``: shards' row counts are at most one apart. ``size`` is
    the text's UTF-8 bytes (null: none) plus 8, ``text_crc32`` that of its bytes
    (null: of none). ``slot`` counts from 0 without gaps in each shard. Rows are
    told apart by their place in the input, so ties, repeated rows and null ids
    need no rule; equal texts spread like any rows. An empty table gives no rows.
    Equal texts, being rows of their own under this law, are not held together.
    Only ids, sizes and checksums move; the texts stay where they are. The driver
    holds partitions x shards counts and nothing that grows with the rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = scratch.table(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        )
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("row", 33)),
        "rows",
    )
    counts = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = sorted(counts)
    matrix = communication_matrix([counts[p] for p in parts], shards, seed) if parts else []
    ends = spark.createDataFrame(
        [(p, [int(x) for x in np.cumsum(line)]) for p, line in zip(parts, matrix, strict=True)],
        "part long, ends array<long>",
    )
    first = F.xxhash64(F.lit(seed), "row")
    local = W.partitionBy("part").orderBy(first, "row")
    # a partition's rows go to the first shard whose running count exceeds their permuted place
    dealt = (
        rows.withColumn("place", F.row_number().over(local) - 1)
        .join(ends, "part")
        .withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("place"))))
        .drop("ends", "place", "part")
    )
    second = F.xxhash64(F.lit(seed + 1), "row")
    dealt = scratch.table(dealt.withColumn("key", second).withColumn("block", key_block(F.col("key"))), "dealt")
    scratch.drop("rows")
    slots = running_total(dealt, ["shard"], "block", ["key", "row"], F.lit(1).cast("long"), "slot")
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
