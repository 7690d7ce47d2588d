"""One pass over all texts for what a text model learns from a corpus.

The pass counts in how many documents each hashed feature occurs, over every
document asked for, and brings the features of a bounded set of sampled
documents to the driver. Neither result grows with the corpus: the counts have
as many entries as there are features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larderflow.llm.scratch import Scratch, arrow_batches


def fold(doc_id, n: int):
    """crc32 of doc_id as text, modulo n; a null id falls in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


#: Labels that a model may know: the most frequent ones, of equal counts the first in order.
MOST_LABELS = 256


def sample_ids(labelled: DataFrame, label: str, per_label: int, most: int = MOST_LABELS) -> dict[int, object]:
    """At most ``per_label`` documents of each label, lowest hash of the id first; a doc_id under several labels has the least of them.

    Every label gets its own bound on the hash, from its count of distinct ids,
    that about twice ``per_label`` ids pass; only those are aggregated by id and
    collected. So nothing of a label gathers in one task, and the driver sees at
    most ``most`` labels and a few times ``per_label`` ids of each, however many
    rows there are.
    """
    rows = labelled.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", F.col(label).alias("label"))
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("doc_id").alias("ids"))
    counts = counts.orderBy(F.desc("n"), "label").limit(most).collect()
    if not counts:
        return {}
    share = F.pmod(F.xxhash64("doc_id"), F.lit(2**40))
    bounds = F.create_map(*[F.lit(x) for r in counts for x in (r["label"], int(min(1.0, (2 * per_label + 64) / max(1, r["ids"])) * 2**40))])
    few = rows.filter(share < F.try_element_at(bounds, F.col("label"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    by_label: dict[object, list] = {}
    for r in few.select("doc_id", "label", share.alias("at")).collect():
        by_label.setdefault(r["label"], []).append((r["at"], r["doc_id"]))
    return {doc_id: value for value, ids in by_label.items() for _, doc_id in sorted(ids)[:per_label]}


def gather(docs: DataFrame, featurize: Callable[[bytes], np.ndarray], dims: int, sample: dict[int, object], scratch: Scratch, label: str | None = None):
    """(documents counted, document frequencies, {doc_id: (features, counts)}) for the rows of ``docs`` (doc_id, text).

    ``featurize`` gives the count of each feature of a text as an array of ``dims``.
    Of several rows of a sampled doc_id, the one with the least text hash counts,
    and with ``label`` (a column) only those that bear the sampled label.
    """
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(sample)
    # the hash is told apart in Python only for sampled rows
    docs = docs.select("doc_id", "text", (F.col(label) if label else F.lit(None)).cast("string").alias("label"))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, least = np.zeros(dims, dtype=np.int64), 0, {}
        names = ["doc_id", "hash", "at", "n"]
        row = lambda d, h, at, n: pa.RecordBatch.from_arrays(
            [pa.array([d], pa.int64()), pa.array([h], pa.int64()), pa.array([at], pa.list_(pa.int32())), pa.array([n], pa.list_(pa.int64()))], names
        )
        for b in batches:
            ids, labels = b.column("doc_id").to_pylist(), b.column("label").to_pylist()
            for doc_id, said, text in zip(ids, labels, b.column("text").cast(pa.large_binary()), strict=True):
                raw = text.as_py() or b""
                counts = featurize(raw)
                total += counts > 0
                seen += 1
                if doc_id in wanted.value and (label is None or said == wanted.value[doc_id]):
                    h = xxhash.xxh64_intdigest(raw) - 2**63
                    if h < least.get(doc_id, 2**63):
                        least[doc_id] = h
                        at = np.flatnonzero(counts)
                        yield row(doc_id, h, at, counts[at])
        at = np.flatnonzero(total)
        # -1 stands for the number of documents
        yield row(None, None, np.append(at, -1), np.append(total[at], seen))

    with arrow_batches(spark):
        found = scratch.table(docs.mapInArrow(over, "doc_id long, hash long, at array<int>, n array<long>"), "features")
    sums = found.filter("doc_id is null").select(F.explode(F.arrays_zip("at", "n")).alias("z")).groupBy(F.col("z.at").alias("at")).agg(F.sum("z.n").alias("n"))
    frequency, documents = np.zeros(dims, dtype=np.int64), 0
    for r in sums.collect():
        if r["at"] < 0:
            documents = r["n"]
        else:
            frequency[r["at"]] = r["n"]
    rows = found.filter("doc_id is not null").groupBy("doc_id").agg(F.min_by(F.struct("at", "n"), "hash").alias("f"))
    features = {r["doc_id"]: (np.array(r["f"]["at"], dtype=np.int64), np.array(r["f"]["n"], dtype=np.float64)) for r in rows.toLocalIterator()}
    scratch.drop("features")
    return documents, frequency, features
