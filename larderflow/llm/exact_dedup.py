"""Exact dedup against a persistent digest index (native).

The index is an append-only Parquet table, bucketed and sorted by digest, with
one row for each distinct text ever kept. A batch is reduced to one row per
digest (partial aggregation first, so a text that is a third of the batch costs
one row per task), anti-joined to the index by sort-merge, and what is new is
appended. The index side of that join is never shuffled. Each batch adds one
sorted file to a bucket, so a task sorts a bucket's files together, which is
near linear on sorted runs; ``DigestIndex.compact`` makes them one file again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larderflow.llm.scratch import Scratch
from larderflow.llm.text import ascii_lower


class DigestIndex:
    """Digests of kept texts: ``digest, keep_id, batch``, at a path that outlives the session.

    ``buckets`` bounds the tasks of the joins with the index and can't be changed
    later; a digest row takes about 100 bytes, so give one bucket for every few
    million texts that the index is to hold.
    """

    def __init__(self, spark: SparkSession, path: str, name: str | None = None, buckets: int = 48):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self._create(self.name, path)

    def _create(self, name: str, path: str) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest STRING, keep_id BIGINT, batch STRING) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def _insert(self, rows: DataFrame, name: str) -> None:
        rows.select("digest", "keep_id", "batch").repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(name)

    def append(self, rows: DataFrame) -> None:
        """One task writes each bucket, so a batch adds at most one sorted file to a bucket."""
        self._insert(rows, self.name)

    def compact(self, path: str) -> DigestIndex:
        """The same index at another path, with one file for each bucket; this one stays as it is."""
        other = DigestIndex(self.spark, path, buckets=self.buckets)
        self._insert(self.read(), other.name)
        return other

    def forget(self) -> None:
        """Takes the table out of the session's catalogue; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def normalised_digest(text: Column) -> Column:
    """SHA-256 of the text with A to Z lower-cased; null counts as empty."""
    return F.sha2(ascii_lower(text), 256)


def dedup_batch(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    A text that an earlier batch kept is never kept again; its ``keep_id`` is
    the earlier document. Of equal texts in this batch the largest doc_id stays
    (a null doc_id is smallest; of rows with the same doc_id exactly one stays).
    ``group_size`` counts the batch's rows. Null text counts as empty, an empty
    table gives an empty result, and further columns are ignored. A batch that
    is run again under the same name gives the same result and appends nothing,
    however its rows are dealt to partitions then: the index remembers which
    batch kept a text, and the row that stays is found anew among the batch's.
    """
    spark, batch = docs.sparkSession, batch or uuid.uuid4().hex
    scratch = Scratch(spark, "exact-dedup")
    rows = scratch.table(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            normalised_digest(F.col("text")).alias("digest"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "rows",
    )
    groups = scratch.table(
        rows.groupBy("digest")
        .agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("group_size"))
        .select("digest", "group_size", F.col("top.doc_id").alias("keep_id"), F.col("top.row").alias("keep_row"), F.lit(batch).alias("batch")),
        "groups",
    )
    index.append(groups.join(index.read().hint("merge"), "digest", "left_anti"))
    known = index.read().select("digest", "keep_id", F.when(F.col("batch") == batch, F.lit(True)).alias("ours"))
    settled = groups.select("digest", "group_size", "keep_row").join(known.hint("merge"), "digest")
    settled = scratch.table(settled.select("digest", "group_size", "keep_id", F.when(F.col("ours"), F.col("keep_row")).alias("keep_row")), "settled")
    scratch.drop("groups")
    # both sides are plain scans, so adaptive execution can split a hot digest
    return rows.join(settled, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def dedup(docs: DataFrame) -> DataFrame:
    """``dedup_batch`` of one batch against a new index, which is dropped with it."""
    scratch = Scratch(docs.sparkSession, "digest-index")
    index = DigestIndex(docs.sparkSession, f"{scratch.path}/index")
    out = dedup_batch(docs, index)
    index.forget()
    scratch.drop("index")
    return out
