"""Extension: recipes as a stream.

Extraction and categorisation are stateless. Each micro-batch's contributions are
written to a store, and a replayed batch changes nothing. Reading the lists that
a batch touched costs what their buckets of the store hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larderflow import config as C
from larderflow.operators.combine import combine
from larderflow.operators.labelling import Labeller
from larderflow.plans.pipeline import extract

BUCKETS = 16


def list_bucket(list_id):
    return F.pmod(F.xxhash64(list_id), F.lit(BUCKETS)).cast("int")


def stream_contributions(spark: SparkSession, path: str, schema, store: str, checkpoint: str, cfg: C.Config = C.DEFAULT, labeller: Labeller | None = None) -> StreamingQuery:
    """Reads recipes that arrive as JSON files below ``path`` and appends their ingredients to ``store``.

    The store is partitioned by a hash of the list and by batch; a batch that is
    run again after a failure overwrites its own partitions only.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = extract(batch, cfg, labeller=labeller).withColumn("bucket", list_bucket("list_id"))
        # a folder per batch and bucket: rerunning the batch writes the same folders again
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/batch={batch_id}")

    source = spark.readStream.schema(schema).json(path)
    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_lists(spark: SparkSession, store: str, cfg: C.Config = C.DEFAULT, touched: DataFrame | None = None) -> DataFrame:
    """Lists from all contributions so far; of those ``touched`` (list_id) only their buckets are read."""
    rows = spark.read.parquet(store)
    if touched is not None:
        touched = touched.select("list_id").distinct()
        # at most BUCKETS numbers
        buckets = [r[0] for r in touched.select(list_bucket("list_id").alias("b")).distinct().collect()]
        rows = rows.filter(F.col("bucket").isin(buckets)).join(touched, "list_id", "left_semi")
    return combine(rows.drop("batch", "bucket"), cfg)


def touched_lists(spark: SparkSession, store: str, batch_id: int) -> DataFrame:
    """``list_id`` of the lists that a batch added to."""
    return spark.read.parquet(f"{store}/batch={batch_id}").select("list_id").distinct()


def event_rates(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type, with a watermark for late rows; runs on streams and tables."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )
