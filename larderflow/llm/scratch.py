"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``; a lost
executor then costs a re-read, never a recomputation of earlier stages.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a temporary one in local mode and an error on a cluster."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="larderflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Bytes and rows of an Arrow batch that carries texts to a Python worker.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 256


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Bounds what one Arrow batch holds for the jobs run inside; a longer text is a batch of its own."""
    want = {"maxRecordsPerBatch": str(rows), "maxBytesPerBatch": str(BATCH_BYTES)}
    want = {f"spark.sql.execution.arrow.{k}": v for k, v in want.items()}
    was = {k: spark.conf.get(k, None) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Narrow rows that one task and file may hold where there are few.
FILE_ROWS = 200_000

#: Folders made inside each open ``released`` block, the innermost last.
_OPEN: list[list[str]] = []


@contextlib.contextmanager
def released(spark: SparkSession):
    """Deletes the folders that operators make inside the block when it ends; write their results elsewhere before."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN.remove(made)
        for path in made:
            _delete(spark, path)


class Scratch:
    """A folder of tables for one operator call.

    Tables that no later read needs are dropped as soon as they are read; those
    a result reads last stay until the caller's ``released`` block ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        if _OPEN:
            _OPEN[-1].append(self.path)

    def table(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Writes ``df`` and returns the table read back, with the schema that was written.

        ``rows`` (about how many rows there will be, at most) keeps the number of
        tasks and files in proportion where that is known to be small.
        """
        where = f"{self.path}/{name}"
        if rows is not None:
            tasks = rows // FILE_ROWS + 1
            df = df.coalesce(tasks) if tasks < int(self.spark.conf.get("spark.sql.shuffle.partitions")) else df
        df.write.mode("overwrite").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, *names: str) -> None:
        """Frees tables that no later read needs."""
        for name in names:
            _delete(self.spark, f"{self.path}/{name}")
