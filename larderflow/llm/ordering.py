"""Global positions and running sums without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Key ranges a group is cut into; a group's rows spread over this many tasks.
BLOCKS = 1024


def key_block(key: Column, blocks: int = BLOCKS) -> Column:
    """The range number of a uniform signed 64-bit key; ranges are in key order."""
    return (F.shiftrightunsigned(key.bitwiseXOR(F.lit(-(2**63))), 33) * F.lit(blocks) / F.lit(2**31)).cast("int")


def running_total(df: DataFrame, group: list[str], block: str, order: list, value: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows of the group that sort earlier.

    ``block`` must not decrease along ``order``. Blocks are summed (partial
    sums before the shuffle), the block sums are prefix-summed within a group,
    and rows are only sorted inside a block, so no task holds a whole group.
    """
    sums = df.groupBy(*group, block).agg(F.sum(value).alias("__sum"))
    before = W.partitionBy(*group).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*group, block, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    within = W.partitionBy(*group, block).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        df.join(starts, [*group, block])
        .withColumn(out, F.col("__start") + F.coalesce(F.sum(value).over(within), F.lit(0)))
        .drop("__start")
    )
