"""Ordered logic as windows and string patterns: islands, runs, context, label patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Runs of consecutive positions: keys, ``first, last, n``."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(pos))
    runs = df.withColumn("__island", F.col(pos) - rank)
    return runs.groupBy(*keys, "__island").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count(F.lit(1)).alias("n")).drop("__island")


def longest_run(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The longest island of each key, the first of equals."""
    best = F.max_by(F.struct("first", "last", "n"), F.struct("n", -F.col("first"))).alias("b")
    return runs.groupBy(*keys).agg(best).select(*keys, "b.*")


def last_of_runs(df: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    """Rows whose successor has another value: the last of each run stays."""
    after = F.lead(value).over(W.partitionBy(*keys).orderBy(pos))
    return df.withColumn("__after", after).filter(~F.col("__after").eqNullSafe(F.col(value)) | F.col(value).isNull() & F.col("__after").isNull()).drop("__after")


def seen_before(df: DataFrame, keys: list[str], pos: str, flag: Column, out: str) -> DataFrame:
    """Whether the flag was set on any earlier row."""
    before = W.partitionBy(*keys).orderBy(pos).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.max(flag).over(before), F.lit(False)))


def context(df: DataFrame, keys: list[str], pos: str, value: str, reach: int = 3) -> DataFrame:
    """Values up to ``reach`` rows before and after, '' beyond the ends."""
    order = W.partitionBy(*keys).orderBy(pos)
    near = {f"{name}{k}": F.coalesce(f(value, k).over(order), F.lit("")) for k in range(1, reach + 1) for name, f in (("lag", F.lag), ("lead", F.lead))}
    return df.withColumns(near)


def pattern_starts(tags: Column, pattern: list[str]) -> Column:
    """Where a sequence of tags begins in an array of tags, leftmost first and without overlap.

    Tags are written between marks, so the search is one literal regular
    expression over a string; an array that doesn't hold the pattern costs no more.
    """
    text = F.concat(F.lit("\x1f"), F.array_join(F.transform(tags, lambda t: F.coalesce(t, F.lit(""))), "\x1f"), F.lit("\x1f"))
    hit = "".join(f"{re.escape(p)}\x1f" for p in pattern)
    pieces = F.split(text, f"(?<=\x1f){hit}", -1)
    count = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\x1f"), F.lit("")))
    starts = F.aggregate(
        F.slice(pieces, 1, F.size(pieces) - 1),
        F.struct(F.lit(-1).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, s: F.struct(
            (acc["at"] + count(s) + F.when(F.size(acc["out"]) > 0, len(pattern)).otherwise(0)).alias("at"),
            F.concat(acc["out"], F.array(acc["at"] + count(s) + F.when(F.size(acc["out"]) > 0, len(pattern)).otherwise(0))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return starts


def best_label(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """The label of the highest total score (ties: the largest label) and the log-sum-exp of the totals."""
    totals = df.groupBy(*keys, label).agg(F.sum(F.col(score).cast("decimal(38,6)")).cast("double").alias("total"))
    top = totals.groupBy(*keys).agg(F.max(F.struct("total", label)).alias("m"))
    parts = totals.join(top, keys).groupBy(*keys).agg(
        F.max("m").alias("m"), F.sum(F.exp(F.col("total") - F.col("m.total"))).alias("s")
    )
    return parts.select(*keys, F.col(f"m.{label}").alias("label"), F.round(F.col("m.total") + F.log("s"), 6).alias("log_sum_exp"))
