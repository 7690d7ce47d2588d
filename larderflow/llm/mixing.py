"""Mixing sources to target weights by distributed prefix sums (native)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larderflow.llm.ordering import BLOCKS, running_total
from larderflow.llm.scratch import Scratch
from larderflow.llm.text import n_words


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Adds ``target`` to a table of one row per source: ``source, source_size``.

    Sources in code-point order (null last) weigh ``weights``, repeating, and
    share the sum of all sizes. No target exceeds ``most`` times its source's
    size; what is above is shared again by weight among the rest. In order of
    (most x size / weight) a source is full exactly if its bound is at most its
    share of what the sources before it leave, so prefix sums settle all rounds
    of resharing at once. The windows read one row per source.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("__n") - 1, len(weights)) + 1).cast("int"))
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    rows = sizes.withColumn("__n", F.row_number().over(order)).withColumn("__w", w.cast("long"))
    rows = rows.withColumn("__cap", (F.col("source_size") * most).cast("long"))
    rise = [F.col("__cap").cast("double") / F.col("__w"), F.col("__n")]
    before = W.orderBy(*rise).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    rest = F.sum("source_size").over(whole) - F.coalesce(F.sum("__cap").over(before), F.lit(0))
    left = F.sum("__w").over(whole) - F.coalesce(F.sum("__w").over(before), F.lit(0))
    rows = rows.withColumn("__level", rest.cast("double") / left.cast("double"))
    rows = rows.withColumn("__full", F.col("__cap").cast("double") / F.col("__w") <= F.col("__level"))
    level = F.min(F.when(~F.col("__full"), F.struct(F.col("__cap").cast("double") / F.col("__w"), "__n", "__level")))
    rows = rows.withColumn("__open", level.over(whole))
    target = F.when(F.col("__full"), F.col("__cap").cast("double")).otherwise(F.col("__open.__level") * F.col("__w"))
    return rows.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, seed: int = 5, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, source_size, target, taken`` and the columns ``carry``.

    A source's documents get hash-random keys (MD5 of seed, doc_id and text, so
    rows that share an id or have none spread as well), are ranged by key and
    prefix-summed by size. Its target, rounded to whole words,
    is taken in epochs: as many whole passes as fit, then the documents in key
    order up to the rest; the document on the cut gives only the words before
    it, so a source's ``taken`` sum to its target exactly. Documents without
    words take none. Null text has no words, null sources form one source, rows
    with the same key are ordered by ``carry`` and then are alike. Results depend
    only on the rows. An empty table gives no rows. ``carry`` may not name a
    column that the result has already, nor one that starts with two underscores.
    The windows of ``targets`` read one row per source in one task.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).cast("binary"))
    rows = scratch.table(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), key.alias("__key"),
                    *[F.col(c).alias(f"__carry_{c}") for c in carry]),
        "rows",
    )
    kept = [f"__carry_{c}" for c in carry]
    # null-safe group key: sources are compared with a mark in front
    mark = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    plan = scratch.table(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "plan")
    rows = rows.withColumn("__src", mark).withColumn(
        "__block", (F.conv(F.substring("__key", 1, 6), 16, 10).cast("long") * BLOCKS / 2**24).cast("int")
    )
    placed = running_total(rows.drop("source"), ["__src"], "__block", ["__key", "size", *kept], F.col("size"), "before")
    placed = scratch.table(placed, "placed")
    budget = plan.select(mark.alias("__src"), "source_size", "target", F.round("target").cast("long").alias("budget"))
    budget = budget.withColumn("passes", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0).cast("long")))
    budget = budget.withColumn("rest", F.col("budget") - F.col("passes") * F.col("source_size"))
    last = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("before")))
    # plain scans on both sides: adaptive execution can split a hot source
    return placed.join(budget, "__src").select(
        "doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + last).cast("long").alias("taken"), *[F.col(k).alias(c) for k, c in zip(kept, carry, strict=True)]
    )
