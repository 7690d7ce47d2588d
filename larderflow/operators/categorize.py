"""Store aisles of ingredient names by best keyword."""

from __future__ import annotations

import re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larderflow import config as C
from larderflow.functions.predicates import known_aisle


def lookup(name: Column, cfg: C.Config = C.DEFAULT) -> Column:
    """The aisle of the longest keyword in the name as a whole word, with s or es added or not; null if there is none.

    One literal pattern looks ahead from each word for the longest keyword that
    starts there; shorter ones at the same place could never win. The best rank
    among what it finds decides. No join, no branch per keyword.
    """
    ranked = cfg.ranked_keywords()
    pattern = rf"\b(?=({'|'.join(re.escape(k) for k, _ in ranked)})(?:es|s)?\b)"
    ranks = F.create_map(*[F.lit(x) for i, (k, _) in enumerate(ranked, 1) for x in (k, i)])
    hits = F.regexp_extract_all(F.lower(name), F.lit(pattern), 1)
    # a name without keywords has one rank past the last, which is no aisle
    best = F.array_min(F.concat(F.array(F.lit(len(ranked) + 1)), F.transform(hits, lambda k: F.try_element_at(ranks, k))))
    return F.element_at(F.array(*[F.lit(a) for _, a in ranked], F.lit(None)), best)


def categorize(ingredients: DataFrame, mapping: DataFrame | None = None, cfg: C.Config = C.DEFAULT) -> DataFrame:
    """Sets ``category``; flags ``needs_category`` where neither keyword nor mapping nor the row itself has a known aisle.

    ``mapping`` (name, category) may come from any model; it is only asked for
    names without a keyword, and only known aisles are accepted. It holds a row
    per distinct name and so grows with the data: the join is left to the
    optimiser, which broadcasts it only below its size limit.
    """
    found = ingredients.withColumn("__found", lookup(F.col("name"), cfg))
    if mapping is not None:
        offered = mapping.filter(known_aisle(F.col("category"), cfg)).groupBy("name").agg(F.min("category").alias("__offered"))
        found = found.withColumn("__ask", F.when(F.col("__found").isNull(), F.col("name")))
        found = found.join(offered.withColumnRenamed("name", "__name"), F.col("__ask") == F.col("__name"), "left").drop("__ask", "__name")
    else:
        found = found.withColumn("__offered", F.lit(None).cast("string"))
    unsure = F.col("__found").isNull() & ~known_aisle(F.coalesce("__offered", "category"), cfg)
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    return (
        found.withColumn("flags", F.when(unsure, F.concat(flags, F.array(F.lit("needs_category")))).otherwise(flags))
        .withColumn("category", F.coalesce("__found", "__offered", "category", F.lit(C.UNCATEGORIZED)))
        .drop("__found", "__offered")
    )


def keyword_table(spark, cfg: C.Config = C.DEFAULT) -> DataFrame:
    """``keyword, category, rank``: the lookup as data, in the order in which keywords are tried."""
    rows = [(k, a, i) for i, (k, a) in enumerate(cfg.ranked_keywords())]
    return spark.createDataFrame(rows, "keyword string, category string, rank int")


def aisle_pos(category: Column, cfg: C.Config = C.DEFAULT) -> Column:
    """Place of the aisle, one past the last for what is no aisle."""
    return F.when(category.isNull(), len(cfg.aisles)).otherwise(
        F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, cfg.aisles)), category), F.lit(0)) - 1, F.lit(len(cfg.aisles)))
    ).cast("int")
