"""Scoring predicted ingredient names against labelled ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larderflow.functions.text import name_words


def same_words(wa: Column, wb: Column) -> Column:
    """Neither without words, and the words of one all among those of the other."""
    inside = (F.size(F.array_except(wa, wb)) == 0) | (F.size(F.array_except(wb, wa)) == 0)
    return (F.size(wa) > 0) & (F.size(wb) > 0) & inside


def same_name(a: Column, b: Column) -> Column:
    return same_words(name_words(a), name_words(b))


def match_cases(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """``case_id, tp, fp, fn, category_hits`` per case; inputs are ``case_id, pos, name, category``.

    Each expected name, in order, takes the first prediction it equals that no
    earlier one took. A case is one recipe, whose rows meet in one array; null
    is a case and a category like any other.
    """
    row = lambda side: F.struct("pos", name_words(F.col("name")).alias("words"), "category").alias(side)
    none = lambda side: F.lit(None).alias(side)
    both = predicted.select("case_id", row("p"), none("e")).unionByName(expected.select("case_id", none("p"), row("e")))
    cases = both.groupBy("case_id").agg(*[F.array_sort(F.collect_list(side)).alias(side) for side in "pe"])
    # places of the predictions that equal each expected name, and then the first that is left
    equal = lambda e: F.array_compact(F.transform("p", lambda p, i: F.when(same_words(p["words"], e["words"]), i + 1)))
    cases = cases.withColumn("offers", F.transform("e", equal))
    left = lambda used, offer: F.coalesce(F.try_element_at(F.array_except(offer, used), F.lit(1)), F.lit(0))
    cases = cases.withColumn("used", F.aggregate("offers", F.array().cast("array<int>"), lambda used, offer: F.concat(used, F.array(left(used, offer)))))
    placed = F.transform("used", lambda u, k: (u > 0) & F.try_element_at("p", F.greatest(u, F.lit(1)))["category"].eqNullSafe(F.get("e", k)["category"]))
    cases = cases.withColumn("tp", F.size(F.filter("used", lambda u: u > 0)).cast("long")).withColumn("placed", placed)
    return cases.select(
        "case_id", "tp", (F.size("p") - F.col("tp")).alias("fp"), (F.size("e") - F.col("tp")).alias("fn"), F.size(F.filter("placed", lambda hit: hit)).cast("long").alias("category_hits")
    )


def rates(cases: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall, F1 and category accuracy by ``by`` and over all (null keys); 0 where nothing is counted."""
    total = cases.rollup(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "category_hits")])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    total = total.withColumn("precision", p).withColumn("recall", r)
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return total.withColumn("f1", f1).withColumn("category_accuracy", ratio(F.col("category_hits"), F.col("tp")))
