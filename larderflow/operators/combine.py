"""Merging contributions of many recipes into one list.

The grouping key is (list, name key). Exact sums, counts, minima and sets are
plain aggregates with partial sums before the shuffle, so a staple that is in a
third of all recipes does not become one huge array: what a group keeps is
bounded by its distinct notes, units, sources and flags, not by its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larderflow import config as C
from larderflow.functions.predicates import excluded, known_aisle
from larderflow.functions.text import format_amount, strip, unit_key
from larderflow.operators.categorize import aisle_pos

GROUP = ["list_id", "key"]


def name_key(name: Column) -> Column:
    low = F.lower(strip(F.coalesce(name, F.lit(""))))
    return F.when(low == "", F.lit("(unnamed)")).otherwise(low)


def keyed(ingredients: DataFrame, cfg: C.Config = C.DEFAULT) -> DataFrame:
    """Contributions with ``key``, without excluded ingredients."""
    return ingredients.withColumn("key", name_key(F.col("name"))).filter(~excluded(F.col("key"), cfg))


def _position() -> Column:
    return F.struct("recipe_pos", "line_pos")


def merged_text(rows: DataFrame) -> DataFrame:
    """Distinct notes, sources and flags of each group in first-seen order, in one pass over (group, kind, value)."""
    at = lambda n: F.struct("recipe_pos", "line_pos", n)
    value = lambda kind, v, n=F.lit(0): F.struct(F.lit(kind).alias("kind"), v.alias("value"), at(n.alias("n")).alias("at"))
    flags = F.transform(F.coalesce("flags", F.array().cast("array<string>")), lambda f, i: value("flags", f, i))
    every = F.concat(F.array(value("notes", F.col("notes")), value("sources", F.col("recipe"))), flags)
    seen = rows.select(*GROUP, F.explode(every).alias("e")).select(*GROUP, "e.*").filter("value is not null and not (kind = 'notes' and value = '')")
    first = seen.groupBy(*GROUP, "kind", "value").agg(F.min("at").alias("at"))
    pick = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("at", "value")))), lambda p: p["value"]).alias(kind)
    return first.groupBy(*GROUP).agg(pick("notes"), pick("sources"), pick("flags"))


def _with_unit_key(rows: DataFrame) -> DataFrame:
    """Adds ``unit_key``, which is null for rows without any amount."""
    has = F.col("quantity").isNotNull() | (strip(F.coalesce("unit", F.lit(""))) != "")
    return rows.withColumn("unit_key", F.when(has, unit_key(F.col("unit"))))


def _by_unit(rows: DataFrame) -> DataFrame:
    """One row per group and unit key, no amount being a key of its own: first name, first aisle, first spelling and sum.

    Whole quantities below 1e9 are summed as integers and others in decimal, so
    the order of rows never matters; only those of 1e17 and more are added as
    doubles, in any order.
    """
    known = F.col("category") != C.UNCATEGORIZED
    spelt = strip(F.coalesce("unit", F.lit(""))) != ""
    first = lambda c, when: F.min(F.when(when, F.struct("recipe_pos", "line_pos", c))).alias(f"first_{c}")
    size = F.abs("quantity")
    whole = (size < 1e9) & (F.floor("quantity") == F.col("quantity"))
    small = ~F.isnan("quantity") & (size < 1e17)
    sums = [
        F.sum(F.when(whole, F.col("quantity").cast("long"))).alias("whole"),
        F.sum(F.when(small & ~whole, F.col("quantity").cast("decimal(38,12)"))).alias("parts"),
        F.sum(F.when(~small, F.col("quantity"))).alias("other"),
    ]
    out = rows.groupBy(*GROUP, "unit_key").agg(first("name", F.lit(True)), first("category", known), first("unit", spelt), *sums)
    # types whose sum still has twelve decimals
    whole, parts = F.col("whole").cast("decimal(20,0)"), F.col("parts").cast("decimal(37,12)")
    exact = F.coalesce((whole + parts).cast("double"), parts.cast("double"), whole.cast("double"))
    out = out.withColumn("exact", exact).drop("whole", "parts")
    total = F.when(F.col("other").isNull(), F.col("exact")).otherwise(F.coalesce("exact", F.lit(0.0)) + F.col("other"))
    return out.withColumn("total", total).drop("exact", "other")


def _rolled_up(rows: DataFrame) -> DataFrame:
    """One row per group: ``at, name, category``, its number of ``units``, and ``quantity, unit`` if that is one."""
    out = _by_unit(rows).groupBy(*GROUP).agg(
        F.min("first_name").alias("first"),
        F.min("first_category").getField("category").alias("category"),
        F.count("unit_key").alias("units"),
        F.max("total").alias("total"),
        F.max(F.col("first_unit").getField("unit")).alias("spelling"),
    )
    single = F.col("units") == 1
    return out.select(
        *GROUP, F.struct("first.recipe_pos", "first.line_pos").alias("at"), F.col("first.name").alias("name"), F.coalesce("category", F.lit(C.UNCATEGORIZED)).alias("category"),
        "units", F.when(single, F.col("total")).alias("quantity"), F.when(single, F.col("spelling")).alias("unit"),
    )


def _mixed_notes(rows: DataFrame) -> DataFrame:
    """``amount_note`` of each group of several units: its amounts by unit in first-seen order, then by line.

    Only such groups have their lines spelled out, as the note itself does; one
    join picks their rows and brings the place of each unit.
    """
    amounts = rows.filter("unit_key is not null")
    units = amounts.groupBy(*GROUP, "unit_key").agg(F.min(_position()).alias("unit_at"))
    units = units.withColumn("units", F.count(F.lit(1)).over(W.partitionBy(*GROUP))).filter("units > 1").drop("units")
    parts = amounts.select(*GROUP, "unit_key", "recipe_pos", "line_pos", "quantity", "unit").join(units, [*GROUP, "unit_key"])
    parts = parts.withColumn("part", format_amount(F.col("quantity"), F.col("unit")))
    listed = parts.groupBy(*GROUP).agg(
        F.array_sort(F.collect_list(F.when(F.col("part") != "", F.struct("unit_at", "recipe_pos", "line_pos", "part")))).alias("p")
    )
    text = F.array_join(F.transform("p", lambda p: p["part"]), " + ")
    return listed.select(*GROUP, F.when(F.size("p") > 0, F.concat(F.lit("amounts: "), text)).otherwise(F.lit("")).alias("amount_note"))


def merged_amounts(rows: DataFrame) -> DataFrame:
    """``quantity, unit, amount_note, mixed`` of each group that has any amount.

    One unit: quantities are summed and the first spelling of the unit is shown.
    Several: neither, and a note lists the amounts.
    """
    rows = _with_unit_key(rows)
    out = _rolled_up(rows).filter("units > 0").join(_mixed_notes(rows), GROUP, "left")
    return out.select(*GROUP, "quantity", "unit", F.coalesce("amount_note", F.lit("")).alias("amount_note"), (F.col("units") > 1).alias("mixed"))


def sanity_flags(flags: Column, name: Column, quantity: Column, category: Column, cfg: C.Config = C.DEFAULT) -> Column:
    """``flags`` and, unless they are there already, those that the checks raise, in a fixed order."""
    number = ~F.coalesce(F.isnan(quantity), F.lit(False))
    raised = F.array_compact(
        F.array(
            F.when(strip(F.coalesce(name, F.lit(""))) == "", F.lit("empty_name")),
            F.when(number & (quantity <= 0), F.lit("bad_quantity")).when(number & (quantity > cfg.most), F.lit("absurd_quantity")),
            F.when(~known_aisle(category, cfg), F.lit("needs_category")),
        )
    )
    return F.concat(flags, F.array_except(raised, flags))


def combine(ingredients: DataFrame, cfg: C.Config = C.DEFAULT) -> DataFrame:
    """One row per list and ingredient (schema ITEM), with ``item_pos`` in first-seen order."""
    rows = _with_unit_key(keyed(ingredients, cfg))
    out = _rolled_up(rows).join(merged_text(rows), GROUP, "left").join(_mixed_notes(rows), GROUP, "left")
    none = F.array().cast("array<string>")
    flags = F.concat(F.coalesce("flags", none), F.when(F.col("units") > 1, F.array(F.lit("mixed_units"))).otherwise(none))
    note = F.coalesce("amount_note", F.lit(""))
    notes = F.array_join(F.concat(F.when(note != "", F.array(note)).otherwise(none), F.coalesce("notes", none)), "; ")
    order = W.partitionBy("list_id").orderBy("at")
    return out.select(
        "list_id", F.row_number().over(order).cast("long").alias("item_pos"), "name", "quantity", "unit", "category", notes.alias("notes"),
        F.lit(False).alias("checked"), F.coalesce("sources", none).alias("sources"), sanity_flags(flags, F.col("name"), F.col("quantity"), F.col("category"), cfg).alias("flags"),
    )


def aisle_sorted(items: DataFrame, cfg: C.Config = C.DEFAULT) -> DataFrame:
    """Adds ``place``: the item's rank in its list by aisle, then name, then first seen."""
    order = W.partitionBy("list_id").orderBy(aisle_pos(F.col("category"), cfg), F.lower("name"), "item_pos")
    return items.withColumn("place", F.row_number().over(order))


def by_category(items: DataFrame) -> DataFrame:
    """One row per list and category: ``cat_pos`` in first-seen order, and its items in order."""
    grouped = items.groupBy("list_id", "category").agg(
        F.min("item_pos").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("item_pos", "name"))), lambda x: x["name"]).alias("names")
    )
    order = W.partitionBy("list_id").orderBy("first")
    return grouped.select("list_id", F.row_number().over(order).alias("cat_pos"), "category", "names")
