"""A recipe relation derived from the order tables, to run the operators on at any scale.

An order is a recipe, its lines are ingredient lines, its customer owns the list.
Names, units, notes and flags are picked by keys from short word lists that
include plurals, excluded waters, unknown and blank names, and units that differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NAMES = (
    "garlic", "Onions", "green onions", "olive oil", "pepper and olive oil", "water", "coconut water", " Pasta Water", "kidney beans",
    "tomatoes", "black pepper", "unobtainium", "", "Salt", "salt ", "brown sugar", "all-purpose flour", "eggs", "sweet potatoes", "ice water",
    "chocolate chips", "red pepper flakes", "dragon fruit", "cream cheese", "whole milk", "lime juice", "crushed tomatoes",
)
UNITS = ("cup", "cups", "bunch", "bunches", None, "clove", "cloves", " ", "Tbsp", "g", "glass")
NOTES = ("", "chopped", "to taste", "", "minced, fresh")


def _pick(words: tuple, index):
    return F.element_at(F.array(*map(F.lit, words)), (index + 1).cast("int"))


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of schema INGREDIENT, without an order."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    lines = lines.withColumn("line_pos", F.row_number().over(order).cast("long"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    factor = F.when(F.col("l_partkey") % 97 == 0, 100.0).when(F.col("l_partkey") % 89 == 0, -1.0).when(F.col("l_partkey") % 7 == 0, 0.25).otherwise(1.0)
    flags = F.when(F.col("l_suppkey") % 11 == 0, F.array(F.lit("unparsed_name"))).otherwise(F.array().cast("array<string>"))
    return rows.select(
        F.col("o_custkey").alias("list_id"),
        F.col("o_orderkey").alias("recipe_pos"),
        F.concat(F.lit("Recipe "), F.col("o_orderkey") % 1000).alias("recipe"),
        "line_pos",
        _pick(NAMES, F.col("l_partkey") % len(NAMES)).alias("name"),
        F.when(F.col("l_linenumber") % 5 != 0, F.col("l_quantity") * factor).alias("quantity"),
        _pick(UNITS, F.col("l_suppkey") % len(UNITS)).alias("unit"),
        F.lit("uncategorized").alias("category"),
        _pick(NOTES, F.col("l_partkey") % len(NOTES)).alias("notes"),
        F.concat(F.lit("https://example.org/"), F.col("o_orderkey")).alias("source_url"),
        F.lit(1.0).alias("confidence"),
        flags.alias("flags"),
    )


def line_text(df: DataFrame) -> DataFrame:
    """Adds ``line``: the contribution as a line that a recipe might have."""
    whole = F.col("quantity").cast("bigint").cast("string")
    amount = F.when(F.col("quantity").isNotNull() & (F.col("quantity") == F.floor("quantity")) & (F.col("quantity") > 0), whole)
    unit = F.when(F.col("unit").isin("cup", "cups", "clove", "cloves", "g"), F.col("unit"))
    return df.withColumn("line", F.concat_ws(" ", amount, unit, F.trim("name")))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, url, html``: a page per recipe, three shapes of JSON-LD in turn, and every fifth without any."""
    rows = line_text(contributions(spark, sf_dir)).filter(F.length(F.trim("name")) > 0)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("line_pos", "line"))), lambda x: x["line"])
    recipes = rows.groupBy("recipe_pos", "recipe", "source_url").agg(lines.alias("lines"))
    node = F.to_json(
        F.struct(F.lit("Recipe").alias("@type"), F.col("recipe").alias("name"), F.lit("serves 4").alias("recipeYield"), F.col("lines").alias("recipeIngredient"))
    )
    n = F.col("recipe_pos") % 5
    shaped = F.when(n == 0, node).when(n == 1, F.concat(F.lit('[{"@type": "WebPage"}, '), node, F.lit("]")))
    shaped = shaped.when(n == 2, F.concat(F.lit('{"@graph": [{"@type": ["Thing"]}, '), node, F.lit("]}"))).otherwise(node)
    script = F.concat(F.lit('<script type="application/ld+json">{broken</script><script type="application/ld+json">'), shaped, F.lit("</script>"))
    items = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("<li>- "), x, F.lit("</li>"))), "")
    text = F.concat(F.lit("<nav>Menu</nav><p>About this</p><h2>Ingredients:</h2><ul>"), items, F.lit("</ul><h2>Directions</h2><p>Mix it all.</p>"))
    body = F.when(n == 4, text).otherwise(script)
    return recipes.select(F.col("recipe_pos").alias("page_id"), F.col("source_url").alias("url"), F.concat(F.lit("<html><body>"), body, F.lit("</body></html>")).alias("html"))


def _sql(value) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _sql_pick(words: tuple, key: str) -> str:
    return f"list_extract([{', '.join(map(_sql, words))}], ({key} % {len(words)} + 1)::INT)"


#: The same relation for an oracle: put before a query that reads ``lens``.
SQL = f"""
WITH lens AS (
  SELECT o_custkey AS list_id, o_orderkey AS recipe_pos, 'Recipe ' || (o_orderkey % 1000) AS recipe, line_pos,
         {_sql_pick(NAMES, 'l_partkey')} AS name,
         CASE WHEN l_linenumber % 5 <> 0 THEN l_quantity * (CASE WHEN l_partkey % 97 = 0 THEN 100.0::DOUBLE WHEN l_partkey % 89 = 0 THEN -1.0::DOUBLE WHEN l_partkey % 7 = 0 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END) END AS quantity,
         {_sql_pick(UNITS, 'l_suppkey')} AS unit, {_sql_pick(NOTES, 'l_partkey')} AS notes,
         'https://example.org/' || o_orderkey AS source_url, CASE WHEN l_suppkey % 11 = 0 THEN 'unparsed_name' END AS flag
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS line_pos FROM lineitem)
  JOIN orders ON l_orderkey = o_orderkey
)"""
