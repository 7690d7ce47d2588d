"""Registered queries of the engine's operators, each with the SQL that gives the same rows where SQL can.

Names follow the operator families. Arrays are joined to strings, so results
compare the same way in any engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larderflow import config as C
from larderflow.functions import text as T
from larderflow.functions.normalise import canonical_unit, is_numeric, normalise, quantity_value, shape, singular, tokenise
from larderflow.functions.predicates import is_candidate, is_heading, is_next_section, is_noise, is_temperature, strip_bullet
from larderflow.operators import categorize as cat
from larderflow.operators import combine as comb
from larderflow.operators import evaluate, export, labelled, labelling, lines, parse, sequences
from larderflow.plans import lens, pipeline
from larderflow.sources import pages, urls
from larderflow.streaming.ingest import event_rates

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MARK = "|"


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def flat(df: DataFrame) -> DataFrame:
    """Arrays of strings as one string each."""
    return df.select(*[F.array_join(c, MARK).alias(c) if t == "array<string>" else F.col(f"`{c}`") for c, t in df.dtypes])


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def placed(spark: SparkSession, d: str) -> DataFrame:
    return cat.categorize(lens.contributions(spark, d))


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- SQL that several oracles share -----------------------------------------

KEYWORD_ROWS = ", ".join(f"({q(k)}, {q(a)}, {i})" for i, (k, a) in enumerate(C.DEFAULT.ranked_keywords()))
AISLE_ROWS = ", ".join(f"({q(a)}, {i})" for i, a in enumerate(C.AISLES))
CATEGORY_SQL = f"""
, kw(keyword, category, rank) AS (VALUES {KEYWORD_ROWS}), aisle(aisle, pos) AS (VALUES {AISLE_ROWS}),
names AS (SELECT DISTINCT name FROM lens),
cats AS (
  SELECT name, arg_min(category, rank) AS category FROM names JOIN kw
  ON regexp_matches(lower(name), '(^|[^a-z0-9_])' || replace(keyword, '-', '\\-') || '(es|s)?([^a-z0-9_]|$)') GROUP BY name
),
placed AS (
  SELECT lens.*, coalesce(c.category, 'uncategorized') AS category,
         list_filter([flag, CASE WHEN c.category IS NULL THEN 'needs_category' END], lambda x: x IS NOT NULL) AS flags,
         CASE WHEN lower(trim(lens.name)) = '' THEN '(unnamed)' ELSE lower(trim(lens.name)) END AS key
  FROM lens LEFT JOIN cats c USING (name)
),
rows_ AS (SELECT * FROM placed WHERE key NOT IN ({", ".join(map(q, C.EXCLUDED))}))
"""
FORMAT_SQL = "(CASE WHEN {0} IS NULL THEN '' WHEN {0} = floor({0}) THEN {0}::BIGINT::VARCHAR ELSE printf('%g', {0}) END)"
COMBINE_SQL = f"""
, amounts AS (
  SELECT *, regexp_replace(lower(trim(coalesce(unit, ''))), 's$', '') AS ukey FROM rows_
  WHERE quantity IS NOT NULL OR trim(coalesce(unit, '')) <> ''
),
units AS (
  SELECT list_id, key, ukey, min((recipe_pos, line_pos)) AS unit_at, sum(quantity::DECIMAL(38,12))::DOUBLE AS total,
         arg_min(unit, (recipe_pos, line_pos)) FILTER (WHERE trim(coalesce(unit, '')) <> '') AS shown
  FROM amounts GROUP BY ALL
),
counted AS (SELECT list_id, key, count(*) AS n, max(total) AS total, max(shown) AS shown FROM units GROUP BY ALL),
parts AS (
  SELECT a.list_id, a.key, unit_at, recipe_pos, line_pos,
         CASE WHEN coalesce(unit, '') <> '' THEN trim({FORMAT_SQL.format("quantity")} || ' ' || unit) ELSE {FORMAT_SQL.format("quantity")} END AS part
  FROM amounts a JOIN units u USING (list_id, key, ukey)
),
mixed AS (SELECT list_id, key, 'amounts: ' || string_agg(part, ' + ' ORDER BY unit_at, recipe_pos, line_pos) FILTER (WHERE part <> '') AS note FROM parts GROUP BY ALL),
base AS (
  SELECT list_id, key, min((recipe_pos, line_pos)) AS first_at, arg_min(name, (recipe_pos, line_pos)) AS name,
         coalesce(arg_min(category, (recipe_pos, line_pos)) FILTER (WHERE category <> 'uncategorized'), 'uncategorized') AS category
  FROM rows_ GROUP BY ALL
),
seen AS (
  SELECT list_id, key, 'n' AS kind, notes AS v, (recipe_pos, line_pos, 0) AS first_at FROM rows_ WHERE notes <> ''
  UNION ALL SELECT list_id, key, 's', recipe, (recipe_pos, line_pos, 0) FROM rows_
  UNION ALL SELECT list_id, key, 'f', f, (recipe_pos, line_pos, i) FROM (SELECT list_id, key, recipe_pos, line_pos, unnest(flags) AS f, unnest(range(len(flags))) AS i FROM rows_)
),
firsts AS (SELECT list_id, key, kind, v, min(first_at) AS first_at FROM seen GROUP BY ALL),
texts AS (
  SELECT list_id, key, coalesce(string_agg(v, '; ' ORDER BY first_at) FILTER (WHERE kind = 'n'), '') AS notes,
         coalesce(string_agg(v, '|' ORDER BY first_at) FILTER (WHERE kind = 's'), '') AS sources,
         coalesce(list(v ORDER BY first_at) FILTER (WHERE kind = 'f'), []) AS flags
  FROM firsts GROUP BY ALL
),
merged AS (
  SELECT b.list_id, b.key, b.first_at, b.name, CASE WHEN n = 1 THEN total END AS quantity, CASE WHEN n = 1 THEN shown END AS unit, b.category,
         CASE WHEN n > 1 AND note IS NOT NULL THEN note || CASE WHEN t.notes <> '' THEN '; ' || t.notes ELSE '' END ELSE coalesce(t.notes, '') END AS notes,
         coalesce(t.sources, '') AS sources, list_concat(coalesce(t.flags, []), CASE WHEN n > 1 THEN ['mixed_units'] ELSE [] END) AS flags
  FROM base b LEFT JOIN texts t USING (list_id, key) LEFT JOIN counted USING (list_id, key) LEFT JOIN mixed USING (list_id, key)
),
items AS (
  SELECT list_id, row_number() OVER (PARTITION BY list_id ORDER BY first_at) AS item_pos, name, quantity, unit, category, notes, false AS checked, sources,
         array_to_string(list_concat(flags, list_filter([
           CASE WHEN trim(name) = '' THEN 'empty_name' END, CASE WHEN quantity <= 0 THEN 'bad_quantity' WHEN quantity > 1000 THEN 'absurd_quantity' END,
           CASE WHEN category = 'uncategorized' THEN 'needs_category' END], lambda x: x IS NOT NULL AND NOT list_contains(flags, x))), '|') AS flags
  FROM merged
),
sorted_items AS (
  SELECT items.*, row_number() OVER (PARTITION BY list_id ORDER BY coalesce(pos, {len(C.AISLES)}), lower(name), item_pos) AS place
  FROM items LEFT JOIN aisle ON category = aisle
)
"""
LENS_COMBINED = lens.SQL + CATEGORY_SQL + COMBINE_SQL


def combined(spark: SparkSession, d: str) -> DataFrame:
    return comb.aisle_sorted(comb.combine(placed(spark, d)))


# --- the list: categorise, combine, check, sort -----------------------------

@query("agg_combine", LENS_COMBINED + "SELECT * FROM sorted_items")
def _(spark, d):
    return flat(combined(spark, d))


@query("jon_category_best_match", lens.SQL + CATEGORY_SQL + "SELECT name, coalesce(category, '') AS category FROM names LEFT JOIN cats USING (name)")
def _(spark, d):
    names = lens.contributions(spark, d).select("name").distinct()
    return names.select("name", F.coalesce(cat.lookup(F.col("name")), F.lit("")).alias("category"))


@query("cat_categorize", lens.SQL + CATEGORY_SQL + "SELECT recipe_pos, line_pos, name, category, array_to_string(flags, '|') AS flags FROM placed")
def _(spark, d):
    return flat(placed(spark, d).select("recipe_pos", "line_pos", "name", "category", "flags"))


MAPPING = (("unobtainium", "frozen"), ("dragon fruit", "produce"), ("", "no such aisle"), ("Salt", "other"))
MAPPING_SQL = ", ".join(f"({q(n)}, {q(c)})" for n, c in MAPPING)


@query(
    "jon_model_mapping",
    lens.SQL + CATEGORY_SQL + f", m(name, offered) AS (VALUES {MAPPING_SQL}) SELECT recipe_pos, line_pos, p.name, "
    "CASE WHEN category = 'uncategorized' THEN coalesce(aisle, category) ELSE category END AS category, "
    "array_to_string(list_filter(flags, lambda x: x <> 'needs_category' OR aisle IS NULL), '|') AS flags "
    "FROM placed p LEFT JOIN m ON p.name = m.name LEFT JOIN aisle ON offered = aisle",
)
def _(spark, d):
    mapping = spark.createDataFrame(list(MAPPING), "name string, category string")
    return flat(cat.categorize(lens.contributions(spark, d), mapping).select("recipe_pos", "line_pos", "name", "category", "flags"))


@query("jon_exclusion_anti", lens.SQL + CATEGORY_SQL + "SELECT recipe_pos, line_pos, key FROM rows_")
def _(spark, d):
    return comb.keyed(lens.contributions(spark, d)).select("recipe_pos", "line_pos", "key")


@query("jon_validity_semi", lens.SQL + CATEGORY_SQL + "SELECT category, count(*) AS n FROM placed WHERE category NOT IN (SELECT aisle FROM aisle) GROUP BY 1")
def _(spark, d):
    aisles = spark.createDataFrame([(a,) for a in C.AISLES], "category string")
    return placed(spark, d).join(aisles, "category", "left_anti").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("jon_sort_rank", lens.SQL + CATEGORY_SQL + f"SELECT DISTINCT category, coalesce(pos, {len(C.AISLES)}) AS pos FROM placed LEFT JOIN aisle ON category = aisle")
def _(spark, d):
    return placed(spark, d).select("category", cat.aisle_pos(F.col("category")).alias("pos")).distinct()


@query(
    "agg_amounts",
    LENS_COMBINED + "SELECT list_id, key, CASE WHEN n = 1 THEN total END AS quantity, CASE WHEN n = 1 THEN shown END AS unit, "
    "CASE WHEN n > 1 THEN coalesce(note, '') ELSE '' END AS amount_note, n > 1 AS mixed FROM counted JOIN mixed USING (list_id, key)",
)
def _(spark, d):
    return comb.merged_amounts(comb.keyed(lens.contributions(spark, d)))


@query("agg_text", LENS_COMBINED + "SELECT list_id, key, notes, sources, array_to_string(flags, '|') AS flags FROM texts")
def _(spark, d):
    out = comb.merged_text(comb.keyed(placed(spark, d)))
    return flat(out.withColumn("notes", F.array_join("notes", "; ")))


@query("agg_first_value", LENS_COMBINED + "SELECT list_id, key, name, category FROM base")
def _(spark, d):
    rows = comb.keyed(placed(spark, d))
    at = F.struct("recipe_pos", "line_pos")
    known = F.min(F.when(F.col("category") != C.UNCATEGORIZED, F.struct("recipe_pos", "line_pos", "category"))).getField("category")
    return rows.groupBy("list_id", "key").agg(F.min_by("name", at).alias("name"), F.coalesce(known, F.lit(C.UNCATEGORIZED)).alias("category"))


@query("agg_unit_fold", lens.SQL + "SELECT DISTINCT coalesce(unit, '?') AS unit, regexp_replace(lower(trim(coalesce(unit, ''))), 's$', '') AS unit_key FROM lens")
def _(spark, d):
    return lens.contributions(spark, d).select(F.coalesce("unit", F.lit("?")).alias("unit"), T.unit_key(F.col("unit")).alias("unit_key")).distinct()


@query("agg_by_category", LENS_COMBINED + """, g AS (SELECT list_id, category, min(item_pos) AS first, string_agg(name, '|' ORDER BY item_pos) AS names FROM items GROUP BY ALL)
SELECT list_id, row_number() OVER (PARTITION BY list_id ORDER BY first) AS cat_pos, category, names FROM g""")
def _(spark, d):
    return flat(comb.by_category(comb.combine(placed(spark, d))))


@query("chk_sanity_flags", LENS_COMBINED + "SELECT unnest(string_split(flags, '|')) AS flag, count(*) AS n FROM items WHERE flags <> '' GROUP BY 1")
def _(spark, d):
    return comb.combine(placed(spark, d)).select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query("srt_aisle_order", LENS_COMBINED + "SELECT list_id, place, name FROM sorted_items")
def _(spark, d):
    return combined(spark, d).select("list_id", "place", "name")


@query("srt_keyword_order", f"SELECT * FROM (VALUES {KEYWORD_ROWS}) v(keyword, category, rank)")
def _(spark, d):
    return cat.keyword_table(spark)


# --- views, exports, edits ---------------------------------------------------

@query(
    "prj_recipe_table",
    lens.SQL + CATEGORY_SQL + f"""SELECT list_id, recipe_pos, row_number() OVER (PARTITION BY list_id, recipe_pos ORDER BY coalesce(pos, {len(C.AISLES)}), lower(name), line_pos) AS place,
    name AS "Ingredient", {FORMAT_SQL.format("quantity")} AS "Quantity", coalesce(unit, '') AS "Unit", category AS "Category", notes AS "Notes",
    CASE WHEN len(flags) > 0 THEN '⚠️' ELSE '' END AS "Review" FROM placed LEFT JOIN aisle ON category = aisle""",
)
def _(spark, d):
    return export.recipe_table(placed(spark, d))


@query(
    "prj_editor_table",
    LENS_COMBINED + """SELECT list_id, item_pos, checked AS "Done", name AS "Ingredient", quantity AS "Quantity", coalesce(unit, '') AS "Unit", category AS "Category",
    replace(sources, '|', ' / ') AS "Recipe(s)", notes AS "Notes", CASE WHEN flags <> '' THEN '⚠️' ELSE '' END AS "Review" FROM items""",
)
def _(spark, d):
    return export.editor_table(comb.combine(placed(spark, d)))


@query(
    "prj_caption",
    lens.SQL + """SELECT recipe_pos, CASE WHEN recipe_pos % 3 = 0 THEN '' ELSE 'serves ' || (recipe_pos % 3) || ' · ' END || count(*) || ' ingredients · url' AS caption
    FROM lens GROUP BY recipe_pos""",
)
def _(spark, d):
    n = lens.contributions(spark, d).groupBy("recipe_pos").agg(F.count(F.lit(1)).alias("n"))
    return n.select("recipe_pos", export.caption(F.col("recipe_pos") % 3, F.col("n"), F.lit("url")).alias("caption"))


CSV_SQL = """, quoted AS (
  SELECT list_id, item_pos, 'False,' || concat_ws(',', cf(name), CASE WHEN quantity IS NULL THEN '' ELSE num(quantity) END, cf(coalesce(unit, '')), cf(category), cf(replace(sources, '|', ' / ')), cf(notes)) AS line
  FROM items
), links AS (SELECT DISTINCT list_id, recipe_pos, recipe, source_url FROM lens),
body AS (SELECT list_id, string_agg(line, chr(10) ORDER BY item_pos) AS body FROM quoted GROUP BY 1),
tail AS (SELECT list_id, string_agg(recipe || ',' || source_url, chr(10) ORDER BY recipe_pos) AS tail FROM links GROUP BY 1)
SELECT list_id, 'Done,Ingredient,Quantity,Unit,Category,Recipe(s),Notes' || chr(10) || body || chr(10) || chr(10) || 'Recipe,Link' || chr(10) || tail || chr(10) AS csv
FROM body JOIN tail USING (list_id)"""
for _name in ("name", "coalesce(unit, '')", "category", "replace(sources, '|', ' / ')", "notes"):
    CSV_SQL = CSV_SQL.replace(f"cf({_name})", f"""CASE WHEN regexp_matches({_name}, '[,"\\r\\n]') THEN '"' || replace({_name}, '"', '""') || '"' ELSE {_name} END""")
CSV_SQL = CSV_SQL.replace("num(quantity)", "quantity::VARCHAR")


@query("snk_csv", LENS_COMBINED + CSV_SQL)
def _(spark, d):
    rows = placed(spark, d)
    links = export.recipe_links(rows.select("list_id", "recipe_pos", "recipe", "source_url").distinct())
    return export.csv_export(comb.combine(rows), links)


TEXT_SQL = f""", shown AS (
  SELECT *, lag(category) OVER (PARTITION BY list_id ORDER BY place) IS DISTINCT FROM category AS opens,
         trim({FORMAT_SQL.format("quantity")} || ' ' || coalesce(unit, '')) AS amount FROM sorted_items WHERE trim(name) <> ''
), lines_ AS (
  SELECT list_id, row_number() OVER (PARTITION BY list_id ORDER BY place) AS place, CASE WHEN opens THEN chr(10) || upper(category) || chr(10) ELSE '' END || '  [ ] ' ||
         CASE WHEN amount <> '' THEN trim(amount || ' ' || name) ELSE name END || CASE WHEN trim(notes) <> '' THEN ' (' || notes || ')' ELSE '' END AS line, opens FROM shown
), links AS (SELECT DISTINCT list_id, recipe_pos, recipe, source_url FROM lens),
body AS (SELECT list_id, string_agg(line, chr(10) ORDER BY place) AS body FROM lines_ GROUP BY 1),
tail AS (SELECT list_id, string_agg('  - ' || recipe || ': ' || source_url, chr(10) ORDER BY recipe_pos) AS tail FROM links GROUP BY 1)
"""


@query("snk_text", LENS_COMBINED + TEXT_SQL + """SELECT list_id, 'Grocery List' || coalesce(chr(10) || body, '') || chr(10) || chr(10) || 'Recipes:' || chr(10) || tail AS text
FROM (SELECT DISTINCT list_id FROM items) LEFT JOIN body USING (list_id) LEFT JOIN tail USING (list_id)""")
def _(spark, d):
    rows = placed(spark, d)
    links = export.recipe_links(rows.select("list_id", "recipe_pos", "recipe", "source_url").distinct())
    return export.text_export(comb.combine(rows), links)


@query("win_group_header", LENS_COMBINED + TEXT_SQL + "SELECT list_id, place, opens AS opens_aisle FROM lines_")
def _(spark, d):
    return export.text_lines(comb.combine(placed(spark, d))).select("list_id", "place", "opens_aisle")


def edits(spark: SparkSession, d: str) -> DataFrame:
    """A change table out of the event stream: deletes, additions, and updates that give or clear one field or two of the first items of lists."""
    e = table(spark, d, "events").filter("event_type is not null")
    op = F.element_at(F.array(F.lit("update"), F.lit("update"), F.lit("update"), F.lit("delete"), F.lit("add")), (F.col("event_id") % 5 + 1).cast("int"))
    update, kind = op == "update", F.floor(F.col("event_id") / 5) % 4
    null = lambda t: F.lit(None).cast(t)
    return e.select(
        F.col("user_id").alias("list_id"), F.when(op == "add", 100000 + F.col("event_id")).otherwise(F.col("event_id") % 7 + 1).alias("item_pos"),
        F.col("event_id").alias("edit_seq"), op.alias("op"), F.when(op == "add", F.lit("extra")).alias("name"),
        F.when(update & kind.isin(0, 2), (F.col("event_id") % 5).cast("double")).alias("quantity"), null("string").alias("unit"), null("string").alias("category"),
        null("string").alias("notes"), F.when(update & kind.isin(1, 2), F.col("event_id") % 2 == 0).alias("checked"),
        F.when(update & (kind == 3), F.array(F.lit("quantity"))).alias("cleared"),
    )


EDIT_SQL = """, e AS (
  SELECT user_id AS list_id, event_id, list_extract(['update', 'update', 'update', 'delete', 'add'], (event_id % 5 + 1)::INT) AS op, event_id // 5 % 4 AS kind,
         CASE WHEN event_id % 5 = 4 THEN 100000 + event_id ELSE event_id % 7 + 1 END AS item_pos
  FROM events WHERE event_type IS NOT NULL
), l AS (
  SELECT list_id, item_pos, bool_or(op = 'delete') AS gone,
         arg_max({'v': CASE WHEN kind <> 3 THEN (event_id % 5)::DOUBLE END}, event_id) FILTER (WHERE op = 'update' AND kind <> 1) AS q,
         arg_max(event_id % 2 = 0, event_id) FILTER (WHERE op = 'update' AND kind IN (1, 2)) AS c
  FROM e WHERE op <> 'add' GROUP BY ALL
),
edited AS (
  SELECT i.list_id, i.item_pos, i.name, CASE WHEN q IS NOT NULL THEN q.v ELSE quantity END AS quantity, coalesce(c, checked) AS checked
  FROM items i LEFT JOIN l USING (list_id, item_pos) WHERE gone IS NOT TRUE
  UNION ALL SELECT list_id, item_pos, 'extra', NULL, false FROM e WHERE op = 'add'
)
"""


@query("snk_edits", LENS_COMBINED + EDIT_SQL + "SELECT * FROM edited")
def _(spark, d):
    items = comb.combine(placed(spark, d))
    return export.apply_edits(items, edits(spark, d)).select("list_id", "item_pos", "name", "quantity", "checked")


@query("snk_progress", LENS_COMBINED + EDIT_SQL + "SELECT list_id, count_if(checked)::BIGINT AS checked, count(*) AS total, count_if(checked) / count(*) AS ratio FROM edited GROUP BY 1")
def _(spark, d):
    return export.progress(export.apply_edits(comb.combine(placed(spark, d)), edits(spark, d)))


# --- sources ----------------------------------------------------------------

@query(
    "src_parse_urls",
    """SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY first) AS pos, url FROM (
    SELECT page_id, url, min(n) AS first FROM (SELECT page_id, unnest(t) AS url, unnest(range(len(t))) AS n FROM (
      SELECT page_id, string_split_regex(url || ', ftp://x ' || url || chr(10) || 'HTTP://y http://z/' || (page_id % 5) || ' note', '[\\s,]+') AS t FROM pages))
    WHERE starts_with(url, 'http://') OR starts_with(url, 'https://') GROUP BY ALL)""",
)
def _(spark, d):
    p = table(spark, d, "pages")
    text = F.concat(F.col("url"), F.lit(", ftp://x "), F.col("url"), F.lit("\nHTTP://y http://z/"), F.col("page_id") % 5, F.lit(" note"))
    return urls.url_rows(p.withColumn("t", text), "page_id", "t")


INPUT_SQL = "SELECT user_id AS session, list_extract(['url', 'photo', 'document'], (event_id % 3 + 1)::INT) AS kind, event_id AS pos FROM events"


def inputs(spark, d):
    kind = F.element_at(F.array(*map(F.lit, urls.KINDS)), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, d, "events").select(F.col("user_id").alias("session"), kind.alias("kind"), F.col("event_id").alias("pos"))


@query("src_input_caps", f"SELECT session, kind, pos FROM (SELECT *, row_number() OVER (PARTITION BY session, kind ORDER BY pos) AS n FROM ({INPUT_SQL})) WHERE kind = 'url' OR n <= 10")
def _(spark, d):
    return urls.cap_inputs(inputs(spark, d))


@query("set_union_sources", f"SELECT session, kind, pos, row_number() OVER (PARTITION BY session ORDER BY list_position(['url', 'photo', 'document'], kind), pos) AS recipe_pos FROM ({INPUT_SQL})")
def _(spark, d):
    return urls.in_source_order(inputs(spark, d))


@query("src_display_name", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'file.txt' WHEN 1 THEN 'Title' ELSE url END AS name FROM pages")
def _(spark, d):
    n = F.col("page_id") % 3
    name = urls.display_name(F.when(n == 1, F.lit("Title")).otherwise(F.lit("")), F.col("url"), F.when(n == 0, F.lit("file.txt")))
    return table(spark, d, "pages").select("page_id", name.alias("name"))


PAGE_LINES = lens.SQL + """, t AS (
  SELECT recipe_pos, line_pos, concat_ws(' ', CASE WHEN quantity = floor(quantity) AND quantity > 0 THEN quantity::BIGINT::VARCHAR END,
         CASE WHEN unit IN ('cup', 'cups', 'clove', 'cloves', 'g') THEN unit END, trim(name)) AS line FROM lens WHERE trim(name) <> ''
)"""


@query("src_jsonld_round_trip", PAGE_LINES + """SELECT recipe_pos AS recipe_id, 'Recipe ' || (recipe_pos % 1000) AS title, 4 AS servings, string_agg(line, '|' ORDER BY line_pos) AS ingredient_lines
FROM t WHERE recipe_pos % 5 <> 4 GROUP BY ALL""")
def _(spark, d):
    got = pages.read_pages(lens.pages(spark, d)).filter(F.size("ingredient_lines") > 0)
    return flat(got.select("recipe_id", "title", "servings", "ingredient_lines"))


@query("flt_heading_round_trip", PAGE_LINES + "SELECT recipe_pos AS recipe_id, string_agg(line, '|' ORDER BY line_pos) AS lines FROM t WHERE recipe_pos % 5 = 4 GROUP BY ALL")
def _(spark, d):
    got = pages.read_pages(lens.pages(spark, d)).filter(F.size("ingredient_lines") == 0)
    return flat(lines.choose_lines(got).select("recipe_id", "lines"))


# the rules of readable text, as pattern and replacement, in order; the pages here hold no recipe data and four references
READABLE = [
    (r"(?s)<!--.*?-->", ""), (r"(?is)<head\b[^>]*>.*?</head\s*>", ""), *[(rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ") for tag in pages.DROPPED],
    (rf"(?i)</?(?:{pages.BLOCK_TAGS})\b[^>]*>", "\n"), (r"<[^>]*>", ""), (r"[ \t\r\f\x0B]+", " "), (r" ?\n[ \n]*", "\n"), ("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&amp;", "&"),
]
READABLE_SQL = "html"
for _pattern, _new in READABLE:
    READABLE_SQL = f"regexp_replace({READABLE_SQL}, {q(_pattern)}, {q(_new)}, 'g')"


@query("src_readable_text", f"""SELECT page_id AS recipe_id, url AS source_url, text AS raw_text, CASE WHEN text = '' THEN 'no recipe content in ' || url END AS ingest_error
FROM (SELECT page_id, url, trim({READABLE_SQL}, ' ' || chr(10) || chr(9) || chr(13)) AS text FROM pages)""")
def _(spark, d):
    got = pages.read_pages(table(spark, d, "pages"))
    return got.select("recipe_id", "source_url", "raw_text", "ingest_error")


# references and what they stand for
REFERENCES = {"&amp;": "&", "&eacute;": "é", "&#8364;": "€", "&#x263A;": "☺", "&lt;b&gt;": "<b>", "&quot;": '"', "&zzz;": "&zzz;", "&frac12": "½", " & ": " & "}


@query("src_html_unescape", f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE url || {q(' '.join(REFERENCES.values()))} || (page_id % 7) || chr(38) END AS text FROM pages")
def _(spark, d):
    text = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.concat("url", F.lit(" ".join(REFERENCES)), F.col("page_id") % 7, F.lit("&amp;")))
    return pages.unescape(table(spark, d, "pages").select("page_id", text.alias("text")), "text")


# --- predicates on lines -----------------------------------------------------

DOC_LINES_SQL = "SELECT doc_id, n, trim(line) AS line FROM (SELECT doc_id, unnest(string_split(trim(text, ' ' || chr(10) || chr(9)), chr(10))) AS line, unnest(range(len(string_split(trim(text, ' ' || chr(10) || chr(9)), chr(10))))) AS n FROM documents)"


def doc_lines(spark, d):
    docs = table(spark, d, "documents").filter("text is not null and trim(text) <> ''")
    return docs.select("doc_id", F.posexplode(lines.split_lines(F.col("text"))).alias("n", "line")).withColumn("line", T.strip(F.col("line")))


def _in(words) -> str:
    return "(" + ", ".join(map(q, sorted(words))) + ")"


NOISE_SQL = (
    f"(l <> '' AND (regexp_matches(l, {q('|'.join(C.NOISE_PHRASES))}) OR regexp_matches(l, {q(C.TEMPERATURE)}) OR "
    f"len(list_filter(string_split_regex(l, '\\s+'), lambda w: trim(w, ',.:;!?') IN {_in(C.NOISE_WORDS)})) > 0))"
)
CANDIDATE_SQL = (
    f"(len(w) > 0 AND len(list_filter(w[1:2], lambda x: lower(trim(x, ':.,')) IN {_in(C.VERBS)})) = 0 AND "
    f"(regexp_matches(line, {q('(?i)^\\s*(\\d|[' + ''.join(C.FRACTIONS) + ']|(' + '|'.join(C.NUMBER_WORDS) + ')\\b)')}) OR "
    f"len(list_filter(w[1:4], lambda x: lower(trim(x, ',.:;')) IN {_in({u.lower() for u in C.UNIT_WORDS})})) > 0))"
)


@query("flt_noise", f"SELECT doc_id, n, {NOISE_SQL} AS noise, regexp_matches(l, {q(C.TEMPERATURE)}) AS temperature FROM (SELECT *, lower(line) AS l FROM ({DOC_LINES_SQL}))")
def _(spark, d):
    return doc_lines(spark, d).select("doc_id", "n", is_noise(F.col("line")).alias("noise"), is_temperature(F.col("line")).alias("temperature"))


@query("flt_candidate", f"SELECT doc_id, n, {CANDIDATE_SQL} AS candidate FROM (SELECT *, list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '') AS w FROM ({DOC_LINES_SQL}))")
def _(spark, d):
    return doc_lines(spark, d).select("doc_id", "n", is_candidate(F.col("line")).alias("candidate"))


@query(
    "flt_headings",
    f"SELECT doc_id, n, regexp_matches(h, {q(C.HEADING)}) AS heading, regexp_matches(h, {q(C.NEXT_SECTION)}) AS section, trim(regexp_replace(h, '^\\s*[-*•]\\s*', '')) AS bare "
    f"FROM (SELECT doc_id, n, CASE n % 4 WHEN 0 THEN 'Ingredients:' WHEN 1 THEN ' notes ' WHEN 2 THEN '- ' || line ELSE line END AS h FROM ({DOC_LINES_SQL}))",
)
def _(spark, d):
    n = F.col("n") % 4
    h = F.when(n == 0, F.lit("Ingredients:")).when(n == 1, F.lit(" notes ")).when(n == 2, F.concat(F.lit("- "), F.col("line"))).otherwise(F.col("line"))
    out = doc_lines(spark, d).withColumn("h", h)
    return out.select("doc_id", "n", is_heading(F.col("h")).alias("heading"), is_next_section(F.col("h")).alias("section"), strip_bullet(F.col("h")).alias("bare"))


@query("flt_fallback_lines", PAGE_LINES + f""", w AS (SELECT *, lower(line) AS l, list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '') AS w FROM t)
SELECT recipe_pos, string_agg(line, '|' ORDER BY line_pos) AS lines FROM w WHERE {CANDIDATE_SQL} AND NOT {NOISE_SQL} GROUP BY 1""")
def _(spark, d):
    """Texts without a heading: each recipe's lines, with prose, noise and steps between."""
    rows = lens.line_text(lens.contributions(spark, d)).filter("trim(name) <> ''")
    found = F.transform(F.array_sort(F.collect_list(F.struct("line_pos", "line"))), lambda x: x["line"])
    text = F.concat(F.lit("A story about dinner.\nSearch\n\n"), F.array_join(found, "\n- "), F.lit("\nServes 4\nPreheat oven to 400 degrees"))
    out = rows.groupBy("recipe_pos").agg(text.alias("text")).select("recipe_pos", lines.candidate_lines(F.col("text")).alias("lines"))
    return flat(out.filter(F.size("lines") > 0))


# --- scalar functions, sequences, evaluation ---------------------------------

@query("txt_format_quantity", f"SELECT DISTINCT x, CASE WHEN x = floor(x) THEN x::BIGINT::VARCHAR ELSE printf('%g', x) END AS text FROM (SELECT l_extendedprice * (1 - l_discount) / 7 AS x FROM lineitem UNION ALL SELECT l_discount / 977 FROM lineitem UNION ALL SELECT l_quantity FROM lineitem) WHERE x <> 0 OR x = 0")
def _(spark, d):
    li = table(spark, d, "lineitem")
    x = li.select((F.col("l_extendedprice") * (1 - F.col("l_discount")) / 7).alias("x")).union(li.select(F.col("l_discount") / 977)).union(li.select("l_quantity"))
    return x.distinct().select("x", T.format_quantity(F.col("x")).alias("text"))


@query("txt_name_words", """SELECT DISTINCT l_comment AS name, array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split_regex(regexp_replace(lower(l_comment), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda w: w <> ''), lambda w: regexp_replace(w, 's$', '')))), '|') AS words
FROM (SELECT p_name || 's, ' || p_type AS l_comment FROM part)""")
def _(spark, d):
    p = table(spark, d, "part").select(F.concat("p_name", F.lit("s, "), "p_type").alias("name")).distinct()
    return p.select("name", F.array_join(F.array_sort(T.name_words(F.col("name"))), MARK).alias("words"))


@query("txt_notes_and_csv", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || ', ' || p_type END AS notes, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE '"' || p_name || ', ' || p_type || '"' END AS field, CASE WHEN p_partkey % 2 = 0 THEN p_partkey::DOUBLE END AS number FROM part""")
def _(spark, d):
    second = F.when(F.col("p_partkey") % 3 == 0, F.lit(" \t")).otherwise(F.concat(F.lit(" "), F.col("p_type"), F.lit("\n")))
    notes = T.join_notes(F.col("p_name"), F.lit(None).cast("string"), second)
    number = T.to_double(F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string")).otherwise(F.lit("x")))
    return table(spark, d, "part").select("p_partkey", notes.alias("notes"), T.csv_field(notes).alias("field"), number.alias("number"))


@query("win_islands", lens.SQL + """, g AS (SELECT DISTINCT recipe_pos, line_pos, line_pos - row_number() OVER (PARTITION BY recipe_pos ORDER BY line_pos) AS island FROM lens WHERE quantity IS NOT NULL)
SELECT recipe_pos, min(line_pos) AS first, max(line_pos) AS last, count(*) AS n FROM g GROUP BY recipe_pos, island""")
def _(spark, d):
    rows = lens.contributions(spark, d).filter("quantity is not null").select("recipe_pos", "line_pos")
    return sequences.islands(rows, ["recipe_pos"], "line_pos")


@query("win_longest_run", lens.SQL + """, g AS (SELECT recipe_pos, line_pos, line_pos - row_number() OVER (PARTITION BY recipe_pos ORDER BY line_pos) AS island FROM lens WHERE quantity IS NOT NULL),
i AS (SELECT recipe_pos, min(line_pos) AS first, max(line_pos) AS last, count(*) AS n FROM g GROUP BY recipe_pos, island)
SELECT recipe_pos, first, last, n FROM (SELECT *, row_number() OVER (PARTITION BY recipe_pos ORDER BY n DESC, first) AS k FROM i) WHERE k = 1""")
def _(spark, d):
    rows = lens.contributions(spark, d).filter("quantity is not null").select("recipe_pos", "line_pos")
    return sequences.longest_run(sequences.islands(rows, ["recipe_pos"], "line_pos"), ["recipe_pos"])


@query("win_adjacent_duplicates", "SELECT user_id, event_id, event_type FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events) WHERE nxt IS DISTINCT FROM event_type")
def _(spark, d):
    return sequences.last_of_runs(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")


@query("win_seen_before", "SELECT user_id, event_id, coalesce(bool_or(event_type = 'click') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen FROM events")
def _(spark, d):
    e = table(spark, d, "events")
    return sequences.seen_before(e, ["user_id"], "event_id", F.col("event_type") == "click", "seen").select("user_id", "event_id", "seen")


@query("win_context", "SELECT user_id, event_id, " + ", ".join(f"coalesce({f}(event_type, {k}) OVER w, '') AS {f}{k}" for k in (1, 2, 3) for f in ("lag", "lead")) + " FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def _(spark, d):
    return sequences.context(table(spark, d, "events"), ["user_id"], "event_id", "event_type").select("user_id", "event_id", *[f"{f}{k}" for k in (1, 2, 3) for f in ("lag", "lead")])


@query("win_label_pattern", """SELECT user_id, coalesce(string_agg(n, '|' ORDER BY n) FILTER (WHERE event_type = 'click' AND after = 'view'), '') AS starts FROM (
  SELECT user_id, event_type, row_number() OVER w - 1 AS n, lead(event_type) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) GROUP BY 1""")
def _(spark, d):
    tags = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"])
    seq = table(spark, d, "events").groupBy("user_id").agg(tags.alias("tags"))
    return seq.select("user_id", F.array_join(F.transform(sequences.pattern_starts(F.col("tags"), ["click", "view"]), lambda i: i.cast("string")), MARK).alias("starts"))


def case_rows(spark, d):
    rows = lens.contributions(spark, d).filter("trim(name) <> ''")
    case = F.concat(F.lit("c"), F.col("recipe_pos"))
    pos = F.col("recipe_pos") * 1000 + F.col("line_pos")
    placed_ = rows.select(case.alias("case_id"), pos.alias("pos"), F.trim("name").alias("name"), F.coalesce(cat.lookup(F.col("name")), F.lit("other")).alias("category"))
    return placed_.filter("pos % 3 <> 0"), placed_.filter("pos % 4 <> 0")


# each expected name, one after another, takes the first prediction with the same name that is left
MATCH_SQL = lens.SQL.replace("WITH", "WITH RECURSIVE", 1) + CATEGORY_SQL + """, cased AS (
  SELECT 'c' || recipe_pos AS case_id, recipe_pos * 1000 + line_pos AS pos, coalesce(nullif(category, 'uncategorized'), 'other') AS category,
         list_distinct(list_transform(list_filter(string_split_regex(regexp_replace(lower(trim(name)), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda x: x <> ''), lambda x: regexp_replace(x, 's$', ''))) AS w
  FROM placed WHERE trim(name) <> ''
),
p AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pos) AS i FROM cased WHERE pos % 3 <> 0),
e AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pos) AS k FROM cased WHERE pos % 4 <> 0),
offers AS (
  SELECT e.case_id, k, list(i ORDER BY i) FILTER (WHERE len(p.w) > 0 AND len(e.w) > 0 AND (list_has_all(e.w, p.w) OR list_has_all(p.w, e.w))) AS offered
  FROM e LEFT JOIN p USING (case_id) GROUP BY ALL
),
steps AS (
  SELECT DISTINCT case_id, 0::BIGINT AS k, []::BIGINT[] AS used FROM cased WHERE pos % 3 <> 0 OR pos % 4 <> 0
  UNION ALL
  SELECT s.case_id, o.k, list_append(used, coalesce(list_filter(coalesce(offered, []), lambda i: NOT list_contains(used, i))[1], 0)) FROM steps s JOIN offers o ON s.case_id = o.case_id AND o.k = s.k + 1
),
took AS (SELECT case_id, unnest(used) AS i, unnest(range(1, len(used) + 1)) AS k FROM (SELECT case_id, arg_max(used, k) AS used FROM steps GROUP BY 1)),
hits AS (SELECT case_id, count(*) AS tp, count(*) FILTER (WHERE p.category = e.category) AS category_hits FROM took JOIN p USING (case_id, i) JOIN e USING (case_id, k) GROUP BY 1),
scored AS (
  SELECT case_id, coalesce(tp, 0)::BIGINT AS tp, (coalesce(np, 0) - coalesce(tp, 0))::BIGINT AS fp, (coalesce(ne, 0) - coalesce(tp, 0))::BIGINT AS fn, coalesce(category_hits, 0)::BIGINT AS category_hits
  FROM (SELECT DISTINCT case_id FROM steps) LEFT JOIN hits USING (case_id) LEFT JOIN (SELECT case_id, count(*) AS np FROM p GROUP BY 1) USING (case_id)
  LEFT JOIN (SELECT case_id, count(*) AS ne FROM e GROUP BY 1) USING (case_id)
)"""
RATES_SQL = """SELECT {0}, tp, fp, fn, category_hits, precision, recall, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1,
CASE WHEN tp = 0 THEN 0 ELSE category_hits / tp END AS category_accuracy FROM (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall
FROM (SELECT {0}, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(category_hits)::BIGINT AS category_hits FROM {1} GROUP BY ROLLUP ({0})))"""


@query("jon_greedy_match", MATCH_SQL + "SELECT * FROM scored")
def _(spark, d):
    return evaluate.match_cases(*case_rows(spark, d))


CASE_SQL = "SELECT l_returnflag AS source, l_orderkey AS case_id, (l_quantity::INT % 7)::BIGINT AS tp, (l_linenumber % 3)::BIGINT AS fp, (l_partkey % 4)::BIGINT AS fn, (l_quantity::INT % 3)::BIGINT AS category_hits FROM lineitem"


@query("agg_prf", RATES_SQL.format("source", f"({CASE_SQL})"))
def _(spark, d):
    n = F.col("l_quantity").cast("int")
    cases = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("source"), (n % 7).cast("long").alias("tp"), (F.col("l_linenumber") % 3).cast("long").alias("fp"),
        (F.col("l_partkey") % 4).alias("fn"), (n % 3).cast("long").alias("category_hits"),
    )
    return evaluate.rates(cases, ["source"])


@query("agg_prf_by_case", MATCH_SQL + RATES_SQL.format("case_id", "scored"))
def _(spark, d):
    return evaluate.rates(evaluate.match_cases(*case_rows(spark, d)), ["case_id"])


@query("set_word_subset", lens.SQL + """, n AS (SELECT DISTINCT trim(name) AS name FROM lens WHERE trim(name) <> ''), w AS (SELECT name, list_distinct(list_transform(list_filter(string_split_regex(regexp_replace(lower(name), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda x: x <> ''), lambda x: regexp_replace(x, 's$', ''))) AS w FROM n)
SELECT a.name AS a, b.name AS b FROM w a JOIN w b ON list_has_all(a.w, b.w) OR list_has_all(b.w, a.w)""")
def _(spark, d):
    names = lens.contributions(spark, d).select(F.trim("name").alias("a")).filter("a <> ''").distinct()
    # names that match share a word, so the words are the join key
    words = names.select("a", F.explode(T.name_words(F.col("a"))).alias("w"))
    pairs = words.join(words.withColumnRenamed("a", "b"), "w").select("a", "b").distinct()
    return pairs.filter(evaluate.same_name(F.col("a"), F.col("b")))


@query("agg_argmax", """, t AS (SELECT user_id, event_type, sum(value::DECIMAL(38,6))::DOUBLE AS total FROM events GROUP BY ALL), m AS (SELECT user_id, max(total) AS m, arg_max(event_type, (total, event_type)) AS label FROM t GROUP BY 1)
SELECT user_id, label, round(m + ln(sum(exp(total - m))), 6) AS log_sum_exp FROM t JOIN m USING (user_id) GROUP BY user_id, label, m""".replace(",", "WITH", 1))
def _(spark, d):
    return sequences.best_label(table(spark, d, "events"), ["user_id"], "event_type", "value")


# --- lines into fields --------------------------------------------------------

# lines of each rule of the normal form, what they become, and their tokens
NORMAL = (
    ("2 cups ( $0.98** ) rice", "2 cups  rice", "2|cups|rice"), ("2–3 cups", "2-3 cups", "2-3|cups"), ("2 cups—sifted", "2 cups - sifted", "2|cups|-|sifted"),
    ("salt &amp; pepper", "salt & pepper", "salt|&|pepper"), ("&frac12; cup", "#1$2 cup", "#1$2|cup"), ("2½ cups", "2#1$2 cups", "2#1$2|cups"), ("1-½ cups", "1-#1$2 cups", "1-#1$2|cups"),
    ("1 and 1/2 cups", "1#1$2 cups", "1#1$2|cups"), ("1 1/2 cups", "1#1$2 cups", "1#1$2|cups"), ("3⁄4 cup", "#3$4 cup", "#3$4|cup"), ("80/20 beef", "80/20 beef", "80|/|20|beef"),
    ("500g flour", "500 g flour", "500|g|flour"), ("g500 flour", "g 500 flour", "g|500|flour"), ("cup-2 bags", "cup - 2 bags", "cup|-|2|bags"), ("two-cup jar", "two cup jar", "two|cup|jar"),
    ("2 tbsp. oil", "2 tbsp oil", "2|tbsp|oil"), ("1 Tsp. salt", "1 Tsp salt", "1|Tsp|salt"), ("1 to 2 cups", "1-2 cups", "1-2|cups"), ("1 or 2 eggs", "1-2 eggs", "1-2|eggs"),
    ("1 cup - 2 cups rice", "1-2 cup rice", "1-2|cup|rice"), ("100 g - 200 grams rice", "100-200 g rice", "100-200|g|rice"), ("1 cup - 2 bags rice", "1 cup - 2 bags rice", "1|cup|-|2|bags|rice"),
    ("8 x 450g tins", "8x 450 g tins", "8x|450|g|tins"), ("1 - 2 apples", "1-2 apples", "1-2|apples"), ("salt and/or pepper (fine), e.g. sea.", "salt and/or pepper (fine), e.g. sea.", "salt|and/or|pepper|(|fine|)|,|e.g.|sea|."),
)


@query("nrm_normalise", lens.SQL + f""", examples(n, line, became, its) AS (VALUES {", ".join(f"({i}, {q(a)}, {q(b)}, {q(t)})" for i, (a, b, t) in enumerate(NORMAL))}),
lined AS (SELECT DISTINCT concat_ws(' ', CASE WHEN quantity = floor(quantity) AND quantity > 0 THEN quantity::BIGINT::VARCHAR END, CASE WHEN unit IN ('cup', 'cups', 'clove', 'cloves', 'g') THEN unit END, trim(name)) AS rest FROM lens)
SELECT trim(line || ' of ' || rest) AS line, trim(became || ' of ' || rest) AS normal, rtrim(its || '|of|' || replace(rest, ' ', '|'), '|') AS tokens FROM lined, examples""")
def _(spark, d):
    # every line after each example; made distinct last, so that the few distinct lines are not one task
    rows = lens.line_text(lens.contributions(spark, d)).select("line")
    after = F.transform(F.array(*[F.lit(a) for a, _, _ in NORMAL]), lambda a: F.trim(F.concat(a, F.lit(" of "), F.col("line"))))
    rows = rows.select(F.explode(after).alias("line")).distinct()
    out = normalise(rows.withColumn("normal", F.col("line")), "normal")
    return out.withColumn("tokens", F.array_join(tokenise(F.col("normal")), MARK))


# tokens with what they are: numeric, singular, shape, value, canonical unit
TOKENS = (
    ("cups", False, "cup", "xxxx", None, "cup"), ("Cups", False, "Cup", "Xxxx", None, None), ("tbsp", False, None, "xxxx", None, "tablespoon"), ("Tb", False, None, "Xx", None, "tablespoon"),
    ("mL", False, "mL", "xX", None, "milliliter"), ("leaves", False, "leaf", "xxxxxx", None, None), ("boxes", False, "box", "xxxxx", None, None), ("tins", False, "tin", "xxxx", None, None),
    ("#1$2", True, None, "#d$d", 0.5, None), ("1#3$4", True, None, "d#d$d", 1.75, None), ("8x", True, None, "dx", 8.0, None), ("two", True, None, "xxx", 2.0, None), ("1-2", True, None, "d-d", 1.0, None),
    ("2.5", True, None, "d.d", 2.5, None), ("00", False, None, "dd", 0.0, None), ("dozen", True, None, "xxxxx", None, None), ("jalapeño", False, None, "xxxxxxxx", None, None),
)
_value = lambda v: "NULL" if v is None else q(v) if isinstance(v, str) else str(v).lower()


@query("tok_attributes", "SELECT DISTINCT list_extract(string_split(p_name, ' '), 1) AS token, false AS numeric, NULL::VARCHAR AS singular, regexp_replace(list_extract(string_split(p_name, ' '), 1), '[a-z]', 'x', 'g') AS shape, NULL::DOUBLE AS value, NULL::VARCHAR AS canonical FROM part UNION ALL VALUES "
       + ", ".join("(" + ", ".join(map(_value, t)) + ")" for t in TOKENS))
def _(spark, d):
    t = table(spark, d, "part").select(F.split("p_name", " ")[0].alias("token")).distinct()
    t = t.union(spark.createDataFrame([(t[0],) for t in TOKENS], "token string"))
    c = F.col("token")
    return t.select("token", is_numeric(c).alias("numeric"), singular(c).alias("singular"), shape(c).alias("shape"), quantity_value(c).alias("value"), canonical_unit(c).alias("canonical"))


PARSED_SQL = """(SELECT list_id, recipe_pos, recipe, line_pos, CASE WHEN trim(name) = 'pepper and olive oil' THEN 'pepper, olive oil' ELSE trim(name) END AS name, q AS quantity,
CASE WHEN unit IN ('cup', 'cups') THEN 'cup' WHEN unit = 'g' THEN 'gram' WHEN unit IN ('clove', 'cloves') THEN CASE WHEN q <> 1 THEN 'cloves' ELSE 'clove' END END AS unit,
'' AS notes, source_url, NULL::VARCHAR AS flag FROM (SELECT *, CASE WHEN quantity = floor(quantity) AND quantity > 0 THEN quantity END AS q FROM lens WHERE trim(name) <> ''))"""


@query("par_parse_lines", lens.SQL + f"SELECT recipe_pos, line_pos, name, quantity, unit FROM {PARSED_SQL}")
def _(spark, d):
    rows = lens.line_text(lens.contributions(spark, d)).filter("trim(name) <> ''").select("recipe_pos", "line_pos", "line")
    return parse.parse_lines(rows).select("recipe_pos", "line_pos", "name", "quantity", "unit")


@query("lab_label_lines")
def _(spark, d):
    out = labelling.label_lines(lens.line_text(lens.contributions(spark, d)).filter("trim(name) <> ''"))
    return flat(out.withColumn("confidences", F.transform("confidences", lambda p: F.format_number(p, 4))))


@query("par_parse_labelled", PAGE_LINES + """, r AS (SELECT recipe_pos, line_pos, trim(name) AS name, CASE WHEN quantity = floor(quantity) AND quantity > 0 THEN quantity END AS q, unit AS u FROM lens WHERE trim(name) <> '')
SELECT recipe_pos, line_pos, name, CASE WHEN q IS NOT NULL THEN q WHEN u IN ('cup', 'clove') THEN 1 END AS quantity,
CASE WHEN u IN ('cup', 'cups') THEN 'cup' WHEN u = 'g' THEN 'gram' WHEN u IN ('clove', 'cloves') THEN CASE WHEN q IS NULL THEN u WHEN q = 1 THEN 'clove' ELSE 'cloves' END END AS unit
FROM r WHERE name NOT LIKE '% and %'""")
def _(spark, d):
    rows = lens.line_text(lens.contributions(spark, d)).filter("trim(name) <> '' and name not like '% and %'").select("recipe_pos", "line_pos", "line")
    # only lines of one name: what hand-set weights make of two is no fixed value
    return labelled.parse_labelled(rows).select("recipe_pos", "line_pos", "name", "quantity", "unit")


def recipes(spark, d):
    """Recipes with structured lines; every fifth has them in readable text instead."""
    rows = lens.line_text(lens.contributions(spark, d)).filter("trim(name) <> ''")
    found = F.transform(F.array_sort(F.collect_list(F.struct("line_pos", "line"))), lambda x: x["line"])
    grouped = rows.groupBy("list_id", "recipe_pos", "recipe", "source_url").agg(found.alias("found"))
    none, text = F.array().cast("array<string>"), F.col("recipe_pos") % 5 == 4
    return grouped.select(
        "list_id", "recipe_pos", "recipe", "source_url", F.when(text, none).otherwise(F.col("found")).alias("ingredient_lines"),
        F.when(text, F.concat(F.lit("Ingredients\n"), F.array_join("found", "\n"))).otherwise(F.lit("")).alias("raw_text"),
    )


def list_sql(recipe: str) -> str:
    """Lists out of parsed lines, whose places are counted anew, by another engine."""
    parsed = f""", parsed AS (SELECT * EXCLUDE (recipe, line_pos), {recipe} AS recipe, row_number() OVER (PARTITION BY recipe_pos ORDER BY line_pos) AS line_pos FROM {PARSED_SQL})"""
    return lens.SQL + parsed + (CATEGORY_SQL + COMBINE_SQL).replace("lens", "parsed") + "SELECT * FROM sorted_items"


@query("pip_build_list", list_sql("recipe"))
def _(spark, d):
    return flat(pipeline.build_list(recipes(spark, d)))


@query("pip_url", list_sql("CASE WHEN recipe_pos % 5 = 4 THEN source_url ELSE recipe END"))
def _(spark, d):
    """Pages to lists: structured data, or readable text in every fifth, whose recipe is named by its URL."""
    owner = lens.contributions(spark, d).select("list_id", "recipe_pos").distinct()
    inputs = lens.pages(spark, d).withColumnRenamed("page_id", "recipe_pos").join(owner, "recipe_pos")
    return flat(pipeline.build_list(pipeline.recipes_from_pages(inputs)))


def files(spark, d, ending):
    found = recipes(spark, d).filter("size(ingredient_lines) > 0")
    text = F.concat(F.lit("My recipe\nIngredients\n- "), F.array_join("ingredient_lines", "\n- "), F.lit("\nMethod\nMix it all."))
    path = F.concat(F.lit("/in/"), F.col("recipe_pos"), F.lit(ending))
    return found.select("list_id", "recipe_pos", path.alias("path"), text.cast("binary").alias("content"))


def file_sql(ending: str) -> str:
    return list_sql(f"recipe_pos || '{ending}'").replace("WHERE trim(name) <> ''))", "WHERE trim(name) <> '' AND recipe_pos % 5 <> 4))")


@query("pip_document", file_sql(".txt"))
def _(spark, d):
    return flat(pipeline.build_list(pipeline.recipes_from_documents(files(spark, d, ".txt"))))


@query("pip_photo", file_sql(".jpg"))
def _(spark, d):
    return flat(pipeline.build_list(pipeline.recipes_from_photos(files(spark, d, ".jpg"), lambda data: data.decode())))


@query("str_event_rates", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value::DECIMAL(38,6))::DOUBLE, 4) AS total FROM events GROUP BY ALL")
def _(spark, d):
    exact = table(spark, d, "events").withColumn("value", F.col("value").cast("decimal(28,6)"))
    return event_rates(exact).withColumn("total", F.round(F.col("total").cast("double"), 4))
