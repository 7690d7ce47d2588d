import io
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from larderflow import config as C
from larderflow.functions import normalise as nrm
from larderflow.functions import text as T
from larderflow.functions.predicates import is_noise
from larderflow.operators import categorize, combine, evaluate, export, lines, parse, sequences
from larderflow.plans import pipeline, queries
from larderflow.sources import documents, pages, urls
from larderflow.streaming import ingest


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


NOISE = ["Q Search", "Wi-Fi", "Sign in", "Partly Sunny", "Prep Time: 10 minutes", "Serves 4", "Servings: 4", "Jump to Recipe", "82 degrees Celsius", "350°F", "82°C", "Internal temperature reaches 165°F", "already in"]
FOOD = ["2 cloves garlic, minced", "1 cup sugar", "salt to taste", "green onions", "2 c flour", "6 oz cream cheese", "2 tbsp olive oil", "", "   "]


def test_noise(spark):
    assert column(spark, NOISE + FOOD, is_noise) == [True] * len(NOISE) + [False] * len(FOOD)


def test_line_finder(spark):
    cases = {
        "My recipe\nIngredients:\n- 2 cups flour\n\n• salt to taste\nWi-Fi\nInstructions\nMix it": ["2 cups flour", "salt to taste"],
        "INGREDIENTS\n1 egg": ["1 egg"],
        "1 cup sugar\nSearch\nStir well\n½ onion\ntwo eggs\nsome prose here": ["1 cup sugar", "½ onion", "two eggs"],
        "1. Preheat oven to 400 degrees": [],
        "Just a story about dinner.": [],
        "": [],
        "Ingredients\n-\nsalt": ["", "salt"],
        "Method\nIngredients\nsalt\nIngredients\nNotes": ["salt", "Ingredients"],
        "a cup of tea": ["a cup of tea"],
    }
    assert column(spark, list(cases), lines.candidate_lines) == list(cases.values())


AISLES = {
    "green onions": "produce", "kidney beans": "pantry", "tomatoes": "produce", "garlic": "produce", "olive oil": "condiments & sauces",
    "2 tsp black pepper": "spices & seasonings", "1/4 cup olive oil": "condiments & sauces", "pepper and olive oil": "condiments & sauces",
    "unobtainium": None, "éegg": None, "water": None, "": None,
}


def test_aisles(spark):
    assert dict(zip(AISLES, column(spark, list(AISLES), categorize.lookup), strict=True)) == AISLES
    mobile = column(spark, ["1 cup sake", "2 tbsp red awase miso paste"], lambda c: categorize.lookup(c, C.Config.mobile()))
    assert mobile == ["beverages", "condiments & sauces"]


def item(recipe_pos, line_pos, name, quantity=None, unit=None, category="uncategorized", notes="", flags=(), list_id=1):
    return (list_id, recipe_pos, f"R{recipe_pos}", line_pos, name, quantity, unit, category, notes, None, 1.0, list(flags))


COLUMNS = "list_id long, recipe_pos long, recipe string, line_pos long, name string, quantity double, unit string, category string, notes string, source_url string, confidence double, flags array<string>"


def merged(spark, rows):
    out = combine.combine(spark.createDataFrame(rows, COLUMNS)).orderBy("list_id", "item_pos").collect()
    return [(r.name, r.quantity, r.unit, r.category, r.notes, r.sources, r.flags) for r in out]


def test_combine(spark):
    rows = [
        item(1, 1, "Garlic", 2.0, "clove", "produce", "minced", ["x"]), item(2, 1, "garlic ", 3.0, "cloves", notes="minced", flags=["x", "y"]),
        item(1, 2, "onions", 2.0), item(2, 2, "onions", 1.0, "cup", notes="diced"), item(1, 3, "water", 1.0), item(1, 4, "coconut water", 1.0, "cup", "other"),
        item(3, 1, "herbs", 1.0, "bunch", "produce"), item(3, 2, "herbs", 2.0, "bunches", "produce"), item(3, 3, " ", None), item(3, 4, "Salt", None, None, "other", "to taste"),
        item(4, 1, "salt", None, "pinch", "other"),
    ]
    assert merged(spark, rows) == [
        ("Garlic", 5.0, "clove", "produce", "minced", ["R1", "R2"], ["x", "y"]),
        ("onions", None, None, "uncategorized", "amounts: 2 + 1 cup; diced", ["R1", "R2"], ["mixed_units", "needs_category"]),
        ("coconut water", 1.0, "cup", "other", "", ["R1"], []),
        ("herbs", None, None, "produce", "amounts: 1 bunch + 2 bunches", ["R3"], ["mixed_units"]),
        (" ", None, None, "uncategorized", "", ["R3"], ["empty_name", "needs_category"]),
        ("Salt", None, "pinch", "other", "to taste", ["R3", "R4"], []),
    ]


@pytest.mark.parametrize("q,flag", [(0.0, "bad_quantity"), (-1.0, "bad_quantity"), (1000.0, None), (1000.5, "absurd_quantity"), (float("nan"), None)])
def test_sanity(spark, q, flag):
    assert merged(spark, [item(1, 1, "x", q, None, "other")])[0][-1] == ([flag] if flag else [])


def test_breakdown_is_by_unit_first_seen(spark):
    rows = [item(1, 1, "x", 1.0, "cup"), item(1, 2, "x", 2.0, "g"), item(1, 3, "x", 0.5, "Cups"), item(1, 4, "x", None, "g")]
    assert merged(spark, rows)[0][4] == "amounts: 1 cup + 0.5 Cups + 2 g + g"


def test_sums_do_not_depend_on_order(spark):
    assert merged(spark, [item(1, i, "x", 0.1) for i in range(10)])[0][1] == 1.0


@pytest.mark.parametrize("q", [1 / 3, 0.25, 2.0, 1e-5, 123456.5, 1234567.5, 999999.5, 0.0001, 1e20, 6119.995, -2.5, 100000.25])
def test_quantity_text(spark, q):
    want = str(int(q)) if q == int(q) and abs(q) < 1e18 else f"{q:g}"
    assert column(spark, [q], T.format_quantity, "double") == [want]


def test_text(spark):
    assert column(spark, ["\t x \n", None, ""], T.strip) == ["x", None, ""]
    assert column(spark, ["Cups", "glass", "s", None, " g "], T.unit_key) == ["cup", "glas", "", "", "g"]
    assert column(spark, ["a http://x,https://y http://x HTTP://z", ""], urls.parse_urls) == [["http://x", "https://y"], []]
    got = column(spark, ['{"a": 1}', "[1]", "{oops", None], lambda c: F.to_json(T.json_object(c)))
    assert got == ['{"a":1}', "{}", "{}", "{}"]


def page(body):
    return f'<html><head><title>t</title></head><body><nav>Menu</nav><script type="application/ld+json">{body}</script><p>Hello &amp; bye<br>next</p></body></html>'


PAGES = {
    '{"@type": "Recipe", "name": " Soup &amp; Co ", "recipeYield": "about 6-8", "recipeIngredient": ["1 &#189; cup", 3, " ", "salt"]}': ("Soup & Co", 6, ["1 ½ cup", "salt"]),
    '[{"@type": "WebPage"}, {"@type": ["Thing", "recipe"], "recipeYield": [], "recipeIngredient": "salt"}]': ("", None, ["salt"]),
    '{"@graph": [{"@type": "X", "child": {"@type": "Recipe"}}, {"@graph": [{"@type": "Recipe", "recipeYield": 4.7, "recipeIngredient": ["a"]}]}]}': ("", 4, ["a"]),
    '{"@type": "Recipe", "recipeYield": true, "recipeIngredient": ["a"]}': ("", None, ["a"]),
    # the first recipe counts even without ingredients, and then the text does
    '[{"@type": "Recipe"}, {"@type": "Recipe", "recipeIngredient": ["a"]}]': None,
    '{"@type": "Recipe", broken': None,
    "": None,
}


def test_pages(spark):
    rows = [(i, f"u{i}", page(p)) for i, p in enumerate(PAGES)] + [(100, "bare", "<script>x</script>"), (101, "null", None)]
    rows.append((102, "two", page("{bad") + page('{"@type": "Recipe", "recipeIngredient": ["b"]}')))
    got = {r.recipe_id: r for r in pages.read_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    for i, want in enumerate(PAGES.values()):
        r = got[i]
        if want:
            assert (r.title, r.servings, r.ingredient_lines, r.raw_text) == (*want, "")
        else:
            assert (r.ingredient_lines, r.raw_text, r.ingest_error) == ([], "Hello & bye\nnext", None)
    assert got[100].ingest_error and got[101].ingest_error and got[102].ingredient_lines == ["b"]


def test_readable_text_leaves_cut_names(spark, tmp_path):
    bodies = ["a&amp;&amp</h1><p>b", "&am", "&copy &copy; &middot;&middot", "&amp;quot; &quot;&quot", "&ampx; &notit;", "plain & simple", "&amp"]
    rows = [(i, f"u{i}", f"<head><title>t</title></head><h1>{b}</h1>") for i, b in enumerate(bodies)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.QUERIES["src_readable_text"](spark, str(tmp_path)).select("recipe_id", "raw_text").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.execute(f"SELECT recipe_id, raw_text FROM ({queries.ORACLES['src_readable_text']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    assert dict(want)[0] == "a&&amp\nb"
    # numbers need no semicolon, and further names are known
    df = spark.createDataFrame([(1, "u", "<p>&#8364 &#x263A; &frac12; &frac12")], "page_id long, url string, html string")
    assert [r.raw_text for r in pages.read_pages(df).collect()] == ["€ ☺ ½ &frac12"]


def test_recipes_at_any_depth(spark):
    recipe = '{"@type": "Recipe", "recipeIngredient": ["%s"]}'
    nested = {n: "[" * n + recipe % n + "]" * n for n in range(12)} | {100 + n: '{"@graph": [' * n + recipe % n + "]}" * n for n in range(12)}
    nested[200] = "[[[[[[" + recipe % "deep" + "]]]]]," + recipe % "later" + "]"
    nested[201] = '{"@type": "Thing", "@type": "Recipe", "recipeIngredient": ["x"], "recipeIngredient": ["last"]}'
    nested[202] = "[" * 40 + "]" * 40
    df = spark.createDataFrame([(i, "u", page(p)) for i, p in nested.items()], "page_id long, url string, html string")
    got = {r.recipe_id: r.ingredient_lines for r in pages.read_pages(df).collect()}
    assert all(got[n] == got[100 + n] == [str(n)] for n in range(12))
    assert got[200] == ["deep"] and got[201] == ["last"] and got[202] == []


PARSED = {
    "2 cups (500 ml) milk": ("milk", 2.0, "cup", ""), "1-2 mashed bananas: as ripe as possible": ("bananas", 1.0, None, "mashed, as ripe as possible"),
    "2 Tbsp lemon juice ($0.08)": ("lemon juice", 2.0, "Tbsps", ""), "1/2  bunch green onions ($0.35)": ("green onions", 0.5, "bunches", ""),
    "1 28 ounce can crushed tomatoes": ("crushed tomatoes", 1.0, "can", ""), "Salt and pepper, to taste": ("Salt, pepper", None, None, "to taste"),
    "2019 vintage red wine": ("vintage red wine", 2019.0, None, ""), "1 and 1/2 cups sugar": ("sugar", 1.5, "cup", ""),
    "½ tsp. salt": ("salt", 0.5, "teaspoon", ""), "500g flour": ("flour", 500.0, "gram", ""), "2 to 3 large eggs": ("eggs", 2.0, None, ""),
    "": ("", None, None, ""),
}


def test_parse(spark):
    df = spark.createDataFrame([(line,) for line in [*PARSED, None, "1 lb 2 oz beef mince"]], "line string")
    got = {r.line: r for r in parse.parse_lines(df).collect()}
    for line, want in PARSED.items():
        assert (got[line].name, got[line].quantity, got[line].unit, got[line].notes) == want, line
    assert got[""].flags == ["unparsed_name"] and got[None].confidence == 0.0 and len(got) == len(PARSED) + 2


NORMAL = {
    "1½ cups ($0.98)": "1#1$2 cups", "2–3": "2-3", "½-¾ cup": "#1$2-#3$4 cup", "80/20 beef": "80/20 beef", "1 1/2 cups": "1#1$2 cups", "500g": "500 g",
    "cup-2": "cup - 2", "two-cup": "two cup", "1 to 2 eggs": "1-2 eggs", "1 cup - 2 cups": "1-2 cup", "1 tbsp to 2 tablespoons": "1-2 tbsp", "8 x 450g": "8x 450 g", "1 - 2": "1-2", "2 Tbsp. oil": "2 Tbsp oil",
}


def test_normal_form(spark):
    got = nrm.normalise(spark.createDataFrame([(x, x) for x in NORMAL], "line string, normal string"), "normal")
    assert {r.line: r.normal for r in got.collect()} == NORMAL
    assert column(spark, ["salt (a and / or b), e.g. x."], nrm.tokenise) == [["salt", "(", "a", "and/or", "b", ")", ",", "e.g.", "x", "."]]
    numbers = {"1": True, "00": False, "#1$2": True, "1-2": True, "two": True, "dozen": True, "8x": True, "x": False, "1.5": True, "a-b": False}
    assert dict(zip(numbers, column(spark, list(numbers), nrm.is_numeric), strict=True)) == numbers
    assert column(spark, ["Crème2", "X-1"], nrm.shape) == ["Xxxxxd", "X-d"]
    assert column(spark, ["1#1$2", "#1$2-#3$4", "three", "x", "8x"], nrm.quantity_value) == [1.5, 0.5, 3.0, None, 8.0]


def test_exports(spark):
    rows = [item(1, 1, 'big "egg", fresh', 2.0, None, "dairy & eggs"), item(1, 2, "Apple", 1.5, "kg", "produce", "red"), item(1, 3, " ", 1.0)]
    items = combine.combine(spark.createDataFrame(rows, COLUMNS))
    links = spark.createDataFrame([(1, 1, "Pie", "http://x")], "list_id long, recipe_pos long, recipe string, link string")
    text = export.text_export(items, links).first().text
    assert text == 'Grocery List\n\nPRODUCE\n  [ ] 1.5 kg Apple (red)\n\nDAIRY & EGGS\n  [ ] 2 big "egg", fresh\n\nRecipes:\n  - Pie: http://x'
    csv = export.csv_export(items, links).first().csv
    assert csv.startswith('Done,Ingredient,Quantity,Unit,Category,Recipe(s),Notes\nFalse,"big ""egg"", fresh",2.0,,dairy & eggs,R1,\n')
    assert csv.endswith("\n\nRecipe,Link\nPie,http://x\n")
    mobile = export.csv_export(items, links.limit(0), "mobile").first().csv
    assert "\nfalse,Apple,1.5,kg" in mobile and not mobile.endswith("\n")
    edits = spark.createDataFrame(
        [(1, 1, 1, "update", "Eggs", None, None, None, None, True), (1, 2, 2, "delete", *[None] * 6), (1, 99, 3, "add", "tea", None, None, None, None, None)],
        "list_id long, item_pos long, edit_seq long, op string, name string, quantity double, unit string, category string, notes string, checked boolean",
    )
    edited = export.apply_edits(items, edits)
    assert sorted((r.item_pos, r.name, r.checked) for r in edited.collect()) == [(1, "Eggs", True), (3, " ", False), (99, "tea", False)]
    assert export.progress(edited).first().ratio == pytest.approx(1 / 3)


def test_evaluation(spark):
    named = lambda rows: spark.createDataFrame(rows, "case_id string, pos int, name string, category string")
    got = evaluate.match_cases(
        named([("a", 1, "green onions", "produce"), ("a", 2, "onion", "produce"), ("a", 3, "", "x"), ("b", 1, "rice", "pantry")]),
        named([("a", 1, "onions", "produce"), ("a", 2, "garlic", "produce"), ("c", 1, "salt", "spices")]),
    )
    assert sorted(map(tuple, got.collect())) == [("a", 1, 2, 1, 1), ("b", 0, 1, 0, 0), ("c", 0, 0, 1, 0)]


def test_expected_names_choose_first(spark):
    named = lambda rows: spark.createDataFrame(rows, "case_id string, pos int, name string, category string")
    got = evaluate.match_cases(
        named([("a", 1, "oil", "x"), ("a", 2, "olive oil", "x")]),
        named([("a", 1, "olive oil", "x"), ("a", 2, "sesame oil", "x")]),
    )
    # "oil" goes to the first expected name, so nothing is left for the second but "olive oil", which is none
    assert [tuple(r) for r in got.collect()] == [("a", 1, 1, 1, 1)]


def test_edits_by_field(spark):
    items = spark.createDataFrame(
        [(1, i, n, 2.0, "cup", "pantry", "note", False, ["R"], []) for i, n in enumerate(["egg", "rice", "salt"], 1)],
        "list_id long, item_pos long, name string, quantity double, unit string, category string, notes string, checked boolean, sources array<string>, flags array<string>",
    )
    schema = "list_id long, item_pos long, edit_seq long, op string, name string, quantity double, unit string, category string, notes string, checked boolean, cleared array<string>"
    none = (None,) * 6
    edits = spark.createDataFrame(
        [
            (1, 1, 1, "update", "Eggs", None, None, None, None, None, None),
            (1, 1, 2, "update", None, None, None, None, None, True, ["quantity"]),
            (1, 2, 3, "delete", *none, None),
            (1, 2, 4, "update", "late", *none[1:], None),
            (1, 9, 5, "add", "tea", *none[1:], None),
            (1, 9, 6, "update", None, 3.0, None, None, None, None, None),
            (1, 10, 7, "add", "milk", *none[1:], None),
            (1, 10, 8, "delete", *none, None),
            (1, 11, 9, "update", "nobody", *none[1:], None),
            (1, 3, 10, "delete", *none, None),
            (1, 3, 11, "add", "pepper", *none[1:], None),
        ],
        schema,
    )
    got = {r.item_pos: r for r in export.apply_edits(items, edits).collect()}
    assert sorted(got) == [1, 3, 9]
    assert (got[1].name, got[1].quantity, got[1].unit, got[1].checked, got[1].sources) == ("Eggs", None, "cup", True, ["R"])
    assert (got[9].name, got[9].quantity, got[9].category, got[9].checked, got[9].sources) == ("tea", 3.0, "uncategorized", False, [])
    assert (got[3].name, got[3].quantity, got[3].sources) == ("pepper", None, [])


def test_units_rewritten(spark):
    words = ["C", "c", "Tb", "Ml", "Pt", "Cl", "fl oz", "fluid ounce", "tins", "Unit", "cup-ish", "oz", "bunch"]
    want = ["cup", "cup", "tablespoon", "milliliter", "pint", "centiliter", "fluid_ounce", "fluid_ounce", None, None, None, "ounce", None]
    assert column(spark, words, nrm.canonical_unit) == want


def test_inputs_to_lists(spark):
    html = {"a": page('{"@type": "Recipe", "name": "Pie", "recipeIngredient": ["2 cups flour"]}'), "b": "<h2>Ingredients</h2><p>1 cup flour</p>"}
    urls_ = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 2, "c")], "list_id long, recipe_pos long, url string")
    read = pipeline.recipes_from_urls(urls_, lambda u: html[u])
    assert {(r.list_id, r.recipe_pos): (r.recipe, bool(r.ingest_error)) for r in read.collect()} == {(1, 1): ("Pie", False), (1, 2): ("b", False), (2, 1): ("Pie", False), (2, 2): ("c", True)}
    assert sorted((r.list_id, r.name, r.quantity, r.sources) for r in pipeline.build_list(read).collect()) == [(1, "flour", 3.0, ["Pie", "b"]), (2, "flour", 2.0, ["Pie"])]
    files = spark.createDataFrame([(1, 1, "/x/a.txt", b"Ingredients\n1 egg"), (1, 2, "/x/b.txt", b"")], "list_id long, recipe_pos long, path string, content binary")
    assert [(r.recipe, r.name, r.quantity) for r in pipeline.process_documents(files).collect()] == [("a.txt", "egg", 1.0)]

    def ocr(data):
        if not data:
            raise ValueError("no image")
        return data.decode()

    assert [(r.recipe, r.name) for r in pipeline.process_photos(files, ocr).collect()] == [("a.txt", "egg")]
    assert {r.recipe: r.ingest_error for r in pipeline.recipes_from_photos(files, ocr).collect()} == {"a.txt": None, "b.txt": "unreadable photo: ValueError"}


def test_a_user_can_plug_in_an_extractor(spark):
    class Own(pipeline.Grammar):
        def ingredient_lines(self, recipes):
            return recipes.withColumn("lines", F.array(F.lit("1 cup moonstuff")))

        def categories(self, names, aisles):
            return names.select("name", F.lit(aisles[-1]).alias("category"))

    df = spark.createDataFrame([(1, 1, "A", "u", ["1 egg"], "")], "list_id long, recipe_pos long, recipe string, source_url string, ingredient_lines array<string>, raw_text string")
    assert [(r.name, r.category) for r in pipeline.extract(df, extractor=Own()).collect()] == [("moonstuff", "other")]


def test_prediction_over_labelled_cases(spark):
    cases = spark.createDataFrame(
        [("a", ["1 lb spaghetti ($0.98)", "¼ cup olive oil"], ""), ("b", [], "Ingredients\n2 cloves garlic, minced\nMethod\nCook.")],
        "case_id string, ingredient_lines array<string>, raw_text string",
    )
    expected = spark.createDataFrame(
        [("a", 1, "spaghetti", "pantry"), ("a", 2, "oil", "condiments & sauces"), ("b", 1, "garlic", "produce")], "case_id string, pos int, name string, category string"
    )
    got = evaluate.rates(evaluate.match_cases(pipeline.predict(cases), expected), ["case_id"]).filter("case_id is null").first()
    assert (got.tp, got.fp, got.fn, got.f1, got.category_accuracy) == (3, 0, 0, 1.0, 1.0)


def test_documents(spark, tmp_path):
    with zipfile.ZipFile(buf := io.BytesIO(), "w") as z:
        ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f"<w:document {ns}><w:p><w:r><w:t>1 egg</w:t></w:r></w:p><w:p><w:r><w:t>2 cups</w:t><w:t> milk</w:t></w:r></w:p></w:document>")
    for name, data in {"a.DOCX": buf.getvalue(), "b.txt": b"x \xff y", "c.pdf": b"%PDF", "d.docx": b"no zip"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.filename: r for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.DOCX"].text == "1 egg\n2 cups milk" and got["b.txt"].text == "x � y"
    assert got["c.pdf"].ingest_error and got["d.docx"].ingest_error == "unreadable docx: BadZipFile"


def test_patterns_in_label_sequences(spark):
    got = column(spark, [["A", "B", "A", "B", "C"], ["AB", "A", "B"], []], lambda c: sequences.pattern_starts(c, ["A", "B"]), "array<string>")
    assert got == [[0, 2], [1], []]


def test_stream_into_lists(spark, tmp_path):
    schema = "list_id long, recipe_pos long, recipe string, source_url string, ingredient_lines array<string>, raw_text string"
    one = '{"list_id": 1, "recipe_pos": %d, "recipe": "R%d", "ingredient_lines": ["2 cups flour"], "raw_text": ""}'
    (tmp_path / "in").mkdir()
    for n in (1, 2):
        (tmp_path / "in" / f"{n}.json").write_text(one % (n, n))
        ingest.stream_contributions(spark, str(tmp_path / "in"), schema, str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination()
    assert [(r.name, r.quantity, r.sources) for r in ingest.current_lists(spark, str(tmp_path / "store")).collect()] == [("flour", 4.0, ["R1", "R2"])]
    (tmp_path / "in" / "3.json").write_text(one.replace('"list_id": 1', '"list_id": 7') % (3, 3))
    ingest.stream_contributions(spark, str(tmp_path / "in"), schema, str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination()
    store = str(tmp_path / "store")
    last = max(int(f.name.partition("=")[2]) for f in (tmp_path / "store").glob("batch=*"))
    touched = ingest.touched_lists(spark, store, last)
    some = ingest.current_lists(spark, store, touched=touched)
    assert [(r.list_id, r.name, r.quantity) for r in some.collect()] == [(7, "flour", 2.0)]
    assert ingest.current_lists(spark, store).count() == 2


def test_failed_recipes_do_not_stop_a_build(spark):
    rows = [(1, 1, "A", "u", ["1 egg"], "", None), (1, 2, "B", "u", [], "", "failed"), (1, 3, "C", "u", [], "Ingredients\n1 egg", None)]
    df = spark.createDataFrame(rows, "list_id long, recipe_pos long, recipe string, source_url string, ingredient_lines array<string>, raw_text string, ingest_error string")
    assert [(r.name, r.quantity, r.sources) for r in pipeline.build_list(df).collect()] == [("egg", 2.0, ["A", "C"])]
    assert [r.recipe for r in pipeline.without_ingredients(df, pipeline.extract(df)).collect()] == ["B"]
