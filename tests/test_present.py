from pyspark.sql import functions as F

from cookwright.operators import present as P


def column(spark, expr, values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(expr(F.col("x"))).collect()]


def test_labels():
    lines = {"2 cups finely chopped red onions (about 3)": "red onion", "For the sauce:": None, "salt and pepper": None, "1 can coconut milk, shaken": "coconut milk shaken", "or 2 eggs": None, "3 cloves garlic, from the garden": "garlic", "": None}
    assert {x: P.label_of(x) for x in lines} == lines


def test_summary(spark):
    assert P.summary_of("Spicy Lentil Soup", ["200 g red lentils", "2 cans tomatoes", "1 mango", "salt"], None) == "A spicy soup featuring red lentils, tomato, and mango."
    assert P.summary_of("Thing", None, None) == "A recipe from the recipe collection."
    assert P.summary_of("Thing", ["1 mango"], "Told.") == "Told."
    rows = spark.createDataFrame([("Apple Pie", ["6 apples"], None), (None, None, None)], "n string, i array<string>, d string")
    assert [r[0] for r in rows.select(P.summary(F.col("n"), F.col("i"), F.col("d"))).collect()] == ["A pie featuring apples.", "A recipe from the recipe collection."]


def test_times(spark):
    assert column(spark, P.format_minutes, [80, 60, 0, 5, -1, None], "int") == ["1 hr 20 min", "1 hr", "0 min", "5 min", None, None]
    assert column(spark, P.format_duration, ["PT1H20M", "PT5M", "soon", "PT", "", None]) == ["1 hr 20 min", "5 min", "soon", "PT", None, None]


def test_facts(spark):
    rows = spark.createDataFrame([("PT10M", "PT20M", "4 servings", ["a"]), (None, "PT20M", None, None), ("PT5M", None, "makes 2", ["a", "b"]), (None, None, "x" * 40, [])], "p string, c string, y string, i array<string>")
    assert [r[0] for r in rows.select(P.facts(F.col("p"), F.col("c"), F.col("y"), F.col("i"))).collect()] == ["30 min total time · Makes 4 servings · 1 ingredient", "20 min cooking time · 0 ingredients", "5 min preparation time · makes 2 · 2 ingredients", "0 ingredients"]


def test_sources(spark):
    assert column(spark, P.source_label, ["AllRecipes", "bonappetit.com", "my_own-site", " ", None]) == ["Allrecipes", "Bon Appétit", "my own site", None, None]
    assert column(spark, P.source_icon, ["Epicurious", "x", None]) == ["source-icons/epicurious.svg?v=1", None, None]


def test_steps(spark):
    text = "Step 1: Mix the flour.\n2) Bake.\n\n3. Bake.\nIntro. Bake the cake until it is done.\nBake the cake until it is done."
    assert column(spark, P.steps, [text, None, "\n"], "string") == [["Mix the flour.", "Bake.", "Bake the cake until it is done."], [], []]


def test_marks(spark):
    assert P.annotate("Bake at 350°F for 10-15 minutes with 2 cups milk", False) == [(8, 13, "temperature"), (18, 31, "time"), (37, 43, "amount")]
    assert P.annotate("2 eggs", True) == [(0, 1, "amount")] and P.annotate(None, True) == [] and P.annotate("B12 cups", False) == []
    assert column(spark, lambda c: P.format_html(c, True), ["1 cup <milk> & 5 min", None]) == ['<span class="recipe-amount">1 cup</span> &lt;milk&gt; &amp; <span class="recipe-time">5 min</span>', ""]


def test_items(spark):
    assert column(spark, P.ingredient_items, ["a, b;; c\n d "]) == [["a", "b", "c", "d"]]
