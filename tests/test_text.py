from pyspark.sql import functions as F

from cookwright.functions import query_text as Q
from cookwright.functions import text as T


def column(spark, expr, values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(expr(F.col("x"))).collect()]


def test_normalize(spark):
    texts = ["  Kokosmjölk, LÖK! ", "1½ cups", "Crème Brûlée – 100 %", "süß GROSSE", "a-b_c", "Ω№5", ""]
    assert column(spark, T.normalize, texts) == [Q.normalize_text(t) for t in texts]
    assert column(spark, T.normalize, texts)[0] == "kokosmjolk lok"
    assert column(spark, T.normalize, [None]) == [None]


def test_terms_equal_plain_version(spark):
    lines = ["2 cups finely chopped red onions", "1 can coconut milk", "kokosmjölk och lök", "3 cloves garlic, minced", "560g jalapeños", "1½ dl grädde", "2 chili peppers", "", "1-2 eggs or nueces"]
    assert [set(x) for x in column(spark, T.terms, lines)] == [Q.terms(x) for x in lines]
    assert Q.terms("1½ cups milk") == {"milk"}


def test_singular(spark):
    words = ["berries", "tomatoes", "potatoes", "eggs", "glass", "hummus", "pies"]
    assert column(spark, T.singular, words) == [Q.singular(w) for w in words] == ["berry", "tomato", "potato", "egg", "glass", "hummu", "pie"]


def test_minutes(spark):
    assert column(spark, T.minutes, ["PT15M", "PT1H30M", "pt2h", "PT0M", "PT", "P1D", "soon", "", None]) == [15, 90, 120, 0, None, None, None, None, None]


def test_urls(spark):
    pairs = {
        "http://www.epicurious.com/recipes/food/views/Foo-1?x=1#f": "https://www.epicurious.com/recipes/food/views/foo-1?x=1",
        "http://bonappetit.com/recipes/quick-recipes/2010/05/Some_Slug/": "https://www.bonappetit.com/recipe/some_slug",
        "https://www.bonappetit.com/recipe/AbC": "https://www.bonappetit.com/recipe/abc",
        "http://allrecipes.com:80/recipe/1/": "https://www.allrecipes.com/recipe/1/",
        "http://allrecipes.com.evil.example/x": "http://allrecipes.com.evil.example/x",
        "http://user:p@allrecipes.com/x": "http://user:p@allrecipes.com/x",
        "http://allrecipes.com:8080/x": "http://allrecipes.com:8080/x",
    }
    assert column(spark, lambda c: T.canonical_url(T.safe_url(c)), list(pairs)) == list(pairs.values())
    assert column(spark, T.safe_url, ["ftp://x/y", "http://", "/x", None, " "]) == [None] * 5


def test_descriptions_and_methods(spark):
    assert column(spark, T.unquote, ['"a b"', "“x”", '"a', 'a "b" c', " ", '"']) == ["a b", "x", '"a', 'a "b" c', None, '"']
    assert column(spark, T.unescape, ["a &amp;amp; b", "&eacute;", "x", None]) == ["a & b", "é", "x", None]
    assert column(spark, T.clean_method, ["Mix. Bake.\nMix.\nBake.", "a\nA \nb", " "]) == ["Mix.\nBake.", "a\nb", ""]


def test_category(spark):
    assert column(spark, T.category, ["Pancake tower", "Green Salad", "Thing"]) == ["dessert", "salad", "other"]


def test_query_terms():
    assert Q.query_terms(["något starkt med torsk och kokosmjölk"]) == ["coconut milk", "cod"]
    assert Q.query_terms(["I have eggs, potatoes and onion"]) == ["egg", "onion", "potato"]


def test_intent():
    assert [Q.intent(t) for t in ("something I haven't had before", "food", "fasting food", "anything is fine for me")] == ["adventurous", "browse", "search", "browse"]


def test_exclusions():
    q = Q.interpret("pasta con tomate sin ajo")
    assert set(q.ingredients) == {"pasta", "tomato"} and q.excluded_ingredients == ["garlic"]
    assert Q.interpret("soup without garlic, onion").excluded_ingredients == ["garlic", "onion"]
    assert Q.interpret("soup without garlic and onion").excluded_ingredients == ["garlic", "onion"]
    assert Q.interpret("not spicy chicken").excluded_preferences == ["spicy"]
    both = Q.from_ingredients(["garlic", "no garlic"])
    assert both.ingredients == [] and both.warning == Q.CONFLICT
    assert Q.interpret("surprise me without nuts").intent == "adventurous"


def test_semantic_text():
    assert Q.interpret("zzz").semantic_text == "zzz. Desired: zzz"
    assert Q.interpret("pasta without garlic").semantic_text == "Desired: pasta"
    assert Q.interpret("anything").semantic_text == "anything"


def test_contract():
    import pytest

    for bad in ({}, {"query": "a", "ingredients": ["b"]}, {"query": "!!"}, {"query": "x" * 501}, {"query": "a", "limit": 51}, {"ingredients": []}, {"ingredients": ["a"] * 21}, {"query": "a", "mode": "other"}):
        with pytest.raises(ValueError):
            Q.validated(**bad)
    assert Q.validated(query="egg").ingredients == ["egg"]
    assert Q.model_would_help("something vegan under thirty minutes please now") and not Q.model_would_help("quick soup")


def test_exclusions_are_one_walk():
    from cookwright.functions.query_text import split_excluded

    for text, wanted, out in [
        ("pasta without garlic, onion with tomato", "pasta with tomato", ["garlic", "onion"]), ("no egg and milk but cream", "but cream", ["egg", "milk"]), ("not spicy chicken", "chicken", []),
        ("soup except for leeks", "soup", ["leek"]), ("no, garlic", "no , garlic", []), ("stew sin ajo con pollo", "stew con pollo", ["garlic"]), ("without", "", []), ("no without onion", "no", ["onion"]),
    ]:
        assert split_excluded(text) == (wanted, out), text


def test_a_model_that_fails_degrades_to_rules():
    from cookwright.functions import query_text as Q

    def answer(**more):
        return lambda q: {"ingredients": ["tomatoes", "basil"], "excluded_ingredients": ["basil"], "preferences": [" vegan "], "max_minutes": 30, **more}

    got = Q.interpret_with(answer(), "not spicy tomato dinner")
    assert (got.ingredients, got.excluded_ingredients, got.preferences, got.max_minutes, got.source, got.warning) == (["tomato"], ["basil"], ["vegan"], 30, "model", Q.CONFLICT) and got.excluded_preferences == ["spicy"]
    for bad in (lambda q: 1 / 0, lambda q: {}, answer(max_minutes=0), answer(ingredients=["x"] * 21), answer(preferences=["y" * 101])):
        low = Q.interpret_with(bad, "tomato soup")
        assert low.degraded and low.warning == Q.UNAVAILABLE and low.ingredients == Q.interpret("tomato soup").ingredients
    assert not Q.interpret_with(None, "tomato soup").degraded
