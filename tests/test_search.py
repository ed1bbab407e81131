import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cookwright.functions import query_text as Q
from cookwright.operators import evaluate as E
from cookwright.operators import index as I
from cookwright.operators import linkage, rank

RECIPES = [
    ("Coconut Cod Curry", ["400 g cod", "1 can coconut milk", "1 onion"], "A mild curry."), ("Red Lentil Soup", ["200 g red lentils", "2 onions", "3 cloves garlic"], None), ("Garlic Pasta", ["500 g pasta", "6 cloves garlic", "chili flakes"], None),
    ("Spicy Bean Tacos", ["2 cans black beans", "jalapenos", "8 tortillas"], None), ("Apple Pie", ["6 apples", "250 g flour", "butter"], None), ("Green Salad", ["lettuce", "cucumber", "olive oil"], None), ("Red Lentil Soup", ["150 g red lentils", "carrots"], None),
    ("Chocolate Cake", ["200 g chocolate", "4 eggs", "sugar"], None), ("Beef Stew", ["1 kg beef", "carrots", "potatoes", "onions"], None), ("Mango Smoothie", ["2 mangos", "yogurt"], None), ("Salmon Burger", ["salmon", "bread", "dill"], None), ("Tomato Salad", ["tomatoes", "basil", "onion"], None),
]


@pytest.fixture(scope="module")
def recipes(spark):
    return spark.createDataFrame([(k, f"id{k}", n, i, "sample", d) for k, (n, i, d) in enumerate(RECIPES)], "row_ix long, id string, name string, ingredients array<string>, source string, description string").select("*", *(F.lit(None).cast("string").alias(c) for c in ("url", "image_url", "prep_time", "cook_time", "recipe_yield", "instructions", "instruction_source")))


@pytest.fixture(scope="module")
def index(recipes):
    return I.RecipeIndex.build(recipes, I.HashEmbedding())


def brute(query, mode="hybrid"):
    """Every recipe's scores by plain loops."""
    names, texts = [n for n, _, _ in RECIPES], [Q.normalize_text(" ".join([n, *i]))[:1600] for n, i, _ in RECIPES]
    grams = [I.char_grams(t) for t in texts]
    df = {}
    for g in grams:
        for x in g:
            df[x] = df.get(x, 0) + 1
    idf = {g: math.log((1 + len(texts)) / (1 + c)) + 1 for g, c in df.items()}
    model = I.LexicalModel(idf)
    q = model.vector(Q.normalize_text(query.original))
    lex = [sum(w * q.get(g, 0) for g, w in model.vector(t).items()) for t in texts]
    b = I.HashEmbedding()
    full = ["\n".join([n, *i, *([d] if d else [])]) for n, i, d in RECIPES]
    sem = np.clip(b.encode(full).astype(float) @ b.encode([query.semantic_text])[0].astype(float), 0, 1)
    terms = [set().union(*(Q.terms(x) for x in i)) for _, i, _ in RECIPES]
    known = [t for t in query.rank_terms if any(t in s for s in terms)]
    ing = [min(1.0, 0.8 * (c := sum(t in s for t in known)) / len(known) + 0.2 * c / math.sqrt(len(known) * max(1, len(s)))) if known else 0.0 for s in terms]
    w = (0.30, 0.15, 0.55) if query.kind == "ingredients" else (0.55, 0.25, 0.20)
    return names, lex, sem, ing, [w[0] * s + w[1] * x + w[2] * i for s, x, i in zip(sem, lex, ing)]


def test_hybrid_equals_plain_loops(index):
    q = Q.interpret("soup with red lentils and onion")
    got = rank.search(index, [rank.Request(1, q, limit=5)]).orderBy("rank").collect()
    names, lex, sem, ing, final = brute(q)
    order, seen = [], set()
    for k in sorted(range(len(final)), key=lambda k: (-final[k], k)):
        if names[k] not in seen:
            seen.add(names[k])
            order.append(k)
    assert [r.row_ix for r in got] == order[:5]
    for r in got:
        assert (r.lexical, r.semantic, r.ingredient, r.final) == pytest.approx((lex[r.row_ix], sem[r.row_ix], ing[r.row_ix], final[r.row_ix]), abs=1e-6)
    assert got[0].strategy == "search" and "Matches" in got[0].reason


def test_batch_equals_single_requests(index):
    asked = [rank.Request(k, Q.interpret(t), m, 4) for k, (t, m) in enumerate([("cod with coconut milk", "hybrid"), ("garlic pasta", "lexical"), ("salad", "semantic")])]
    whole = {(r.request_id, r.rank): r.row_ix for r in rank.search(index, asked).collect()}
    single = {(r.request_id, r.rank): r.row_ix for a in asked for r in rank.search(index, [a]).collect()}
    assert whole == single


def test_exclusions(index):
    names = [r.row_ix for r in rank.search(index, [rank.Request(1, Q.interpret("soup or pasta without garlic"), limit=12)]).collect()]
    assert not {1, 2} & set(names)
    mild = [r.row_ix for r in rank.search(index, [rank.Request(1, Q.interpret("not spicy beans tacos"), limit=12)]).collect()]
    assert 3 not in mild


def test_low_signal_and_discovery(index):
    r = rank.search(index, [rank.Request(1, Q.interpret("xqzw vvvkk"), limit=4)]).collect()
    assert {x.strategy for x in r} == {"discovery"} and {x.warning for x in r} == {rank.DISCOVERED}
    meta = rank.metadata(index, [rank.Request(1, Q.interpret("xqzw vvvkk"))], rank.search(index, [rank.Request(1, Q.interpret("xqzw vvvkk"))])).first()
    assert meta.confidence == "low" and meta.total_recipes == len(RECIPES)
    some = rank.search(index, [rank.Request(2, Q.interpret("surprise me"), limit=12)]).collect()
    assert {x.strategy for x in some} == {"adventurous"}
    assert 9 not in {x.row_ix for x in some} and not {1, 6} <= {x.row_ix for x in some}


def test_without_semantic_backend(recipes):
    plain = I.RecipeIndex.build(recipes)
    r = rank.search(plain, [rank.Request(1, Q.from_ingredients(["coconut milk", "cod"]))]).orderBy("rank").first()
    assert r.row_ix == 0 and r.semantic is None and r.final == pytest.approx(0.15 / 0.7 * r.lexical + 0.55 / 0.7 * r.ingredient)


def test_failing_backend_degrades(index):
    class Broken(I.HashEmbedding):
        def encode(self, texts):
            raise RuntimeError

    import dataclasses

    r = rank.search(dataclasses.replace(index, backend=Broken()), [rank.Request(1, Q.interpret("red lentil soup"))]).collect()
    assert all(x.semantic is None and x.semantic_degraded and x.warning == rank.SEMANTIC_FAILED for x in r)


def test_responses_and_pages(index):
    found = rank.search(index, [rank.Request(1, Q.interpret("red lentil soup"), limit=12)])
    rows = rank.responses(index, found).orderBy("rank").collect()
    assert rows[0].name == "Red Lentil Soup" and rows[0].summary.startswith("A soup featuring") and rows[0].score == round(rows[0].score, 4)
    assert [r.rank for r in rank.page(found, 2, 5).orderBy("rank").collect()] == [6, 7, 8, 9, 10][: rank.page(found, 2, 5).count()]


def test_empty_batch_and_empty_index(spark, index, recipes):
    assert rank.search(index, []).count() == 0
    none = I.RecipeIndex.build(recipes.limit(0), I.HashEmbedding())
    assert rank.search(none, [rank.Request(1, Q.interpret("soup"))]).count() == 0


def test_save_and_load(spark, index, tmp_path):
    index.save(str(tmp_path / "i"))
    again = I.RecipeIndex.load(spark, str(tmp_path / "i"), I.HashEmbedding())
    ask = [rank.Request(1, Q.interpret("garlic"), limit=3)]
    assert [r.row_ix for r in rank.search(again, ask).orderBy("rank").collect()] == [r.row_ix for r in rank.search(index, ask).orderBy("rank").collect()]
    assert I.RecipeIndex.load(spark, str(tmp_path / "none")) is None and I.RecipeIndex.load(spark, str(tmp_path / "i"), I.HashEmbedding(32)) is None


def test_vocabulary_cap(index):
    t = index.terms
    all_ = {r.gram: r.total for r in I.lexical_vocabulary(t).collect()}
    few = [r.gram for r in I.lexical_vocabulary(t, 7).collect()]
    assert few == sorted(all_, key=lambda g: (-all_[g], g))[:7]


def test_vectors_are_checked(spark):
    good = spark.createDataFrame([(1, [1.0, 0.0])], "row_ix long, vec array<float>")
    assert I.checked_vectors(good, 2).count() == 1
    for bad in ([1.0], [float("nan"), 0.0], None):
        with pytest.raises(ValueError):
            I.checked_vectors(spark.createDataFrame([(1, bad)], "row_ix long, vec array<float>"), 2)


def test_evaluation(spark, index):
    cases = spark.createDataFrame([(1, "red lentil soup", None, ["lentil"], ["beef"], 1, "x"), (2, "something quite impossible zzz", None, ["dragon"], None, 1, "without"), (3, None, ["cod"], ["cod"], None, 1, None)], "item_id long, query_text string, ingredients array<string>, expected_any array<string>, excluded_any array<string>, minimum_matches int, note string")
    rows = E.evaluate(index, cases, 5, ("hybrid", "lexical"))
    a = {r["mode"]: r for r in E.aggregates(rows, cases).collect()}
    assert a["hybrid"].labelled == 2 and a["hybrid"].hit_rate == 1.0 and a["hybrid"].mrr == 1.0 and a["hybrid"].excluding == 1
    assert "Hit@5 100%" in E.markdown_report(rows, cases, 5)


def test_strict_linkage(spark):
    r = spark.createDataFrame([(1, "Soup", ["egg", "milk"], "allrecipes"), (2, "Pie", ["apple", "flour"], "epicurious"), (3, "Stew", ["beef", "carrot"], "allrecipes"), (4, "Cake", ["egg", "sugar"], "other"), (5, None, None, None)], "row_ix long, name string, ingredients array<string>, source string")
    m = spark.createDataFrame([("recipe_box_allrecipes", "a", 1, "SOUP", ["1 egg", "milk"], "Boil."), ("recipe_box_epicurious", "b", 1, "Soup", ["egg", "milk"], "No."), ("recipe_box_epicurious", "c", 2, "Pie", ["apples", "flour"], "Bake."), ("recipe_box_epicurious", "d", 3, "Pie", ["apples", "flour"], "Fry."), ("recipe_box_allrecipes", "e", 2, "Stew", ["beef", "carrot", "onion", "leek"], "Stew."), ("recipe_box_allrecipes", "f", 3, "Cake", ["egg", "sugar"], "Mix.")], "corpus string, record_key string, ordinal long, title string, ingredients array<string>, instructions string")
    assert [(x.row_ix, x.record_key, x.score) for x in linkage.strict_matches(r, m).collect()] == [(1, "a", 1.0)]
    assert {x.row_ix for x in linkage.strict_matches(r, m, any_source=True).collect()} == {4}


def test_retrieval_quality_takes_every_case(spark, monkeypatch):
    from cookwright import catalog

    all_ = spark.createDataFrame([(k, f"q{k}") for k in (1, 2, 99, 100, 101)], "item_id long, query_text string")
    monkeypatch.setattr(catalog, "table", lambda *_: all_)
    monkeypatch.setattr(catalog, "_index", lambda *_: None)
    monkeypatch.setattr(catalog, "evaluate", lambda _, cases: cases)
    monkeypatch.setattr(catalog, "aggregates", lambda rows, cases: rows.join(cases, "item_id"))
    assert {r.item_id for r in catalog.retrieval_quality(spark, "").collect()} == {1, 2, 99, 100, 101}


def test_stored_vectors_equal_those_of_the_model(spark, index):
    rows = index.terms.select("row_ix", "text", "grams", "weights").collect()
    names = sorted(index.model.idf)
    for r in rows:
        assert dict(zip([names[g] for g in r.grams], r.weights)) == pytest.approx(index.model.vector(r.text))
    long = I.lexical_weights(index.terms, index.model)
    assert {(r.row_ix, r.gram) for r in long.collect()} == {(r.row_ix, names[g]) for r in rows for g in r.grams}


def test_search_does_not_depend_on_partitions(spark, recipes):
    import dataclasses

    many = recipes.crossJoin(spark.range(40).select(F.col("id").alias("copy"))).withColumn("row_ix", F.col("row_ix") * 40 + F.col("copy")).withColumn("name", F.concat("name", F.lit(" "), F.col("copy") % 7)).drop("copy")
    index = I.RecipeIndex.build(many, I.HashEmbedding())
    asked = [rank.Request(1, Q.interpret("red lentil soup"), limit=30), rank.Request(2, Q.interpret("surprise me"), limit=20), rank.Request(3, Q.interpret("pie without flour"), "lexical", 5), rank.Request(4, Q.interpret("xqzw"), limit=9)]
    seen = [sorted(map(tuple, rank.search(dataclasses.replace(index, terms=index.terms.repartition(n)), asked).select("request_id", "rank", "row_ix", "strategy", F.round("final", 9)).collect())) for n in (1, 7)]
    assert seen[0] == seen[1] and {r[0] for r in seen[0]} == {1, 2, 3, 4}


def test_given_vectors_and_rows_without_one(spark, recipes):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8])], "row_ix long, vec array<double>")

    class Fixed(I.HashEmbedding):
        def encode(self, texts):
            return np.array([[1.0, 0.0] for _ in texts])

    index = I.RecipeIndex.build(recipes, Fixed(), vectors=vectors)
    got = {r.row_ix: r.semantic for r in rank.search(index, [rank.Request(1, Q.interpret("red lentil soup with cod"), "semantic", 12)]).collect()}
    assert got[0] == 1.0 and got[1] == pytest.approx(0.6) and {v for k, v in got.items() if k > 1} == {0.0}


def test_text_limit(recipes):
    assert {len(r.text) for r in I.term_table(recipes, 5).collect()} == {5} and max(len(r.text) for r in I.term_table(recipes).collect()) > 20
