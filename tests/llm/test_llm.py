import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cookwright.functions.encoding import CHAINS, garble, invert, repair
from cookwright.llm import leakage, linkage, mixing, mojibake, neighbours, ranking, residue, setjoin, stuffing
from cookwright.llm.hnsw import Graph


def pairs(df, a="a", b="b"):
    return {(r[a], r[b]) for r in df.collect()}


# 1 ---------------------------------------------------------------------------------------------------------------


def test_ranking(spark):
    rng = random.Random(1)
    rows = [(1, k, rng.random(), rng.random() * 1000, -1.0) for k in range(30)] + [(1, 100, 0.97, 960.0, None), (1, 101, 0.1, 1e12, None), (1, 100, 0.97, 960.0, None)]
    rows += [(2, 1, float("nan"), None, -1.0), (2, 2, None, 5.0, None), (2, 3, None, 5.0, None), (3, 7, None, None, None), (None, 1, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "q long, row long, s double, l double, i double").withColumn("fused", F.lit("clash"))
    fused = ranking.fused_scores(df, "q", "row", ["s", "l", "i"])
    assert {r.q: r.row for r in ranking.best_of_each(fused, "q", "row").collect()} == {1: 100, 2: 2}
    assert {r.used for r in fused.where("q = 1").collect()} == {2}
    assert ranking.fused_scores(df.limit(0), "q", "row", ["s"]).count() == 0


# 2 ---------------------------------------------------------------------------------------------------------------

NATURAL = ["2 cups flour, divided", "[optional] apricots", "Follow the script on the packet for soaking.", "See page 404 of the old cookbook.", "Stir in the onions and let it bubble gently.", "salt and pepper", "250 g butter", "Bake at 200 degrees until golden."]


@pytest.fixture(scope="module")
def residue_model():
    rng = random.Random(2)
    return residue.train([rng.choice(NATURAL).replace("2", str(rng.randrange(9))) for _ in range(4000)])


def test_residue(spark, residue_model):
    rows = [(1, ["2 cups flour", "{{ingredient}}"], None), (2, NATURAL, "\n".join(NATURAL)), (3, ["butter"], "Please enable JavaScript to view this recipe."), (4, None, "Lorem ipsum dolor sit amet consectetur."), (5, [None, ""], " "), (6, ["500: Internal server error"], "Stir in the onions and let it bubble gently. " * 3_000)]
    df = spark.createDataFrame(rows, "row_ix long, ingredients array<string>, instructions string").withColumn("coverage", F.lit(1))
    got = {(r.row_ix, r.field): r.coverage for r in residue.residue(df, "row_ix", ["ingredients"], ["instructions"], residue_model).collect()}
    assert set(got) == {(1, "ingredients"), (3, "instructions"), (4, "instructions"), (6, "ingredients")}
    assert got[(3, "instructions")] > 0.9 and got[(1, "ingredients")] < 0.8
    assert residue.residue(df.limit(0), "row_ix", ["ingredients"], ["instructions"], residue_model).count() == 0


# 3 ---------------------------------------------------------------------------------------------------------------

FOODS = ["salmon", "butter", "lemon", "fennel", "leek", "barley", "feta", "spinach", "almond", "honey", "carrot", "pumpkin", "walnut", "cumin", "paprika", "spelt", "rhubarb", "kale"]


def test_linkage(spark):
    rng, left, right = random.Random(5), [], []
    for k in range(120):
        foods = rng.sample(FOODS, 8)
        title = f"{foods[0]} and {foods[1]} {rng.choice(['soup', 'pie', 'stew'])}"
        pub = f"torvel{rng.choice('abcdef')}-hearth"
        left.append((str(k), title, [f"{rng.randrange(9)} g {x}" for x in foods], pub, None))
        if k < 60:
            words = title.split()
            right.append((f"m{k}", " ".join([words[2], *words[:2], *words[3:], "(easy)"]).upper(), foods[:7] + ["salt"], pub.replace("-", " ").title() if k % 3 else None, None))
    right += [("none", None, ["salmon"], None, None), ("empty", "salmon pie", None, None, None), right[0]]
    schema = "key string, title string, lines array<string>, publisher string, entity string"
    l, r = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    got = pairs(linkage.match(l, r), "left", "right")
    want = {(str(k), f"m{k}") for k in range(60)}
    assert len(got & want) >= 57 and len(got - want) <= 2
    assert linkage.match(l, r.limit(0)).count() == 0


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(3)
    for n, m in ((3, 4), (4, 4), (1, 3)):
        p = rng.random((n, m))
        best = max(sum(p[i, c[i]] for i in range(n)) for c in permutations(range(m), n))
        assert sum(p[i, j] for i, j in linkage._hungarian(p)) == pytest.approx(best)


# 4 ---------------------------------------------------------------------------------------------------------------


def test_set_join_equals_all_pairs(spark):
    rng, rows = random.Random(7), []
    for k in range(150):
        base = rows[rng.randrange(len(rows))][1] if rows and rng.random() < 0.5 else [f"t{rng.randrange(60)}" for _ in range(rng.randrange(3, 14))]
        rows.append((k, [x if rng.random() < 0.9 else f"t{rng.randrange(60)}" for x in base]))
    rows += [(150, [f"u{j}" for j in range(60)]), (151, [f"u{j}" for j in range(55)]), (152, [" A  b", "a b", "c", "d", "e", "f"]), (153, ["A B", "c", "D", "e", "f"]), (154, None), (155, [None, ""])]
    sets = {k: {" ".join(x.lower().split()) for x in v if x} for k, v in rows if v}
    want = {(a, b) for a in sets for b in sets if a < b and min(len(sets[a]), len(sets[b])) >= 5 and 100 * len(sets[a] & sets[b]) >= 60 * len(sets[a] | sets[b])}
    df = spark.createDataFrame(rows, "id long, lines array<string>").withColumn("rep", F.lit("clash"))
    assert pairs(setjoin.similar_rows(df, "id", "lines")) == want and (150, 151) in want and (152, 153) in want
    assert setjoin.similar_rows(df.limit(0), "id", "lines").count() == 0


# 5 ---------------------------------------------------------------------------------------------------------------


def test_graph_recall():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found, _ = Graph(x, 10, 48).search(x, 6)
    want = np.argsort(-(x @ x.T), axis=1)[:, :6]
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(found, want)]) >= 0.9


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 8))
    x[200:230] = x[:30] * 3 + rng.standard_normal((30, 8)) * 0.02
    x[230:233] = x[0]
    rows = [(k, [float(a) for a in v]) for k, v in enumerate(x)] + [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8), (503, [1.0]), (5, [float(a) for a in x[5]])]
    df = spark.createDataFrame(rows, "id long, v array<float>").withColumn("cell", F.lit("clash"))
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = {(a, b) for a, b in zip(*np.where(u @ u.T >= 0.995)) if a < b}
    got = pairs(neighbours.similar_rows(df, "id", "v", 0.995, dim=8))
    assert len(got & want) >= 0.97 * len(want) and got <= want
    near, members = neighbours.nearest(df, "id", "v", k=3, dim=8, ask=F.col("row") % 100 == 0, probes=None, shard_rows=100)
    assert {r.row for r in near.select("row").distinct().collect()} == {0, 100, 200, 300} and members.count() == 400
    assert neighbours.similar_rows(df.limit(0), "id", "v", 0.9, dim=8).count() == 0


# 7 ---------------------------------------------------------------------------------------------------------------

SOUND = ["gräddfil och smör på bröd", "jalapeños, crème fraîche", "Müsli für Gäste – süß", "azúcar moreno y limón", "PÂTÉ EN CROÛTE", "Tarta «Ñandú»", "½ cup", "It’s good"]


def test_chains_invert():
    for chain in CHAINS:
        for t in SOUND:
            g = garble(t, chain)
            if g and g != t and chain.startswith("utf-8") and "mac_roman" not in chain:
                assert invert(g, chain) == t, (chain, t)
    assert all(repair(t) == t for t in SOUND)


def test_garbled(spark):
    model = mojibake.train(SOUND * 300)
    bad = [(k, garble(t, c)) for k, (t, c) in enumerate([(SOUND[0], "utf-8>cp1252"), (SOUND[1], "utf-8>cp437"), (SOUND[2], "utf-8>cp1252>utf-8>cp1252"), (SOUND[3], "utf-8>cp1251")])]
    rows = [(k, t, None, None) for k, t in bad] + [(10 + k, t, t, [t, None]) for k, t in enumerate(SOUND)] + [(30, "sm�r", None, None), (31, "", "", []), (32, "x" * 100_000 + " grÃ¤dde", None, None)]
    df = spark.createDataFrame(rows, "row_ix long, name string, description string, ingredients array<string>").withColumn("chain", F.lit("clash"))
    got = {(r.row_ix, r.field): (r.restored, r.lines[0]) for r in mojibake.garbled(df, "row_ix", ["name", "description"], ["ingredients"], model).collect()}
    assert set(got) == {(0, "name"), (1, "name"), (2, "name"), (3, "name"), (30, "name"), (32, "name")}
    assert [got[(k, "name")][1] for k in range(4)] == SOUND[:4] and got[(30, "name")][0] is False
    assert mojibake.garbled(df.limit(0), "row_ix", ["name"], ["ingredients"]).count() == 0


# 8 ---------------------------------------------------------------------------------------------------------------


def test_myers_equals_plain_distance():
    rng = random.Random(3)
    for _ in range(50):
        p, t = ([rng.choice("abc") for _ in range(n)] for n in (rng.randrange(1, 8), rng.randrange(1, 12)))
        row = list(range(len(p) + 1))
        want = []
        for w in t:
            new = [0]
            for i in range(1, len(p) + 1):
                new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (p[i - 1] != w)))
            row = new
            want.append(row[-1])
        assert leakage.myers(p, t) == want


def test_leaks(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen".split()
    texts = {1: "x " + " ".join(item[2:15]).upper() + " y", 2: " ".join(item[:12]) + " but", 3: " ".join(item[:6] + ["oops"] + item[6:14]), 4: None, 5: "", 6: ", ".join(item[4:17]) + " z" * 60_000}
    docs = spark.createDataFrame(list(texts.items()) + [(1, texts[1])], "id long, text string").withColumn("errors", F.lit("clash"))
    items = spark.createDataFrame([(9, " ".join(item)), (10, None), (11, "too short"), (9, " ".join(item))], "item long, passage string")
    assert pairs(leakage.leaks(docs, "id", "text", items, "item", "passage"), "id", "item") == {(1, 9), (6, 9)}
    assert {(r.id, r.errors) for r in leakage.leaks(docs, "id", "text", items, "item", "passage", errors=2).collect()} == {(1, 0), (2, 1), (3, 1), (6, 0)}
    assert leakage.leaks(docs.limit(0), "id", "text", items, "item", "passage").count() == 0
    assert leakage.leaks(docs, "id", "text", items.limit(0), "item", "passage").count() == 0


# 9 ---------------------------------------------------------------------------------------------------------------


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(k, "big", rng.randrange(1, 50)) for k in range(3000)] + [(5000 + k, "tiny", 10) for k in range(20)] + [(9000, "other", 5), (9001, None, 5), (9002, "big", 0)]
    counts = spark.createDataFrame(rows, "id long, source string, tokens long")
    targets = spark.createDataFrame([("big", 0.5, 3), ("tiny", 0.3, 2), ("none", 0.2, 5)], "source string, target_share double, max_repeats int")
    drawn, shares = mixing.mix(counts, targets, total=20_000)
    s = {r.source: r for r in shares.collect()}
    assert abs(s["big"].tokens - 10_000) <= 50 and s["tiny"].tokens == 400 and s["tiny"].capped and s["none"].tokens == 0
    got = drawn.collect()
    assert sum(r.tokens * r.repeats for r in got if r.source == "big") == s["big"].tokens and {r.repeats for r in got if r.source == "tiny"} == {2}
    assert len({r.id for r in got}) == len(got) and {r.source for r in got} == {"big", "tiny"}
    assert {(r.id, r.repeats) for r in mixing.mix(counts.repartition(7), targets, total=20_000)[0].collect()} == {(r.id, r.repeats) for r in got}
    assert mixing.mix(counts.limit(0), targets)[0].count() == 0


def test_tokens(spark):
    import os

    if not os.path.exists(mixing.VOCABULARY):
        pytest.skip("no vocabulary here")
    df = spark.createDataFrame([(1, "a", "hello world"), (2, "A b", None), (3, "a", "")], "id long, s string, t string")
    assert {(r.id, r.source, r.tokens) for r in mixing.token_counts(df, "id", mixing.source_name(F.col("s")), "t").collect()} == {(1, "a", 2), (2, "a_b", 0), (3, "a", 0)}


# 10 --------------------------------------------------------------------------------------------------------------


def test_stuffing(spark):
    prose = "The first time I made this soup, the onions went soft before the lentils were ready. " * 4
    pages = {
        1: prose, 2: "- 200 g butter\n- 3 eggs\n- 1 cup flour\n1. Stir the butter into the flour.\n2. Bake at 180 degrees until it is golden.", 3: "\n".join(f"https://shop{k}.example/x/{k} butter" for k in range(30)), 4: "#BuyButter #CheapEggs " * 20,
        5: "buy cheap butter online | best butter near me | butter discount | " * 10, 6: "Home > Shop > Deals > Login > " * 12, 7: prose + "\nTags: butter, eggs", 8: None, 9: "", 10: "Torvel butter 250g cheap EAN 50042 8.36 EUR\n" * 12, 11: prose + "see https://a.example/x",
    }
    df = spark.createDataFrame([(k, t, f"https://h{k}.example/p", None) for k, t in pages.items()] + [(1, prose, None, "s")], "id long, text string, url string, source string").withColumn("words", F.lit("clash"))
    got = {r.id: r.stuffed for r in stuffing.stuffed_pages(df, "id", "text", "url", "source").collect()}
    assert got == {1: False, 2: False, 3: True, 4: True, 5: True, 6: True, 7: False, 10: True, 11: False}
    assert stuffing.stuffed_pages(df.limit(0), "id", "text", "url", "source").count() == 0


def test_phrases_are_counted_over_all_texts(spark):
    prose = [f"We thought {x} was what the neighbours asked us about." for x in ("seaside velvet lanterns", "copper harbour whistles", "painted orchard ladders")]
    stitched = "\n".join(["seaside velvet lanterns", "copper harbour whistles", "painted orchard ladders"])
    rows = [(k, " ".join(prose), f"https://h{k}.example/p", None) for k in range(4)] + [(9, stitched, "https://h9.example/p", None)]
    rows += [(20 + k, f"Another page number{k} that speaks of the weather and of its garden{k}.", f"https://o{k}.example/p", None) for k in range(30)]
    df = spark.createDataFrame(rows, "id long, text string, url string, source string")
    assert {r.id for r in stuffing.stuffed_pages(df, "id", "text", "url", "source").where("stuffed").collect()} == {9}


def test_stuffing_does_not_depend_on_the_number_of_hosts(spark):
    rng = random.Random(10)
    words = [f"word{k}" for k in range(40)]
    prose = lambda: " ".join(f"It is the {rng.choice(words)} {rng.choice(words)} of the {rng.choice(words)}." for _ in range(12))
    places = "\n".join(f"celeriac skewers {x} Town{k}" for k, x in enumerate(["near", "around", "in"] * 6))
    chance = "\n".join(f"{a} {b}" for a, b in zip(words[::2], words[1::2]))  # words that meet in prose by chance
    for n in (40, 800):
        rows = [(k, prose(), f"https://h{k}.example/p", None) for k in range(n)] + [(-1, places, "https://a.example/p", None), (-2, chance, "https://b.example/p", None)]
        df = spark.createDataFrame(rows, "id long, text string, url string, source string")
        assert {r.id for r in stuffing.stuffed_pages(df, "id", "text", "url", "source").where("stuffed").collect()} == {-1}, n


def test_windows_hold_thirty_neighbours():
    n = 26  # other foods than the first and the last record
    t = {"uid": np.arange(n), "side": np.array([0] * (n - 1) + [1]), "food": np.array([0] + [-1] * (n - 2) + [0]), "title": np.zeros(n, dtype=np.int64), "pub": np.zeros(n, dtype=np.int32)}
    t["food2"] = t["food"]
    assert [(int(a), int(b)) for a, b in zip(*linkage._window_pairs(t))] == [(n - 1, 0)]


def test_windows_go_over_borders_and_batches():
    rng = np.random.default_rng(4)
    n, small = 5_000, 40  # far apart from one another but for some
    t = {"uid": np.arange(n), "side": (rng.random(n) < 0.3).astype(np.int64), "pub": np.zeros(n, dtype=np.int32), "title": np.zeros(n, dtype=np.int64)}
    t["food"] = t["food2"] = np.where(rng.random(n) < 0.1, 0, rng.integers(-(2**62), 2**62, n))
    whole = {(int(a), int(b)) for a, b in zip(*linkage._window_pairs(t))}
    pieces, at = set(), 2_300
    for a, z in ((0, at), (at, n)):
        pieces |= {(int(t["uid"][a:z][i]), int(t["uid"][a:z][j])) for i, j in zip(*linkage._window_pairs({c: v[a:z] for c, v in t.items()}))}
    around = {c: v[at - linkage.REACH : at + linkage.REACH] for c, v in t.items()}
    pieces |= {(int(around["uid"][i]), int(around["uid"][j])) for i, j in zip(*linkage._window_pairs(around, 1, linkage.REACH))}
    assert whole == pieces and len(whole) > small


def test_components_of_long_chains(spark):
    chain = spark.createDataFrame([(f"n{k:04d}", f"n{k + 1:04d}") for k in range(300)] + [("x", "y")], "x string, y string")
    labels = {r.node: r.label for r in linkage.components(chain).collect()}
    assert len(labels) == 303 and set(labels.values()) == {"n0000", "x"} and labels["y"] == "x"
    assert linkage.components(chain.limit(0)).count() == 0


def test_auction_is_near_the_best_total(spark, monkeypatch):
    rng = np.random.default_rng(8)
    profit = np.where(rng.random((25, 30)) < 0.3, np.round(0.5 + rng.random((25, 30)) / 2, 6), 0)
    edges = spark.createDataFrame([(f"a{i}", f"b{j}", float(profit[i, j])) for i, j in zip(*np.nonzero(profit))], "ea string, eb string, confidence double")
    best = sum(profit[i, j] for i, j in linkage._hungarian(profit))
    value = lambda df: sum(profit[int(r.ea[1:]), int(r.eb[1:])] for r in df.collect())
    got = linkage.auction(edges).collect()
    assert len({r.ea for r in got}) == len({r.eb for r in got}) == len(got)
    assert best - 25 * linkage.EPSILON <= value(linkage.auction(edges)) <= best + 1e-9
    assert value(linkage.assignment(edges)) == pytest.approx(best)
    monkeypatch.setattr(linkage, "EXACT", 3)  # the group is too large for one task
    assert value(linkage.assignment(edges)) >= best - 25 * linkage.EPSILON


def test_leftover_rivals_are_copies_only_if_alike(spark):
    foods = ["parsnips", "red lentils", "whole milk", "barley", "spelt flour", "rhubarb", "smoked mackerel", "walnuts"]
    other = ["parsnips", "red lentils", "whole milk", "barley", "spelt flour", "basmati rice", "kale", "honey", "fennel seeds"]
    noise = [(f"x{k}", f"plain word{k} thing{k}", [f"stuff{k}", f"more{k}", f"else{k}"], None, None) for k in range(40)]
    schema = "key string, title string, lines array<string>, publisher string, entity string"
    left = spark.createDataFrame([("1", "Harvest Barley Soup", foods, "torvel-hearth", None), *noise], schema)
    right = spark.createDataFrame([("m1", "Harvest Barley Soup", foods, None, None), ("m2", "harvest barley soup", foods[:7] + ["salt"], None, None), ("m3", "Harvest Barley Soup", foods[:1] + other[1:], None, None)], schema)
    assert pairs(linkage.match(left, right), "left", "right") == {("1", "m1"), ("1", "m2")}


def test_linkage_finds_what_all_pairs_find(spark):
    import os

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("the test tables are not there")
    from cookwright.llm import catalog

    got = pairs(catalog.p3_found(spark, d), "row_ix", "record_key")
    left = spark.read.parquet(f"{d}/sample_recipes.parquet").select("row_ix", "name", "ingredients", linkage.stated(F.col("source"), F.col("url")).alias("s")).collect()
    right = spark.read.parquet(f"{d}/method_corpus.parquet").collect()
    foods = lambda lines: {w for x in lines or [] if x for w in linkage._LETTERS.findall(linkage.fold(x)) if len(w) > 2}
    ls = [(r.row_ix, " ".join(linkage.title_words(r.name)), foods(r.ingredients), *linkage.publisher(r.s)) for r in left]
    rs = [(r.record_key, " ".join(linkage.title_words(r.title)), foods(r.ingredients), *linkage.publisher(r.credit)) for r in right]
    df: dict = {}
    for x in ls + rs:
        for w in x[2]:
            df[w] = df.get(w, 0) + 1
    weight = lambda ws: sum(min(4.0, np.log(len(ls + rs) / df[w])) for w in ws)
    sure = {(a[0], b[0]) for a in ls for b in rs if a[1] and b[1] and a[2] and b[2] and linkage.publishers_agree(a[3], b[3], a[4], b[4]) and linkage.title_similarity(a[1], b[1]) >= 0.6 and weight(a[2] & b[2]) >= 0.5 * weight(a[2] | b[2])}
    assert len(sure) > 20 and len(sure & got) >= 0.97 * len(sure)


def test_negative_scores_count_unless_they_stand_for_none(spark):
    df = spark.createDataFrame([(1, k, -float(k)) for k in range(1, 9)], "q long, row long, s double")
    first = lambda **more: {r.q: r.row for r in ranking.best_of_each(ranking.fused_scores(df, "q", "row", ["s"], **more), "q", "row").collect()}
    assert first(missing=None) == {1: 1} and first() == {1: 2}


def test_residue_generalises_and_spoilt_fields_go(spark, residue_model):
    from cookwright.llm.residue import exclude_spoilt

    told = [x for b in (residue.FILLER, residue.FAILURES, residue.NOTICES) for x in b.split("|")] + residue.residue_lines()
    held_out = ["Switch scripting on before you read these directions", "Kindly turn on scripts, else the list stays empty", "Write the method of your dish in here", "Oops, our kitchen server had an internal error", "Bitte schalten Sie JavaScript für diese Rezepte ein", "Introduzca aquí la lista de ingredientes"]
    assert not set(held_out) & set(told)
    rows = [(k, [x], "Stir in the onions and let it bubble gently.") for k, x in enumerate(held_out)] + [(50, ["2 cups flour"], "Bake until golden."), (None, ["{{item}}"], None), (51, ["{{x}}"] + NATURAL * 9, None)]
    df = spark.createDataFrame(rows, "row_ix long, ingredients array<string>, instructions string").withColumn("_fields", F.lit("clash"))
    found = residue.residue(df, "row_ix", ["ingredients"], ["instructions"], residue_model)
    assert len({r.row_ix for r in found.where("row_ix < 50 and field = 'ingredients'").collect()}) >= 5
    left = exclude_spoilt(df, found, "row_ix", ["ingredients"], ["instructions"]).collect()
    assert len(left) == len(rows) and sum(r.ingredients is None for r in left if r.row_ix is not None and r.row_ix < 50) >= 4
    assert all(r.instructions is not None for r in left if r.row_ix is not None and r.row_ix < 51) and all(r.ingredients for r in left if r.row_ix in (50, 51))


def test_nearest_over_many_cells(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((60, 24))
    x = centres[rng.integers(0, 60, 6000)] + rng.standard_normal((6000, 24)) * 0.6
    df = spark.createDataFrame([(k, [float(a) for a in v]) for k, v in enumerate(x)], "id long, v array<float>")
    near, _ = neighbours.nearest(df, "id", "v", k=5, dim=24, ask=F.col("row") % 100 == 0, shard_rows=100)
    found: dict = {}
    for r in near.collect():
        found.setdefault(r.row, set()).add(r.near)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {k: set(np.argsort(-(u @ u[k]))[1:6].tolist()) for k in range(0, 6000, 100)}
    assert np.mean([len(found[k] & want[k]) / 5 for k in want]) >= 0.95


def test_classes_of_copies(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [2.0, 4.0]), (4, None)], "id long, v array<float>")
    assert {(r.row, r.rep, r.rows) for r in neighbours.classes(df, "id", "v", 2).collect()} == {(1, 1, 2), (2, 1, 2), (3, 3, 1)}
    lines = list("abcdef")
    sets = spark.createDataFrame([(1, lines), (2, lines[::-1]), (3, lines[:5]), (4, lines[:4]), (5, list("uvwxyz")), (6, None)], "id long, lines array<string>")
    got = {r.row: (r.rep, r.rows, r.links) for r in setjoin.linked_classes(sets, "id", "lines").collect()}
    assert got == {1: (1, 2, 1), 2: (1, 2, 1), 3: (3, 1, 1), 5: (5, 1, 0)}


def test_words_are_counted_in_all_rows(spark):
    sound = ["tolv och zwölf eier", "zwölf eier und mehl", "gräddfil och smör"]
    rows = [(k, sound[k % 3]) for k in range(400)] + [(900, garble("zwölf", "cp1252>mac_roman") or "zw\\x9alf")]
    df = spark.createDataFrame(rows, "row_ix long, name string").withColumn("ingredients", F.array(F.lit(None).cast("string")))
    model = mojibake.train(["gräddfil och smör på bröd"] * 50 + SOUND * 50)
    assert model.words["zwölf"] == 0 and mojibake.counted(model, df, ["name"], ["ingredients"]).words["zwölf"] == sum("zwölf" in t for _, t in rows[:400])


def test_link_lists_without_repetition_and_hot_hosts(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("bcdfghjklmnprstvw") + rng.choice("aeiou") for _ in range(3))
    rows = [(k, "\n".join(f"https://{word()}.example/{word()}/{rng.randrange(9999)} {word()}" for _ in range(14)), f"https://h{k}.example/p", None) for k in range(6)]
    rows += [(100 + k, f"The {word()} was so good that I went back for the {word()}, which we had with {word()} on the side.", "https://one.example/p", "s") for k in range(60)]
    rows += [(200, "A link to https://one.example/a that I liked, and why it is worth the time of anyone who cooks.", None, None), (100, None, None, None)]
    df = spark.createDataFrame(rows, "id long, text string, url string, source string")
    assert {r.id for r in stuffing.stuffed_pages(df, "id", "text", "url", "source").where("stuffed").collect()} == set(range(6))


def test_linkage_does_not_depend_on_windows(spark):
    # dishes that 400 publishers have alike; the publishers' short forms are equal, so only their by-lines tell them apart
    rng, left, right = random.Random(21), [], []
    word = lambda n: "".join(rng.choice("bcdfghklmnprstvw") for _ in range(n))
    extras, publishers = [word(6) for _ in range(200)], [f"torv{word(2 * k)}gate" for k in range(1, 401)]
    for dish in range(10):
        title, base = [word(7) for _ in range(3)], [word(6) for _ in range(12)]
        for k, by in enumerate(publishers):
            mine = rng.sample(extras, 2)
            left.append((f"{dish}-{k}", " ".join(title), base + mine, by, None))
            if k % 16 == 8:
                right.append((f"m{dish}-{k}", " ".join(title).upper(), mine[:1] + base, by, None))
    schema = "key string, title string, lines array<string>, publisher string, entity string"
    got = pairs(linkage.match(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)), "left", "right")
    assert len(right) == 250 and got == {(r[0][1:], r[0]) for r in right}


def test_blocks_are_compared_whole(monkeypatch):
    rng = np.random.default_rng(9)
    n = 3_000
    t = {"k": rng.integers(0, 4, n), "uid": np.arange(n), "side": rng.integers(0, 2, n), "pub": rng.integers(0, 3, n).astype(np.int32)}
    t |= {c: np.where(rng.random(n) < 0.5, 0, rng.integers(-(2**62), 2**62, n)) for c in ("food", "title")} | {"food2": np.zeros(n, dtype=np.int64)}
    tokens, starts, weights = rng.integers(0, 12, 5 * n), np.arange(0, 5 * n, 5), np.ones(linkage.BUCKETS, dtype=np.float32)
    tokens = np.concatenate([rng.choice(12, 5, replace=False) for _ in range(n)])
    i, j = (x.ravel() for x in np.meshgrid(np.flatnonzero(t["side"] == 0), np.flatnonzero(t["side"] == 1)))
    near = linkage._close(t, i, j) & (t["k"][i] == t["k"][j])
    sets = [set(tokens[5 * r : 5 * r + 5].tolist()) for r in range(n)]
    want = {(a, b) for a, b in zip(i[near].tolist(), j[near].tolist()) if len(sets[a] & sets[b]) >= linkage.LEAST_FOODS * len(sets[a] | sets[b])}
    for wide in (10, 1_000):
        monkeypatch.setattr(linkage, "WIDE", wide)
        got = list(zip(*(x.tolist() for x in linkage._block_pairs(t, tokens, starts, weights))))
        assert len(want) > 1_000 and len(got) == len(set(got)) and set(got) == want
    for left, right in ((5, 8), (6, 6), (7, 9)):  # a word of many records: in parts, of which any two meet once
        a, b = (linkage._blocks_of(side, uid, ["stew", "a", "b", "c"], [], {"stew": 3}) for side, uid in ((0, left), (1, right)))
        assert len(a) == 3 + 3 and len(set(a) & set(b)) == 1 + 3


def test_residue_model_is_fitted_to_all_rows(spark):
    rng = random.Random(3)
    texts = [rng.choice(NATURAL).replace("2", str(rng.randrange(9))) for _ in range(7_000)]
    rows = [(k, [x, None], f"{x}\n \n{texts[-k]}" if k % 3 else None) for k, x in enumerate(texts)] + [(9_000, ["Lorem ipsum dolor sit amet"], "")]
    lines = [x for _, a, t in rows for v in [*a, t] if v for x in v.split("\n") if x.strip()]
    df = spark.createDataFrame(rows, "row_ix long, ingredients array<string>, instructions string")
    whole, got = residue.train(lines), residue.fit(df.repartition(5), ["ingredients"], ["instructions"])
    assert all(np.array_equal(whole.tables[n], got.tables[n], equal_nan=True) for n in whole.tables)
    found = residue.residue(df, "row_ix", ["ingredients"], ["instructions"]).collect()
    assert [(r.row_ix, r.field) for r in found] == [(9_000, "ingredients")]
    assert residue.fit(df.limit(0), ["ingredients"], ["instructions"]).tables[1].shape == (256,)
