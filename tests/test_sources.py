import json

import pytest

from cookwright.sources import recipes as S


def write(path, data):
    path.write_text(data if isinstance(data, str) else json.dumps(data), encoding="utf-8")


def test_object_root_aliases_and_rejects(spark, tmp_path):
    write(tmp_path / "recipes_raw_nosource_ar.json", {"k1": {"title": "Soup &amp;amp; Bread", "ingredients": "1 egg\n- ADVERTISEMENT\n , salt -", "recipeInstructions": [{"text": "Mix."}, "Bake.", {"name": "Eat."}]}, "k2": {"title": "No ingredients"}, "k3": 5})
    got, report, print_ = S.load_recipes(spark, str(tmp_path))
    r = got.collect()[0]
    assert (r.name, r.ingredients, r.instructions, r.source, r.instruction_source) == ("Soup & Bread", ["1 egg", "salt"], "Mix.\nBake.\nEat.", None, "dataset")
    assert (report.records_seen, report.records_skipped, report.recipes_loaded) == (3, 2, 1) and len(print_) == 16


def test_id_and_source(spark, tmp_path):
    import hashlib

    write(tmp_path / "sample_recipes.json", [{"name": "A", "ingredients": ["x"]}, {"name": "B", "recipeIngredient": ["y"], "url": "https://www.site.example/b", "image": ["http://i"], "yield": 4}])
    rows = S.load_recipes(spark, str(tmp_path))[0].orderBy("row_ix").collect()
    assert [r.source for r in rows] == ["sample", "site.example"]
    assert rows[0].id == hashlib.sha1(b"sample_recipes.json:0:A").hexdigest()[:16]
    assert rows[1].image_url is None and rows[1].recipe_yield == "4"


def test_lines_keep_physical_numbers_and_broken_ones_do_not_stop(spark, tmp_path):
    import hashlib

    write(tmp_path / "a.jsonl", '\n{"name": "A", "ingredients": ["x"]}\nnot json\n{"name": "B", "ingredients": ["y"]}\n')
    got, report, _ = S.load_recipes(spark, str(tmp_path / "a.jsonl"))
    rows = got.orderBy("row_ix").collect()
    assert [r.name for r in rows] == ["A", "B"] and report.records_seen == 3 and report.warnings
    assert rows[1].id == hashlib.sha1(b"a.jsonl:3:B").hexdigest()[:16]


def test_files_take_turns(spark, tmp_path):
    for f in "ab":
        write(tmp_path / f"{f}.json", [{"name": f"{f}{k}", "ingredients": ["x"]} for k in range(4)])
    assert [r.name for r in S.load_recipes(spark, str(tmp_path), most=4)[0].orderBy("row_ix").collect()] == ["a0", "b0", "a1", "b1"]


def test_samples(spark, tmp_path):
    write(tmp_path / "a.jsonl", "\n".join(json.dumps({"name": f"n{k}", "ingredients": ["x"]}) for k in range(40)))
    names = lambda **x: [r.name for r in S.load_recipes(spark, str(tmp_path / "a.jsonl"), most=5, **x)[0].orderBy("row_ix").collect()]
    assert names() == names() and len(set(names())) == 5
    assert names(reservoir=True) == [f"n{k}" for k in S.reservoir_positions(40, 5)]


def test_errors(spark, tmp_path):
    with pytest.raises(S.DatasetError):
        S.resolve_files(str(tmp_path / "missing"))
    write(tmp_path / "x.json", "5")
    with pytest.raises(S.DatasetError):
        S.load_recipes(spark, str(tmp_path))
    write(tmp_path / "x.json", [{"name": "no lines"}])
    with pytest.raises(S.DatasetError):
        S.load_recipes(spark, str(tmp_path))


def test_instructions_are_required(spark, tmp_path):
    write(tmp_path / "x.json", [{"name": "A", "ingredients": ["x"]}])
    with pytest.raises(S.DatasetError):
        S.require_instructions(S.load_recipes(spark, str(tmp_path))[0])


def test_methods_and_sinks(spark, tmp_path):
    write(tmp_path / "recipes_raw_nosource_epi.json", {"a": {"title": "T", "ingredients": ["egg"], "instructions": "Mix. Bake.\nMix.\nBake."}, "b": {"title": "U", "ingredients": [], "instructions": "x"}})
    m = S.load_methods(spark, str(tmp_path)).collect()
    assert [(r.corpus, r.record_key, r.instructions) for r in m] == [("recipe_box_epicurious", "a", "Mix.\nBake.")]
    body = S.write_manifest(str(tmp_path / "m.json"), [str(tmp_path / "recipes_raw_nosource_epi.json")], {"linked": 1}, seed=1)
    assert json.loads((tmp_path / "m.json").read_text()) == body
    S.write_jsonl(spark.createDataFrame([("a", None)], "x string, y string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == '{"x":"a","y":null}'


def test_lines_of_split_files_are_numbered_in_order(spark, tmp_path):
    for f, n in (("a", 300), ("b c", 7)):
        write(tmp_path / f"{f}.jsonl", "".join(json.dumps({"name": f"{f}{k}", "ingredients": ["x" * 40]}) + ("\n\n" if k % 3 == 0 else "\n") for k in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        rows = S.raw_records(spark, S.resolve_files(str(tmp_path))).orderBy("file_no", "ordinal").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for f, n in (("a", 300), ("b c", 7)):
        mine = [r for r in rows if r.file == f"{f}.jsonl"]
        assert [json.loads(r.raw)["name"] for r in mine] == [f"{f}{k}" for k in range(n)] and [r.ordinal for r in mine] == list(range(n))
        assert [int(r.key) for r in mine] == [k + (k + 2) // 3 for k in range(n)]


def test_fingerprint_follows_bytes_and_names(spark, tmp_path):
    write(tmp_path / "a.json", "[1]")
    one = S.fingerprint(spark, [str(tmp_path / "a.json")])
    write(tmp_path / "a.json", "[2]")
    assert len(one) == 16 and one != S.fingerprint(spark, [str(tmp_path / "a.json")])


def test_readiness_and_coverage(spark):
    df = spark.createDataFrame([("a", "dataset"), (None, None), ("b", "dataset")], "instructions string, instruction_source string")
    assert tuple(S.readiness(df, True).first()) == ("ready", 3, 2, 0.6667, True, False) and S.readiness(df.limit(0), False).first().status == "empty"
    assert {tuple(r) for r in S.instruction_coverage(df).collect()} == {("dataset", 2, 0.6667), ("none", 1, 0.6667)}


def test_stored_tables_are_released(spark):
    from cookwright.plans import frames

    kept = frames.stored(spark.range(5))
    path = frames._STORED[-1][1].removeprefix("file:")
    assert kept.count() == 5 and __import__("os").path.isdir(path)
    before, frames._STORED[:] = frames._STORED[:-1], frames._STORED[-1:]
    frames.release()
    assert not __import__("os").path.isdir(path)
    frames._STORED[:] = before
