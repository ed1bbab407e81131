"""Reading recipe records from JSON of several shapes into the fixed schema, and writing results."""

from __future__ import annotations

import hashlib
import html
import json
import os
import random
from dataclasses import asdict, dataclass, field
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from cookwright.functions import text as T
from cookwright.plans.frames import cut, offsets, small, with_index

#: Seed of the samples of capped single files and of enriched output.
SEED = 20_260_902
COLUMNS = ["id", "name", "ingredients", "source", "url", "image_url", "prep_time", "cook_time", "recipe_yield", "description", "instructions", "instruction_source"]


class DatasetError(RuntimeError):
    """No usable data where some was expected."""


@dataclass
class LoadReport:
    files: int = 0
    records_seen: int = 0
    records_skipped: int = 0
    recipes_loaded: int = 0
    warnings: list[str] = field(default_factory=list)


def resolve_files(path: str) -> list[str]:
    """The file itself, or the folder's ``*.json*`` files by name; not recursive."""
    p = Path(path)
    if p.is_file():
        return [str(p)]
    if p.is_dir():
        return sorted(str(x) for x in p.glob("*.json*") if x.is_file())
    raise DatasetError(f"no such recipe data: {path}")


def fingerprint(spark: SparkSession, files: list[str]) -> str:
    """16 hex digits over the names and checksums of the files, in order. The files are read by tasks, one each."""
    digest = hashlib.sha256()
    sums = checksums(spark, files)
    for f in files:
        digest.update(f"{os.path.basename(f)}:{sums[_uri(f)]}".encode())
    return digest.hexdigest()[:16]


def checksums(spark: SparkSession, files: list[str]) -> dict[str, str]:
    """The SHA-256 of each file by its URI."""
    read = spark.read.format("binaryFile").load(list(map(_readable, files)))
    return {r[0]: r[1] for r in read.select(_path(F.col("_metadata.file_path")), F.sha2("content", 256)).collect()}  # one row for each file


def _readable(file: str) -> str:
    return file if "://" in file else os.path.abspath(file)


def _uri(file: str) -> str:
    """The file as a scan names it."""
    return file if "://" in file else Path(os.path.abspath(file)).as_uri()


def _path(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/(?=[^/])", "file:///")


def index_key(print_: str, rows: int, version: str, model: str | None) -> str:
    """The folder name of an index: what it was built from and with."""
    return f"{version}-{print_}-{rows}-{hashlib.sha256((model or 'no-semantic').encode()).hexdigest()[:10]}"


def raw_records(spark: SparkSession, files: list[str]) -> DataFrame:
    """``file, file_no, key, ordinal, raw, v``: every record as text and parsed, null where it is no JSON.

    Lines of ``.jsonl`` files are one record each, keyed by physical line, blank ones skipped; a broken line is kept
    with a null ``v`` instead of ending its file. Other files hold one object of records, keyed by its names, or one
    array, keyed by position. ``ordinal`` counts a file's records in order. All files of a kind are one scan: lines in
    splits of any size, other files whole, one task each, as a root cannot be split.
    """
    rows = [(_uri(f), os.path.basename(f), no) for no, f in enumerate(files)]
    names = small(spark.createDataFrame(rows, "path string, file string, file_no int"))
    lines, others = ([_readable(f) for f in files if f.endswith(".jsonl") == kind] for kind in (True, False))
    parts = []
    if lines:
        text = spark.read.text(lines).select(_path(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
        every = cut(text).withColumn("_m", F.monotonically_increasing_id())
        some = cut(every.where(F.trim("value") != "")).withColumn("_k", F.monotonically_increasing_id())
        for kept, at, name in ((every, "_m", "_line"), (some, "_k", "_ordinal")):
            some = some.join(small(offsets(kept, ["path"], "block", at, name)), ["path", "block"])
        parts.append(some.select("path", (F.col("_m") + F.col("_line")).cast("string").alias("key"), (F.col("_k") + F.col("_ordinal")).alias("ordinal"), F.col("value").alias("raw")))
    if others:
        whole = spark.read.text(others, wholetext=True).select(_path(F.col("_metadata.file_path")).alias("path"), "value")
        whole = whole.withColumn("root", F.substring(F.regexp_replace("value", "^[\\s\ufeff]+", ""), 1, 1))
        odd = whole.where(~F.col("root").isin("{", "[")).select("path").limit(1).collect()
        if odd:
            raise DatasetError(f"neither an object nor an array in {odd[0][0]}")
        keyed = whole.where("root = '{'").select("path", F.posexplode(F.from_json("value", "map<string,variant>")).alias("ordinal", "key", "v"))
        listed = whole.where("root = '['").select("path", F.posexplode(F.from_json("value", "array<variant>")).alias("ordinal", "v")).select("path", "ordinal", F.col("ordinal").cast("string").alias("key"), "v")
        parts.append(keyed.unionByName(listed).select("path", "key", F.col("ordinal").cast("long"), F.to_json("v").alias("raw")))
    return reduce(DataFrame.unionByName, parts).join(names, "path").select("file", "file_no", "key", "ordinal", "raw").withColumn("v", F.try_parse_json("raw"))


def _kind(v: Column, name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))


def scalar(v: Column, name: str) -> Column:
    """A field as text if it is a scalar that counts as given: not null, empty, zero or false."""
    kind, text = _kind(v, name), F.try_variant_get(v, f"$.{name}", "string")
    empty = (text == "") | ((kind != "STRING") & text.isin("0", "0.0", "false"))
    return F.when(~kind.startswith("ARRAY") & ~kind.startswith("OBJECT") & ~empty, text)


def _first(v: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*(scalar(v, n) for n in names))


def _lines(v: Column, names: tuple[str, ...], objects: bool) -> Column:
    """The lines of the first given field: a string by its line ends, an array by its elements (and their text or name)."""
    out = []
    for n in names:
        kind = _kind(v, n)
        items = F.try_variant_get(v, f"$.{n}", "array<variant>")
        plain = lambda x: F.when(~F.schema_of_variant(x).startswith("ARRAY") & ~F.schema_of_variant(x).startswith("OBJECT"), F.try_variant_get(x, "$", "string"))
        inner = lambda x: F.coalesce(F.nullif(F.try_variant_get(x, "$.text", "string"), F.lit("")), F.try_variant_get(x, "$.name", "string"))
        element = (lambda x: F.when(F.schema_of_variant(x).startswith("OBJECT"), inner(x)).otherwise(plain(x))) if objects else plain
        listed = F.filter(F.transform(items, element), lambda x: x.isNotNull())
        text = F.try_variant_get(v, f"$.{n}", "string")
        out.append(F.when(kind.startswith("ARRAY") & (F.size(items) > 0), listed).when((kind == "STRING") & (text != ""), F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")))
    return F.coalesce(*out)


@F.pandas_udf(ArrayType(StringType()))
def _unescaped_lines(s: pd.Series) -> pd.Series:
    return s.map(lambda a: None if a is None else [html.unescape(html.unescape(x)) if x and "&" in x else x for x in a])


def clean_method(lines: list[str]) -> str:
    """As :func:`cookwright.functions.text.clean_method`, over lines with entities."""
    return "\n".join(T.cleaned_lines([x for t in lines for x in html.unescape(html.unescape(t)).replace("ADVERTISEMENT", "").splitlines()]))


@F.pandas_udf(StringType())
def _method_text(s: pd.Series) -> pd.Series:
    return s.map(lambda a: "" if a is None else clean_method([x for x in a if x is not None]))


def _clean_lines(lines: Column, strip: str | None) -> Column:
    less = F.transform(_unescaped_lines(lines), lambda x: F.replace(x, F.lit("ADVERTISEMENT"), F.lit("")))
    trimmed = F.transform(less, (lambda x: F.btrim(x, F.lit(strip))) if strip else (lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")))
    return F.filter(trimmed, lambda x: x != "")


def to_recipes(records: DataFrame) -> DataFrame:
    """Records in the fixed schema; those without a name or ingredients are left out.

    Every field is the first of its aliases that is given. Nested values where text is expected count as not given.
    """
    v = F.col("v")
    text = lambda *names: T.blank_to_null(T.unescape(_first(v, names)))
    picked = records.select(
        "file", "file_no", "key", "ordinal",
        text("name", "title").alias("name"),
        _clean_lines(_lines(v, ("ingredients", "recipeIngredient", "ingredient_lines"), False), " \t,-").alias("ingredients"),
        T.canonical_url(T.safe_url(text("url", "source_url", "link"))).alias("url"),
        T.safe_url(text("image", "image_url", "picture_link")).alias("image_url"),
        F.nullif(F.array_join(_clean_lines(_lines(v, ("instructions", "recipeInstructions", "method"), True), None), "\n"), F.lit("")).alias("instructions"),
        text("instructionSource").alias("said"),
        text("source").alias("explicit"),
        text("prepTime", "prep_time").alias("prep_time"), text("cookTime", "cook_time").alias("cook_time"), text("recipeYield", "yield").alias("recipe_yield"),
        T.unquote(text("description")).alias("description"),
    ).where(F.col("name").isNotNull() & (F.size("ingredients") > 0))
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    by_file = F.when(stem.startswith("recipes_raw_nosource"), None).when(stem == "sample_recipes", "sample").otherwise(stem)
    source = F.coalesce(F.col("explicit"), F.when(F.col("url").isNotNull(), T.host_of(F.col("url"))), by_file)
    ident = F.substring(F.sha1(F.concat_ws(":", "file", "key", "name")), 1, 16)
    given = F.when(F.col("said").isin("dataset", "matched_corpus"), F.col("said")).otherwise("dataset")
    out = picked.withColumn("source", source).withColumn("id", ident).withColumn("instruction_source", F.when(F.col("instructions").isNotNull(), given))
    return out.select("file_no", "ordinal", *COLUMNS)


def interleaved(recipes: DataFrame) -> DataFrame:
    """The recipes of several files in turn, a record of each; exhausted files drop out."""
    return recipes.orderBy("ordinal", "file_no")


def hash_sample(recipes: DataFrame, n: int, seed: int = SEED, ident: str = "id") -> DataFrame:
    """The ``n`` records with the smallest md5 of seed and id: the same ones however the data is partitioned."""
    return recipes.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(ident))), ident).limit(n)


def reservoir_positions(valid: int, n: int, seed: int = SEED) -> list[int]:
    """Which valid records a reservoir of size ``n`` over ``valid`` of them ends with, slot by slot."""
    slots, rng = list(range(min(n, valid))), random.Random(seed)
    for seen in range(n + 1, valid + 1):
        at = rng.randrange(seen)
        if at < n:
            slots[at] = seen - 1
    return slots


def load_recipes(spark: SparkSession, path: str, most: int | None = None, reservoir: bool = False) -> tuple[DataFrame, LoadReport, str]:
    """All recipes of a file or folder with a contiguous ``row_ix``, a report, and the data's fingerprint.

    With a cap, several files give their first records in turn, a single file a sample: by hash, or (``reservoir``)
    exactly what sequential reservoir sampling would keep. Raises where nothing is usable.
    """
    files = resolve_files(path)
    if not files:
        raise DatasetError(f"no JSON files in {path}")
    records = cut(raw_records(spark, files))
    seen, broken = records.agg(F.count("*"), F.count_if(F.col("v").isNull())).first()
    recipes = with_index(interleaved(to_recipes(records)), "row_ix")
    valid = recipes.count()
    if not valid:
        raise DatasetError("no usable recipe in the data")
    report = LoadReport(len(files), seen, seen - valid, valid, [f"{broken} records are no JSON"] if broken else [])
    if most is not None and most < valid:
        if len(files) > 1:
            recipes = recipes.where(F.col("row_ix") < most)
        elif reservoir:
            slots = spark.createDataFrame(list(enumerate(reservoir_positions(valid, most))), "slot long, row_ix long")
            recipes = recipes.join(F.broadcast(slots), "row_ix").drop("row_ix").withColumnRenamed("slot", "row_ix")
        else:
            recipes = with_index(hash_sample(recipes, most).drop("row_ix"), "row_ix")
        report.recipes_loaded = most
    return recipes.select("row_ix", *COLUMNS), report, fingerprint(spark, files)


def instruction_coverage(recipes: DataFrame) -> DataFrame:
    """``origin, recipes, share``: by origin of the instructions the recipes, and the share of all that have any."""
    whole = recipes.agg(F.bround(F.avg(F.col("instructions").isNotNull().cast("double")), 4).alias("share"))
    return recipes.groupBy(F.coalesce("instruction_source", F.lit("none")).alias("origin")).agg(F.count("*").alias("recipes")).crossJoin(F.broadcast(whole))


def readiness(recipes: DataFrame, semantic: bool, model_ready: bool = False) -> DataFrame:
    """One row on whether searches can be answered: ``status, recipes, with_instructions, coverage, semantic, model``."""
    n, some = F.count("*"), F.count("instructions")
    share = F.bround(F.coalesce(F.try_divide(some, n), F.lit(0.0)), 4)
    return recipes.agg(F.when(n > 0, "ready").otherwise("empty").alias("status"), n.alias("recipes"), some.alias("with_instructions"), share.alias("coverage"), F.lit(semantic).alias("semantic"), F.lit(model_ready).alias("model"))


def require_instructions(recipes: DataFrame) -> DataFrame:
    """The recipes, if all have instructions; else an error with the number that lacks them."""
    lacking = recipes.where(F.col("instructions").isNull()).count()
    if lacking:
        raise DatasetError(f"{lacking} recipes have no instructions")
    return recipes


def corpus_of(file_name: Column) -> Column:
    """The corpus that a method file belongs to, by the end of its name."""
    return F.when(file_name.endswith("_ar.json"), "recipe_box_allrecipes").when(file_name.endswith("_epi.json"), "recipe_box_epicurious").otherwise(F.concat(F.lit("recipe_box_"), F.regexp_replace(file_name, r"\.[^.]*$", "")))


def load_methods(spark: SparkSession, folder: str) -> DataFrame:
    """``corpus, record_key, ordinal, title, ingredients, instructions`` of a folder of method files."""
    files = sorted(str(x) for x in Path(folder).glob("recipes_raw_nosource_*.json"))
    if not files:
        raise DatasetError(f"no method files in {folder}")
    r, v = raw_records(spark, files), F.col("v")
    out = r.select(
        corpus_of(F.col("file")).alias("corpus"), F.col("key").alias("record_key"), (F.col("file_no") * F.lit(1 << 40) + F.col("ordinal")).alias("ordinal"),
        T.blank_to_null(T.unescape(_first(v, ("title", "name")))).alias("title"), _clean_lines(_lines(v, ("ingredients",), False), " \t,-").alias("ingredients"), _method_text(_lines(v, ("instructions",), True)).alias("instructions"),
    )
    return out.where(F.col("title").isNotNull() & (F.size("ingredients") > 0) & (F.col("instructions") != ""))


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls included; the commit protocol publishes all files or none."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_manifest(path: str, inputs: list[str], report: object, **more: object) -> dict:
    """A manifest with checksums of the inputs, read by tasks, written beside its place and renamed into it."""
    known = checksums(SparkSession.active(), inputs)
    sums = {os.path.basename(f): known[_uri(f)] for f in inputs}
    body = {"inputs": sums, "report": report if isinstance(report, dict) else asdict(report), **more}
    Path(f"{path}.tmp").write_text(json.dumps(body, sort_keys=True, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    os.replace(f"{path}.tmp", path)
    return body
