"""Strict record linkage: recipes to methods by title, source family and two-way coverage of ingredient terms."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cookwright.operators.index import term_batches
from cookwright.plans.frames import spread

MATCHER = "strict-title-source-coverage"
# Which publishers a method corpus may serve.
COMPATIBLE = [("recipe_box_allrecipes", "allrecipes"), ("recipe_box_epicurious", "epicurious"), ("recipe_box_epicurious", "bonappetit")]


def strict_matches(recipes: DataFrame, methods: DataFrame, compatible: DataFrame | None = None, least: float = 0.9, any_source: bool = False) -> DataFrame:
    """``row_ix, corpus, record_key, instructions, score``: the one method of each recipe that surely belongs to it.

    ``recipes`` has ``row_ix, name, ingredients, source``; ``methods`` has ``corpus, record_key, ordinal, title,
    ingredients, instructions``; ``compatible`` has ``corpus, source``. Titles have to be equal when normalised, and
    the smaller share of common terms at least ``least``. A recipe with more than one distinct method above it gets
    none. Among equals the larger mean share, then the earlier method wins. ``any_source`` leaves the source out. Records without any term take no part.
    """
    spark = recipes.sparkSession
    allowed = compatible if compatible is not None else spark.createDataFrame(COMPATIBLE, "corpus string, source string")
    r = _with_terms(recipes, "row_ix", "name", ["source"]).withColumnRenamed("terms", "r_terms")
    m = _with_terms(methods.where("instructions <> ''"), "record_key", "title", ["corpus", "ordinal", "instructions"]).withColumnRenamed("terms", "m_terms")
    pairs = r.join(m, "title_norm") if any_source else r.join(F.broadcast(allowed.dropDuplicates()), "source").join(m, ["title_norm", "corpus"])
    shared = F.size(F.array_intersect("r_terms", "m_terms"))
    scored = pairs.select("row_ix", "corpus", "record_key", "ordinal", "instructions", (shared / F.size("r_terms")).alias("x"), (shared / F.size("m_terms")).alias("y"))
    passing = scored.select("*", F.least("x", "y").alias("score"), ((F.col("x") + F.col("y")) / 2).alias("mean")).where(F.col("score") >= least)
    best = passing.groupBy("row_ix").agg(F.min("instructions").alias("one"), F.max("instructions").alias("other"), F.min_by(F.struct("corpus", "record_key", "instructions", "score"), F.struct(-F.col("score"), -F.col("mean"), "ordinal", "record_key")).alias("b"))
    return best.where("one = other").select("row_ix", "b.corpus", "b.record_key", "b.instructions", F.round("b.score", 6).alias("score"))


def _with_terms(df: DataFrame, ident: str, title: str, more: list[str]) -> DataFrame:
    """``ident, title_norm, terms`` and the columns ``more``; rows without a title or terms are left out.

    What has to stay with a row goes through the Arrow pass beside its name, as it is.
    """
    kept = [ident, *more]
    cols = spread(df.where(F.col(title).isNotNull()).select(*kept, F.col(title).alias("_name"), F.col("ingredients").alias("_lines")))
    kinds = ", ".join(f"`{c}` {k}" for c, k in cols.select(*kept).dtypes)
    return cols.mapInArrow(_terms_beside(kept), f"{kinds}, title_norm string, terms array<string>").where("size(terms) > 0")


def _terms_beside(kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            plain = pa.RecordBatch.from_arrays([pa.array(range(b.num_rows), pa.int64()), b.column("_name"), b.column("_lines")], names=["row_ix", "name", "ingredients"])
            for t in term_batches(iter([plain])):
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), t.column("name_norm"), t.column("terms")], names=[*kept, "title_norm", "terms"])

    return run


def enriched(recipes: DataFrame, matches: DataFrame) -> DataFrame:
    """The linked recipes in the shape of the enriched file, one row each."""
    m = matches.select("row_ix", "corpus", "record_key", F.col("instructions").alias("method"), "score")
    return recipes.join(m, "row_ix").select(
        "name", "ingredients", "source", "url", F.col("image_url").alias("image"), F.col("prep_time").alias("prepTime"), F.col("cook_time").alias("cookTime"), F.col("recipe_yield").alias("recipeYield"), "description",
        F.col("method").alias("recipeInstructions"), F.lit("matched_corpus").alias("instructionSource"), F.col("corpus").alias("instructionCorpus"), F.col("record_key").alias("instructionRecord"), F.col("id").alias("assignmentRecord"),
        F.lit(MATCHER).alias("instructionMatcher"), F.bround("score", 6).alias("instructionMatchScore"),
    )


def enrichment_report(recipes: DataFrame, methods: DataFrame, matches: DataFrame) -> DataFrame:
    """One row of counts: recipes and methods seen, recipes linked, and linked by corpus."""
    by = matches.groupBy("corpus").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("corpus", "count")))).alias("by_corpus"), F.coalesce(F.sum("count"), F.lit(0)).alias("linked"))
    return recipes.agg(F.count("*").alias("recipes_seen")).crossJoin(methods.agg(F.count("*").alias("methods_seen"))).crossJoin(by)


def sampled(rows: DataFrame, n: int, ident: str, seed: int) -> DataFrame:
    """Exactly ``n`` rows in the order of a hash of seed and id; an error if there are fewer."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(ident).cast("string")))
    have = rows.count()
    if have < n:
        raise ValueError(f"{n} rows are wanted, there are {have}")
    return rows.orderBy(key, ident).limit(n)


def first_of_each(rows: DataFrame, by: str, order: list) -> DataFrame:
    """The first row of each value of ``by``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("_n = 1").drop("_n")
