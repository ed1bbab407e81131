"""The registered queries of the core and, where SQL can express them, their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cookwright import catalog_sql
from cookwright.functions import text as T
from cookwright.functions.query_text import from_ingredients, interpret
from cookwright.operators import index as I
from cookwright.operators import linkage, present, rank
from cookwright.operators.evaluate import aggregates, evaluate
from cookwright.operators.quantities import quantities
from cookwright.plans.frames import shared_dir, stored, table
from cookwright.sources import recipes as sources
from cookwright.sources.recipes import hash_sample
from cookwright.streaming.limiter import limited
from cookwright.streaming.requests import read_requests

ASKED = catalog_sql.ASKED
TEXT = catalog_sql.TEXT


def _recipes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sample_recipes")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return quantities(_recipes(spark, d), table(spark, d, "unit_factors"))


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return _recipes(spark, d).select("row_ix", T.normalize(F.col("name")).alias("name_norm"))


def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    url = T.canonical_url(T.safe_url(F.col("url")))
    return _recipes(spark, d).select("row_ix", url.alias("url"), T.host_of(url).alias("host"))


def durations(spark: SparkSession, d: str) -> DataFrame:
    p, c = F.col("prep_time"), F.col("cook_time")
    return _recipes(spark, d).select("row_ix", T.minutes(p).alias("prep_minutes"), T.minutes(c).alias("cook_minutes"), T.total_minutes(p, c).alias("total_minutes"))


def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return _recipes(spark, d).groupBy(T.category(F.col("name")).alias("category")).agg(F.count("*").alias("n"))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return I.term_table(_recipes(spark, d))


def postings(spark: SparkSession, d: str) -> DataFrame:
    return I.postings(_terms(spark, d))


def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return I.document_frequency(I.postings(_terms(spark, d)))


def distinctiveness(spark: SparkSession, d: str) -> DataFrame:
    return I.distinctiveness(_terms(spark, d)).select("row_ix", F.round("distinctiveness", 6).alias("distinctiveness"))


def ingredient_topk(spark: SparkSession, d: str) -> DataFrame:
    """Explicit-ingredient search: the ten best recipes, one for each title, by the postings of the wanted terms."""
    found = rank.postings_scores(I.postings(_terms(spark, d), "n_terms", "name_norm"), {1: ASKED}, "name_norm")
    top = rank.standard_top(found.withColumn("limit", F.lit(10)).withColumnRenamed("ingredient", "final"))
    return top.select("row_ix", "name_norm", F.round("final", 6).alias("score"), "rank")


def exclusions(spark: SparkSession, d: str) -> DataFrame:
    """The recipes left when some ingredients, and spicy dishes, are ruled out."""
    out = rank.excluded(F.col("terms"), F.col("name_norm"), F.array(F.lit("garlic clove"), F.lit("salmon")), F.lit(True))
    return _terms(spark, d).where(~out).select("row_ix")


def lexical_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten texts nearest to a request by character TF-IDF."""
    t = stored(_terms(spark, d).select("row_ix", "text"))
    model = I.lexical_model(I.lexical_vocabulary(t))
    scored = I.lexical_scores(I.document_vectors(t, model), model, [(1, TEXT)])
    return scored.select("row_ix", F.round("lexical", 6).alias("lexical")).orderBy(F.desc("lexical"), "row_ix").limit(10)


def lexical_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """The grams that the lexical index keeps."""
    return I.lexical_vocabulary(stored(_terms(spark, d).select("text"))).select("gram", "df", "total", F.round("idf", 6).alias("idf"))


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten vectors nearest to the first one, by an exact scan."""
    v = given_vectors(spark, d).withColumnRenamed("vec", "v")
    first = v.orderBy("row_ix").limit(1).select(F.col("row_ix").alias("asked"), F.col("v").alias("q"))
    near = v.crossJoin(F.broadcast(first)).where("row_ix <> asked").select("row_ix", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), I.dot(F.col("v"), F.col("q")))), 5).alias("cosine"))
    return near.orderBy(F.desc("cosine"), "row_ix").limit(10)


def distinct_titles_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 20 most distinctive recipes, one for each title."""
    t = stored(_terms(spark, d).select("row_ix", "name_norm", "terms"))
    scored = t.select("row_ix", "name_norm").join(I.distinctiveness(t), "row_ix").select("row_ix", "name_norm", F.round("distinctiveness", 6).alias("final"), F.lit(1).alias("request_id"), F.lit(20).alias("limit"))
    return rank.standard_top(scored).select("row_ix", "rank")


def strict_linkage(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "method_corpus").select(F.coalesce("corpus", F.lit("")).alias("corpus"), "record_key", F.col("record_key").alias("ordinal"), "title", "ingredients", F.col("instructions"))
    return linkage.strict_matches(_recipes(spark, d), m, any_source=True, least=0.5).select("row_ix", "record_key", "score")


def hashed_sample(spark: SparkSession, d: str) -> DataFrame:
    return hash_sample(_recipes(spark, d).select("row_ix", "id"), 100, ident="row_ix")


def round_robin(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 method records when the corpora take turns."""
    m = table(spark, d, "method_corpus").where("corpus is not null").select("corpus", "record_key")
    n = m.withColumn("ordinal", F.row_number().over(Window.partitionBy("corpus").orderBy("record_key"))).withColumn("file_no", F.col("corpus"))
    return sources.interleaved(n).limit(200).select("corpus", "record_key", F.col("ordinal").alias("turn"))


def ingested(spark: SparkSession, d: str) -> DataFrame:
    """The delivered records as lines of JSON under other field names, read into the fixed schema."""
    r = _recipes(spark, d)
    line = F.to_json(F.struct(F.col("name").alias("title"), F.col("ingredients").alias("recipeIngredient"), F.col("url").alias("source_url"), "source", F.col("prep_time").alias("prepTime"), F.col("recipe_yield").alias("yield"), F.col("instructions").alias("method")))
    records = r.select(F.lit("delivered.jsonl").alias("file"), F.lit(0).alias("file_no"), F.col("row_ix").cast("string").alias("key"), F.col("row_ix").alias("ordinal"), line.alias("raw"))
    out = sources.to_recipes(records.withColumn("v", F.try_parse_json("raw")))
    return out.select(F.col("ordinal").alias("row_ix"), "id", "name", F.size("ingredients").alias("lines"), F.md5(F.array_join("ingredients", "|")).alias("lines_md5"), "source", "url", "prep_time", "recipe_yield", "instruction_source")


def json_fields(spark: SparkSession, d: str) -> DataFrame:
    """A field of raw JSON by event type, as ingestion reads it: absent, null, empty and zero values are not given."""
    v = sources.scalar(F.try_parse_json("props"), "k").try_cast("bigint")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.count(v).alias("with_k"), F.sum(v).alias("sum_k"))


def coverage(spark: SparkSession, d: str) -> DataFrame:
    return sources.instruction_coverage(_recipes(spark, d))


def readiness(spark: SparkSession, d: str) -> DataFrame:
    return sources.readiness(_recipes(spark, d), semantic=True)


def _methods(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "method_corpus").select(F.coalesce("corpus", F.lit("")).alias("corpus"), "record_key", F.col("record_key").alias("ordinal"), "title", "ingredients", "instructions", F.col("credit").alias("source"))


def source_linkage(spark: SparkSession, d: str) -> DataFrame:
    """Strict linkage at the usual threshold, where the method's corpus credits the recipe's publisher by its very name."""
    m = _methods(spark, d)
    credited = m.where("corpus <> '' and source is not null").select("corpus", "source").distinct()
    return linkage.strict_matches(_recipes(spark, d), m.drop("source"), credited, least=0.9).select("row_ix", "record_key", "score")


def enriched_records(spark: SparkSession, d: str) -> DataFrame:
    """The recipes linked by title and half of the terms, in the shape of the enriched file."""
    r = _recipes(spark, d)
    rows = linkage.enriched(r, linkage.strict_matches(r, _methods(spark, d).drop("source"), any_source=True, least=0.5))
    return rows.select("assignmentRecord", "name", "url", "recipeInstructions", "instructionCorpus", "instructionRecord", "instructionMatcher", "instructionMatchScore")


def enrichment_counts(spark: SparkSession, d: str) -> DataFrame:
    r, m = _recipes(spark, d), _methods(spark, d).drop("source")
    report = linkage.enrichment_report(r, m, linkage.strict_matches(r, m, any_source=True, least=0.5))
    by = F.array_join(F.transform(F.map_entries("by_corpus"), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), ", ")
    return report.select("recipes_seen", "methods_seen", "linked", by.alias("by_corpus"))


def saved_index_search(spark: SparkSession, d: str) -> DataFrame:
    """The first requests of the batch by an index that was saved and loaded again."""
    index, asked = _batch(spark, d)
    folder = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    index.save(folder)
    return _shown(rank.search(I.RecipeIndex.load(spark, folder, I.HashEmbedding()), asked[:3]))


def facts(spark: SparkSession, d: str) -> DataFrame:
    return _recipes(spark, d).select("row_ix", present.facts(F.col("prep_time"), F.col("cook_time"), F.col("recipe_yield"), F.col("ingredients")).alias("facts"), present.source_label(F.col("source")).alias("source_label"))


def summaries(spark: SparkSession, d: str) -> DataFrame:
    return _recipes(spark, d).select("row_ix", present.summary(F.col("name"), F.col("ingredients"), T.unquote(T.unescape(F.col("description")))).alias("summary"))


def steps(spark: SparkSession, d: str) -> DataFrame:
    return _recipes(spark, d).select("row_ix", F.posexplode(present.steps(T.clean_method(F.col("instructions")))).alias("step_no", "step"))


def marked_steps(spark: SparkSession, d: str) -> DataFrame:
    return _recipes(spark, d).select("row_ix", present.format_html(F.col("instructions"), False).alias("html"))


def _index(spark: SparkSession, d: str) -> I.RecipeIndex:
    return I.RecipeIndex.build(_recipes(spark, d), I.HashEmbedding())


def given_vectors(spark: SparkSession, d: str) -> DataFrame:
    """``row_ix, vec``: the delivered vectors at unit length, one a row; of unlike vectors of a row the least."""
    v = table(spark, d, "recipe_vectors").where(I.usable(F.col("vec"), 64) & F.exists("vec", lambda x: x != 0))
    return v.groupBy("row_ix").agg(F.min("vec").alias("vec")).select("row_ix", I.l2_normalize(F.col("vec")).alias("vec"))


def _batch(spark: SparkSession, d: str) -> tuple[I.RecipeIndex, list[rank.Request]]:
    index = I.RecipeIndex.build(_recipes(spark, d), I.HashEmbedding(), vectors=given_vectors(spark, d))
    return index, [rank.Request(*b) for b in catalog_sql.BATCH]


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """A batch of requests of every strategy and mode against all recipes, whose vectors are the delivered ones."""
    index, asked = _batch(spark, d)
    return _shown(rank.search(index, asked))


def _shown(results: DataFrame) -> DataFrame:
    return results.select("request_id", "rank", "row_ix", "strategy", *(F.round(c, 6).alias(c) for c in ("final", "semantic", "lexical", "ingredient", "distinctiveness")), F.array_join("matched", ", ").alias("matched"), "reason", "low_signal")


def search_metadata(spark: SparkSession, d: str) -> DataFrame:
    """What is said about the results of the same batch: strategy, numbers, confidence, warnings, notice."""
    index, asked = _batch(spark, d)
    meta = rank.metadata(index, asked, rank.search(index, asked))
    return meta.join(rank.notices(meta), "request_id").select("request_id", "mode", "query", "kind", "intent", "strategy", "total_recipes", "returned", "confidence", "semantic_available", "semantic_degraded", "retrieval_warning", "notice")


def _requests(spark: SparkSession, d: str):
    return read_requests(table(spark, d, "search_requests").where("request_id % 100 = 0"))


def search_responses(spark: SparkSession, d: str) -> DataFrame:
    """Every request of the table whose id is divisible by 100, against all recipes, with the recipes themselves."""
    index = _index(spark, d)
    return rank.responses(index, rank.search(index, _requests(spark, d)))


def discovery(spark: SparkSession, d: str) -> DataFrame:
    """Varied ideas for a request without any constraint."""
    return _shown(rank.search(_index(spark, d), [rank.Request(*b) for b in _ONE]))


def retrieval_quality(spark: SparkSession, d: str) -> DataFrame:
    """Hit@5, MRR and violated exclusions over all evaluation cases."""
    cases = table(spark, d, "eval_cases")
    return aggregates(evaluate(_index(spark, d), cases), cases)


def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return limited(table(spark, d, "events"), "event_id", "user_id", "ts")


def entry(spark: SparkSession, d: str) -> DataFrame:
    return ingredient_topk(spark, d)


assert from_ingredients(ASKED).ingredients == ASKED, "the SQL of ingredient_topk is written for these terms"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p6_found, normalize_text, canonical_urls, durations, category_counts, postings, document_frequency, distinctiveness, ingredient_topk, exclusions, lexical_topk, lexical_vocabulary,
        cosine_topk, distinct_titles_topk, strict_linkage, hashed_sample, round_robin, ingested, json_fields, coverage, readiness, source_linkage, enriched_records, enrichment_counts, saved_index_search, facts, summaries, steps, marked_steps, hybrid_search, search_responses,
        search_metadata, discovery, retrieval_quality, rate_limit,
    )
}
_ASKED_VECTORS = I.HashEmbedding().encode([q.semantic_text for _, q, _, _ in catalog_sql.BATCH]).tolist()
_ONE = [(1, interpret("surprise me"), "hybrid", 20)]
SQL: dict[str, str] = {
    **catalog_sql.SQL,
    "hybrid_search": catalog_sql.hybrid_search(catalog_sql.BATCH, _ASKED_VECTORS),
    "search_metadata": catalog_sql.search_metadata(catalog_sql.BATCH, _ASKED_VECTORS, rank.DISCOVERED, rank.ADVENTURE, rank.BROAD, rank.CLOSEST),
    "saved_index_search": catalog_sql.hybrid_search(catalog_sql.BATCH[:3], _ASKED_VECTORS[:3]),
    "discovery": catalog_sql.hybrid_search(_ONE, _ASKED_VECTORS[:1]),
}
