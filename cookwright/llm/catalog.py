"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cookwright.llm import leakage, linkage, mixing, mojibake, neighbours, ranking, residue, setjoin, stuffing
from cookwright.plans.frames import table


SCORES = ["semantic", "lexical", "ingredient", "distinctiveness"]


def p1_fused(spark: SparkSession, d: str) -> DataFrame:
    fused = ranking.fused_scores(table(spark, d, "score_breakdown"), "request_id", "row_ix", SCORES, missing=-1)
    return fused.select("request_id", "row_ix", F.round("fused", 6).alias("fused"), "used")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    fused = ranking.fused_scores(table(spark, d, "score_breakdown"), "request_id", "row_ix", SCORES, missing=-1)
    return ranking.best_of_each(fused, "request_id", "row_ix")


def p2_residue(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "sample_recipes"), "row_ix", ["ingredients"], ["instructions"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_residue(spark, d).select("row_ix", "field").distinct()


def p3_matches(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "sample_recipes").select(F.col("row_ix").alias("key"), F.col("name").alias("title"), F.col("ingredients").alias("lines"), linkage.stated(F.col("source"), F.col("url")).alias("publisher"), F.col("id").alias("entity"))
    right = table(spark, d, "method_corpus").select(F.col("record_key").alias("key"), "title", F.col("ingredients").alias("lines"), F.col("credit").alias("publisher"), F.lit(None).cast("string").alias("entity"))
    return linkage.match(left, right).select(F.col("left").cast("long").alias("row_ix"), F.col("right").alias("record_key"), "confidence")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_matches(spark, d).select("row_ix", "record_key")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = setjoin.similar_rows(table(spark, d, "sample_recipes"), "row_ix", "ingredients")
    return pairs.select(pairs.a.alias("row_ix_a"), pairs.b.alias("row_ix_b"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """For every row with a set of five lines or more: its class of equal sets and the classes similar to it."""
    found = setjoin.linked_classes(table(spark, d, "sample_recipes"), "row_ix", "ingredients")
    return found.select(F.col("row").alias("row_ix"), F.col("rep").alias("class_id"), "size", "rows", "links")


def _p7(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(table(spark, d, "sample_recipes"), "row_ix", ["name", "description"], ["ingredients"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d).select("row_ix", "field").distinct()


def p7_restored(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d)


def _p8(spark: SparkSession, d: str, errors: int) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_cases"), "item_id", "passage", errors=errors)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _p8(spark, d, 0).select("doc_id", "item_id")


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    return _p8(spark, d, 2)


def p10_pages(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, d, "documents"), "doc_id", "text", "url", "source")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_pages(spark, d).where("stuffed").select("doc_id")


def _p9(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    counts = mixing.token_counts(table(spark, d, "documents"), "doc_id", mixing.source_name(F.col("source")), "text")
    return mixing.mix(counts, table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _p9(spark, d)[0].withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _p9(spark, d)[1]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neighbours.similar_rows(table(spark, d, "recipe_vectors"), "row_ix", "vec", 0.9)
    return pairs.select(F.col("a").alias("row_ix_a"), F.col("b").alias("row_ix_b"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """For every row with a usable vector: the class of rows with the very same vector."""
    found = neighbours.classes(table(spark, d, "recipe_vectors"), "row_ix", "vec", 64)
    return found.select(F.col("row").alias("row_ix"), F.col("rep").alias("class_id"), "rows")


def p5_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest distinct vectors of every row whose row_ix is divisible by 100, over all shards."""
    near, members = neighbours.nearest(table(spark, d, "recipe_vectors"), "row_ix", "vec", k=5, ask=F.col("row") % 100 == 0, probes=None, shard_rows=20_000)
    mine = members.where(F.col("row") % 100 == 0).select(F.col("row").alias("row_ix"), F.col("rep").alias("row")).distinct()
    return near.join(mine, "row").select("row_ix", F.col("near").alias("near_row_ix"), F.round("similarity", 4).alias("similarity"), "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_fused": p1_fused,
    "p2_found": p2_found,
    "p2_residue": p2_residue,
    "p3_found": p3_found,
    "p3_matches": p3_matches,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p4_classes": p4_classes,
    "p5_classes": p5_classes,
    "p5_nearest": p5_nearest,
    "p7_found": p7_found,
    "p7_restored": p7_restored,
    "p8_found": p8_found,
    "p8_near": p8_near,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_pages": p10_pages,
}
SQL: dict[str, str] = {}

SQL["p4_found"] = """
WITH s AS (
  SELECT row_ix, list_distinct(list_filter(list_transform(ingredients, lambda x: regexp_replace(trim(lower(x)), ' +', ' ', 'g')), lambda x: x <> '')) AS t
  FROM sample_recipes WHERE ingredients IS NOT NULL
), t AS (SELECT row_ix, len(t) AS n, unnest(t) AS x FROM s WHERE len(t) >= 5)
SELECT a.row_ix AS row_ix_a, b.row_ix AS row_ix_b
FROM t a JOIN t b ON a.x = b.x AND a.row_ix < b.row_ix
GROUP BY a.row_ix, b.row_ix
HAVING count(*) * 100 >= (min(a.n) + min(b.n) - count(*)) * 60
"""

SQL["p4_classes"] = """
WITH s AS (
  SELECT row_ix, list_sort(list_distinct(list_filter(list_transform(ingredients, lambda x: regexp_replace(trim(lower(x)), ' +', ' ', 'g')), lambda x: x <> ''))) AS t
  FROM sample_recipes WHERE ingredients IS NOT NULL
), c AS (SELECT row_ix, t, min(row_ix) OVER (PARTITION BY t) AS class_id, count(*) OVER (PARTITION BY t) AS rows FROM s WHERE len(t) >= 5),
u AS (SELECT class_id, len(t) AS n, unnest(t) AS x FROM c WHERE row_ix = class_id),
p AS (
  SELECT a.class_id AS a, b.class_id AS b FROM u a JOIN u b ON a.x = b.x AND a.class_id < b.class_id
  GROUP BY a.class_id, b.class_id HAVING count(*) * 100 >= (min(a.n) + min(b.n) - count(*)) * 60
), k AS (SELECT class_id, count(*) AS links FROM (SELECT a AS class_id FROM p UNION ALL SELECT b FROM p) GROUP BY class_id)
SELECT row_ix, class_id, len(t) AS size, rows, coalesce(links, 0) AS links FROM c LEFT JOIN k USING (class_id)
"""

SQL["p8_found"] = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(passage), '[\\p{L}\\p{N}]+') AS w FROM eval_cases WHERE passage IS NOT NULL),
dg AS (SELECT doc_id, hash(w[k:k+12]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d)),
ig AS (SELECT DISTINCT item_id, hash(w[k:k+12]) AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""

_FUSED = """
WITH c AS (
  SELECT request_id, row_ix, {computed}
  FROM score_breakdown WHERE request_id IS NOT NULL AND row_ix IS NOT NULL GROUP BY request_id, row_ix
), m AS (SELECT request_id, {medians} FROM c GROUP BY request_id),
o AS (SELECT c.request_id, row_ix, {offsets} FROM c JOIN m USING (request_id)),
s AS (SELECT request_id, {spreads} FROM o GROUP BY request_id),
z AS (SELECT request_id, row_ix, {values} FROM o JOIN s USING (request_id)),
f AS (SELECT request_id, row_ix, exp(({sums}) / ({used})) AS fused, {used} AS used FROM z WHERE {used} > 0)
"""
_each = lambda t, sep=", ": sep.join(t.replace("$", s) for s in SCORES)
_FUSED = _FUSED.format(
    computed=_each("max(CASE WHEN CAST($ AS VARCHAR) NOT IN ('nan', '-nan', 'inf', '-inf') AND $ <> -1 THEN $ END) AS $"),
    medians=_each("quantile_disc($, 0.5) AS m_$"),
    offsets=_each("$ - m_$ AS $"),
    spreads=_each("quantile_disc(abs($), 0.5) AS d_$, avg(abs($)) AS a_$"),
    values=_each(
        "CASE WHEN $ IS NULL THEN NULL WHEN d_$ > 0 THEN ln(1 / (1 + exp(-greatest(-4.0, least(4.0, $ / (d_$ * 1.4826::DOUBLE))))))"
        " WHEN a_$ > 0 THEN ln(1 / (1 + exp(-greatest(-4.0, least(4.0, $ / (a_$ * 1.2533::DOUBLE)))))) ELSE ln(0.5::DOUBLE) END AS $"
    ),
    sums=_each("coalesce($, 0)", " + "),
    used=_each("CAST($ IS NOT NULL AS INT)", " + "),
)
SQL["p1_fused"] = _FUSED + "SELECT request_id, row_ix, round(fused, 6) AS fused, CAST(used AS INT) AS used FROM f"
SQL["p1_found"] = _FUSED + "SELECT request_id, row_ix FROM f QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY round(fused, 12) DESC, row_ix) = 1"

SQL["p5_classes"] = """
WITH v AS (
  SELECT DISTINCT row_ix, vec FROM recipe_vectors
  WHERE vec IS NOT NULL AND len(vec) = 64 AND NOT list_contains(list_transform(vec, lambda x: CAST(x AS VARCHAR) IN ('nan', '-nan', 'inf', '-inf')), true) AND list_dot_product(CAST(vec AS DOUBLE[]), CAST(vec AS DOUBLE[])) > 0
)
SELECT row_ix, min(row_ix) OVER (PARTITION BY vec) AS class_id, count(*) OVER (PARTITION BY vec) AS rows FROM v
"""

SQL["p5_found"] = """
WITH v AS (
  SELECT DISTINCT row_ix, CAST(vec AS DOUBLE[]) AS v FROM recipe_vectors
  WHERE vec IS NOT NULL AND len(vec) = 64 AND NOT list_contains(list_transform(vec, lambda x: CAST(x AS VARCHAR) IN ('nan', '-nan', 'inf', '-inf')), true)
), n AS (SELECT row_ix, v, sqrt(list_dot_product(v, v)) AS s FROM v WHERE list_dot_product(v, v) > 0)
SELECT DISTINCT a.row_ix AS row_ix_a, b.row_ix AS row_ix_b FROM n a JOIN n b ON a.row_ix < b.row_ix
WHERE list_dot_product(a.v, b.v) / (a.s * b.s) >= 0.9
"""
