"""Evaluation of retrieval: relevance by theme terms, ranks, Hit@k, MRR, violated exclusions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cookwright.functions import text as T
from cookwright.functions.query_text import MODES, from_ingredients, interpret
from cookwright.operators.index import RecipeIndex
from cookwright.operators.rank import Request, metadata, search
from cookwright.plans.frames import stored


def matches(text: Column, expected: Column) -> Column:
    """How many of the expected terms a text holds, whole words, both canonical."""
    has = lambda t: F.regexp_like(text, F.concat(F.lit(r"(?<!\w)"), T.normalize(t), F.lit(r"(?!\w)")))
    return F.size(F.filter(expected, has))


def relevant(text: Column, expected: Column, least: Column) -> Column:
    """Whether a canonical text holds at least ``least`` of the terms; never where ``least`` is not positive."""
    return F.coalesce((least > 0) & (matches(text, expected) >= least), F.lit(False))


def _answered(cases: list[tuple[int, list[str], int]]):
    """Which of the cases the texts of a task answer, each once: all their terms are sought in one walk over a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, of = ahocorasick.Automaton(), {}
        for k, (_, terms, _) in enumerate(cases):
            for t in terms:
                of.setdefault(t, []).append(k)
        for t in of:
            auto.add_word(t, t)
        if of:
            auto.make_automaton()
        word = lambda c: c.isalnum() or c == "_"
        done: set[int] = set()
        for b in batches:
            for text in b.column(0).to_pylist() if of else ():
                found = {t for end, t in auto.iter(text or "") if not (end - len(t) >= 0 and word(text[end - len(t)])) and not (end + 1 < len(text) and word(text[end + 1]))}
                hits = Counter(k for t in found for k in of[t])
                done |= {k for k, n in hits.items() if n >= cases[k][2]}
        yield pa.RecordBatch.from_arrays([pa.array([cases[k][0] for k in sorted(done)], pa.int64())], names=["item_id"])

    return run


def answerable(recipes: DataFrame, cases: DataFrame) -> DataFrame:
    """The cases that some recipe answers (``item_id``). The cases are a fixed set and go to the recipes, which are read once."""
    terms = F.array_distinct(F.filter(F.transform("expected_any", T.normalize), lambda t: t.isNotNull() & (t != "")))
    rows = cases.where("expected_any is not null").select("item_id", terms.alias("t"), F.coalesce("minimum_matches", F.lit(1)).alias("n")).where("n > 0").collect()
    text = recipes.select(T.canonicalize(T.search_text(F.col("name"), F.col("ingredients"), F.col("description"))).alias("text"))
    return text.mapInArrow(_answered([(r.item_id, list(r.t), r.n) for r in rows]), "item_id long").distinct()


def evaluate(index: RecipeIndex, cases: DataFrame, top_k: int = 5, modes: tuple[str, ...] = MODES) -> DataFrame:
    """``item_id, mode, top_result, first_relevant_rank, confidence, strategy, answerable, exclusion_violation``.

    ``cases`` has ``item_id, query_text, ingredients, expected_any, excluded_any, minimum_matches``; a case has a text
    or ingredients. Cases are a fixed set and are read to the driver; all of them in all modes are one batch.
    """
    rows = cases.select("item_id", "query_text", "ingredients").orderBy("item_id").collect()
    ask = [(r.item_id, from_ingredients(list(r.ingredients)) if r.ingredients else interpret(r.query_text)) for r in rows if r.ingredients or r.query_text]
    known = answerable(index.recipes, cases).withColumn("answerable", F.lit(True))
    requests = [Request(k * len(modes) + n, q, mode, top_k) for k, (_, q) in enumerate(ask) for n, mode in enumerate(modes)]
    names = index.recipes.sparkSession.createDataFrame([(r.request_id, ask[r.request_id // len(modes)][0], r.mode) for r in requests], "request_id long, item_id long, mode string")
    found = stored(search(index, requests))
    meta = metadata(index, requests, found).select("request_id", "confidence", "strategy").join(F.broadcast(names), "request_id")
    # at most top_k rows a request, so they go to the recipes
    shown = index.recipes.select("row_ix", "name", "ingredients").join(F.broadcast(found.select("request_id", "rank", "row_ix").join(names, "request_id")), "row_ix").join(F.broadcast(cases.select("item_id", "expected_any", "excluded_any", "minimum_matches")), "item_id")
    lines = F.array_join("ingredients", " ")
    judged = shown.select("request_id", "rank", "name", relevant(T.canonicalize(F.concat_ws(" ", "name", lines)), F.col("expected_any"), F.coalesce("minimum_matches", F.lit(1))).alias("good"), relevant(T.canonicalize(lines), F.col("excluded_any"), F.lit(1)).alias("bad"))
    per = judged.groupBy("request_id").agg(F.min_by("name", "rank").alias("top_result"), F.min(F.when(F.col("good"), F.col("rank"))).alias("first_relevant_rank"), F.bool_or("bad").alias("exclusion_violation"))
    one = meta.join(per, "request_id", "left").join(known, "item_id", "left")
    return one.select("item_id", "mode", F.coalesce("top_result", F.lit("none")).alias("top_result"), "first_relevant_rank", "confidence", "strategy", F.coalesce("answerable", F.lit(False)).alias("answerable"), F.coalesce("exclusion_violation", F.lit(False)).alias("exclusion_violation"))


def aggregates(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """By mode: labelled cases, hits, Hit@k, MRR; and violations among the cases that exclude something, and, as the
    report also counts them, among those whose note says ``without``."""
    notes = cases.select("item_id", (F.size("excluded_any") > 0).alias("excludes"), F.lower(F.coalesce("note", F.lit(""))).contains("without").alias("noted"))
    r = rows.join(notes, "item_id")
    lab, rank = F.col("answerable"), F.col("first_relevant_rank")
    n = F.count_if(lab)
    return r.groupBy("mode").agg(
        n.alias("labelled"), F.count_if(lab & rank.isNotNull()).alias("hits"), F.round(F.coalesce(F.try_divide(F.count_if(lab & rank.isNotNull()), n), F.lit(0.0)), 6).alias("hit_rate"),
        F.round(F.coalesce(F.try_divide(F.sum(F.when(lab, 1 / rank)), n), F.lit(0.0)), 6).alias("mrr"),
        F.count_if(F.coalesce("excludes", F.lit(False))).alias("excluding"), F.count_if(F.coalesce("excludes", F.lit(False)) & F.col("exclusion_violation")).alias("violations"),
        F.count_if("noted").alias("noted_without"), F.count_if(F.col("noted") & F.col("exclusion_violation")).alias("noted_violations"),
    )


def markdown_report(rows: DataFrame, cases: DataFrame, top_k: int) -> str:
    """The evaluation as a Markdown table with its aggregates. Reads one row for each case and mode."""
    clean = lambda t: (t or "").replace("|", "/")
    text = {r.item_id: r.query_text or ", ".join(r.ingredients or []) for r in cases.select("item_id", "query_text", "ingredients").collect()}
    lines = ["# Retrieval evaluation", "", f"Relevant: at least the case's minimum number of theme terms, within the first {top_k} results.", "", "| Query | Mode | Strategy | Top result | First relevant rank | Confidence | Exclusion violation |", "|---|---|---|---|---:|---|---|"]
    for r in rows.orderBy("item_id", "mode").collect():
        rank = "n/a" if not r.answerable else "none" if r.first_relevant_rank is None else str(r.first_relevant_rank)
        lines.append(f"| {clean(text.get(r.item_id))} | {r.mode} | {r.strategy} | {clean(r.top_result)} | {rank} | {r.confidence} | {'yes' if r.exclusion_violation else 'no'} |")
    lines += ["", "## Aggregate (labelled queries)", ""]
    for a in aggregates(rows, cases).orderBy("mode").collect():
        lines.append(f"- **{a['mode']}**: Hit@{top_k} {a.hit_rate:.0%}, MRR {a.mrr:.3f}; exclusion violations {a.violations}/{a.excluding} (by note {a.noted_violations}/{a.noted_without})")
    return "\n".join(lines) + "\n"
