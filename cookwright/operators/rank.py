"""Batch search: scores of a bounded set of requests against all recipes, fusion, strategies, top-k, explanations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cookwright.functions import text as T
from cookwright.functions import words as W
from cookwright.functions.query_text import Interpretation, query_terms
from cookwright.operators.index import GramQueries, RecipeIndex
from cookwright.plans.frames import stored

#: Requests that are scored in one pass; a larger batch is split into blocks of this size.
BLOCK = 200
#: Most results of a request, and most candidates that varied picks are made from: parts of the definition of a search.
MOST, CANDIDATES = 50, 250
LOW_CONFIDENCE = 0.31
DISCOVERED = "We could not identify a specific cooking request, so these are varied ideas from the collection. Add an ingredient, cuisine, mood, or cooking time for closer matches."
SEMANTIC_FAILED = "Semantic query processing failed; local lexical fallback used."
ADVENTURE = "We do not know your cooking history, so these picks favor less common ingredient combinations in this collection."
BROAD = "This was a broad request, so these are varied ideas from the collection."
CLOSEST = "These are the closest available matches. Add an ingredient, cuisine, mood, or cooking time for better results."
NO_TIMING = "Cooking time could not be verified because this dataset has no timing data."


@dataclass(frozen=True)
class Request:
    """One interpreted request of a batch."""

    request_id: int
    query: Interpretation
    mode: str = "hybrid"
    limit: int = 10


def weights(kind: str, semantic: bool) -> tuple[float, float, float]:
    """Weights of semantic, lexical and ingredient scores; without semantic ones the others share its part."""
    s, x, i = (0.30, 0.15, 0.55) if kind == "ingredients" else (0.55, 0.25, 0.20)
    return (s, x, i) if semantic else (0.0, x / (x + i), i / (x + i))


def ingredient_score(present: Column, wanted: Column, own: Column) -> Column:
    """0.8 of the share of wanted terms present plus 0.2 of the cosine of both sets, within [0, 1]."""
    share = 0.8 * present / wanted + 0.2 * present / F.sqrt(wanted * F.greatest(F.lit(1), own))
    return F.when(wanted > 0, F.least(F.lit(1.0), share)).otherwise(0.0)


def postings_scores(postings: DataFrame, wanted: dict[int, list[str]], *keep: str) -> DataFrame:
    """``request_id, row_ix, keep, ingredient``: the ingredient scores of all recipes that have some wanted term, from
    the postings (``term, row_ix, n_terms``) of those terms only. The wanted terms are a bounded batch, broadcast."""
    asked = [(k, t, len(set(ts))) for k, ts in wanted.items() for t in sorted(set(ts))]
    side = F.broadcast(postings.sparkSession.createDataFrame(asked, "request_id long, term string, wanted long"))
    hits = postings.where(F.col("term").isin(sorted({t for _, t, _ in asked}))).join(side, "term")
    count = hits.groupBy("request_id", "row_ix", "n_terms", "wanted", *keep).agg(F.count("*").alias("c"))
    return count.select("request_id", "row_ix", *keep, ingredient_score(F.col("c"), F.col("wanted"), F.col("n_terms")).alias("ingredient"))


def supported(postings: DataFrame, wanted: dict[int, list[str]]) -> dict[int, list[str]]:
    """Of each request's terms those that some recipe has. Only the terms of the bounded batch come back."""
    asked = sorted({t for ts in wanted.values() for t in ts})
    have = {r[0] for r in postings.where(F.col("term").isin(asked)).select("term").distinct().collect()} if asked else set()
    return {k: [t for t in ts if t in have] for k, ts in wanted.items()}


def excluded(terms: Column, name_norm: Column, out: Column, no_spicy: Column) -> Column:
    """Whether a recipe holds an excluded ingredient, or is spicy where that is ruled out."""
    spicy = F.arrays_overlap(terms, F.array(*(F.lit(t) for t in W.SPICY))) | F.array_contains(F.split(name_norm, " "), "spicy")
    return ((F.size(out) > 0) & F.arrays_overlap(terms, out)) | (no_spicy & spicy)


class _Best:
    """The best rows offered so far, by score and then by row; with ``by_title`` only the best of each title."""

    def __init__(self, most: int, by_title: bool) -> None:
        self.most, self.by_title, self.floor, self.rows = most, by_title, -np.inf, []

    def offer(self, score: np.ndarray, rows: np.ndarray, names: list[str], *parts: np.ndarray) -> None:
        at = np.flatnonzero((score >= self.floor) & np.isfinite(score))
        order = at[np.lexsort((rows[at], -score[at]))]
        new, seen = [], set()
        for k in order:
            if len(new) == self.most:
                break
            if not self.by_title or names[k] not in seen:
                seen.add(names[k])
                new.append((-float(score[k]), int(rows[k]), names[k], *(float(p[k]) for p in parts)))
        self.rows = self._kept(sorted(self.rows + new))
        if len(self.rows) == self.most:
            self.floor = -self.rows[-1][0]

    def _kept(self, rows: list[tuple]) -> list[tuple]:
        if self.by_title:
            first: dict[str, tuple] = {}
            for r in rows:
                first.setdefault(r[2], r)
            rows = list(first.values())
        return rows[: self.most]


@dataclass(frozen=True)
class _Batch:
    """A block of requests as arrays, one column for each request, as it goes to the recipes."""

    ids: list[int]
    grams: GramQueries
    terms: list[str]
    wanted: np.ndarray
    out: np.ndarray
    spicy: np.ndarray
    no_spicy: np.ndarray
    vectors: np.ndarray | None
    semantic: np.ndarray
    weights: np.ndarray
    intents: list[str]
    bound: np.ndarray
    limits: list[int]

    def scores(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Semantic, lexical and ingredient scores of each recipe for each request, and which rows are ruled out."""
        n, q = b.num_rows, len(self.ids)
        lists = b.column("terms")
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        term = pc.index_in(lists.flatten(), value_set=pa.array(self.terms, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
        has = np.zeros((n, len(self.terms)))
        owner, hit = np.repeat(np.arange(n), sizes), term >= 0
        has[owner[hit], term[hit]] = 1
        count, asked = has @ self.wanted, self.wanted.sum(axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            share = 0.8 * count / asked + 0.2 * count / np.sqrt(asked * np.maximum(1, sizes)[:, None])
        ingredient = np.where(asked > 0, np.minimum(1.0, share), 0.0)
        spicy = (has @ self.spicy > 0) | np.array([x is not None and "spicy" in x.split(" ") for x in b.column("name_norm").to_pylist()], dtype=bool)
        ruled_out = (has @ self.out > 0) | (spicy[:, None] & self.no_spicy[None, :])
        semantic = np.zeros((n, q))
        if self.vectors is not None:
            known = np.flatnonzero(b.column("vec").is_valid().to_numpy(zero_copy_only=False))
            if len(known):
                v = b.column("vec").take(pa.array(known)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(known), -1)
                semantic[known] = np.clip(v @ self.vectors.T, 0, 1)
        return semantic, self.grams.scores(b.column("grams"), b.column("weights")), ingredient, ruled_out


_FOUND = "request_id long, kind string, row_ix long, name_norm string, semantic double, lexical double, ingredient double, distinctiveness double, final double"


def _pass(shared):
    """One pass over the recipes. A task keeps of each request its highest scores and, among the recipes that aren't
    ruled out, the best by title for a plain ranking and the candidates of varied picks: a bounded number of rows,
    whatever the number of recipes. Which of the two counts is decided once the highest scores of all tasks are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: _Batch = shared.value
        q, most = len(s.ids), np.zeros((3, len(s.ids)))
        plain, varied = ([_Best(m, t) for m in ms] for ms, t in ((s.limits, True), ([CANDIDATES] * q, False)))
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                b = whole.slice(at, 2_000)
                semantic, lexical, ingredient, ruled_out = s.scores(b)
                for k, x in enumerate((semantic, lexical, ingredient)):
                    np.maximum(most[k], x.max(axis=0), out=most[k])
                rows, names = b.column("row_ix").to_numpy(zero_copy_only=False), b.column("name_norm").to_pylist()
                d = b.column("distinctiveness").to_numpy(zero_copy_only=False)
                fused = s.weights[1] * lexical + s.weights[2] * ingredient + s.weights[0] * semantic
                for k in range(q):
                    allowed = ~ruled_out[:, k]
                    own = (rows, names, semantic[:, k], lexical[:, k], ingredient[:, k], d)
                    if s.intents[k] == "search":
                        plain[k].offer(np.where(allowed, fused[:, k], -np.inf), *own)
                    blend = 0.82 * fused[:, k] + 0.18 * d if s.intents[k] == "adventurous" and s.bound[k] else d
                    varied[k].offer(np.where(allowed, blend, -np.inf), *own)
        out = []
        for k, i in enumerate(s.ids):
            on = bool(s.semantic[k])
            out.append((i, "most", None, None, float(most[0, k]) if on else None, float(most[1, k]), float(most[2, k]), None, None))
            for kind, best in (("plain", plain[k]), ("varied", varied[k])):
                out += [(i, kind, r, n, x if on else None, y, z, d, -minus) for minus, r, n, x, y, z, d in best.rows]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), *[pa.float64()] * 5)
        names = ["request_id", "kind", "row_ix", "name_norm", "semantic", "lexical", "ingredient", "distinctiveness", "final"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return run


def _greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    """Varied picks from a request's candidates: each next one is the best after penalties for likeness and category."""
    pdf = pdf.sort_values(["final", "row_ix"], ascending=[False, True]).reset_index(drop=True)
    category = lambda n: next((c for c, ps in W.CATEGORIES if any(p in n for p in ps)), "other")
    left = [(k, float(s), set(t), n, category(n)) for k, (s, t, n) in enumerate(zip(pdf.final, pdf.terms, pdf.name_norm)) if not set(n.split()) & set(W.NON_DISH)]
    picked, names, kinds, like = [], set(), {}, [0.0] * len(left)
    for _ in range(int(pdf.limit.iloc[0]) if len(pdf) else 0):
        best, value = None, -np.inf
        for k, (_at, s, _t, n, c) in enumerate(left):
            if n not in names and (v := s - 0.18 * like[k] - 0.1 * min(2, kinds.get(c, 0))) > value:
                best, value = k, v
        if best is None:
            break
        chosen = left[best]
        picked.append(chosen[0])
        names.add(chosen[3])
        kinds[chosen[4]] = kinds.get(chosen[4], 0) + 1
        like = [max(a, len(x[2] & chosen[2]) / len(u) if (u := x[2] | chosen[2]) else 0.0) for a, x in zip(like, left)]
    out = pdf.iloc[picked].copy()
    out["rank"] = np.arange(1, len(picked) + 1, dtype=np.int32)
    return out


def standard_top(scored: DataFrame) -> DataFrame:
    """The rows of ``scored`` (``request_id, row_ix, name_norm, limit, final`` and others) that are shown, with their
    ``rank``: the best recipes, one for each title, ties by row_ix. Pre-aggregated by title."""
    order = F.struct("final", (-F.col("row_ix")).alias("minus"))
    best = scored.groupBy("request_id", "name_norm").agg(F.max_by(F.struct(*scored.columns), order).alias("b")).select("b.*")
    w = Window.partitionBy("request_id").orderBy(F.desc("final"), "row_ix")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= MOST).where(F.col("rank") <= F.col("limit"))


def candidates(scored: DataFrame) -> DataFrame:
    """The best rows of each request, as many as varied picks are made from; ties by row_ix."""
    w = Window.partitionBy("request_id").orderBy(F.desc("final"), "row_ix")
    return scored.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= CANDIDATES).drop("_n")


def diverse_top(near: DataFrame) -> DataFrame:
    """Varied picks from each request's candidates, with their ``rank``; dishes only, one for each title. A request has
    at most ``CANDIDATES`` rows, so a group is small whatever the number of recipes. ``near`` has ``terms`` besides."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in near.schema.fields if f.name != "rank")
    return near.drop("rank").groupBy("request_id").applyInPandas(_greedy, f"{kinds}, rank int")


def reason(strategy: Column, matched: Column, semantic: Column, lexical: Column) -> Column:
    """Why a recipe is shown, in words."""
    return (
        F.when(strategy == "adventurous", "Adventurous pick with a less common ingredient combination")
        .when(strategy == "discovery", "Varied discovery pick from the recipe collection")
        .when(F.size(matched) > 0, F.concat(F.lit("Matches "), F.array_join(F.slice(matched, 1, 4), ", ")))
        .when(semantic >= lexical, "Strong meaning-based match")
        .when(lexical > 0, "Matches words in the request")
        .otherwise("Closest available match")
    )


def confidence(strategy: Column, warned: Column, top: Column, low: float = LOW_CONFIDENCE) -> Column:
    return F.when(strategy == "discovery", F.when(warned, "low").otherwise("medium")).when(strategy != "search", "medium").when(top >= 0.55, "high").when(top >= low, "medium").otherwise("low")


def relevance_label(strategy: Column, conf: Column, rank: Column) -> Column:
    """The label of a result by strategy, confidence and rank."""
    return (
        F.when(strategy == "adventurous", "Adventurous pick").when(strategy == "discovery", "Idea to explore").when(conf == "low", "Closest available").when(rank == 1, "Best match")
        .when(conf == "medium", F.when(rank <= 3, "Top pick").otherwise("Worth exploring")).when(rank <= 3, "Close match").when(rank <= 10, "Strong match").otherwise("Relevant match")
    )


def search(index: RecipeIndex, requests: list[Request]) -> DataFrame:
    """Ranked results of a batch: ``request_id, rank, row_ix, strategy, final, semantic, lexical, ingredient,
    distinctiveness, matched, reason, warning, semantic_degraded, low_signal``. An empty batch or index gives none."""
    out = None
    for at in range(0, len(requests), BLOCK):
        part = _search_block(index, requests[at : at + BLOCK])
        out = part if out is None else out.unionByName(part)
    return index.terms.sparkSession.createDataFrame([], RESULT) if out is None else out


#: Columns of search results.
RESULT = "request_id long, rank int, row_ix long, strategy string, final double, semantic double, lexical double, ingredient double, distinctiveness double, matched array<string>, reason string, warning string, semantic_degraded boolean, low_signal boolean"


def _search_block(index: RecipeIndex, requests: list[Request]) -> DataFrame:
    spark = index.terms.sparkSession
    wants = {r.request_id: r.query.rank_terms for r in requests}
    known = supported(index.postings, wants)
    # without any constraint an adventure or a walk through the collection needs no meaning
    use = [r.mode != "lexical" and not (r.query.intent != "search" and not r.query.ingredients and not r.query.preferences) for r in requests]
    vectors, failed = None, False
    if index.semantic and index.backend is not None and any(use):
        try:
            vectors = np.asarray(index.backend.encode([r.query.semantic_text for r in requests]), dtype=np.float64)
            failed = not np.isfinite(vectors).all()
        except Exception:
            failed = True
        vectors = None if failed else vectors
    outs = [query_terms(r.query.excluded_ingredients) for r in requests]
    terms = sorted({t for ts in [*known.values(), *outs, W.SPICY] for t in ts})
    place = {t: k for k, t in enumerate(terms)}
    wanted, out = np.zeros((len(terms), len(requests))), np.zeros((len(terms), len(requests)))
    weighed = np.zeros((3, len(requests)))
    rows = []
    for k, r in enumerate(requests):
        q, on = r.query, use[k] and vectors is not None
        wanted[[place[t] for t in known[r.request_id]], k] = 1
        out[[place[t] for t in outs[k]], k] = 1
        weighed[:, k] = (0, 1, 0) if r.mode == "lexical" or (r.mode == "semantic" and not on) else (1, 0, 0) if r.mode == "semantic" else weights(q.kind, on)
        foreign = any(c.isalpha() and not c.isascii() for c in q.original)
        rows.append((r.request_id, q.intent, r.limit, known[r.request_id], len(wants[r.request_id]), bool(q.preferences), 0.45 if foreign else 0.6, use[k] and failed))
    batch = _Batch(
        ids=[r.request_id for r in requests], grams=GramQueries.of(index.model, [r.query.original for r in requests]), terms=terms, wanted=wanted, out=out, spicy=np.array([float(t in W.SPICY) for t in terms]),
        no_spicy=np.array(["spicy" in r.query.excluded_preferences for r in requests]), vectors=vectors, semantic=np.array([u and vectors is not None for u in use]), weights=weighed, intents=[r.query.intent for r in requests],
        bound=np.array([bool(known[r.request_id] or r.query.preferences) for r in requests]), limits=[min(MOST, max(1, r.limit)) for r in requests],
    )
    read = index.terms.select("row_ix", "name_norm", "terms", "grams", "weights", "distinctiveness", *(["vec"] if vectors is not None else [F.lit(None).cast("array<float>").alias("vec")]))
    found = stored(read.mapInArrow(_pass(spark.sparkContext.broadcast(batch)), _FOUND))
    most = found.where("kind = 'most'").groupBy("request_id").agg(F.max("ingredient").alias("mi"), F.max("lexical").alias("ml"), F.max("semantic").alias("ms"))
    asked = spark.createDataFrame(rows, "request_id long, intent string, `limit` int, wanted array<string>, asked int, wishes boolean, floor double, semantic_failed boolean")
    weak = ~F.col("wishes") & ((F.size("wanted") / F.greatest(F.lit(1), F.col("asked")) < 0.5) | (F.col("mi") < 0.3)) & (F.col("ml") < 0.3) & (F.coalesce("ms", F.lit(0.0)) < F.col("floor"))
    strategy = F.when(F.col("intent") == "adventurous", "adventurous").when((F.col("intent") == "browse") | F.col("low_signal"), "discovery").otherwise("search")
    decided = asked.join(most, "request_id").withColumn("low_signal", (F.col("intent") == "search") & weak).withColumn("strategy", strategy)
    rows_ = found.where("kind <> 'most'").join(F.broadcast(decided.select("request_id", "limit", "wanted", "semantic_failed", "low_signal", "strategy")), "request_id")
    plain = standard_top(rows_.where("kind = 'plain' and strategy = 'search'"))
    pool = candidates(rows_.where("kind = 'varied' and strategy <> 'search'")).withColumn("rank", F.lit(None).cast("int"))
    # at most BLOCK x (MOST + CANDIDATES) rows, so they go to the recipes' terms
    pool = stored(index.terms.select("row_ix", "terms").join(F.broadcast(plain.unionByName(pool)), "row_ix"))
    won = pool.where("rank is not null").unionByName(diverse_top(pool.where("rank is null")))
    matched = F.array_sort(F.array_intersect("wanted", "terms"))
    warning = F.when(F.col("low_signal"), DISCOVERED).when(F.col("semantic_failed"), SEMANTIC_FAILED)
    won = won.withColumn("matched", matched).withColumn("warning", warning)
    return won.select("request_id", "rank", "row_ix", "strategy", "final", "semantic", "lexical", "ingredient", "distinctiveness", "matched", reason(F.col("strategy"), F.col("matched"), F.col("semantic"), F.col("lexical")).alias("reason"), "warning", F.col("semantic_failed").alias("semantic_degraded"), "low_signal")


def responses(index: RecipeIndex, results: DataFrame) -> DataFrame:
    """The results with their recipes: payload columns are joined last, for the recipes shown only."""
    from cookwright.operators.present import summary

    r4 = lambda c: F.bround(c, 4)
    scores = F.struct(*(r4(c).alias(c) for c in ("final", "semantic", "lexical", "ingredient", "distinctiveness")))
    full = results.join(index.recipes, "row_ix").withColumn("total_minutes", T.total_minutes(F.col("prep_time"), F.col("cook_time")))
    why = F.struct(F.col("reason").alias("summary"), F.col("matched").alias("matched_ingredients"), scores.alias("scores")).alias("match_reason")
    keep = ["request_id", "rank", "id", "name", "ingredients", "source", "url", "image_url", "prep_time", "cook_time", "total_minutes", "recipe_yield", "description", "instructions", "instruction_source"]
    return full.select(*keep, summary(F.col("name"), F.col("ingredients"), F.col("description")).alias("summary"), r4("final").alias("score"), why)


def metadata(index: RecipeIndex, requests: list[Request], results: DataFrame) -> DataFrame:
    """One row for each request: mode, strategy, totals, confidence, flags, warning and the interpretation."""
    spark = results.sparkSession
    total, timed = index.recipes.agg(F.count("*"), F.bool_or(F.col("prep_time").isNotNull() | F.col("cook_time").isNotNull())).first()
    asked = spark.createDataFrame([(r.request_id, r.mode, r.query.original, r.query.kind, r.query.intent, r.query.ingredients, r.query.excluded_ingredients, r.query.preferences, r.query.excluded_preferences, r.query.max_minutes, r.query.source, r.query.degraded, r.query.warning) for r in requests], "request_id long, mode string, query string, kind string, intent string, ingredients array<string>, excluded_ingredients array<string>, preferences array<string>, excluded_preferences array<string>, max_minutes int, interpreter string, degraded boolean, query_warning string")
    per = results.groupBy("request_id").agg(F.count("*").alias("returned"), F.max_by("final", -F.col("rank")).alias("top"), F.max("strategy").alias("strategy"), F.max("warning").alias("warning"), F.bool_or("semantic_degraded").alias("semantic_degraded"))
    untimed = F.when(F.col("max_minutes").isNotNull() & F.lit(not timed), NO_TIMING)
    out = asked.join(per, "request_id", "left").withColumn("strategy", F.coalesce("strategy", F.lit("search")))
    conf = confidence(F.col("strategy"), F.col("warning").isNotNull(), F.coalesce("top", F.lit(0.0)))
    return out.select(*asked.columns, "strategy", F.lit(total).alias("total_recipes"), F.coalesce("returned", F.lit(0)).alias("returned"), conf.alias("confidence"), F.lit(index.semantic).alias("semantic_available"), F.coalesce("semantic_degraded", F.lit(False)).alias("semantic_degraded"), F.coalesce("warning", untimed).alias("retrieval_warning"))


def page(results: DataFrame, number: int, size: int = 10) -> DataFrame:
    """One page of the ranked results."""
    return results.where(F.col("rank").between((number - 1) * size + 1, number * size))


def notices(meta: DataFrame) -> DataFrame:
    """``request_id, notice``: what a reader is told about the results, null where nothing is."""
    strategy = F.col("strategy")
    lead = (
        F.when(strategy == "adventurous", ADVENTURE)
        .when((strategy == "discovery") & F.col("retrieval_warning").isNull(), BROAD)
        .when(F.col("confidence") == "low", CLOSEST)
    )
    return meta.select("request_id", F.nullif(F.concat_ws(" ", lead, "query_warning", "retrieval_warning"), F.lit("")).alias("notice"))
