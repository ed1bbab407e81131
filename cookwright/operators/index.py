"""The three indexes over recipes: ingredient postings with distinctiveness, character TF-IDF, dense vectors."""

from __future__ import annotations

import hashlib
import math
import os
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cookwright.functions import text as T
from cookwright.functions.query_text import normalize_text
from cookwright.functions.query_text import terms as line_terms
from cookwright.plans.frames import spread, stored

VERSION = "2"
MAX_FEATURES = 40_000


def term_batches(batches: Iterator[pa.RecordBatch], text_limit: int | None = None) -> Iterator[pa.RecordBatch]:
    known: dict[str, set[str]] = {}
    for b in batches:
        out: tuple[list, ...] = ([], [], [])
        for name, lines in zip(b.column("name").to_pylist(), b.column("ingredients").to_pylist()):
            mine: set[str] = set()
            lines = [x for x in lines or () if x is not None]
            for x in lines:
                if (got := known.get(x)) is None:
                    if len(known) > 50_000:
                        known.clear()
                    got = known[x] = line_terms(x)
                mine |= got
            for o, v in zip(out, (normalize_text(name or ""), sorted(mine), normalize_text(" ".join([*([name] if name is not None else []), " ".join(lines)]))[:text_limit])):
                o.append(v)
        kinds = (pa.string(), pa.list_(pa.string()), pa.string())
        yield pa.RecordBatch.from_arrays([b.column("row_ix"), b.column("name"), *(pa.array(o, k) for o, k in zip(out, kinds))], names=["row_ix", "name", "name_norm", "terms", "text"])


def term_table(recipes: DataFrame, text_limit: int | None = None) -> DataFrame:
    """``row_ix, name, name_norm, terms, text``: what ranking needs of each recipe. No shuffle but where
    the input has fewer partitions than there are cores.

    ``text_limit`` cuts the normalised text to so many characters (1,600 in the usual definition of the lexical index);
    by default it is whole. Terms in column expressions (:func:`cookwright.functions.text.terms`) are equal, but queries
    with them were measured two to three times slower, as array functions are interpreted; so this is one Arrow pass.
    """
    cols = spread(recipes.select(F.col("row_ix").cast("long").alias("row_ix"), "name", "ingredients"))
    return cols.mapInArrow(lambda batches: term_batches(batches, text_limit), "row_ix long, name string, name_norm string, terms array<string>, text string")


def postings(terms: DataFrame, *more: str) -> DataFrame:
    """``term, row_ix``, the number of the row's terms as ``n_terms`` and the columns ``more``, where asked for: the
    inverted index as a long table, never one list per term."""
    return terms.select(F.explode("terms").alias("term"), "row_ix", *(F.size("terms").alias(c) if c == "n_terms" else F.col(c) for c in more))


def document_frequency(postings_: DataFrame) -> DataFrame:
    return postings_.groupBy("term").agg(F.count("*").alias("df"))


def distinctiveness(terms: DataFrame) -> DataFrame:
    """``row_ix, distinctiveness`` in [0, 1]: the mean capped IDF of a recipe's six rarest usual terms, by the range
    of its 20th to 98th percentile.

    Terms of fewer than 3 recipes (1 below 50 recipes) or more than 15 % of them don't count; a recipe with fewer
    than two has 0. With fewer than two positive values they stay as they are; with no range they are clipped.
    The recipes' distinctive terms are stored first, as they are read more than once.
    """
    mine = stored(terms.select("row_ix", F.array_distinct(T.distinctive(F.col("terms"))).alias("own")))
    own = mine.select("row_ix", F.explode_outer("own").alias("term"))
    n = mine.agg(F.count("*").alias("n"))
    df = own.where("term is not null").groupBy("term").agg(F.count("*").alias("df"))
    least = F.when(F.col("n") < 50, 1).otherwise(3)
    usual = df.crossJoin(F.broadcast(n)).where((F.col("df") >= least) & (F.col("df") <= F.greatest(least, F.floor(F.col("n") * 0.15))))
    value = F.least(F.log((F.col("n") + 1) / (least + 1)), F.log((F.col("n") + 1) / (F.col("df") + 1)))
    top = own.join(usual.select("term", value.alias("idf")), "term", "left").groupBy("row_ix").agg(F.slice(F.sort_array(F.collect_list("idf"), False), 1, 6).alias("v"))
    raw = stored(top.select("row_ix", F.when(F.size("v") >= 2, F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / 6).otherwise(0.0).alias("raw")))
    cut_ = raw.where("raw > 0").agg(F.percentile("raw", F.array(F.lit(0.2), F.lit(0.98))).alias("p"), F.count("*").alias("positive"))
    low, high = F.col("p")[0], F.col("p")[1]
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    scaled = F.when(F.col("positive") < 2, F.col("raw")).when(high <= low, clip(F.col("raw"))).otherwise(clip((F.col("raw") - low) / (high - low)))
    return raw.crossJoin(F.broadcast(cut_)).select("row_ix", scaled.alias("distinctiveness"))


def word_grams(word: str) -> list[str]:
    """Runs of three and four characters of a word padded by a blank on both sides; a one-letter word has one."""
    p = f" {word} "
    return [p[i : i + n] for n in (3, 4) if len(p) >= n for i in range(len(p) - n + 1)]


def char_grams(text: str) -> Counter:
    """How often each gram stands in the words of a text."""
    return Counter(g for w in text.split() for g in word_grams(w))


class GramCounter:
    """Gram counts of whole batches of texts: each distinct word is taken apart once, the rest is array work.

    With ``ids`` only its grams count; without, grams are numbered as they come (``self.ids``).
    """

    def __init__(self, ids: dict[str, int] | None = None) -> None:
        self.fixed, self.ids = ids is not None, ids if ids is not None else {}
        self.forget()

    def forget(self) -> None:
        outer = self

        class Words(dict):
            def __missing__(self, word: str) -> int:
                for g in word_grams(word):
                    n = outer.ids.get(g) if outer.fixed else outer.ids.setdefault(g, len(outer.ids))
                    if n is not None:
                        outer.flat.append(n)
                outer.ends.append(len(outer.flat))
                self[word] = len(self)
                return self[word]

        self.words, self.flat, self.ends = Words(), [], [0]

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position of the text, gram and count, sorted by position and gram."""
        if len(self.words) > 200_000:
            self.forget()
        at, lengths = [], []
        for t in texts:
            mine = [self.words[w] for w in t.split()] if t else []
            at += mine
            lengths.append(len(mine))
        if not at:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        ends, flat = np.asarray(self.ends, dtype=np.int64), np.asarray(self.flat, dtype=np.int64)
        word = np.asarray(at, dtype=np.int64)
        size = ends[word + 1] - ends[word]
        doc = np.repeat(np.repeat(np.arange(len(texts)), lengths), size)
        gram = flat[np.repeat(ends[word] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))]
        width = max(1, len(self.ids))
        both, n = np.unique(doc * width + gram, return_counts=True)
        return both // width, both % width, n


def _slices(column: pa.Array, size: int = 2_000) -> Iterator[list]:
    for at in range(0, len(column), size):
        yield column.slice(at, size).to_pylist()


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # pre-aggregated over the documents of a task before anything is shuffled
    def rows(ids: dict, df: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        n = len(ids)
        return pa.RecordBatch.from_arrays([pa.array(list(ids), pa.string()), pa.array(df[:n], pa.int64()), pa.array(total[:n], pa.int64())], names=["gram", "df", "total"])

    def grown(a: np.ndarray, n: int) -> np.ndarray:
        return a if len(a) >= n else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), dtype=np.int64)])

    counter, df, total = GramCounter(), np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64)
    for batch in batches:
        for texts in _slices(batch.column(0)):
            _doc, gram, n = counter.counts(texts)
            df, total = grown(df, len(counter.ids)), grown(total, len(counter.ids))
            df += np.bincount(gram, minlength=len(df)) if len(gram) else 0
            total += np.bincount(gram, n, minlength=len(total)).astype(np.int64) if len(gram) else 0
            if len(counter.ids) > 1_000_000:
                yield rows(counter.ids, df, total)
                counter, df, total = GramCounter(), np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64)
    if counter.ids:
        yield rows(counter.ids, df, total)


@dataclass(frozen=True)
class LexicalModel:
    """The grams kept with their inverse document frequencies: at most ``MAX_FEATURES``, so small enough to broadcast.

    A gram's number is its place among the grams in alphabetical order.
    """

    idf: dict[str, float]

    def vector(self, text: str) -> dict[str, float]:
        """Unit weights of a normalised text's known grams: (1 + ln count) times idf."""
        w = {g: (1 + math.log(c)) * self.idf[g] for g, c in char_grams(text).items() if g in self.idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {g: x / norm for g, x in w.items()} if norm else {}

    def numbered(self) -> tuple[dict[str, int], np.ndarray]:
        names = sorted(self.idf)
        return {g: k for k, g in enumerate(names)}, np.array([self.idf[g] for g in names], dtype=np.float64)


def lexical_vocabulary(terms: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """``gram, df, total, idf`` of the grams kept: those of at least two documents (one below 25 documents), of these
    the most frequent ``max_features``, equal ones in alphabetical order."""
    n = terms.count()
    grams = terms.select("text").mapInArrow(_gram_rows, "gram string, df long, total long").groupBy("gram").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    kept = grams.where(F.col("df") >= (1 if n < 25 else 2)).orderBy(F.desc("total"), "gram").limit(max_features)
    return kept.withColumn("idf", F.log(F.lit(1.0 + n) / (F.col("df") + 1)) + 1)


def lexical_model(vocabulary: DataFrame) -> LexicalModel:
    return LexicalModel({r.gram: r.idf for r in vocabulary.select("gram", "idf").toLocalIterator()})


def document_vectors(terms: DataFrame, model: LexicalModel) -> DataFrame:
    """The rows of ``terms`` with ``grams`` (numbers, ascending) and their unit ``weights`` besides: the sparse document
    matrix, one row a document. One pass, no shuffle; the model is broadcast."""
    shared = terms.sparkSession.sparkContext.broadcast(model.numbered())
    names = terms.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, idf = shared.value
        counter = GramCounter(ids)
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                b = whole.slice(at, 2_000)
                doc, gram, n = counter.counts(b.column("text").to_pylist())
                w = (1 + np.log(n)) * idf[gram] if len(gram) else np.zeros(0)
                norm = np.sqrt(np.bincount(doc, w * w, minlength=b.num_rows)) if len(gram) else np.zeros(b.num_rows)
                w = w / norm[doc] if len(gram) else w
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b.num_rows))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.ListArray.from_arrays(ends, pa.array(gram.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(w))], names=[*names, "grams", "weights"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in terms.schema.fields)
    return terms.mapInArrow(run, f"{kinds}, grams array<int>, weights array<double>")


def lexical_weights(vectors: DataFrame, model: LexicalModel) -> DataFrame:
    """``row_ix, gram, weight``: the document matrix of :func:`document_vectors` as a long table."""
    names = vectors.sparkSession.createDataFrame([(k, g) for g, k in model.numbered()[0].items()] or [], "k int, gram string")
    return vectors.select("row_ix", F.explode(F.arrays_zip("grams", "weights")).alias("z")).select("row_ix", F.col("z.grams").alias("k"), F.col("z.weights").alias("weight")).join(F.broadcast(names), "k").select("row_ix", "gram", "weight")


@dataclass(frozen=True)
class GramQueries:
    """Query texts as a matrix: ``slot`` has the row of each gram or -1, ``weight`` a column for each query."""

    slot: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, model: LexicalModel, texts: list[str]) -> GramQueries:
        ids, _ = model.numbered()
        vectors = [model.vector(normalize_text(t or "")) for t in texts]
        used = sorted({ids[g] for v in vectors for g in v})
        slot = np.full(max(1, len(ids)), -1, dtype=np.int64)
        slot[used] = np.arange(len(used))
        weight = np.zeros((len(used), len(texts)))
        for k, v in enumerate(vectors):
            for g, x in v.items():
                weight[slot[ids[g]], k] = x
        return cls(slot, weight)

    def scores(self, grams: pa.Array, weights: pa.Array) -> np.ndarray:
        """Cosines of each document with each query, within [0, 1]."""
        n, used = len(grams), len(self.weight)
        ends = np.concatenate([[0], np.cumsum(grams.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        flat, w = grams.flatten().to_numpy(zero_copy_only=False), weights.flatten().to_numpy(zero_copy_only=False)
        out = np.zeros((n, self.weight.shape[1]))
        step = max(1, 1_000_000 // max(1, used))
        for at in range(0, n if used else 0, step):
            a, z = ends[at], ends[min(n, at + step)]
            slot = self.slot[flat[a:z]]
            hit = np.flatnonzero(slot >= 0)
            doc = np.searchsorted(ends, a + hit, side="right") - 1 - at
            dense = np.zeros((min(n, at + step) - at, used))
            dense[doc, slot[hit]] = w[a:z][hit]
            out[at : at + step] = dense @ self.weight
        return np.clip(out, 0, 1)


def lexical_scores(vectors: DataFrame, model: LexicalModel, queries: list[tuple[int, str]]) -> DataFrame:
    """``request_id, row_ix, lexical`` in (0, 1]: cosines of the given query texts with every document they share a
    gram with. ``vectors`` has ``row_ix, grams, weights``. The queries, a bounded batch, go to the documents; nothing
    is shuffled."""
    ids = np.array([q for q, _ in queries], dtype=np.int64)
    shared = vectors.sparkSession.sparkContext.broadcast(GramQueries.of(model, [t for _, t in queries]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.scores(b.column("grams"), b.column("weights"))
            r, k = np.nonzero(s)
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array(ids[k]), b.column("row_ix").take(pa.array(r)), pa.array(s[r, k])], names=["request_id", "row_ix", "lexical"])

    return vectors.select("row_ix", "grams", "weights").mapInArrow(run, "request_id long, row_ix long, lexical double")


class EmbeddingBackend(Protocol):
    """What turns texts into vectors. A model goes in here; it is loaded on the workers, once each."""

    name: str

    def encode(self, texts: Iterable[str]) -> np.ndarray: ...


class HashEmbedding:
    """A deterministic backend without a model: hashed character trigrams, counted and normalised."""

    def __init__(self, dimensions: int = 64) -> None:
        self.dimensions, self.name = dimensions, f"hash-{dimensions}"

    def encode(self, texts: Iterable[str]) -> np.ndarray:
        size = self.dimensions

        class Slots(dict):  # each trigram is hashed once
            def __missing__(self, gram: str) -> int:
                self[gram] = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "little") % size
                return self[gram]

        slots, rows = Slots(), []
        for t in texts:
            n = normalize_text(t or "")
            v = np.bincount([slots[n[i : i + 3]] for i in range(max(1, len(n) - 2))], minlength=size).astype(np.float64)
            rows.append(v / max(float(np.linalg.norm(v)), 1e-12))
        return np.stack(rows).astype(np.float32) if rows else np.empty((0, size), dtype=np.float32)


def embed(recipes: DataFrame, backend: EmbeddingBackend, text_limit: int | None = None) -> DataFrame:
    """``row_ix, vec``: the vector of each recipe's search text; ``text_limit`` cuts it to so many characters (2,000 in
    the usual definition), by default it is whole."""

    @F.pandas_udf("array<float>")
    def encode(s: pd.Series) -> pd.Series:
        return pd.Series(list(backend.encode(s.tolist())), index=s.index)

    text = T.search_text(F.col("name"), F.col("ingredients"), F.col("description"))
    if text_limit is not None:
        text = F.substring(text, 1, text_limit)
    return spread(recipes.select(F.col("row_ix").cast("long").alias("row_ix"), "name", "ingredients", "description")).select("row_ix", encode(text).alias("vec"))


def l2_normalize(vec: Column) -> Column:
    """The vector over its length, which is taken for 1e-12 at least."""
    wide = F.transform(vec, lambda x: x.cast("double"))
    norm = F.greatest(F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-12))
    return F.transform(wide, lambda x: x / norm)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def usable(vec: Column, dimensions: int) -> Column:
    """Whether a vector has the right length and only finite parts."""
    return F.coalesce((F.size(vec) == dimensions) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def checked_vectors(vectors: DataFrame, dimensions: int) -> DataFrame:
    """The vectors, if every one has the right length and finite parts; else an error with the number that hasn't."""
    bad = vectors.where(~usable(F.col("vec"), dimensions)).count()
    if bad:
        raise ValueError(f"{bad} vectors are malformed")
    return vectors


@dataclass
class RecipeIndex:
    """The index tables of one corpus.

    ``terms`` has all that ranking reads of a recipe: ``row_ix, name, name_norm, terms, text, grams, weights,
    distinctiveness, vec``, one row each, so that a batch of requests is one pass over one table. ``vec`` is null for a
    recipe without a vector, and everywhere where no backend was given or it failed (``warning``).
    """

    recipes: DataFrame
    terms: DataFrame
    postings: DataFrame
    model: LexicalModel
    semantic: bool
    backend: EmbeddingBackend | None
    warning: str | None = None

    @classmethod
    def build(cls, recipes: DataFrame, backend: EmbeddingBackend | None = None, max_features: int = MAX_FEATURES, vectors: DataFrame | None = None, text_limits: tuple[int | None, int | None] = (None, None)) -> RecipeIndex:
        """Index ``recipes``. ``vectors`` (``row_ix, vec``; one row each) takes the place of encoding the recipes;
        ``text_limits`` are those of the lexical text and of the text to embed."""
        base, warning = stored(term_table(recipes, text_limits[0])), None
        model = lexical_model(lexical_vocabulary(base, max_features))
        if vectors is None and backend is not None:
            try:
                vectors = stored(embed(recipes, backend, text_limits[1]))
            except Exception:
                backend, warning = None, "Semantic index could not be built; lexical retrieval is used."
        full = document_vectors(base, model).join(distinctiveness(base), "row_ix")
        full = full.join(vectors.select("row_ix", "vec"), "row_ix", "left") if vectors is not None else full.withColumn("vec", F.lit(None).cast("array<float>"))
        full = stored(full)
        return cls(recipes, full, postings(full, "n_terms"), model, vectors is not None, backend, warning)

    def save(self, folder: str) -> None:
        """All tables as Parquet, postings sorted by term so that row groups can be skipped; the count of rows last, as the seal."""
        spark = self.recipes.sparkSession
        self.recipes.write.mode("overwrite").parquet(os.path.join(folder, "recipes"))
        self.terms.write.mode("overwrite").parquet(os.path.join(folder, "terms"))
        spark.createDataFrame(list(self.model.idf.items()), "gram string, idf double").write.mode("overwrite").parquet(os.path.join(folder, "vocabulary"))
        self.postings.repartitionByRange("term", "row_ix").sortWithinPartitions("term", "row_ix").write.mode("overwrite").parquet(os.path.join(folder, "postings"))
        meta = [(VERSION, self.recipes.count(), self.backend.name if self.backend else None, self.semantic)]
        spark.createDataFrame(meta, "version string, rows long, backend string, semantic boolean").write.mode("overwrite").parquet(os.path.join(folder, "sealed"))

    @classmethod
    def load(cls, spark: SparkSession, folder: str, backend: EmbeddingBackend | None = None) -> RecipeIndex | None:
        """The saved index, or None where it is missing, incomplete, of another version, backend or number of rows."""
        read = lambda name: spark.read.parquet(os.path.join(folder, name))
        try:
            meta = read("sealed").first()
            recipes, terms = read("recipes"), read("terms")
            if meta.version != VERSION or meta.backend != (backend.name if backend else None) or not recipes.count() == terms.count() == meta.rows:
                return None
            return cls(recipes, terms, read("postings"), lexical_model(read("vocabulary")), meta.semantic, backend)
        except Exception:
            return None
