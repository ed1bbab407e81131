"""The most similar vectors for every vector: a small-world graph in each shard, shard results merged.

Shards are the cells of pivots fitted to a bounded sample; every vector is indexed in its own cell and searched in
the nearest few (or in all). A cell that holds more rows than a shard is split at random, and each part is searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cookwright.llm.hnsw import Graph
from cookwright.plans.frames import cut

#: Vectors that one graph holds, about, and queries that one task puts to it.
SHARD_ROWS, QUERY_ROWS = 2_000, 40_000
#: Vectors of the sample that the pivots are fitted to, and most pivots.
SAMPLE_ROWS, MOST_PIVOTS = 20_000, 4_096
#: Cells in which a vector is searched where not all are: for its nearest ones, and for very similar ones only.
PROBES, CLOSE_PROBES = 6, 3
#: Breadth of the walks over a graph: for the nearest ones, and where only very similar ones are asked for.
BREADTH, NARROW = 40, 32
#: Copies of one vector that are expanded to all their pairs; a larger group gives pairs with its first row only.
EXPAND = 1_000


def usable(vec: Column, dim: int) -> Column:
    """Whether the vector has a direction: the right length, no null, NaN or infinite part, not all zero."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vec) == dim) & fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def classes(rows: DataFrame, ident: str, vec: str, dim: int) -> DataFrame:
    """``row, rep, rows``: the rows with a usable vector, with the smallest ident that has the very same vector."""
    keyed = rows.where(F.col(ident).isNotNull() & usable(F.col(vec), dim)).select(F.col(ident).cast("long").alias("row"), F.xxhash64(vec).alias("h1"), F.xxhash64(F.lit(1), vec).alias("h2")).distinct()
    first = keyed.groupBy("h1", "h2").agg(F.min("row").alias("rep"), F.count("*").alias("rows"))
    return keyed.join(first, ["h1", "h2"]).select("row", "rep", "rows", "h1", "h2")


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(arr.flatten(), dtype=np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _pivots(reps: DataFrame, dim: int, count: int, n: int) -> np.ndarray:
    """Directions of ``n`` cells: a few rounds of spherical k-means over a sample by hash."""
    slots = 1_000_000
    open_ = min(slots, 2 * SAMPLE_ROWS * slots // max(1, count) + 1)
    got = reps.where(F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(slots)) < open_).orderBy(F.xxhash64("rep", F.lit(3)), "rep").limit(SAMPLE_ROWS).select("vec").toArrow()
    x = _matrix(got.column(0), dim)
    centre = x[:n].copy()
    for _ in range(6):
        near = (x @ centre.T).argmax(axis=1)
        for k in range(len(centre)):
            if (near == k).any():
                c = x[near == k].sum(axis=0)
                centre[k] = c / max(1e-12, float(np.linalg.norm(c)))
    return centre


def _route(centre: np.ndarray, dim: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = _matrix(b.column("vec"), dim) @ centre.T
                take = min(probes, s.shape[1])
                near = np.argpartition(-s, take - 1, axis=1)[:, :take]
                near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1).astype(np.int32)
                cells = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, take, dtype=np.int32)), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("vec"), b.column("ask"), cells], names=["rep", "vec", "ask", "cells"])

    return run


def _search(dim: int, k: int, least: float | None, m: int, ef: int):
    def run(t: pa.Table) -> pa.Table:
        index = t.filter(pc.field("ask") == False)  # noqa: E712
        query = t.filter(pc.field("ask"))
        empty = pa.table({"row": pa.array([], pa.int64()), "near": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        if not index.num_rows or not query.num_rows:
            return empty
        ids, asked = index.column("rep").to_numpy(), query.column("rep").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, x, q = ids[order], _matrix(index.column("vec"), dim)[order], _matrix(query.column("vec"), dim)
        graph = Graph(x, m, ef)
        rows, near, sims = [], [], []
        todo, want = np.arange(len(q)), k + 1
        while len(todo):
            i, s = graph.search(q[todo], min(want, len(x)), max(ef, want))
            ok = (ids[i] != asked[todo][:, None]) & (s > -1.5)
            if least is not None:
                ok &= s >= least
                # all that were found are similar enough: there may be more, ask these for more
                full = (s[:, -1] >= least) & (i.shape[1] < len(x))
            else:
                full = np.zeros(len(todo), dtype=bool)
            r, c = np.nonzero(ok & ~full[:, None])
            rows.append(asked[todo][r])
            near.append(ids[i[r, c]])
            sims.append(s[r, c].astype(np.float64))
            todo, want = todo[full], want * 4
        return pa.table({"row": pa.array(np.concatenate(rows), pa.int64()), "near": pa.array(np.concatenate(near), pa.int64()), "similarity": pa.array(np.concatenate(sims), pa.float64())})

    return run


def nearest(rows: DataFrame, ident: str, vec: str, k: int = 5, dim: int = 64, ask: Column | None = None, least: float | None = None, probes: int | None = PROBES, shard_rows: int = SHARD_ROWS, m: int = 10, ef: int = BREADTH) -> tuple[DataFrame, DataFrame]:
    """The approximate nearest distinct vectors by cosine.

    Returns ``(near, members)``. ``members`` has ``row, rep, rows`` for every row with a usable vector; ``near`` has
    ``row, near, similarity`` over those reps: for each (or each with a member for which ``ask`` holds) its ``k``
    nearest, or with ``least`` all found that are at least so similar. ``probes`` None searches every shard. Rows
    with a null ident, or a null, zero, NaN or wrongly long vector have none; repeated rows count once; a row with
    several vectors is looked up by each. Every vector is indexed, none is sampled away.
    """
    members = cut(classes(rows, ident, vec, dim))
    asked = members.where(ask if ask is not None else F.lit(True)).select(F.col("rep")).distinct() if ask is not None else None
    vecs = rows.where(F.col(ident).isNotNull() & usable(F.col(vec), dim)).select(F.col(ident).cast("long").alias("row"), F.col(vec).alias("vec"), F.xxhash64(vec).alias("h1"), F.xxhash64(F.lit(1), vec).alias("h2"))
    reps = vecs.join(members.where("row = rep").select("row", "h1", "h2"), ["row", "h1", "h2"]).groupBy(F.col("row"), "h1", "h2").agg(F.first("vec").alias("vec"))
    # a row that stands first for several vectors needs a name for each
    reps = reps.select(F.col("row").alias("rep"), "vec").withColumn("ask", F.lit(True))
    if asked is not None:
        reps = reps.drop("ask").join(asked.withColumn("ask", F.lit(True)), "rep", "left").withColumn("ask", F.coalesce("ask", F.lit(False)))
    reps = cut(reps)
    count = reps.count()
    n = max(1, min(MOST_PIVOTS, round(count / shard_rows)))
    centre = _pivots(reps, dim, count, n) if n > 1 else np.zeros((1, dim), dtype=np.float32)
    n = len(centre) or 1
    routed = cut(reps.mapInArrow(_route(centre, dim, min(probes or n, n)), "rep long, vec array<float>, ask boolean, cells array<int>"))
    homes = {r[0]: r[1] for r in routed.groupBy(F.element_at("cells", 1)).count().collect()}  # one row for each cell
    asks = {r[0]: r[1] for r in routed.where("ask").select(F.explode("cells").alias("c")).groupBy("c").count().collect()}
    parts = [max(1, -(-4 * homes.get(c, 0) // (5 * shard_rows))) for c in range(n)]
    blocks = [max(1, -(-asks.get(c, 0) // QUERY_ROWS)) for c in range(n)]
    of = lambda values, c: F.element_at(F.array(*(F.lit(v) for v in values)), c + 1) if len(set(values)) > 1 else F.lit(values[0])
    h = F.xxhash64("rep", F.lit(9))
    home = routed.select("rep", "vec", F.element_at("cells", 1).alias("cell"), h.alias("h"))
    index = home.select("rep", "vec", "cell", F.pmod("h", of(parts, F.col("cell"))).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), of(blocks, F.col("cell")) - 1)).alias("block"), F.lit(False).alias("ask"))
    query = routed.where("ask").select("rep", "vec", F.explode("cells").alias("cell"), h.alias("h"))
    query = query.select("rep", "vec", "cell", F.explode(F.sequence(F.lit(0), of(parts, F.col("cell")) - 1)).alias("part"), F.pmod(F.shiftright("h", 20), of(blocks, F.col("cell"))).cast("int").alias("block"), F.lit(True).alias("ask"))
    found = index.unionByName(query).groupBy("cell", "part", "block").applyInArrow(_search(dim, k, least, m, ef), "row long, near long, similarity double")
    if least is None:
        best = found.groupBy("row", "near").agg(F.max("similarity").alias("similarity")).withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("similarity"), "near")))
        return best.where(F.col("rank") <= k), members
    return found.groupBy("row", "near").agg(F.max("similarity").alias("similarity")), members


def similar_rows(rows: DataFrame, ident: str, vec: str, least: float, dim: int = 64) -> DataFrame:
    """``a, b, similarity``: pairs of different rows with a cosine of at least ``least``, the smaller ident first.

    A pair is found from either end. Rows with the very same vector are pairs of similarity 1; of more than
    ``EXPAND`` of them each is paired with the first only.
    """
    near, members = nearest(rows, ident, vec, k=7, dim=dim, least=least, probes=CLOSE_PROBES, ef=NARROW)
    pairs = near.select(F.least("row", "near").alias("a"), F.greatest("row", "near").alias("b"), "similarity").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    multi = members.where("rows > 1").select("row", "rep", "rows").distinct()
    few, other = multi.where(f"rows <= {EXPAND}"), F.col("y.row")
    within = few.alias("x").join(few.select("rep", "row").alias("y"), "rep").where(F.col("x.row") < other).select(F.col("x.row").alias("a"), other.alias("b"))
    huge = multi.where(f"rows > {EXPAND} and row <> rep").select(F.col("rep").alias("a"), F.col("row").alias("b"))
    out = pairs
    for side in ("a", "b"):
        out = out.join(few.select(F.col("rep").alias(side), F.col("row").alias("copy")), side, "left").withColumn(side, F.coalesce("copy", side)).drop("copy")
    same = within.union(huge).select("a", "b", F.lit(1.0).alias("similarity"))
    both = out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").unionByName(same).where("a < b")
    return both.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
