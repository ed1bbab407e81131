"""All similar pairs between set-valued records: a size-aware overlap join.

Exact copies of a set are collapsed first. Tokens that only one set has can't be shared and are dropped, with
their number remembered. Small sets list subsets of as many tokens as any pair has to share (taken from the
rarest tokens that a pair must meet in); large sets, which would have too many subsets, scan inverted lists of
their rarest tokens. Both kinds of candidates are verified with the exact similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cookwright.plans.frames import cut

#: A set with more subsets than this is large and scans inverted lists instead.
MOST_SUBSETS = 2_000
#: Copies of one set that are expanded to all their pairs; a larger group gives pairs with its first row only.
EXPAND = 1_000


def line_set(lines: Column) -> Column:
    """The distinct lines, lower-cased, trimmed, with runs of spaces made one; nulls and empty lines left out."""
    clean = F.transform(lines, lambda x: F.regexp_replace(F.trim(F.lower(x)), " +", " "))
    return F.array_distinct(F.filter(clean, lambda x: x.isNotNull() & (x != "")))


def _hashed(rows: DataFrame, ident: str, lines: str, least: int) -> DataFrame:
    """``row, size, hashes, h1, h2`` of each row with at least ``least`` tokens; h1 and h2 know the set."""
    sets = rows.select(F.col(ident).alias("row"), line_set(F.col(lines)).alias("tokens")).where(F.size("tokens") >= least)
    hashed = sets.select("row", F.size("tokens").alias("size"), F.array_sort(F.transform("tokens", lambda x: F.xxhash64(x))).alias("hashes"))
    return hashed.select("*", F.xxhash64("hashes").alias("h1"), F.xxhash64(F.lit(1), "hashes").alias("h2"))


def _own(size: int, percent: int, least_shared: int) -> int:
    """Tokens that a set of this size shares at least with any similar set."""
    return max(least_shared, -(-size * percent // 100))


def _signatures(least_shared: int, percent: int):
    """Arrow batches of sets to ``row, sig``: the hashes of the subsets of small sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, tokens = (c.to_pylist() for c in batch.columns)
            by: dict[tuple[int, int], list[int]] = {}
            for i, (n, ts) in enumerate(zip(sizes, tokens)):
                by.setdefault((n, len(ts)), []).append(i)
            out_row, out_sig = [], []
            for (n, have), at in by.items():
                reach = have - _own(n, percent, least_shared) + least_shared
                if reach < least_shared:
                    continue
                m = np.array([tokens[i][:reach] for i in at], dtype=np.int64).view(np.uint64)
                m = (m ^ (m >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)  # sums of plain hashes would be too regular
                picks = np.array(list(combinations(range(reach), least_shared)))
                with np.errstate(over="ignore"):
                    sums = m[:, picks].sum(axis=2, dtype=np.uint64)
                out_sig.append(sums.view(np.int64).ravel())
                out_row.append(np.repeat(np.array([rows[i] for i in at], dtype=np.int64), len(picks)))
            if out_sig:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_row)), pa.array(np.concatenate(out_sig))], names=["row", "sig"])

    return run


def similar_sets(rows: DataFrame, ident: str, lines: str, percent: int = 60, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """Similar classes of equal sets, and who is in them.

    Returns ``(pairs, members)``: ``pairs`` has ``a, b, shared, either`` for each two different sets with
    ``100 * shared >= percent * either`` (``a`` and ``b`` are the smallest idents that hold them, ``a < b``), and
    ``members`` has ``row, rep, size, rows`` for every row whose set has at least ``least`` tokens. Rows with a null array,
    or fewer tokens, take no part; a repeated ident counts once. Exact at every size: no cap on list lengths,
    partners or candidates. Shuffles hashed tokens only, never texts.
    """
    keyed = cut(_hashed(rows, ident, lines, least))
    first = keyed.groupBy("h1", "h2", "size").agg(F.min("row").alias("rep"), F.count("*").alias("rows"))
    members = keyed.select("row", "h1", "h2", "size").join(first, ["h1", "h2", "size"]).groupBy("row").agg(F.min(F.struct("rep", "size", "rows")).alias("m")).select("row", "m.rep", "m.size", "m.rows")
    members = cut(members)
    reps = keyed.join(members.where("row = rep").select("row"), "row").groupBy(F.col("row").alias("rep")).agg(F.min_by(F.struct("size", "hashes"), F.struct("h1", "h2")).alias("s")).select("rep", "s.*")
    tokens = reps.select("rep", F.explode("hashes").alias("t"))
    often = tokens.groupBy("t").count().where("count > 1")
    # only what several sets have; the rarest first, ties by hash, the same order in every set
    kept = tokens.join(often, "t").groupBy("rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("count", "t"))), lambda x: x.t).alias("tokens"))
    least_shared = max(1, -(-2 * least * percent // (100 + percent)))
    own = F.greatest(F.lit(least_shared), F.ceil(F.col("size") * percent / 100).cast("int"))
    cand = cut(kept.join(reps.select("rep", "size"), "rep").where(F.size("tokens") >= own))
    bound = max(n for n in range(least_shared, 200) if comb(n, least_shared) <= MOST_SUBSETS)
    reach = F.size("tokens") - own + least_shared
    sigs = cand.where(reach <= bound).select("rep", "size", "tokens").mapInArrow(_signatures(least_shared, percent), "row long, sig long")
    small_pairs = sigs.alias("x").join(sigs.alias("y"), (F.col("x.sig") == F.col("y.sig")) & (F.col("x.row") < F.col("y.row"))).select(F.col("x.row").alias("a"), F.col("y.row").alias("b"))
    # a large set against all: a similar pair meets in one of the rarest (have - own + 1) tokens of both
    prefix = cand.select("rep", (reach > bound).alias("large"), F.explode(F.slice("tokens", F.lit(1), F.size("tokens") - own + 1)).alias("t"))
    large_pairs = (
        prefix.where("large").alias("x")
        .join(prefix.alias("y"), (F.col("x.t") == F.col("y.t")) & (F.col("x.rep") != F.col("y.rep")))
        .select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
    )
    found = small_pairs.union(large_pairs).distinct()
    left, right = (cand.select(F.col("rep").alias(k), F.col("size").alias(f"n{k}"), F.col("tokens").alias(f"t{k}")) for k in "ab")
    shared = found.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("ta", "tb")).alias("shared"), (F.col("na") + F.col("nb")).alias("both"))
    pairs = shared.select("a", "b", "shared", (F.col("both") - F.col("shared")).alias("either")).where(F.col("shared") * 100 >= F.col("either") * percent)
    return pairs, members


def linked_classes(rows: DataFrame, ident: str, lines: str, percent: int = 60, least: int = 5) -> DataFrame:
    """``row, rep, size, rows, links``: one row for each row with a set: its class of equal sets (the smallest ident that
    holds the set), the set's size, the rows of the class, and the number of other classes similar to it."""
    pairs, members = similar_sets(rows, ident, lines, percent, least)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return members.join(ends, "rep", "left").select("row", "rep", "size", "rows", F.coalesce("links", F.lit(0)).alias("links"))


def similar_rows(rows: DataFrame, ident: str, lines: str, percent: int = 60, least: int = 5) -> DataFrame:
    """``a, b, shared, either``: the similar pairs as pairs of rows, copies included, the smaller ident first.

    Of a group of more than ``EXPAND`` copies of one set, each copy is paired with the group's first row only
    (and with the first rows of similar sets); :func:`similar_sets` gives those groups whole, as classes.
    """
    pairs, members = similar_sets(rows, ident, lines, percent, least)
    multi = members.where("rows > 1").select("row", "rep", "size", "rows")
    few, other = multi.where(f"rows <= {EXPAND}"), F.col("y.row")
    within = few.alias("x").join(few.select("rep", "row").alias("y"), "rep").where(F.col("x.row") < other).select(F.col("x.row").alias("a"), other.alias("b"), "size")
    huge = multi.where(f"rows > {EXPAND} and row <> rep").select(F.col("rep").alias("a"), F.col("row").alias("b"), "size")
    same = within.union(huge).select("a", "b", F.col("size").alias("shared"), F.col("size").alias("either"))
    out = pairs
    for side in ("a", "b"):  # a class of one row needs no expansion: the left join keeps it as it is
        grown = few.select(F.col("rep").alias(side), F.col("row").alias("copy"))
        out = out.join(grown, side, "left").withColumn(side, F.coalesce("copy", side)).drop("copy")
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared", "either").unionByName(same)
