"""Mixing sources to target weights by tokens, with capped repeats.

Every record gets a hash-random key. Records are range-sorted by that key within their source, prefix sums of their
tokens are built from bucket totals, and each source is cut where its budget ends; small sources are repeated whole
before that, at most as often as they may.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cookwright.plans.frames import cut, small, spread

#: The public vocabulary whose tokens are counted; a path on every worker.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split into words that belongs to it (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Records of a bucket, about; a bucket is the unit in which a source is sorted.
BUCKET_ROWS = 20_000
#: Characters of a piece of text that is encoded at once; texts are cut between words.
_CHUNK = 50_000


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(path)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["id", "source", "tokens"])

    return run


def token_counts(records: DataFrame, ident: str, source: Column, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``id, source, tokens`` of each record; a null or empty text has none. No shuffle."""
    return spread(records.select(F.col(ident).cast("long").alias("id"), source.alias("source"), F.col(text).alias("t"))).mapInArrow(_count(vocabulary), "id long, source string, tokens long")


def source_name(source: Column) -> Column:
    """A source by one spelling: lower case, blanks and hyphens as underscores."""
    return F.regexp_replace(F.trim(F.lower(source)), "[ -]+", "_")


def mix(counts: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Draw records so that each source has its share of ``total`` tokens.

    ``counts`` has ``id, source, tokens``; ``targets`` has ``source, target_share, max_repeats`` (repeated names are
    added up, with their largest cap). Returns ``(drawn, shares)``. ``drawn`` has ``id, source, tokens, repeats``
    for every record used at least once; ``shares`` has one row for each target: ``source, target_share, budget,
    available, tokens, share, of_total, capped``. ``total`` defaults to the tokens of all records, those without a
    target too. A source is used in whole epochs and then cut at the record boundary nearest to its budget; a source
    whose cap binds is used ``max_repeats`` times and marked. ``share`` is the share of all tokens drawn, ``of_total``
    that of ``total``. Sources without a target (a null source too) and records without tokens are not drawn; a target
    without records has a share of 0. A repeated ``id`` counts each time.

    Buckets are ranges of the random keys, so a source of any size is split evenly and sorted in pieces; only bucket
    totals and targets, both small, are joined in. Their number grows with the rows over ``BUCKET_ROWS``.
    """
    wanted = targets.where("source is not null and target_share > 0").select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    wanted = small(wanted.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats")))
    counts = cut(counts.where("tokens > 0"))
    rows = counts.join(wanted.select("source"), "source")
    everything = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0] if total is None else int(total)
    size = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("available"))
    size = cut(size)  # one row for each source
    goal = F.lit(everything)
    plan = wanted.join(size, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("available", F.lit(0)).alias("available"), goal.alias("total"))
    budget = F.floor(F.col("target_share") * F.col("total"))
    plan = plan.withColumn("budget", budget).withColumn("use", F.least(F.col("budget"), F.col("available") * F.col("max_repeats")))
    plan = small(cut(plan.withColumn("epochs", F.when(F.col("available") > 0, F.floor(F.col("use") / F.col("available"))).otherwise(0)).withColumn("rest", F.col("use") - F.col("epochs") * F.col("available"))))
    key = F.xxhash64(F.lit(seed), "id", "source")
    # the top bits of the key choose the bucket: buckets are in key order, and even however large the source
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET_ROWS))
    keyed = rows.join(plan.select("source", "n", "epochs", "rest"), "source").withColumn("key", key).withColumn("bucket", F.floor((F.shiftrightunsigned("key", 11) / F.lit(float(1 << 53))) * buckets).cast("int"))
    within = Window.partitionBy("source", "bucket").orderBy(F.shiftrightunsigned("key", 1), "key", "id", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = keyed.withColumn("upto", F.sum("tokens").over(within))
    totals = keyed.groupBy("source", "bucket").agg(F.sum("tokens").alias("bucket_tokens"))
    before = totals.select("source", "bucket", (F.sum("bucket_tokens").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("bucket_tokens")).alias("before"))
    drawn = summed.join(before, ["source", "bucket"]).withColumn("repeats", F.col("epochs") + (2 * (F.col("before") + F.col("upto")) - F.col("tokens") <= 2 * F.col("rest")).cast("long"))
    drawn = drawn.where("repeats > 0").select("id", "source", "tokens", F.col("repeats").cast("int").alias("repeats"))
    reached = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
    both = plan.join(reached, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    share = F.col("tokens") / F.greatest(F.sum("tokens").over(Window.partitionBy()), F.lit(1))
    shares = both.select("source", F.round("target_share", 6).alias("target_share"), "budget", "available", "tokens", F.round(share, 6).alias("share"), F.round(F.col("tokens") / F.greatest(F.col("total"), F.lit(1)), 6).alias("of_total"), (F.col("use") < F.col("budget")).alias("capped"))
    return drawn, shares
