"""Helpers that every operator shares: table access, lineage cuts and guarded broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Most rows a side may have, counted, before it is broadcast.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, as a lazy Parquet scan (filters and column pruning reach the files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one the session names, or a local one set here if it names none.

    On a cluster ``spark.checkpoint.dir`` has to name storage that all executors share; it is an error if it is unset.
    Only on one machine (a ``local`` master) a temporary folder is used instead.
    """
    jsc = spark.sparkContext._jsc.sc()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "cookwright-checkpoints"))
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and go on from there.

    A lost executor then costs a re-read instead of the whole lineage, and results with a partition id
    in them stay the same however often they are read.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like :func:`cut`, as a Parquet table in the same folder: smaller on disk, and read by column.

    Row order and partitions may change. The table is dropped by :func:`release`, or when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STORED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_STORED: list[tuple[SparkSession, str]] = []


def release() -> None:
    """Drop all stored tables. For long sessions, once the results made from them are written: they can't be read then."""
    while _STORED:
        _drop(*_STORED.pop())


atexit.register(release)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended before
        pass


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores: only where it has fewer partitions than there are cores, as small files do, is it shuffled."""
    width = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(width) if df.rdd.getNumPartitions() < width else df


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have at most ``limit`` rows, otherwise as it is.

    Beyond the limit the join that uses it is planned as a shuffled one; the result is the same.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_index(df: DataFrame, name: str, first: int = 0) -> DataFrame:
    """``df`` with a contiguous index in its present order, without gathering it in one task.

    The rows are materialised, numbered within their partition, and shifted by the sizes of the partitions before.
    """
    kept = cut(df).withColumn("_m", F.monotonically_increasing_id())
    kept = kept.withColumn("_p", F.shiftright("_m", 33)).withColumn("_k", F.col("_m").bitwiseAND((1 << 33) - 1))
    at, offsets = first, []
    for p, n in sorted((r[0], r[1]) for r in kept.groupBy("_p").count().collect()):  # one row for each partition
        offsets.append((p, at))
        at += n
    if not offsets:
        return kept.select(*df.columns, F.col("_k").alias(name))
    shift = F.broadcast(df.sparkSession.createDataFrame(offsets, "_p long, _o long"))
    return kept.join(shift, "_p").select(*df.columns, (F.col("_k") + F.col("_o")).alias(name))


def offsets(kept: DataFrame, group: list[str], split: str, at: str, name: str) -> DataFrame:
    """``group, split, name``: what to add to ``at`` for an index from 0 within each group, in the order of ``split``.

    ``kept`` is materialised and ``at`` a monotonically increasing id on it, gap-free within a task. Each split, as the
    blocks of text files are, is held whole and in order by one task; only the splits' sizes, one row each, are summed up.
    """
    sizes = kept.groupBy(*group, split).agg(F.min(at).alias("_a"), F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy(split).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(*group, split, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_a")).alias(name))
