"""Rate limits over events: at most so many admitted within the trailing minute, for each client and in all."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _admit(seconds: float, mine: deque, every: deque | None, client_limit: int, global_limit: int | None) -> bool:
    for q in (mine, every):
        while q and q[0] <= seconds - 60:
            q.popleft()
    if client_limit == 0 or global_limit == 0 or len(mine) >= client_limit or (every is not None and len(every) >= global_limit):
        return False
    mine.append(seconds)
    if every is not None:
        every.append(seconds)
    return True


def limited(events: DataFrame, ident: str, client: str, ts: str, client_limit: int = 5, global_limit: int | None = 20) -> DataFrame:
    """``ident, client, ts, allowed``: whether each event is admitted. Only admitted events use up a limit.

    Events count in the order of time, then ident; a limit of 0 admits none; a null client is a client like others;
    events without a time are refused. Without a global limit, clients are spread over the cluster and each
    partition is one pass in order, so a client of any size never sits in memory. A global limit orders all events
    against each other. A minute without any event makes what follows independent of what was before, so the sequence is
    cut there and the pieces are spread; without such gaps it is by definition one pass in one task, with bounded state.
    """
    cols = events.select(F.col(ident).alias("ident"), F.col(client).cast("string").alias("client"), F.col(ts).alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    if global_limit is not None:
        minute = F.floor(F.col("us") / 60_000_000)
        # one row for each minute that has events
        apart = (F.col("minute") - F.lag("minute", 1).over(Window.orderBy("minute")) > 1).cast("int")
        pieces = cols.select(minute.alias("minute")).where("minute is not null").distinct().select("minute", F.coalesce(apart, F.lit(0)).alias("apart"))
        pieces = pieces.select("minute", F.sum("apart").over(Window.orderBy("minute")).alias("piece"))
        cols = cols.withColumn("minute", minute).join(pieces, "minute", "left").drop("minute").withColumn("piece", F.coalesce("piece", F.lit(-1)))
        spread, lead = cols.repartition("piece"), ["piece"]
    else:
        cols = cols.withColumn("piece", F.lit(0))
        spread, lead = cols.repartition(F.coalesce("client", F.lit(""))), [F.asc_nulls_first("client")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = deque() if global_limit is not None else None
        clients: dict = defaultdict(deque)
        last = piece = None
        for pdf in batches:
            allowed = []
            for c, us, now in zip(pdf.client, pdf.us, pdf.piece):
                key = None if pd.isna(c) else c
                if now != piece:  # nothing of the piece before counts any more
                    clients.clear()
                    if every is not None:
                        every.clear()
                    piece = now
                if every is None and key != last:
                    clients.clear()  # sorted by client: the one before is done
                    last = key
                elif every is not None and len(clients) > 100_000:
                    for k in [k for k, q in clients.items() if not q or q[-1] <= us / 1e6 - 60]:
                        del clients[k]
                allowed.append(bool(not pd.isna(us) and _admit(us / 1e6, clients[key], every, client_limit, global_limit)))
            yield pdf[["ident", "client", "ts"]].assign(allowed=allowed)

    kind = dict(events.dtypes)
    out = spread.sortWithinPartitions(*lead, F.asc_nulls_first("us"), "ident").mapInPandas(run, f"ident {kind[ident]}, client string, ts {kind[ts]}, allowed boolean")
    return out.select(F.col("ident").alias(ident), F.col("client").alias(client), F.col("ts").alias(ts), "allowed")


def limited_stream(events: DataFrame, ident: str, client: str, ts: str, client_limit: int = 5) -> DataFrame:
    """The limit for each client over a stream: state is the admitted times of the last minute, at most the limit.

    Events of a micro-batch are taken in order of time. A client that is silent keeps its few times in the state store.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mine = deque(state.get[0]) if state.exists else deque()
        pdf = pd.concat(list(frames)).sort_values(["us", "ident"])
        allowed = [_admit(us / 1e6, mine, None, client_limit, None) for us in pdf.us]
        state.update((list(mine),))
        yield pdf[["ident", "client", "us"]].assign(allowed=allowed)

    cols = events.select(F.col(ident).alias("ident"), F.coalesce(F.col(client).cast("string"), F.lit("")).alias("client"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us")).where("us is not null")
    kind = dict(events.dtypes)[ident]
    out = cols.groupBy("client").applyInPandasWithState(step, f"ident {kind}, client string, us long, allowed boolean", "times array<double>", "append", GroupStateTimeout.NoTimeout)
    return out.select(F.col("ident").alias(ident), F.col("client").alias(client), F.timestamp_micros("us").alias(ts), "allowed")
