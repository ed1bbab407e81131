import datetime as dt
import random
from collections import defaultdict

from pyspark.sql import functions as F

from cookwright.functions import query_text as Q
from cookwright.operators.index import RecipeIndex
from cookwright.streaming.limiter import limited, limited_stream
from cookwright.streaming.requests import answer_stream

T0 = dt.datetime(2025, 1, 1)


def plain(events, client_limit, global_limit):
    kept, by = [], defaultdict(list)
    out = {}
    for k, c, t in sorted(events, key=lambda e: (e[2], e[0])):
        s = (t - T0).total_seconds()
        every = [x for x in kept if x > s - 60]
        mine = [x for x in by[c] if x > s - 60]
        ok = len(mine) < client_limit and (global_limit is None or len(every) < global_limit)
        if ok:
            kept.append(s)
            by[c].append(s)
        out[k] = ok
    return out


def events():
    rng = random.Random(4)
    return [(k, f"c{rng.randrange(4)}", T0 + dt.timedelta(seconds=rng.randrange(400))) for k in range(200)]


def test_limits_equal_plain_loops(spark):
    df = spark.createDataFrame(events(), "id long, client string, ts timestamp")
    for g in (None, 12):
        assert {r.id: r.allowed for r in limited(df, "id", "client", "ts", 5, g).collect()} == plain(events(), 5, g)
    assert not any(r.allowed for r in limited(df, "id", "client", "ts", 0, None).collect())
    odd = spark.createDataFrame([(1, None, T0), (2, "a", None)], "id long, client string, ts timestamp")
    assert {r.id: r.allowed for r in limited(odd, "id", "client", "ts", 5, None).collect()} == {1: True, 2: False}
    assert limited(df.limit(0), "id", "client", "ts").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(events(), "id long, client string, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = limited_stream(s, "id", "client", "ts").writeStream.format("memory").queryName("limits").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert {r.id: r.allowed for r in spark.table("limits").collect()} == plain(events(), 5, None)


def test_requests_of_a_stream(spark, tmp_path):
    recipes = spark.createDataFrame([(0, "Cod Curry", ["cod", "coconut milk"], None), (1, "Apple Pie", ["apples"], None)], "row_ix long, name string, ingredients array<string>, description string")
    index = RecipeIndex.build(recipes)
    schema = "request_id long, query_text string, ingredients array<string>, max_results int, search_mode string"
    spark.createDataFrame([(1, "cod curry", None, 3, "hybrid"), (2, None, ["apples"], None, "odd"), (3, None, None, None, None)], schema).write.parquet(str(tmp_path / "q"))
    seen = []
    q = answer_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "q")), index, lambda df, n: seen.extend((r.request_id, r.rank, r.row_ix) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {(1, 1, 0), (2, 1, 1)} <= set(seen) and Q.interpret("cod curry").ingredients and F
