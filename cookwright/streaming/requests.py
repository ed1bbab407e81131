"""Answering a stream of search requests, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from cookwright.functions.query_text import from_ingredients, interpret
from cookwright.operators.index import RecipeIndex
from cookwright.operators.rank import Request, search


def read_requests(rows: DataFrame, limit: int = 10) -> list[Request]:
    """The requests of a bounded batch: ``request_id, query_text, ingredients, max_results, search_mode``; rows with
    neither a text nor ingredients are left out, a repeated id counts once."""
    out = {}
    for r in rows.select("request_id", "query_text", "ingredients", "max_results", "search_mode").collect():
        if r.ingredients or r.query_text:
            q = from_ingredients(list(r.ingredients)) if r.ingredients else interpret(r.query_text)
            mode = r.search_mode if r.search_mode in ("hybrid", "lexical", "semantic") else "hybrid"
            out.setdefault(r.request_id, Request(r.request_id, q, mode, min(50, max(1, r.max_results or limit))))
    return [out[k] for k in sorted(out)]


def answer_stream(requests: DataFrame, index: RecipeIndex, sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that hands each micro-batch's ranked results to ``sink``; its number makes retries idempotent."""

    def answer(batch: DataFrame, epoch: int) -> None:
        asked = read_requests(batch)
        if asked:
            sink(search(index, asked), epoch)

    return requests.writeStream.foreachBatch(answer)
