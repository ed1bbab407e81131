"""Evaluation texts leaking into a corpus, found by pigeonhole matching of pieces and bit-parallel verification.

A stretch of ``window`` words of a test item with at most ``errors`` word edits holds one of ``errors + 1`` pieces
unchanged. Every item is cut into pieces so short that any stretch holds that many whole ones; the documents are
searched for all pieces at once with an automaton, and each hit is verified with Myers' bit-parallel distance.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cookwright.plans.frames import spread

#: Words of a stretch that counts as a leak.
WINDOW = 13
#: Most items, and characters of items, that are sought in one scan of the texts: a bound on what is broadcast. More items
#: take more scans, each at the price of reading the texts (at 1,000 characters an item, a million take 32).
BLOCK, BLOCK_CHARS = 20_000, 32_000_000
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, case folded."""
    return _WORD.findall(text.casefold()) if text else []


def piece_length(window: int, errors: int) -> int:
    """Words of a piece, such that any ``window`` words hold ``errors + 1`` whole pieces of a text cut from its start.

    A stretch that begins just after a cut loses ``length - 1`` words, so ``(errors + 2) * length - 1 <= window``.
    """
    return max(1, (window + 1) // (errors + 2))


def myers(pattern: list[str], text: list[str]) -> list[int]:
    """Least edit distance between the pattern and a stretch of the text that ends at each of its words.

    Myers' bit-parallel algorithm over words: one step for each word of the text, whatever the pattern's length.
    """
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        where[w] |= 1 << i
    plus, minus, score, out = mask, 0, m, []
    for w in text:
        eq = where.get(w, 0)
        x = eq | minus
        d = ((((x & plus) + plus) ^ plus) | x) & mask
        up, down = minus | ~(d | plus) & mask, plus & d
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & mask, (down << 1) & mask
        plus, minus = down | ~(d | up) & mask, up & d
        out.append(score)
    return out


class Matcher:
    """The pieces of a block of items, and the verification of their hits."""

    def __init__(self, items: list[tuple[int, str]], window: int, errors: int) -> None:
        self.items = [(k, ws) for k, t in items if len(ws := words(t)) >= window]
        self.window, self.errors = window, errors
        size = piece_length(window, errors)
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, ws) in enumerate(self.items):
            for i in range(0, len(ws) - size + 1, size):
                at[" ".join(ws[i : i + size])].append((k, i))
        self.auto = ahocorasick.Automaton()
        for piece, places in at.items():
            self.auto.add_word(f" {piece} ", places)
        if at:
            self.auto.make_automaton()
        self.some = bool(at)

    def find(self, text: str | None) -> dict[int, int]:
        """Item to least number of errors over its stretches, for the items with a stretch within the budget."""
        ws = words(text)
        if not self.some or len(ws) < self.window - self.errors:
            return {}
        joined = " " + " ".join(ws) + " "
        hits = [(last, k, i) for last, places in self.auto.iter(joined) for k, i in places]
        found: dict[int, int] = {}
        if not hits:
            return found
        ends, n = {}, 0
        for j, w in enumerate(ws):
            ends[n := n + len(w) + 1] = j  # the blank after word j
        length = piece_length(self.window, self.errors)
        for last, k, i in hits:
            ident, item = self.items[k]
            if found.get(ident) != 0:
                best = self._verify(item, ws, i, ends[last] - length + 1, length)
                if best <= self.errors:
                    found[ident] = min(best, found.get(ident, best))
        return found

    def _verify(self, item: list[str], ws: list[str], i: int, j: int, length: int) -> int:
        """Least distance of any stretch of the item around word i to the text around word j."""
        best = self.errors + 1
        for start in range(max(0, i + length - self.window), min(i, len(item) - self.window) + 1):
            near = ws[max(0, j - (i - start) - self.errors) : j - (i - start) + self.window + self.errors]
            best = min(best, min(myers(item[start : start + self.window], near), default=best))
            if best == 0:
                break
        return best


_LAST: list = []


def _matcher(block: list[tuple[int, str]], window: int, errors: int) -> Matcher:
    """The matcher of a block; the last one is kept, so a worker that scans on makes it once."""
    if not (_LAST and _LAST[0] is block and _LAST[1:3] == [window, errors]):
        _LAST[:] = [block, window, errors, Matcher(block, window, errors)]
    return _LAST[3]


def leaks(documents: DataFrame, doc: str, text: str, items: DataFrame, item: str, passage: str, window: int = WINDOW, errors: int = 0) -> DataFrame:
    """``doc, item, errors``: each document with each item of which it holds ``window`` words within ``errors`` edits.

    Edits are words inserted, left out or replaced; words are runs of letters and digits, case ignored. The items
    are the query set: they are read to the driver in blocks of ``BLOCK``, each searched against all documents.
    Null or short passages and null or empty texts match nothing; repeated documents and items give their rows
    once. Texts are read whole, once for each block; nothing but the hits is shuffled.
    """
    wanted = items.select(F.col(item).cast("long"), passage).where(F.col(passage).isNotNull()).distinct().orderBy(item, passage)
    texts = spread(documents.select(F.col(doc).cast("long").alias(doc), F.col(text).alias("t")).where("t is not null"))
    ddl = f"{doc} long, {item} long, errors int"
    out, block, size = None, [], 0

    def search(block: list[tuple[int, str]]) -> DataFrame:
        shared = documents.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared.value, window, errors)
            for batch in batches:
                rows = [(d, k, n) for d, t in zip(*(c.to_pylist() for c in batch.columns)) for k, n in matcher.find(t).items()]
                if rows:
                    a, b, c = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int32())], names=[doc, item, "errors"])

        return texts.mapInArrow(run, ddl)

    for r in wanted.toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1])
        if len(block) == BLOCK or size >= BLOCK_CHARS:
            out, block, size = search(block) if out is None else out.unionByName(search(block)), [], 0
    if block or out is None:
        out = search(block) if out is None else out.unionByName(search(block))
    return out.groupBy(doc, item).agg(F.min("errors").alias("errors"))
