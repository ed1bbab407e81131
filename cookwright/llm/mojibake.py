"""Text garbled by a wrong character encoding: find it, name the chain of encodings, restore the original.

A multinomial classifier over hashed bigrams of bytes is trained on sound records that are garbled on purpose,
one class for each chain of encodings and one for sound text. Its prediction for a piece of text is inverted and
has to decode strictly; if it doesn't, the next most likely class is tried.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cookwright.functions.encoding import CHAINS, LOST, MULTI, garble, invert
from cookwright.plans.frames import spread

SOUND = "sound"
CLASSES = (SOUND, *CHAINS)
BUCKETS = 1 << 15
#: Records from which the classifier learns what sound text looks like: a bound on what the driver reads.
TRAINING_ROWS = 6_000
#: Log-odds that a chain between one-byte pages needs over sound text, as any text could be its result.
MARGIN = 2.0
#: Times that the word a chain of one-byte pages leads to has to be as frequent as what stands there.
USUAL = 8
#: Places of either table of word counts; a word's count is the lesser of its two places.
BUCKETS_OF_WORDS = 1 << 20
#: A run without ASCII white space that holds another character; other white space may be part of the damage.
_PIECE = re.compile(r"(?<![^ \t\n\r\f\v])[!-~\x00-\x08\x0e-\x1f\x7f]*+[^\x00-\x7f][^ \t\n\r\f\v]*")
_EDGES = re.compile(r"^[^\w¡¿½¼¾⅓⅔]+|[^\w½¼¾⅓⅔]+$")
_CONTROL = re.compile("[\x80-\x9f]")


def _features(piece: str) -> np.ndarray:
    b = np.frombuffer(f" {piece} ".encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.int64)
    two = b[:-1] * 257 + b[1:]
    three = (b[:-2] * 257 + b[1:-1]) * 257 + b[2:]
    return np.concatenate([two % BUCKETS, (three * 2_654_435_761 >> 7) % BUCKETS])


def _word(piece: str) -> str:
    return _EDGES.sub("", piece).lower()


def _places(word: str) -> tuple[int, int]:
    h = xxhash.xxh64_intdigest(word)
    return h % BUCKETS_OF_WORDS, BUCKETS_OF_WORDS + (h >> 32) % BUCKETS_OF_WORDS


class WordCounts:
    """How often words stand in all texts: two hashed tables of fixed size, whose lesser entry counts. Never too low, and
    too high only where a word meets others in both."""

    def __init__(self, counts: np.ndarray | None = None) -> None:
        self.counts = np.zeros(2 * BUCKETS_OF_WORDS, dtype=np.int64) if counts is None else counts

    def add(self, word: str, n: int = 1) -> None:
        for at in _places(word):
            self.counts[at] += n

    def __getitem__(self, word: str) -> int:
        return int(min(self.counts[at] for at in _places(word)))


@dataclass(frozen=True)
class ChainModel:
    """Log-likelihoods of the hashed bigrams under each class, the characters of sound text, and how often its words stand."""

    weights: np.ndarray
    alphabet: frozenset
    words: WordCounts

    def ranked(self, piece: str) -> list[tuple[float, str]]:
        """Classes by likelihood, the best first, with their log-odds over sound text."""
        score = self.weights[:, _features(piece)].sum(axis=1)
        return [(float(score[k] - score[0]), CLASSES[k]) for k in np.argsort(-score, kind="stable")]

    def restore(self, piece: str) -> tuple[str | None, str]:
        """The chain that garbled a piece (None if it is sound) and the piece before; ``lost`` can't be restored.

        A multi-byte chain counts where its sequences decode strictly; chains whose result has only familiar
        characters go before the others. A chain of one-byte pages fits any text, so besides the odds its result
        has to be a word that the records have, far more often than the word as it stands.
        """
        if LOST in piece:
            return "lost", piece
        second = None
        for odds, chain in self.ranked(piece):
            if chain == SOUND:
                continue
            if chain.startswith("utf-8"):
                out = invert(piece, chain) if odds > 0 or self._foreign(piece) else None
                if out is not None:
                    if self._familiar(out):
                        return chain, out
                    second = second or (odds > 0 and (chain, out)) or None
            elif odds >= MARGIN:
                out = invert(piece, chain)
                if out is not None and self.words[_word(out)] > USUAL * self.words[_word(piece)]:
                    return chain, out
        if second:
            return second
        return ("lost", piece) if _CONTROL.search(piece) else (None, piece)

    def sound(self, piece: str) -> bool:
        """Whether a piece has only familiar characters and no multi-byte chain explains it."""
        return LOST not in piece and not _CONTROL.search(piece) and self._familiar(piece) and all(invert(piece, c) is None for c in MULTI)

    def _foreign(self, piece: str) -> bool:
        return any(ord(c) > 127 and c not in self.alphabet for c in piece)

    def _familiar(self, piece: str) -> bool:
        return all(ord(c) < 128 or c in self.alphabet for c in piece)


def train(texts: list[str]) -> ChainModel:
    """Fit the classifier to records, most of which are sound; words are counted in them too (see :func:`counted`).

    A character is familiar if it holds 1 in 5,000 of the non-ASCII places outside pieces that any multi-byte
    chain would explain. Pieces of familiar characters only are the sound class; garbled by each chain they are
    the other classes. Without such pieces every text counts as sound unless a chain decodes strictly.
    """
    pieces = Counter(p for t in texts for p in _PIECE.findall(t))
    whole = {p: n for p, n in pieces.items() if LOST not in p and not _CONTROL.search(p) and all(invert(p, c) is None for c in MULTI)}
    count: Counter = Counter()
    for p, n in whole.items():
        count.update({c: n for c in p if ord(c) > 127})
    least = max(2, sum(count.values()) // 5_000)
    alphabet = {c for c, n in count.items() if n >= least}
    sound = {p: n for p, n in whole.items() if all(ord(c) < 128 or c in alphabet for c in p)}
    counts = np.full((len(CLASSES), BUCKETS), 0.05)
    for p, n in sound.items():
        for k, g in enumerate([p, *(garble(p, chain) for chain in CHAINS)]):
            if k == 0 or (g is not None and g != p):
                counts[k] += np.bincount(_features(g), minlength=BUCKETS) * np.sqrt(n)
    words = WordCounts()
    for p, n in sound.items():
        words.add(_word(p), n)
    weights = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
    return ChainModel(weights, frozenset(alphabet), words)


def fit(rows: DataFrame, ident: str, columns: list[str], arrays: list[str], most: int = TRAINING_ROWS) -> ChainModel:
    """Train on a bounded sample: the ``most`` records with the smallest hash of ``ident``."""
    parts = [F.col(c) for c in columns] + [F.array_join(F.filter(a, lambda x: x.isNotNull()), "\n") for a in arrays]
    text = F.concat_ws("\n", *parts)
    # a threshold on the hash first: else every task would send its own ``most`` candidates
    slots = 1_000_000
    open_ = min(slots, 4 * most * slots // max(1, rows.count()) + 1)
    some = rows.select(text.alias("t"), F.xxhash64(ident).alias("h")).where(F.pmod("h", F.lit(slots)) < open_).where(F.col("t").rlike("[^\\x00-\\x7F]"))
    return train([r.t for r in some.orderBy("h", "t").limit(most).collect()])


def counted(model: ChainModel, rows: DataFrame, columns: list[str], arrays: list[str]) -> ChainModel:
    """The model with the words of all rows: one pass that adds up the words of sound pieces in tables of fixed size."""
    shared = rows.sparkSession.sparkContext.broadcast(ChainModel(np.zeros((0, 0)), model.alphabet, WordCounts(np.zeros(0))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = WordCounts(), {}
        for batch in batches:
            pieces: Counter = Counter()
            for column in batch.columns:
                for value in column.to_pylist():
                    for x in value if isinstance(value, list) else (value,):
                        if x and not x.isascii():
                            pieces.update(_PIECE.findall(x))
            for p, n in pieces.items():
                if p not in known:
                    if len(known) > 200_000:
                        known.clear()
                    known[p] = _word(p) if shared.value.sound(p) else None
                if known[p] is not None:
                    words.add(known[p], n)
        at = np.flatnonzero(words.counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(words.counts[at])], names=["place", "n"])

    total = np.zeros(2 * BUCKETS_OF_WORDS, dtype=np.int64)
    for r in _doubtful(rows, columns, arrays).mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        total[r.place] = r.n
    return replace(model, words=WordCounts(total.astype(np.int32)))


def _doubtful(rows: DataFrame, columns: list[str], arrays: list[str], *more: Column) -> DataFrame:
    """The rows and fields that hold another character than ASCII ones; other fields are null."""
    other = "[^\\x00-\\x7F]"
    some = [F.coalesce(F.col(c).rlike(other), F.lit(False)) for c in columns] + [F.coalesce(F.exists(a, lambda x: x.rlike(other)), F.lit(False)) for a in arrays]
    return spread(rows.where(reduce(lambda a, b: a | b, some)).select(*more, *(F.when(s, F.col(c)).alias(c) for s, c in zip(some, [*columns, *arrays]))))


def _scan(shared, columns: list[str], arrays: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}

        def fix(m: re.Match) -> str:
            piece = m[0]
            if (got := known.get(piece)) is None:
                if len(known) > 200_000:
                    known.clear()
                got = known[piece] = model.restore(piece)
            if got[0]:
                chains.append(got[0])
            return got[1]

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            out: list[tuple] = []
            for ident, *values in zip(*cols):
                for name, value in zip([*columns, *arrays], values):
                    if value is None:
                        continue
                    lines = value if isinstance(value, list) else [value]
                    chains: list[str] = []
                    fixed = [x if x is None or x.isascii() else _PIECE.sub(fix, x) for x in lines]
                    if chains:
                        lost = any(c == "lost" for c in chains)
                        out.append((ident, name, max(sorted(set(chains)), key=chains.count), not lost, fixed))
            if out:
                a, b, c, d, e = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b), pa.array(c), pa.array(d), pa.array(e, pa.list_(pa.string()))], names=["row_ix", "field", "chain", "restored", "lines"])

    return run


def garbled(rows: DataFrame, ident: str, columns: list[str], arrays: list[str], model: ChainModel | None = None) -> DataFrame:
    """``row_ix, field, chain, restored, lines``: one row for each garbled field of each row.

    ``columns`` are string fields, ``arrays`` fields of lines. ``lines`` is the field restored as far as possible
    (one element for a string), ``chain`` the chain of most pieces, ``restored`` false where a character is lost.
    Null fields, null lines and empty texts give nothing; a repeated row gives its rows each time; texts are read
    whole. Two passes without a shuffle of texts, the first to count words; rows without any non-ASCII character don't
    reach Python.
    """
    model = model or counted(fit(rows, ident, columns, arrays), rows, columns, arrays)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    return _doubtful(rows, columns, arrays, F.col(ident).cast("long").alias(ident)).mapInArrow(_scan(shared, columns, arrays), "row_ix long, field string, chain string, restored boolean, lines array<string>")
